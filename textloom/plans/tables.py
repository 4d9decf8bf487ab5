"""Queries over embeddings, conversations, benchmark items and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import annotate, clusters, reconcile, review, signal, stats
from ..session import read
from .registry import query

# ---- vectors

#: Queries of a search are a stated set: vectors whose id is divisible by this ask, all vectors answer.
EVERY = 20
VEC_SQL = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"""
WITH e AS {VEC_SQL}, x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e),
m AS (SELECT i, avg(x) AS m FROM x GROUP BY i), c AS (SELECT vec_id, x.i, x - m AS x FROM x JOIN m USING (i))
SELECT a.i::INT AS i, b.i::INT AS j, round(CASE WHEN a.i = b.i THEN sum(a.x * b.x) / greatest(count(*) - 1, 1) + 0.05 ELSE 0.8 * sum(a.x * b.x) / greatest(count(*) - 1, 1) END, 5) + 0 AS cov
FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""")
def covariance_shrunk(spark: SparkSession, folder: str) -> DataFrame:
    return stats.covariance(read(spark, folder, "embeddings"), "embedding").withColumn("cov", F.round("cov", 5) + 0)


@query(f"""
WITH e AS {VEC_SQL}, d AS (
  SELECT a.vec_id, b.vec_id AS ref_id, round(list_distance(a.v, b.v), 9) AS distance FROM e a, e b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, ref_id) AS rank FROM d)
SELECT vec_id, ref_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 3""")
def nearest_refs_top3(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings")
    return stats.nearest_all(e.filter(F.col("vec_id") % EVERY == 0), e, "vec_id", "ref_id", "embedding", 3).withColumn("distance", F.round("distance", 6))


@query(f"""
WITH e AS {VEC_SQL}, d AS (
  SELECT a.vec_id, b.vec_id AS other, round(1 - list_cosine_similarity(a.v, b.v), 9) AS distance FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS rank FROM d)
SELECT vec_id, other, round(1 - distance, 6) AS cosine, rank FROM r WHERE rank <= 5""")
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors of the same label that are most alike in direction."""
    e = read(spark, folder, "embeddings")
    near = stats.nearest_all(e.filter(F.col("vec_id") % EVERY == 0), e, "vec_id", "other", "embedding", 5, within="label", cosine=True)
    return near.select("vec_id", "other", F.round(1 - F.col("distance"), 6).alias("cosine"), "rank")


CENTROID_SQL = f"""
WITH e AS {VEC_SQL}, x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
d AS (SELECT vec_id, e.label AS own, c.label, list_distance(v, c) AS d FROM e, c)
"""


@query(f"""{CENTROID_SQL},
r AS (SELECT vec_id, label, round(d, 9) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), label) AS rank FROM d)
SELECT vec_id, label, round(d, 6) AS distance FROM r WHERE rank = 1""")
def centroid_assign(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings")
    return stats.assign(e.drop("label"), stats.centroids(e, "embedding", "label"), "vec_id", "embedding", "label")


@query(f"""{CENTROID_SQL},
s AS (SELECT vec_id, own AS label, min(d) FILTER (label = own) AS a, min(d) FILTER (label <> own) AS b FROM d GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s GROUP BY label""")
def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    return stats.silhouette(read(spark, folder, "embeddings"), "embedding", "label", "vec_id")


@query()
def kmeans_2(spark: SparkSession, folder: str) -> DataFrame:
    """Two clusters of the labels' mean vectors: split on the driver from their farthest pair while labels are few, else refined in Spark from far points."""
    means = stats.centroids(read(spark, folder, "embeddings"), "embedding", "label")
    rows = means.orderBy("label").take(10_001)
    if len(rows) > 10_000:
        return clusters.clustered(means.withColumnRenamed("centroid", "point"), "label", 2).select("label", "cluster")
    found = stats.two_means([(r["label"], r["centroid"]) for r in rows])
    return spark.createDataFrame(sorted(found.items()), "label int, cluster int")


@query()
def mahalanobis(spark: SparkSession, folder: str) -> DataFrame:
    return stats.mahalanobis(read(spark, folder, "embeddings"), "embedding", "vec_id")


@query()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return stats.bootstrap_interval(read(spark, folder, "labels"), "quality", "doc_id")


# ---- conversations

TURNS = ["conv_id"], ["turn", "role", "text"]


@query("""
WITH h AS (SELECT conv_id, turn, role, text, sha256(coalesce(text, '')) AS text_hash FROM conversations),
k AS (SELECT *, concat_ws(':', role, text_hash) AS own FROM h)
SELECT conv_id, turn, role, text_hash,
  sha256(concat_ws('|', coalesce(lag(own) OVER w, '^'), coalesce(lead(own) OVER w, '$'))) AS context_hash
FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def context_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = reconcile.context_hashes(read(spark, folder, "conversations"), *TURNS, "role", "text")
    return rows.select("conv_id", "turn", "role", "text_hash", "context_hash")


@query("""
SELECT conv_id, turn, role, lag(turn) OVER w AS previous, lead(turn) OVER w AS following
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def prev_next_nav(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.neighbours(read(spark, folder, "conversations"), *TURNS, "turn").select("conv_id", "turn", "role", "previous", "following")


@query("""
SELECT conv_id, turn, role, CASE WHEN lead(role) OVER w IS NULL THEN 1600 WHEN lead(role) OVER w = role THEN 320 ELSE 800 END AS pause
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def turn_pauses(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.pauses(read(spark, folder, "conversations"), *TURNS, "role", same=320, change=800, end=1600).select("conv_id", "turn", "role", "pause")


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN sha256(coalesce(text, '')) WHEN role = 'system' THEN '' END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inherited
FROM conversations""")
def witness_inherit(spark: SparkSession, folder: str) -> DataFrame:
    """What each turn answers: the last user turn before it; a system turn resets."""
    event = F.when(F.col("role") == "user", F.sha2(F.coalesce("text", F.lit("")), 256)).when(F.col("role") == "system", "")
    return annotate.inherit(read(spark, folder, "conversations"), *TURNS, event).select("conv_id", "turn", "role", "inherited")


@query("""
WITH k AS (SELECT DISTINCT conv_id, role, text AS t FROM conversations WHERE text IS NOT NULL),
b AS (SELECT conv_id, role, t, unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) AS g FROM k),
c AS (SELECT conv_id, role, t, g, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT a.conv_id, a.role, a.t AS x, b.t AS y FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.role = b.role AND a.t < b.t),
s AS (SELECT p.conv_id, p.role, x, y, sum(least(a.n, b.n)) AS n FROM p JOIN c a ON a.conv_id = p.conv_id AND a.role = p.role AND a.t = x JOIN c b ON b.conv_id = p.conv_id AND b.role = p.role AND b.t = y AND a.g = b.g GROUP BY ALL),
d AS (SELECT p.conv_id, p.role, max(CASE WHEN length(p.x) + length(p.y) > 2 THEN 2.0 * coalesce(n, 0) / (greatest(length(p.x) - 1, 0) + greatest(length(p.y) - 1, 0)) ELSE 0 END) AS m FROM p LEFT JOIN s USING (conv_id, role, x, y) GROUP BY ALL)
SELECT conv_id, role, count(*) AS variants, round(coalesce(any_value(m), 0), 6) AS most_alike,
  CASE WHEN count(*) = 1 THEN 'single' WHEN any_value(m) >= 0.5 THEN 'variants' ELSE 'mixed' END AS status
FROM k LEFT JOIN d USING (conv_id, role) GROUP BY conv_id, role""")
def locus_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts of all turns of each role in a conversation, collated like witnesses of one place."""
    return annotate.collate_shared(read(spark, folder, "conversations").select("conv_id", "role", F.col("text").alias("t")), ["conv_id", "role"], "t")


# ---- benchmark items as blocks of two versions

NEW, OLD = "item_id % 2 = 0", "item_id % 2 = 1"


def _items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, folder, "benchmark").select("item_id", F.col("text").alias("t"), F.lit("item").alias("kind"))
    return rows.filter(NEW), rows.filter(OLD)


@query()
def edit_ratio_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with all their characters; DuckDB's edit distance counts bytes, so there is no SQL."""
    pairs = reconcile.fuzzy_pairs(*_items(spark, folder), "kind", "item_id", "t", 0.8)
    return pairs.withColumn("ratio", F.round("ratio", 6))


@query()
def fuzzy_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Each even item's closest odd one, by whole texts, where no other comes within a hundredth of it."""
    return reconcile.best_matches(reconcile.fuzzy_pairs(*_items(spark, folder), "kind", "item_id", "t", 0.8), "item_id", 0.01)


# ---- events as a log

KINDS = ["click", "view", "purchase", "signup", "error"]


@query("""
SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_decision(spark: SparkSession, folder: str) -> DataFrame:
    return review.latest(read(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("""
WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type FROM b WHERE before IS NULL OR before IS DISTINCT FROM event_type""")
def dedupe_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user without those that repeat the type of the one before."""
    return review.collapse_repeats(read(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id % 50 AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in KINDS) + " FROM events GROUP BY 1")
def status_counts_zero(spark: SparkSession, folder: str) -> DataFrame:
    return review.status_counts(read(spark, folder, "events").withColumn("bucket", F.col("user_id") % 50), ["bucket"], "event_type", KINDS)


@query("""
SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS approved, bool_and(o_orderstatus = 'F') AS all_approved,
  bool_or(o_orderpriority LIKE '1%') AS any_blocked, bool_and(o_orderstatus = 'F') AND NOT bool_or(o_orderpriority LIKE '1%') AS "open"
FROM orders GROUP BY o_custkey""")
def gates(spark: SparkSession, folder: str) -> DataFrame:
    return review.gates(read(spark, folder, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderpriority").like("1%"))


@query("""
WITH l AS (SELECT l_orderkey AS k, count(*) % 7 AS was, min(l_linestatus) AS status FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1),
o AS (SELECT o_orderkey AS k, (SELECT 4) AS now FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(o.k, l.k) AS target_id, CASE WHEN l.k IS NULL THEN 'inserted' WHEN o.k IS NULL THEN 'removed' WHEN now IS DISTINCT FROM was THEN 'superseded' ELSE status END AS outcome
FROM o FULL JOIN l ON o.k = l.k""")
def approval_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as planned targets, their lines as what was approved."""
    targets = read(spark, folder, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("target_id"), F.lit(4).cast("long").alias("binding"))
    lines = read(spark, folder, "lineitem").filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("target_id"))
    return review.reconcile_approvals(targets, lines.agg((F.count("*") % 7).alias("binding"), F.min("l_linestatus").alias("status")), "target_id", "binding", "status")


@query("""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events))
SELECT event_id, user_id, event_type, n = 1 AS active FROM r""")
def upsert_active(spark: SparkSession, folder: str) -> DataFrame:
    return review.upsert_active(read(spark, folder, "events"), ["user_id", "event_type"], ["ts"], "event_id").select("event_id", "user_id", "event_type", "active")


@query("SELECT k AS o_custkey FROM range((SELECT min(o_custkey) FROM orders), (SELECT max(o_custkey) + 1 FROM orders)) t(k) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Customers between the first and the last that have no order."""
    orders = read(spark, folder, "orders")
    first, last = orders.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    return review.missing(orders, "o_custkey", first or 0, -1 if last is None else last)


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def jsonprops_extract(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"))


@query("""
SELECT l_orderkey, count(l_quantity) AS rounds, round(median(l_quantity), 6) AS median, round(max(l_quantity) - min(l_quantity), 6) AS range,
  CASE WHEN count(l_quantity) <> 3 THEN 'incomplete' WHEN max(l_quantity) - min(l_quantity) <= 10 THEN 'stable' ELSE 'unstable' END AS status
FROM lineitem GROUP BY l_orderkey""")
def median_of_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return review.rounds(read(spark, folder, "lineitem"), ["l_orderkey"], "l_quantity", 3, 10.0)


@query("""
WITH n AS (SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier)
SELECT a.s_nationkey, a.s_suppkey AS better, b.s_suppkey AS worse, round(a.s_acctbal - b.s_acctbal, 6) AS gap FROM n a JOIN n b USING (s_nationkey) WHERE a.s_acctbal - b.s_acctbal >= 5000""")
def pair_gap_gate(spark: SparkSession, folder: str) -> DataFrame:
    return review.gated_pairs(read(spark, folder, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 5000.0)


# ---- signals

QUIET = 40.0


@query(f"""
WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS frames FROM events),
i AS (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS island FROM p WHERE value < {QUIET}),
r AS (SELECT user_id, min(place) AS "first", max(place) AS "last", count(*) AS n, any_value(frames) AS frames FROM i GROUP BY user_id, island)
SELECT user_id, "first", "last", n, CASE WHEN "first" = 1 THEN 'leading' WHEN "last" = frames THEN 'trailing' ELSE 'internal' END AS place FROM r WHERE n >= 2""")
def quiet_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of two or more values below QUIET in each user's events."""
    return signal.quiet_runs(read(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("value") < QUIET, 2)


@query(f"""
WITH g AS (SELECT event_type, count(value) AS n, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, avg(CASE WHEN abs(value) > {QUIET} THEN 1.0 ELSE 0 END) AS active,
  list_sort(list(abs(value)) FILTER (abs(value) > {QUIET})) AS a FROM events GROUP BY event_type)
SELECT event_type, n, round(rms, 6) AS rms, round(peak, 6) AS peak, round(active, 6) AS active, round(a[len(a) // 2 + 1], 6) AS median_active FROM g""")
def level_stats(spark: SparkSession, folder: str) -> DataFrame:
    return signal.levels(read(spark, folder, "events"), "event_type", "value", QUIET)


@query("""
SELECT event_id, user_id, round(coalesce(sum(value + 0.5) OVER w, 0), 4) AS "start", round(coalesce(sum(value + 0.5) OVER w, 0) + value, 4) AS "end"
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_timeline(spark: SparkSession, folder: str) -> DataFrame:
    rows = signal.timeline(read(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "value", 0.5)
    return rows.select("event_id", "user_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("""
WITH n AS (SELECT ((p_size - 1) // 10)::INT AS bin, count(*) AS n FROM part GROUP BY 1)
SELECT k::INT AS bin, coalesce(n, 0) AS n FROM range(0, 8) t(k) LEFT JOIN n ON n.bin = k""")
def decade_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.histogram(read(spark, folder, "part"), F.col("p_size"), 10, 0, 7)


# ---- relational summaries

@query("""
SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY r_name, n_name""")
def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Lines are summed by order before the joins, so the large shuffle carries one row an order."""
    lines = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    orders = read(spark, folder, "orders").filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).select("o_orderkey", "o_custkey")
    customers = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    places = read(spark, folder, "nation").join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = lines.join(orders, "o_orderkey").join(customers, "o_custkey").join(places, "n_nationkey")
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("paid"), 2).alias("revenue"))


@query("""
WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, value FROM events)
SELECT user_id, event_id, value, rank FROM r WHERE rank <= 3""")
def top_values_by_user(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return read(spark, folder, "events").select("user_id", "event_id", "value", F.row_number().over(w).alias("rank")).filter("rank <= 3")
