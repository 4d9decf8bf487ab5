"""Queries of splits, report counts and checks of single texts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clusters, reports, stats, wording
from ..session import read
from .registry import query

# ---- splits and folds

RANK_SQL = "row_number() OVER ({by} ORDER BY md5({key}::VARCHAR || '{seed}'), {key}) - 1"


@query(f"SELECT o_orderkey, {RANK_SQL.format(by='', key='o_orderkey', seed='42')} AS rank FROM orders")
def shuffled_rank(spark: SparkSession, folder: str) -> DataFrame:
    return reports.hash_rank(read(spark, folder, "orders").select("o_orderkey"), "o_orderkey", seed="42")


SPLIT_SQL = f"""SELECT doc_id, lang, source, n_chars, rank, CASE WHEN rank % 3 = 0 THEN 'test' ELSE 'calibration' END AS split
FROM (SELECT *, {RANK_SQL.format(by="PARTITION BY lang", key="doc_id", seed="7")} AS rank FROM documents)"""


@query(f"SELECT doc_id, lang, rank, split FROM ({SPLIT_SQL})")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return reports.stratified_split(read(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "lang", "7")


FOLD_SQL = f"""SELECT d.*, fold FROM documents d JOIN
(SELECT source AS s, (({RANK_SQL.format(by="", key="source", seed="")}) % 5)::INT AS fold FROM (SELECT DISTINCT source FROM documents)) ON source IS NOT DISTINCT FROM s"""


@query(f"SELECT doc_id, fold FROM ({FOLD_SQL})")
def group_folds(spark: SparkSession, folder: str) -> DataFrame:
    return reports.group_folds(read(spark, folder, "documents").select("doc_id", "source"), "source").select("doc_id", "fold")


@query(f"""
WITH f AS ({FOLD_SQL}), g AS (SELECT DISTINCT fold, source FROM f),
t AS (SELECT a.fold, list_sort(list(DISTINCT b.source)) AS training FROM g a JOIN g b ON a.fold <> b.fold GROUP BY a.fold)
SELECT fold, count(*) AS n, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.9), 6) AS p90,
  array_to_string(list_sort(list(DISTINCT source)), ' ') AS held_out, array_to_string(any_value(training), ' ') AS training
FROM f JOIN t USING (fold) GROUP BY fold""")
def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    docs = reports.group_folds(read(spark, folder, "documents").select("source", "n_chars"), "source")
    rows = reports.fold_metrics(docs, "fold", "source", "n_chars")
    return rows.withColumn("held_out", F.array_join("held_out", " ")).withColumn("training", F.array_join("training", " "))


# ---- counts of reports

SHARES_SQL = "SELECT c_custkey, c_mktsegment, (c_custkey * 37 % 1000) / 10.0 AS feature, (c_custkey * 91 % 1000) / 10.0 AS language FROM customer"


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, folder, "customer").select("c_custkey", "c_mktsegment", (key * 37 % 1000 / 10).alias("feature"), (key * 91 % 1000 / 10).alias("language"))


MIXED_SQL = f"""SELECT c_custkey, c_mktsegment, round(0.6 * feature + 0.4 * language, 6) AS overall,
  CASE WHEN least(feature, language) < 5 THEN 'alarm' WHEN 0.6 * feature + 0.4 * language < 20 THEN 'weak' ELSE 'in range' END AS band, abs(feature - language) > 20 AS unstable
FROM ({SHARES_SQL})"""


@query(MIXED_SQL)
def mixed_bands(spark: SparkSession, folder: str) -> DataFrame:
    overall, band, unstable = reports.mixed_band(F.col("feature"), F.col("language"))
    return _shares(spark, folder).select("c_custkey", "c_mktsegment", F.round(overall, 6).alias("overall"), band.alias("band"), unstable.alias("unstable"))


@query(f"""
SELECT coalesce(c_mktsegment, 'all') AS split, count(*) AS n, count(*) FILTER (band = 'in range') AS in_range, count(*) FILTER (band = 'weak') AS weak, count(*) FILTER (band = 'alarm') AS alarm
FROM ({MIXED_SQL}) GROUP BY GROUPING SETS ((c_mktsegment), ())""")
def band_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.band_counts(mixed_bands(spark, folder), "band", "c_mktsegment")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT source, lang, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def dominant_language(spark: SparkSession, folder: str) -> DataFrame:
    return reports.dominant(read(spark, folder, "documents"), "source", "lang")


@query("SELECT DISTINCT name, length(name) AS length FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_name FROM part) WHERE length(name) > 0")
def name_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return reports.lexicon(*(read(spark, folder, t).select(c) for t, c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name"))))


@query("SELECT c_custkey, score FROM (SELECT c_custkey, nullif(greatest(c_acctbal, 0), 0) AS score FROM customer) ORDER BY score ASC NULLS LAST, c_custkey LIMIT 5")
def worst_five(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "customer").select("c_custkey", F.nullif(F.greatest("c_acctbal", F.lit(0.0)), F.lit(0.0)).alias("score"))
    return reports.worst(rows, "score", "c_custkey")


@query("SELECT p_brand, p_name, length(p_name) AS length FROM part WHERE p_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) = 1")
def longest_names(spark: SparkSession, folder: str) -> DataFrame:
    return reports.longest(read(spark, folder, "part"), "p_brand", "p_name")


@query("""
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS z FROM x GROUP BY ALL)
SELECT label, i, round(z, 6) AS z, row_number() OVER (PARTITION BY label ORDER BY round(abs(z), 6) DESC, i) AS rank FROM m
QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(abs(z), 6) DESC, i) <= 6""")
def top_signals(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_signals(stats.centroids(read(spark, folder, "embeddings"), "embedding", "label"), "label", "centroid")


@query("""
WITH o AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1),
a AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM o), b AS (SELECT conv_id - 1 AS conv_id, turn, coalesce(text, '') AS t FROM o)
SELECT conv_id, count(*) FILTER (a.t = b.t) AS unchanged, count(*) FILTER (a.t <> b.t) AS needs_review, count(*) FILTER (a.t IS NULL) AS new, count(*) FILTER (b.t IS NULL) AS removed
FROM a FULL JOIN b USING (conv_id, turn) GROUP BY conv_id""")
def change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation taken as the version before the next one."""
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = read(spark, folder, "conversations").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return reports.change_counts(turns, turns.withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], ["turn"], "text")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  last_value(m IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(m IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def returned_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))
    return reports.marked_neighbours(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], returned).select("l_orderkey", "l_linenumber", "l_partkey", "before", "after")


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS names, min(p_type) AS \"primary\" FROM part GROUP BY p_brand")
def brand_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return reports.aliases(read(spark, folder, "part"), "p_brand", "p_type").withColumn("names", F.array_join("names", "|"))


@query("SELECT p_partkey FROM part ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity >= 45) ON p_partkey = l_partkey")
def parts_without_bulk(spark: SparkSession, folder: str) -> DataFrame:
    bulk = read(spark, folder, "lineitem").filter("l_quantity >= 45")
    return reports.orphans(read(spark, folder, "part"), "p_partkey", bulk, "l_partkey").select("p_partkey")


@query("""
SELECT n_nationkey, n_regionkey, route, CASE WHEN route IS NULL THEN 'no route' END AS problem
FROM nation LEFT JOIN (SELECT r_regionkey, lower(r_name) AS route FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def nation_routes(spark: SparkSession, folder: str) -> DataFrame:
    routes = read(spark, folder, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("route"))
    return reports.routed(read(spark, folder, "nation").select("n_nationkey", "n_regionkey"), routes, "n_regionkey", "route")


RATING_SQL = """
r AS (SELECT l_orderkey AS k, floor(l_quantity / 26)::INT AS d1, floor(l_discount * 12)::INT AS d2, floor(l_tax * 15)::INT AS d3 FROM lineitem),
g AS (SELECT k, count(*) AS rounds, 5.0 * (median(d1) + median(d2) + median(d3)) AS total, 5.0 * (max(d1 + d2 + d3) - min(d1 + d2 + d3)) AS total_range,
  greatest(max(d1) - min(d1), max(d2) - min(d2), max(d3) - min(d3)) AS widest FROM r GROUP BY k),
q AS (SELECT k AS l_orderkey, rounds, CASE WHEN rounds = 3 THEN total END AS total, CASE WHEN rounds = 3 THEN total_range END AS total_range,
  CASE WHEN rounds <> 3 THEN 'incomplete' WHEN total_range <= 10 AND widest <= 1 THEN 'stable' ELSE 'unstable' END AS status FROM g)"""


@query(f"WITH {RATING_SQL} SELECT * FROM q")
def item_report(spark: SparkSession, folder: str) -> DataFrame:
    """All lines as rounds that rate their order: quantity, discount and tax are the dimensions."""
    scores = [F.floor(F.col("l_quantity") / 26), F.floor(F.col("l_discount") * 12), F.floor(F.col("l_tax") * 15)]
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_discount", "l_tax")
    lines = reports.dealt(read(spark, folder, "lineitem"), "l_orderkey").withColumn("round", F.row_number().over(w))
    rated = lines.select("l_orderkey", "round", F.posexplode(F.array(*(s.cast("int") for s in scores))).alias("dimension", "score"))
    return reports.item_report(rated, "l_orderkey")


@query(f"""WITH {RATING_SQL},
c AS (SELECT o_custkey, count(*) AS items, count(*) FILTER (status <> 'incomplete') AS completed, count(*) FILTER (status = 'stable') AS stable FROM q JOIN orders ON l_orderkey = o_orderkey WHERE total IS NOT NULL GROUP BY o_custkey)
SELECT *, CASE WHEN items <> 2 OR completed <> 2 THEN 'incomplete' WHEN stable >= 2 THEN 'passed' ELSE 'failed' END AS status FROM c""")
def calibration_status(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as packages of two completed orders, both of which must be stable."""
    report = item_report(spark, folder).filter("total IS NOT NULL").join(read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return reports.calibration_status(report, "o_custkey", 2, 2)


@query("""
WITH v AS (SELECT l_orderkey, count(*) AS rounds, list(nullif(l_returnflag, 'N') ORDER BY l_returnflag) AS w FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, rounds, CASE WHEN rounds = 2 AND w[1] = w[2] THEN w[1] END AS winner,
  CASE WHEN rounds < 2 THEN 'incomplete' WHEN rounds = 2 AND w[1] = w[2] THEN 'agreed' ELSE 'no agreement' END AS status FROM v""")
def both_orders(spark: SparkSession, folder: str) -> DataFrame:
    votes = read(spark, folder, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("winner"))
    return reports.both_orders(votes, "l_orderkey", "winner")


@query("""
WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderpriority LIKE '1%') AS errors, count(*) FILTER (o_orderstatus = 'P') AS incomplete, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN errors > 0 THEN 1 WHEN incomplete > 0 THEN 2 WHEN pending > 0 THEN 3 ELSE 0 END AS code FROM c""")
def exit_codes(spark: SparkSession, folder: str) -> DataFrame:
    counts = [F.count_if(F.col("o_orderpriority").startswith("1")), F.count_if(F.col("o_orderstatus") == "P"), F.count_if(F.col("o_orderstatus") == "O")]
    return read(spark, folder, "orders").groupBy("o_custkey").agg(reports.exit_code(*counts).alias("code"))


@query()
def cluster_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Two to six clusters of the mean vectors of labels and eighths of their ids; the choice by silhouette."""
    rows = read(spark, folder, "embeddings").withColumn("part", (F.col("label") * 8 + F.col("vec_id") % 8).cast("long"))
    points = clusters.clipped(stats.centroids(rows, "embedding", "part"), "part", "centroid").persist()
    found = clusters.choices(points, "part")
    points.unpersist()
    return found


# ---- single texts


@query("""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS b, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS a FROM conversations),
d AS (SELECT *, list_position(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: substring(a, i, 1) = substring(b, i, 1)), false) - 1 AS p FROM t WHERE a <> b),
h AS (SELECT *, string_split(left(a, p), chr(10)) AS lines FROM d)
SELECT conv_id, turn, role, p AS "offset", len(lines) AS line, length(lines[-1]) + 1 AS "column" FROM h""")
def turn_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Where a turn's text first differs from the text of the turn before."""
    rows = read(spark, folder, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    found = rows.withColumn("d", wording.first_difference(before, F.col("text"))).filter("d IS NOT NULL")
    return found.select("conv_id", "turn", "role", "d.offset", "d.line", "d.column")


SSML_SQL = """CASE turn % 4 WHEN 0 THEN '<speak>' || replace(t, '. ', '. <break time="300ms"/> ') || '</speak>' WHEN 1 THEN '<speak>' || replace(t, 'e', 'a') || '</speak>'
WHEN 2 THEN '<speak>' || replace(t, ' ', '<b/> ') || '</speak>' ELSE t END"""


@query(f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), s AS (SELECT *, {SSML_SQL} AS x FROM c),
i AS (SELECT *, regexp_replace(x[8:-9], '<break time="[0-9]+(\\.[0-9]+)?(ms|s)"\\s*/>', '', 'g') AS y FROM s)
SELECT conv_id, turn, role, CASE WHEN left(x, 7) <> '<speak>' OR right(x, 8) <> '</speak>' OR len(regexp_extract_all(x, '</?speak>')) <> 2 THEN 'root' WHEN y SIMILAR TO '(?s).*[<>].*' THEN 'tags'
  WHEN regexp_replace(y, '[\\s\\pP\\pZ]', '', 'g') <> regexp_replace(t, '[\\s\\pP\\pZ]', '', 'g') THEN 'words' END AS problem FROM i""")
def ssml_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as marked-up speech, with pauses, other words, other marks or no root by their number."""
    t, n = F.coalesce("text", F.lit("")), F.col("turn") % 4

    def root(x):
        return F.concat(F.lit("<speak>"), x, F.lit("</speak>"))

    x = F.when(n == 0, root(F.replace(t, F.lit(". "), F.lit('. <break time="300ms"/> ')))).when(n == 1, root(F.replace(t, F.lit("e"), F.lit("a")))).when(n == 2, root(F.replace(t, F.lit(" "), F.lit("<b/> "))))
    return read(spark, folder, "conversations").select("conv_id", "turn", "role", wording.ssml_problem(F.col("text"), x.otherwise(t)).alias("problem"))


@query(r"""
WITH n AS (SELECT conv_id, turn, role, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n, length(coalesce(text, '')) * (turn + 1) * 0.25 AS seconds FROM conversations)
SELECT conv_id, turn, role, round(least(120, greatest(6, n * 0.8 + 3)), 6) AS most, NOT (seconds > 0 AND seconds <= least(120, greatest(6, n * 0.8 + 3))) AS implausible FROM n""")
def implausible_durations(spark: SparkSession, folder: str) -> DataFrame:
    seconds, most = F.length(F.coalesce("text", F.lit(""))) * (F.col("turn") + 1) * 0.25, wording.plausible_seconds(F.col("text"))
    return read(spark, folder, "conversations").select("conv_id", "turn", "role", F.round(most, 6).alias("most"), (~((seconds > 0) & (seconds <= most))).alias("implausible"))


@query(r"""
WITH p AS (SELECT n_nationkey, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, concat_ws(',', CASE WHEN length(a) <> 6 OR length(b) <> 6 THEN 'length' END, CASE WHEN length(a) <> length(b) THEN 'unequal' END,
  CASE WHEN NOT (regexp_full_match(a, '\p{L}+') AND regexp_full_match(b, '\p{L}+')) THEN 'characters' END) AS issues FROM p""")
def format_issues(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "nation").join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", F.array_join(wording.format_issues(F.col("n_name"), F.col("r_name"), 6, r"\p{L}"), ",").alias("issues"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), ',[ \t]*([^\n]*)', 1) AS x FROM documents),
u AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS ordinal, regexp_replace(unnest(x), '[ \t\r]+$', '') AS name FROM a WHERE len(x) > 0)
SELECT * FROM u WHERE name <> ''""")
def attributions(spark: SparkSession, folder: str) -> DataFrame:
    return wording.attributions(read(spark, folder, "documents"), "doc_id", "text", ",")


@query(r"SELECT item_id, lower(regexp_replace(coalesce(text, ''), '[\s\pP\pS\pZ]', '', 'g')) AS form FROM benchmark")
def transcript_forms(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "benchmark").select("item_id", wording.transcript_form(F.col("text")).alias("form"))


@query(r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(url, ''), '[^\p{L}\p{N}-]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'input') AS slug,
  coalesce(regexp_full_match(path, '[^/\\:\x00]+(/[^/\\:\x00]+)*') AND NOT regexp_matches(path, '(^|/)\.{1,2}(/|$)'), false) AS safe
FROM (SELECT *, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)""")
def page_slugs(spark: SparkSession, folder: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, folder, "pages").select("page_id", wording.slug(F.col("url")).alias("slug"), wording.safe_path(path).alias("safe"))


@query("""
SELECT page_id, sha256(coalesce(list_reduce(list_prepend('', list_transform(string_split(html, '"'), lambda p, i: CASE WHEN i = 1 THEN p WHEN i % 2 = 0 THEN '“' || p ELSE '”' || p END)), lambda a, b: a || b), '')) AS quoted_hash
FROM pages""")
def quoted_pages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", F.sha2(F.coalesce(wording.alternating_quotes(F.col("html")), F.lit("")), 256).alias("quoted_hash"))


#: A small table of variants; a user's own is a parameter of the same form.
VARIANTS = {"ß": "s", "é": "e", "è": "e", "ñ": "n", "ü": "u"}


@query(f"""
SELECT doc_id, sha256(translate(t, '{"".join(VARIANTS)}', '{"".join(VARIANTS.values())}')) AS form_hash, length(regexp_replace(t, '[^{"".join(VARIANTS)}]', '', 'g')) AS changed
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def orthography(spark: SparkSession, folder: str) -> DataFrame:
    form, changed = wording.orthography(F.col("text"), VARIANTS)
    return read(spark, folder, "documents").select("doc_id", F.sha2(form, 256).alias("form_hash"), changed.alias("changed"))


@query(r"""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS raw FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS clean FROM c WHERE regexp_matches(c, '\p{L}'))
SELECT doc_id, min(clean) AS clean, min(raw) AS raw, count(*) AS length FROM k GROUP BY doc_id, raw - clean""")
def raw_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where every letter of a document comes from, once all else is dropped: its runs of letters."""
    runs = wording.kept_ranges(F.col("text"), r"[^\p{L}]+")
    return read(spark, folder, "documents").select("doc_id", F.explode(runs).alias("r")).select("doc_id", *(F.col(f"r.{c}").cast("long").alias(c) for c in ("clean", "raw", "length")))


INSTANT_SQL = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 1 THEN strftime(o_orderdate, '%Y-02-%dT%H:%M:%S.000Z')
WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS t FROM orders"""


@query(f"""SELECT o_orderkey, coalesce(regexp_full_match(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z') AND try_strptime(left(t, 19), '%Y-%m-%dT%H:%M:%S') IS NOT NULL, false) AS valid FROM ({INSTANT_SQL})""")
def iso_instants(spark: SparkSession, folder: str) -> DataFrame:
    n, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(n == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")).when(n == 1, F.date_format(day, "yyyy-'02'-dd'T'HH:mm:ss'.000Z'")).when(n == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    return read(spark, folder, "orders").select("o_orderkey", wording.iso_instant(t).alias("valid"))


@query(r"""
WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, trim(regexp_extract(t, '^([^,\n]{1,60}),', 1)) AS prefix, regexp_replace(regexp_replace(t, '^([^,\n]{1,60}),', ''), '^\s+|\s+$', '', 'g') AS core FROM p)
SELECT doc_id, prefix, sha256(CASE WHEN length(core) > 1 AND left(core, 1) || right(core, 1) IN ('【】', '（）', '[]') THEN trim(core[2:-2]) ELSE core END) AS core_hash FROM c""")
def comment_parts(spark: SparkSession, folder: str) -> DataFrame:
    prefix, core = wording.comment_parts(F.col("text"), ",")
    return read(spark, folder, "documents").select("doc_id", prefix.alias("prefix"), F.sha2(core, 256).alias("core_hash"))


FEATURES = ["sentence.mean", "clause.p90", "structure.dialogue_ratio", "punctuation.;", "function.the", "lexical.mattr", "ngram.2.th", "formula.once"]


@query(f"""
WITH f AS (SELECT p_partkey, {FEATURES!r}[p_size % 8 + 1] AS f, p_retailprice - 1400 AS z FROM part), d AS (SELECT *, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS w, string_split(f, '.') AS s FROM f)
SELECT p_partkey, f AS feature, CASE s[1] WHEN 'sentence' THEN 'sentence rhythm ' || w || ': vary long and short sentences' WHEN 'clause' THEN 'sentence rhythm ' || w || ': vary long and short sentences'
  WHEN 'structure' THEN 'dialogue ' || w || ': weigh narration against speech' WHEN 'lexical' THEN 'vocabulary ' || w || ': look for repetition or strain'
  WHEN 'ngram' THEN 'characters ' || s[3] || ' ' || w || ': check the wording' ELSE s[2] || ' ' || w || ': check how often it is used' END AS suggestion FROM d""")
def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    feature = F.get(F.array(*map(F.lit, FEATURES)), F.col("p_size") % 8)
    return read(spark, folder, "part").select("p_partkey", feature.alias("feature"), wording.suggestion(feature, F.col("p_retailprice") - 1400).alias("suggestion"))
