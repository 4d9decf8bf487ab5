"""Queries of review packages and spoken-text planning, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packages, reconcile, review, speech
from ..session import read
from .registry import query

HEX = packages.DIGITS
TERMS = ["license", "copyright", "password", "e-mail"]


def text_sql(*texts: str) -> str:
    """SHA-256 of texts with their lengths."""
    return "sha256(" + " || ".join(f"length(coalesce({t}, ''))::VARCHAR || ':' || coalesce({t}, '')" for t in texts) + ")"


def package_sql(rows: str, by: str) -> str:
    """(by, n, package_hash) of rows (by, h)."""
    lanes = ", ".join(f"sum(('0x' || substring(h, {1 + i * HEX}, {HEX}))::BIGINT)::VARCHAR" for i in range(packages.LANES))
    return f"SELECT {by}, count(*) AS n, sha256(concat_ws(':', count(*)::VARCHAR, {lanes})) AS package_hash FROM {rows} GROUP BY {by}"


# ---- packages


@query(f"SELECT 't-' || left(sha256(concat_ws('|', item_id::VARCHAR, {text_sql('text')})), 16) AS blind_key, {text_sql('text')} AS text_hash, text FROM benchmark")
def blind_items(spark: SparkSession, folder: str) -> DataFrame:
    return packages.blind(read(spark, folder, "benchmark"), "item_id", ["text"])


ROW_SQL = f"(SELECT *, {text_sql('doc_id::VARCHAR', 'text')} AS h FROM documents)"


@query(package_sql(ROW_SQL, "source"))
def package_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return packages.package_hashes(read(spark, folder, "documents"), ["source"], packages.text_hash(F.col("doc_id").cast("string"), F.col("text")))


@query("SELECT DISTINCT source, 'hash differs' AS problem FROM documents WHERE lang = 'de'")
def changed_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of a source whose German texts have a mark more than when their hash was taken."""
    docs = read(spark, folder, "documents")
    row = packages.text_hash(F.col("doc_id").cast("string"), F.col("text"))
    now = docs.withColumn("text", F.when(F.col("lang") == "de", F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")))
    return packages.changed_packages(packages.package_hashes(docs, ["source"], row), now, "source", row)


@query(f"""
WITH c AS (SELECT doc_id, text, {text_sql('text')} AS text_hash FROM documents),
r AS (SELECT quality, doc_id, CASE WHEN toxic = 1 THEN 'old' ELSE text_hash END AS rated_hash, CASE WHEN lang = 'fr' THEN '#' ELSE '' END || substring(coalesce(text, ''), 5, 12) AS quote
  FROM labels LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
n AS (SELECT *, count(*) OVER (PARTITION BY quality, doc_id) AS n FROM r)
SELECT quality, doc_id, CASE WHEN n > 1 THEN 'rated twice' WHEN text_hash IS NULL THEN 'unknown' WHEN rated_hash IS DISTINCT FROM text_hash THEN 'text differs'
  WHEN NOT contains(coalesce(text, ''), coalesce(quote, '')) THEN 'quote not in text' END AS problem FROM n LEFT JOIN c USING (doc_id)""")
def rating_problems(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    known = docs.select("doc_id", "text", packages.text_hash(F.col("text")).alias("text_hash"))
    quote = F.concat(F.when(F.col("lang") == "fr", "#").otherwise(""), F.substring(F.coalesce("text", F.lit("")), 5, 12))
    rated = docs.select("doc_id", packages.text_hash(F.col("text")).alias("text_hash"), quote.alias("quote"))
    ratings = read(spark, folder, "labels").join(rated, "doc_id", "left").withColumn("text_hash", F.when(F.col("toxic") == 1, "old").otherwise(F.col("text_hash")))
    return packages.rating_problems(ratings, known, "quality", "doc_id")


@query("""
WITH m AS (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, turn // 2) AS r, count(*) OVER (PARTITION BY conv_id, length(text) % 5) AS c FROM conversations),
l AS (SELECT conv_id, min('=' || role) <> max('=' || role) AS mixed FROM m WHERE r = 1 AND c = 1 GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN r > 1 OR c > 1 THEN 'round or context repeated' WHEN mixed THEN 'snapshots differ' END AS problem FROM m LEFT JOIN l USING (conv_id)""")
def independent_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as reviews of their conversation: two turns a round, a context by length, a snapshot by role."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("round"), (F.length("text") % 5).alias("context"), F.col("role").alias("snapshot"))
    return packages.independent_reviews(turns, "conv_id", "turn")


@query(f"SELECT o_orderkey, {text_sql('o_orderstatus', 'o_orderpriority')} AS family, 'initial' AS attempt FROM orders")
def run_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return packages.attempts(read(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"], F.lit(False)).select("o_orderkey", "family", "attempt")


# ---- speech

PACES, TONES = ["slow", "medium", "fast", "urgent", "broken"], ["low", "medium", "high"]


@query(f"""
WITH t AS (SELECT *, (user_id % 5)::INT AS p, (event_id % 3)::INT AS q, (floor(value)::BIGINT % 60)::INT AS v FROM events),
s AS (SELECT event_id, v - 20 + [-10, 0, 8, 15, -12][p + 1] + CASE event_type WHEN 'view' THEN -5 WHEN 'click' THEN -11 ELSE 0 END AS r, v - 30 + [-3, 0, 3][q + 1] AS h,
  [-10, 0, 8][q + 1] + CASE event_type WHEN 'view' THEN -20 ELSE 0 END AS l FROM t)
SELECT event_id, format('{{:+d}}%', least(greatest(r, -50), 100)) AS rate, format('{{:+d}}Hz', least(greatest(h, -20), 20)) AS pitch, format('{{:+d}}%', least(greatest(l, -50), 50)) AS volume FROM s""")
def prosody_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as voices: their value gives rate and pitch, ids give tags, the type gives modifiers."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    v = F.floor("value").cast("long") % 60
    rows = read(spark, folder, "events").select(
        "event_id", speech.signed_text(v - 20, "%").alias("rate"), speech.signed_text(v - 30, "Hz").alias("pitch"), F.lit("loud").alias("volume"),
        pick(PACES, F.col("user_id") % 5).alias("pace"), pick(TONES, F.col("event_id") % 3).alias("tone"), pick(["light", "medium", "heavy"], F.col("event_id") % 3).alias("energy"),
        F.when(F.col("event_type") == "view", F.array(F.lit("whispering"))).when(F.col("event_type") == "click", F.array(F.lit("sobbing"), F.lit("crying"), F.lit("choked"))).alias("modifiers"),
    )
    return speech.prosody(rows, F.col("modifiers")).select("event_id", "rate", "pitch", "volume")


@query("""
SELECT event_id, concat_ws('; ', CASE event_type WHEN 'view' THEN 'calm' WHEN 'error' THEN 'angry' END, CASE WHEN value > 100 THEN 'strong' END, CASE WHEN event_type = 'error' THEN 'no shouting' END, 'speak clearly') AS instruction FROM events""")
def instruction_texts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.array("event_type")
    parts = [(kind, {"view": "calm", "error": "angry"}), (F.array(F.when(F.col("value") > 100, "high")), {"high": "strong"}), (kind, {"error": "no shouting"})]
    return read(spark, folder, "events").select("event_id", speech.instruction(parts, "speak clearly", "; ").alias("instruction"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[！？!?]\z') THEN 130 WHEN regexp_matches(coalesce(text, ''), '[；;]\z') THEN 120 WHEN regexp_matches(coalesce(text, ''), '。\z') THEN 165 ELSE 95 END AS pause FROM documents")
def ending_pauses(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", speech.pause_after(F.col("text")).alias("pause"))


@query("SELECT doc_id, replace(replace(text, 'th', 'z'), 'zen', 'T') AS text FROM documents")
def substituted_texts(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*(F.struct(F.lit(a).alias("text"), F.lit(b).alias("replacement")) for a, b in (("th", "z"), ("zen", "T"))))
    return read(spark, folder, "documents").select("doc_id", speech.substitute(F.col("text"), words).alias("text"))


@query()
def speech_units(spark: SparkSession, folder: str) -> DataFrame:
    return speech.speech_units(read(spark, folder, "documents"), "doc_id", F.col("text"), 120, ".!?;。！？；", ",:，、：")


@query()
def render_targets(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select(F.struct("conv_id", "turn", "role").alias("place"), "text")
    units = speech.speech_units(turns, "place", F.col("text"), 120, ".!?;", ",:").select("place.*", "unit_index", "unit")
    return speech.render_targets(units, ["conv_id", "turn", "unit_index"], F.col("role"))


SCENE_SQL = """
WITH a AS (SELECT conv_id, min(left(text, 10)) AS s, max(right(text, 10)) AS e FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, count(*) FILTER (starts_with(text, s)) AS ns, count(*) FILTER (ends_with(text, e)) AS ne, min(turn) FILTER (starts_with(text, s)) AS a, min(turn) FILTER (ends_with(text, e)) AS b
  FROM conversations JOIN a USING (conv_id) GROUP BY conv_id),
p AS (SELECT *, CASE WHEN ns <> 1 THEN 'start not unique' WHEN ne <> 1 THEN 'end not unique' WHEN b < a THEN 'end before start' END AS problem FROM f)
"""


def _scene(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    turns = read(spark, folder, "conversations")
    anchors = turns.groupBy("conv_id").agg(F.min(F.left("text", F.lit(10))).alias("start_anchor"), F.max(F.right("text", F.lit(10))).alias("end_anchor"))
    return turns, speech.scene_bounds(turns, anchors, "conv_id", "turn", "text")


@query(f"{SCENE_SQL} SELECT conv_id, CASE WHEN problem IS NULL THEN a END AS first, CASE WHEN problem IS NULL THEN b END AS last, problem FROM p")
def scene_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return _scene(spark, folder)[1]


@query(f"{SCENE_SQL} SELECT conv_id, turn, role FROM conversations JOIN p USING (conv_id) WHERE problem IS NULL AND turn BETWEEN a AND b")
def scene_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns, bounds = _scene(spark, folder)
    return speech.scene_rows(turns, bounds, "conv_id", "turn").select("conv_id", "turn", "role")


@query()
def scene_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations' turns against a version of them in which every fifth one was edited and system turns are missing."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn", "role").alias("id"), F.col("role").alias("kind"), "text")
    old = turns.filter("kind <> 'system'").withColumn("text", F.when(F.col("turn") % 5 == 4, F.concat(F.lit("Well, "), F.col("text"))).otherwise(F.col("text")))
    return reconcile.align(*(reconcile.context_hashes(t, ["conv_id"], ["turn", "kind", "text"], "kind", "text") for t in (turns, old)), "conv_id", "id")


@query("""
WITH w AS (SELECT s_suppkey * 3 AS o_orderkey, s_suppkey AS wanted_order FROM supplier),
j AS (SELECT w.o_orderkey, wanted_order, o_custkey FROM w LEFT JOIN orders o ON w.o_orderkey = o.o_orderkey)
SELECT j.o_orderkey, j.wanted_order, j.o_custkey, CASE WHEN j.o_custkey IS NULL THEN 'missing' WHEN j.o_custkey <= b.o_custkey THEN 'out of order' END AS problem FROM j LEFT JOIN j b ON j.wanted_order = b.wanted_order + 1""")
def excerpt_order(spark: SparkSession, folder: str) -> DataFrame:
    wanted = read(spark, folder, "supplier").select((F.col("s_suppkey") * 3).alias("o_orderkey"), F.col("s_suppkey").alias("wanted_order"))
    return speech.excerpt(read(spark, folder, "orders"), wanted, "o_orderkey", "o_custkey")


@query("""
SELECT o_orderkey // 4 AS group_id, count(*) AS n, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'unknown target' WHEN bool_or(o_orderkey % 13 = 0) AND count(*) > 1 THEN 'not contiguous'
  WHEN bool_or(o_orderpriority LIKE '1%') THEN 'binding changed' END AS problem FROM orders GROUP BY ALL""")
def group_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in groups of four: some targets are gone, some have moved, some are bound to another state."""
    orders = read(spark, folder, "orders")
    key = F.col("o_orderkey")
    moved = F.when(key % 13 == 0, key + 1_000_000).otherwise(key)
    targets = orders.filter("o_orderstatus <> 'P'").select(key.alias("target_id"), moved.alias("position"), F.col("o_orderstatus").alias("binding"))
    changed = F.when(F.col("o_orderpriority").startswith("1"), "X").otherwise(F.col("o_orderstatus"))
    groups = orders.select(F.floor(key / 4).alias("group_id"), (key % 4).alias("ordinal"), key.alias("target_id"), changed.alias("binding"))
    return speech.group_problems(targets, groups)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'approved' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'cached' ELSE 'new' END AS run_class
FROM orders""")
def run_classes(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    sources = [(name, lines.filter(F.col("l_returnflag") == flag)) for name, flag in (("approved", "R"), ("cached", "A"))]
    return speech.run_classes(read(spark, folder, "orders"), sources, "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority NOT LIKE '1%' AND o_orderstatus <> 'P' AS reusable FROM orders")
def reusable_targets(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders")
    old = orders.filter("o_orderstatus <> 'P'").withColumn("o_orderpriority", F.when(F.col("o_orderpriority").startswith("1"), F.lit(None)).otherwise(F.col("o_orderpriority")))
    return speech.reusable(orders, old, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("SELECT conv_id, NOT bool_or(role = 'system') AS same FROM conversations GROUP BY conv_id")
def same_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a conversation is as it was, where what was lacks the system turns."""
    turns = read(spark, folder, "conversations")
    return speech.same_sequence(turns, turns.filter("role <> 'system'"), "conv_id", ["turn", "role", "text"], ["role", "text"])


@query("""
SELECT o_orderkey, o_totalprice > 1e5 AS rendered, o_totalprice > 1e5 AND o_orderstatus = 'F' AS auto_passed, CASE WHEN o_orderstatus <> 'P' THEN CASE o_orderstatus WHEN 'F' THEN 'passed' ELSE 'review' END END AS status FROM orders""")
def review_sources(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders")
    levels = orders.filter("o_totalprice > 1e5").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"), F.lit(-22.0).alias("rms"))
    heard = orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "passed").otherwise("review").alias("status"))
    return speech.review_sources(orders.select("o_orderkey"), levels, heard, ["o_orderkey"]).select("o_orderkey", "rendered", "auto_passed", "status")


@query("""
WITH x AS (SELECT l_returnflag, l_quantity::INT AS q, l_quantity::INT + l_linenumber - 3 AS h, l_linenumber % 3 AS e FROM lineitem)
SELECT q, h, count(*) AS n, count(*) FILTER (l_returnflag <> 'R' AND (h / q BETWEEN 0.94 AND 1.04 OR abs(q - h) <= 1) AND e <= 1) AS passed FROM x GROUP BY q, h""")
def structure_checks(spark: SparkSession, folder: str) -> DataFrame:
    x = read(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("q"), (F.col("l_quantity").cast("int") + F.col("l_linenumber") - 3).alias("h"), (F.col("l_linenumber") % 3).alias("e"))
    passed = speech.structural_pass(F.col("q"), F.col("h"), F.col("l_returnflag") == "R", F.col("e"))
    return x.groupBy("q", "h").agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"))


@query("SELECT conv_id, turn, role, bool_or(length(text) < 100) OVER (PARTITION BY conv_id) AS fallback FROM conversations")
def group_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    return speech.group_fallback(read(spark, folder, "conversations"), ["conv_id"], F.length("text") < 100).select("conv_id", "turn", "role", "fallback")


@query(f"SELECT doc_id, term FROM documents, (SELECT unnest({TERMS}) AS term) WHERE contains(lower(text), term)")
def term_hits(spark: SparkSession, folder: str) -> DataFrame:
    return speech.term_hits(read(spark, folder, "documents"), "doc_id", "text", TERMS)


@query("SELECT role, count(turn) AS n FROM (SELECT unnest(['user', 'assistant', 'tool']) AS role) LEFT JOIN conversations USING (role) GROUP BY role")
def role_counts(spark: SparkSession, folder: str) -> DataFrame:
    return speech.counts_over(read(spark, folder, "conversations"), "role", ["user", "assistant", "tool"])


@query("SELECT l_orderkey, l_linenumber, k.status, k.price FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P') k ON l_orderkey = o_orderkey")
def carried_over(spark: SparkSession, folder: str) -> DataFrame:
    old = read(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return speech.carry_over(read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), old, "l_orderkey", ["status", "price"])


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 40 THEN 'middle' END AS label, lpad(p_size::VARCHAR, 3, '0') AS padded FROM part")
def range_labels(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return read(spark, folder, "part").select("p_partkey", speech.range_label(size, [("small", 1, 10), ("middle", 11, 40)]).alias("label"), F.lpad(size.cast("string"), 3, "0").alias("padded"))


@query("""
SELECT o_orderkey AS speaker, CASE WHEN o_orderstatus <> 'F' THEN 'not approved' WHEN o_orderpriority IN (SELECT max(o_orderpriority) FROM orders) THEN 'denied' WHEN o_totalprice > 1e5 THEN 'changed' END AS problem FROM orders""")
def verified_voices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as voices whose file is their priority: approved if finished, denied if of the last priority, changed if dear."""
    orders = read(spark, folder, "orders")
    configs = orders.select(F.col("o_orderkey").alias("speaker"), F.col("o_orderkey").alias("approval_id"), F.col("o_orderpriority").alias("file_hash"))
    decisions = orders.select(
        F.col("o_orderkey").alias("approval_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("decision"),
        F.when(F.col("o_totalprice") > 1e5, "other").otherwise(F.col("o_orderpriority")).alias("file_hash"),
    )
    denied = orders.agg(F.max("o_orderpriority").alias("file_hash"))
    return review.verified(configs, decisions, denied).select("speaker", "problem")


@query("SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'available' ELSE 'missing' END AS status FROM part")
def part_availability(spark: SparkSession, folder: str) -> DataFrame:
    offered = read(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return review.availability(read(spark, folder, "part").select("p_partkey"), offered, "p_partkey")


@query("""
SELECT s_suppkey, CASE WHEN n_regionkey = 1 AND s_nationkey > 5 THEN 'moved' ELSE s_name END AS s_name, CASE WHEN n_regionkey = 1 AND s_nationkey <= 5 THEN 'not the expected value' END AS problem
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def overridden_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "supplier").join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    overrides = rows.filter("n_regionkey = 1").select("s_suppkey", F.when(F.col("s_nationkey") > 5, F.col("s_name")).otherwise("else").alias("expected"), F.lit("moved").alias("replacement"))
    return review.overridden(rows.select("s_suppkey", "s_name"), overrides, "s_suppkey", "s_name").select("s_suppkey", "s_name", "problem")


@query()
def repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Turns whose transcript says the third to sixth characters twice."""
    turns = read(spark, folder, "conversations").select(F.concat_ws(":", "conv_id", "turn", "role").alias("id"), "text", F.regexp_replace("text", r"^(..)(....)", "$1$2$2").alias("heard"))
    return reconcile.repeated_spans(turns, "id", "text", "heard")
