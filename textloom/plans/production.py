"""Queries of annotations, coverage by recordings, synthesis requests and review batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import acceptance, annotations, assembly, batches, markup, ngrams, reports, requests, stats
from ..session import read
from .registry import ORACLES, query
from .tables import CENTROID_SQL


def _anchor_sql(before: str) -> str:
    flat = rf"trim(regexp_replace(right({before}, {annotations.KEEP}), '[\s\x0B\x{{feff}}\x{{a0}}\x{{3000}}]+', ' ', 'g'))"
    return rf"right(regexp_replace(regexp_replace({flat}, '(?s)^---.*?---\s*', ''), '[【】]', '', 'g'), {annotations.TAIL})"


@query(f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND text <> '' THEN text END AS body FROM conversations),
b AS (SELECT conv_id, turn, string_agg(body, '') OVER w AS before, max(CASE WHEN body IS NOT NULL THEN turn + 1 END) OVER w AS cursor FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, {_anchor_sql("coalesce(before, '')")} AS anchor, coalesce(cursor, 0)::BIGINT AS cursor FROM b""")
def turn_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn with the end of what the assistant had said before it, and behind which turn that is."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.col("text")).alias("body"), (F.col("turn") + 1).alias("end"))
    return annotations.anchored(turns, "conv_id", "turn", "body", "end").select("conv_id", "turn", "anchor", "cursor")


def _bracketed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which brackets are annotations, below an empty title."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\\[]", "")
    return read(spark, folder, "documents").select("doc_id", F.concat(F.lit("[T]\n"), F.replace(F.replace(plain, F.lit("("), F.lit("[zp]")), F.lit(")"), F.lit("[-]"))).alias("body"))


BRACKETS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\\[]', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, unnest(regexp_extract_all(t, '[()]|[^()]+')) AS token, generate_subscripts(regexp_extract_all(t, '[()]|[^()]+'), 1) AS place FROM d),
s AS (SELECT *, sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS raw, 4 + sum(CASE token WHEN '(' THEN 4 WHEN ')' THEN 3 ELSE length(token) END) OVER w AS upto
  FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
v AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY doc_id ORDER BY place)) AS level FROM s),
b AS (SELECT *, CASE WHEN level = 0 AND token NOT IN ('(', ')') THEN token END AS body FROM v),
a AS (SELECT doc_id, place, token, concat(chr(10), string_agg(body, '') OVER w) AS before, max(CASE WHEN body IS NOT NULL THEN upto END) OVER w AS cursor
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(f"""{BRACKETS_SQL}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place)::INTEGER AS ordinal, coalesce(cursor, 4)::BIGINT AS locus_offset, {_anchor_sql("before")} AS anchor
FROM a WHERE token = '('""")
def bracket_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Every bracket of every document as an annotation: its number, where the text before it ended, and the end of that text."""
    docs = _bracketed(spark, folder)
    found = annotations.annotations(markup.nodes(docs, "doc_id", "body"), "doc_id")
    return annotations.complete(found, annotations.mark_counts(docs, found, "doc_id", "body"), "doc_id").select("doc_id", "ordinal", "locus_offset", "anchor")


@query("""
SELECT doc_id, length(text) - length(replace(text, '(', '')) AS marked, length(text) - length(replace(text, '(', '')) AS extracted
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def annotation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Marks in every document against annotations found."""
    docs = _bracketed(spark, folder)
    return annotations.mark_counts(docs, annotations.annotations(markup.nodes(docs, "doc_id", "body"), "doc_id"), "doc_id", "body")


def _takes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turns as targets, and recordings of an earlier version in groups of three: some of other words, of other turns, gone, or made twice."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "role")
    bound = [F.sha2("text", 256).alias("text_hash"), F.sha2(F.coalesce("role", F.lit("")), 256).alias("annotation_hash")]
    targets = assembly.numbered(turns.select("conv_id", F.col("turn").alias("target"), *bound), ["conv_id"], "target")
    was = turns.withColumn("text", F.when((F.col("conv_id") * 5 + F.col("turn")) % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    moved = F.col("turn") + F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, 1).otherwise(0)
    group = F.floor(F.col("turn") / 3)
    covers = was.filter((F.col("conv_id") + F.col("turn")) % 11 != 0).select("conv_id", group.alias("cover"), (F.col("turn") - 3 * group).alias("ordinal"), moved.alias("target"), *bound)
    again = was.filter((F.col("turn") == 1) & (F.col("conv_id") % 7 == 0)).select("conv_id", F.lit(99).cast("long").alias("cover"), F.lit(0).cast("long").alias("ordinal"), F.col("turn").alias("target"), *bound)
    return targets, covers.unionByName(again)


TAKES_SQL = """
WITH t AS (SELECT conv_id, turn AS target, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, sha256(coalesce(text, '')) AS text_hash, sha256(coalesce(role, '')) AS annotation_hash FROM conversations),
w AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN (conv_id * 5 + turn) % 13 = 0 THEN '!' ELSE '' END AS text, role FROM conversations),
c AS (SELECT conv_id, turn // 3 AS cover, turn % 3 AS ordinal, turn + CASE WHEN (conv_id + turn) % 17 = 0 THEN 1 ELSE 0 END AS target, sha256(text) AS text_hash, sha256(coalesce(role, '')) AS annotation_hash
  FROM w WHERE (conv_id + turn) % 11 <> 0
  UNION ALL SELECT conv_id, 99, 0, turn, sha256(text), sha256(coalesce(role, '')) FROM w WHERE turn = 1 AND conv_id % 7 = 0)
"""


@query(f"""{TAKES_SQL},
m AS (SELECT c.*, t.position, t.text_hash AS th, t.annotation_hash AS ah, count(*) OVER (PARTITION BY c.conv_id, c.target) AS times FROM c LEFT JOIN t USING (conv_id, target)),
n AS (SELECT a.*, b.position AS before, b.cover IS NOT NULL AS follows FROM m a LEFT JOIN m b ON a.conv_id = b.conv_id AND a.cover = b.cover AND a.ordinal = b.ordinal + 1),
r AS (
  SELECT *, 'unknown target' AS problem FROM n WHERE position IS NULL
  UNION ALL SELECT *, 'text hash differs' FROM n WHERE position IS NOT NULL AND text_hash <> th
  UNION ALL SELECT *, 'annotation hash differs' FROM n WHERE position IS NOT NULL AND annotation_hash <> ah
  UNION ALL SELECT *, 'not next' FROM n WHERE position <> before + 1
  UNION ALL SELECT *, 'covered twice' FROM n WHERE position IS NOT NULL AND times > 1
  UNION ALL SELECT *, 'hole' FROM n WHERE ordinal > 0 AND NOT follows)
SELECT conv_id, cover, ordinal, target, problem FROM r""")
def cover_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What keeps recordings of an earlier version from standing for the turns they were made for."""
    return assembly.cover_problems(*_takes(spark, folder), "conv_id")


WITHIN = 100
TILING_SQL = f"""
WITH i AS (SELECT l_orderkey AS order_id, date_diff('day', o_orderdate, l_shipdate) AS b, date_diff('day', o_orderdate, l_shipdate) + floor(l_quantity)::INTEGER AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT order_id, b AS place FROM i UNION SELECT order_id, e FROM i UNION SELECT o_orderkey, unnest([0, {WITHIN}]) FROM orders),
s AS (SELECT order_id, place, lead(place) OVER (PARTITION BY order_id ORDER BY place) AS until FROM p),
d AS (SELECT s.order_id, s.place, s.until, count(i.b) AS depth FROM s LEFT JOIN i ON i.order_id = s.order_id AND i.b < i.e AND i.b <= s.place AND i.e > s.place WHERE until IS NOT NULL GROUP BY ALL),
r AS (SELECT order_id, place AS "begin", until AS "end", depth, CASE WHEN place >= 0 AND place < {WITHIN} THEN CASE WHEN depth = 0 THEN 'gap' WHEN depth > 1 THEN 'overlap' END WHEN depth > 0 THEN 'outside' END AS problem FROM d)
SELECT * FROM r WHERE problem IS NOT NULL UNION ALL SELECT order_id, b, e, 0, 'empty' FROM i WHERE b >= e"""


@query(TILING_SQL)
def transit_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """For every order the stretches of its first hundred days in which no line or more than one was under way; a line travels a day for each of its pieces."""
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderdate")
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_shipdate", "l_quantity").join(orders, "order_id")
    begin = F.datediff("l_shipdate", "o_orderdate")
    intervals = lines.select("order_id", begin.alias("begin"), (begin + F.floor("l_quantity").cast("int")).alias("end"))
    return assembly.tiling_problems(intervals, orders.select("order_id", F.lit(WITHIN).alias("total")), "order_id")


def _requests(spark: SparkSession, folder: str, louder: Column, faster: Column) -> DataFrame:
    """Every turn in sentences, said by its role's voices; a turn's annotation may be `louder`, which only its block's hash knows, or `faster`."""
    role = F.coalesce("role", F.lit(""))
    blocks = read(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("block"), F.coalesce("text", F.lit("")).alias("text"), role.alias("role"),
        F.when(louder, "loud").otherwise("plain").alias("block_hash"), F.when(faster, 1.2).otherwise(1.0).cast("string").alias("speed"),
    )
    units = F.filter(F.split("text", r"\. "), lambda u: u != "")
    voices = F.when(F.col("role") == "assistant", F.array(F.lit("first"), F.lit("second"))).otherwise(F.array(F.lit("other")))
    said = requests.fanned_out(blocks, "block", units, voices).withColumn("spoken", F.lower("unit"))
    return requests.hashed(said.withColumns({"voice_hash": F.sha2("voice", 256), "instruction": F.col("role"), "retry": F.lit(0)}), "block", "block_hash")


def _requests_sql(louder: str, faster: str) -> str:
    held = lambda *parts: "sha256(concat(" + ", ".join(f"length({p}), ':', {p}" for p in parts) + "))"
    return f"""(SELECT *, {held("synthesis_hash", "block", "block_hash", "unit_index::VARCHAR", "unit")} AS render_hash FROM (
      SELECT *, {held("lower(unit)", "voice", "sha256(voice)", "role", "speed", "'0'")} AS synthesis_hash FROM (
        SELECT block, role, block_hash, speed, unit, unit_index, unnest(CASE WHEN role = 'assistant' THEN ['first', 'second'] ELSE ['other'] END) AS voice FROM (
          SELECT block, role, block_hash, speed, unnest(units) AS unit, (generate_subscripts(units, 1) - 1)::INTEGER AS unit_index FROM (
            SELECT concat(conv_id, '-', turn) AS block, coalesce(role, '') AS role, CASE WHEN {louder} THEN 'loud' ELSE 'plain' END AS block_hash, CASE WHEN {faster} THEN '1.2' ELSE '1.0' END AS speed,
              list_filter(string_split(coalesce(text, ''), '. '), lambda u: u <> '') AS units FROM conversations)))))"""


@query(f"SELECT block, unit_index, voice, synthesis_hash, render_hash FROM {_requests_sql('false', 'false')}")
def speech_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A request for each sentence of each turn and each voice, with the hash of its speech and that of its place."""
    return _requests(spark, folder, F.lit(False), F.lit(False)).select("block", "unit_index", "voice", "synthesis_hash", "render_hash")


NOW_SQL = _requests_sql("conv_id % 5 = 0", "turn % 4 = 1")


def _runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """This run's requests, in which some blocks are annotated anew and some said faster, and the run before."""
    return _requests(spark, folder, F.col("conv_id") % 5 == 0, F.col("turn") % 4 == 1), _requests(spark, folder, F.lit(False), F.lit(False))


@query(f"""
WITH n AS {NOW_SQL}, o AS {_requests_sql('false', 'false')}
SELECT n.block, n.unit_index, n.voice, CASE WHEN n.render_hash = o.render_hash THEN 'keep' WHEN n.synthesis_hash IN (SELECT synthesis_hash FROM o) THEN 'render' ELSE 'synthesise' END AS work
FROM n JOIN o USING (block, unit_index, voice)""")
def request_work(spark: SparkSession, folder: str) -> DataFrame:
    """What each request needs after a change: nothing, another render of speech that is there, or new speech."""
    now, before = _runs(spark, folder)
    return requests.work(now, before, ["block", "unit_index", "voice"], before)


@query(f"""
WITH n AS {NOW_SQL}, o AS {_requests_sql('false', 'false')}
SELECT synthesis_hash, (min((block, unit_index, voice)))[1] AS block, (min((block, unit_index, voice)))[2] AS unit_index, (min((block, unit_index, voice)))[3] AS voice, count(*) AS uses
FROM n WHERE synthesis_hash NOT IN (SELECT synthesis_hash FROM o) GROUP BY synthesis_hash""")
def new_speech(spark: SparkSession, folder: str) -> DataFrame:
    """Speech to be made, each once, with the first request for it and how many use it."""
    now, before = _runs(spark, folder)
    return requests.to_synthesise(now, before, ["block", "unit_index", "voice"])


def _reviews(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turns as recordings of plans (their conversations), and where each stands."""
    t = read(spark, folder, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("target"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("kind"))
    targets = t.select(
        "conv_id", "target", "kind", F.concat(F.lit("cache/"), "target", F.when(F.col("turn") % 2 == 0, ".WAV").otherwise(".mp3")).alias("path"), F.sha2("text", 256).alias("file_hash"),
        F.sha2(F.concat_ws(":", "kind", "text"), 256).alias("render_hash"), (F.length("text") > 40).alias("auto_passed"),
    )
    status = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "approved").when((F.col("conv_id") + F.col("turn")) % 3 == 1, "pending_review").otherwise("planned")
    return targets, t.select("target", status.alias("status"))


BATCH_SQL = """
WITH t AS (SELECT conv_id, turn, concat(conv_id, '-', turn) AS target, coalesce(role, '') AS kind, sha256(coalesce(text, '')) AS file_hash, length(coalesce(text, '')) > 40 AS passed, (conv_id + turn) % 3 AS state FROM conversations),
b AS (SELECT *, concat('review/', file_hash, CASE WHEN turn % 2 = 0 THEN '.wav' ELSE '.mp3' END) AS object_key FROM t WHERE state = 1 AND passed AND kind IN ('user', 'assistant'))
"""


@query(f"""{BATCH_SQL}
SELECT conv_id, count(*) AS targets, count(*) FILTER (state = 0) AS approved, count(*) FILTER (state = 2) AS waiting, count(*) FILTER (state = 1) AS pending, coalesce(max(n), 0) AS playable
FROM t LEFT JOIN (SELECT conv_id, count(*) AS n FROM b GROUP BY conv_id) USING (conv_id) GROUP BY conv_id""")
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    """For every plan how many targets it has, in what state, and how many can be listened to."""
    targets, records = _reviews(spark, folder)
    return batches.batch_summary(targets, records, batches.review_batch(targets, records, "target", ("user", "assistant"), "review"), "conv_id", "target")


@query(f"{BATCH_SQL} SELECT object_key, file_hash, min(concat('cache/', target, CASE WHEN turn % 2 = 0 THEN '.WAV' ELSE '.mp3' END)) AS path, count(*) AS targets FROM b GROUP BY object_key, file_hash")
def batch_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the batch, equal ones once."""
    targets, records = _reviews(spark, folder)
    return batches.uploads(batches.review_batch(targets, records, "target", ("user", "assistant"), "review"))


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, (conv_id + turn) % 9 AS state,
  sha256(concat(coalesce(lag(text) OVER w, ''), '|', coalesce(lead(text) OVER w, ''))) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
o AS (SELECT *, role = 'assistant' AS told, (conv_id * 5 + turn) % 13 = 0 AS reworded, (conv_id * 3 + turn) % 10 = 0 AS moved, (conv_id + turn) % 11 = 0 AS gone FROM t),
j AS (SELECT *, CASE WHEN gone THEN 'pending' WHEN NOT told AND conv_id % 5 = 4 THEN 'unknown voice' WHEN state = 0 THEN 'accepted'
  WHEN reworded OR (NOT told AND moved) OR (state = 1 AND turn % 2 = 0) THEN 'pending' ELSE 'accepted' END AS judged FROM o)
SELECT conv_id, turn, judged AS state, CASE WHEN judged = 'pending' THEN CASE WHEN gone THEN 'no annotation' ELSE 'text or context has changed' END END AS reason,
  CASE WHEN judged = 'accepted' THEN CASE WHEN moved AND state <> 0 THEN 'elsewhere' ELSE context END END AS context_hash FROM j""")
def accepted_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Which turns keep the annotation that an earlier version of them had: some had other words or neighbours, some voices are gone."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    around = F.concat(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit("|"), F.coalesce(F.lead("text").over(w), F.lit("")))
    state = (F.col("conv_id") + F.col("turn")) % 9
    told = F.coalesce(F.col("role") == "assistant", F.lit(False))
    t = read(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(told, "narration").otherwise("dialogue").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.sha2(around, 256).alias("context_hash"),
        F.when(state == 0, acceptance.REUSED).when(state == 1, "new").otherwise("same").alias("match"), F.lit(None).cast("string").alias("reason"),
        F.when(told, acceptance.NARRATOR).otherwise(F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string"))).alias("speaker"),
    )
    old = t.filter((F.col("conv_id") + F.col("turn")) % 11 != 0).select(
        "conv_id", "turn", "speaker", F.when((F.col("conv_id") * 5 + F.col("turn")) % 13 == 0, "other words").otherwise(F.col("text_hash")).alias("text_hash"),
        F.when((F.col("conv_id") * 3 + F.col("turn")) % 10 == 0, "elsewhere").otherwise(F.col("context_hash")).alias("context_hash"), F.when(F.col("turn") % 2 == 0, acceptance.REUSED).otherwise("reviewed").alias("review"),
    )
    cards = t.filter((F.col("conv_id") % 5 != 4) & (F.col("speaker") != acceptance.NARRATOR)).select("speaker")
    return acceptance.judged(t, old, cards, ["conv_id", "turn"]).select("conv_id", "turn", "state", "reason", "context_hash")


@query(f"""{CENTROID_SQL},
g AS (SELECT vec_id % 20 AS part, * FROM d),
n AS (SELECT part, vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), label) AS rank FROM g),
v AS (SELECT part, label, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, label) AS rank FROM n WHERE rank = 1 GROUP BY part, label),
mx AS (SELECT vec_id % 20 AS part, i, avg(x) AS m FROM x GROUP BY ALL), mm AS (SELECT part, list(m ORDER BY i) AS m FROM mx GROUP BY part),
k AS (SELECT part, label, row_number() OVER (PARTITION BY part ORDER BY round(list_distance(m, c), 9), label) AS rank FROM mm, c)
SELECT e.part, e.fragments, e.mean_value, v.label AS vote, k.label AS cluster
FROM (SELECT vec_id % 20 AS part, count(*) AS fragments, round(avg(vec_id), 6) AS mean_value FROM e GROUP BY ALL) e JOIN v ON v.part = e.part AND v.rank = 1 JOIN k ON k.part = e.part AND k.rank = 1""")
def group_report(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors in twenty groups: how many, the cluster that most of them are in, and the one of their mean."""
    e = read(spark, folder, "embeddings")
    rows = e.select("vec_id", (F.col("vec_id") % 20).alias("part"), "embedding")
    found = reports.group_report(rows.withColumn("value", F.col("vec_id")), "part", "vec_id", "value", "embedding", stats.centroids(e, "embedding", "label"), "label")
    return found.withColumn("mean_value", F.round("mean_value", 6))


@query(f"SELECT source, count(bpc) AS texts, round(avg(bpc), 5) AS mean_bpc FROM ({ORACLES['ngram_lm_bpc']}) JOIN documents USING (doc_id) GROUP BY source")
def source_bpc(spark: SparkSession, folder: str) -> DataFrame:
    """The mean bits per character of every source's documents under a model of the benchmark."""
    docs = read(spark, folder, "documents")
    bits = ngrams.score_bits(docs, ngrams.fit_counts(read(spark, folder, "benchmark")))
    return docs.select("doc_id", "source").join(bits, "doc_id").groupBy("source").agg(F.count("bpc").alias("texts"), F.round(F.avg("bpc"), 5).alias("mean_bpc"))
