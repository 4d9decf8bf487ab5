"""Queries of voice blocks and of JSON checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, cuts, markup, schema, versions
from ..session import read
from .registry import query

#: Brackets stand for the quotes of speech in the tables' texts.
QUOTES = ("(", ")")

BLOCKS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text <> ''),
p AS (SELECT doc_id, line, trim(regexp_replace(regexp_replace(raw, '【[^】]*】', '', 'g'), '[\s\x0B\x{feff}\x{a0}\x{3000}]+', ' ', 'g')) AS text FROM l),
t AS (SELECT doc_id, line, unnest(regexp_extract_all(text, '[()]|[^()]+')) AS token, generate_subscripts(regexp_extract_all(text, '[()]|[^()]+'), 1) AS place FROM p WHERE text <> ''),
v AS (SELECT *, coalesce(sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY place DESC) = 1 AS last FROM t),
b AS (SELECT *, CASE WHEN token = '(' AND level >= 1 THEN 'nested' WHEN token = ')' AND level <= 0 THEN 'not open'
  WHEN last AND level + CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END > 0 THEN 'not closed' END AS problem FROM v)
"""


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.paragraphs(markup.nodes(read(spark, folder, "documents"), "doc_id", "text"), "doc_id")


@query(f"""{BLOCKS_SQL},
g AS (SELECT doc_id, line, place, CASE WHEN level > 0 THEN 'dialogue' ELSE 'narration' END AS kind, trim(token) AS text FROM b
  WHERE token NOT IN ('(', ')') AND trim(token) <> '' AND doc_id NOT IN (SELECT doc_id FROM b WHERE problem IS NOT NULL))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, place)::INTEGER AS "order", kind, line::INTEGER AS line, sha256(text) AS text_hash FROM g""")
def voice_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Narration and speech of every document whose brackets are sound, in order."""
    return blocks.voice_blocks(_paragraphs(spark, folder), "doc_id", QUOTES).select("doc_id", "order", "kind", "line", "text_hash")


@query(f"""{BLOCKS_SQL}
SELECT doc_id, line::INTEGER AS line, min_by(problem, place) AS problem FROM b WHERE problem IS NOT NULL GROUP BY doc_id, line""")
def quote_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents whose brackets nest, close without being open, or stay open."""
    return blocks.quote_problems(_paragraphs(spark, folder), "doc_id", QUOTES)


PROPS = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 89}}}


@query("""
WITH e AS (SELECT event_id, try_cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, '$.k' AS path, CASE WHEN k < 10 THEN 'minimum' ELSE 'maximum' END AS problem FROM e WHERE k < 10 OR k > 89""")
def props_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What the properties of every event break of their schema."""
    return schema.problem_rows(schema.checked(read(spark, folder, "events"), "props", PROPS), ["event_id"])


ORDER = {
    "type": "object", "required": ["order", "lines"], "additionalProperties": False,
    "properties": {
        "order": {"type": "integer", "minimum": 0},
        "lines": {"type": "array", "maxItems": 6, "items": {"type": "object", "required": ["mode"], "properties": {
            "quantity": {"type": "number", "maximum": 45}, "flag": {"type": "string", "enum": ["A", "N"]}, "mode": {"type": "string", "pattern": "^[A-Z ]+$", "maxLength": 5},
        }, "additionalProperties": False}},
    },
}


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 AS i FROM lineitem),
r AS (
  SELECT l_orderkey AS order_id, concat('$.lines[', i, '].quantity') AS path, 'maximum' AS problem FROM l WHERE l_quantity > 45
  UNION ALL SELECT l_orderkey, concat('$.lines[', i, '].flag'), 'enum' FROM l WHERE l_returnflag NOT IN ('A', 'N')
  UNION ALL SELECT l_orderkey, concat('$.lines[', i, '].mode'), 'required' FROM l WHERE l_linestatus = 'O'
  UNION ALL SELECT l_orderkey, '$.lines', 'maxItems' FROM l GROUP BY l_orderkey HAVING count(*) > 6)
SELECT order_id, path, problem FROM r""")
def order_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a document with its lines, against a schema with nested rules; lines of one status have no mode."""
    lines = read(spark, folder, "lineitem")
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    mode = F.when(F.col("l_linestatus") != "O", F.lit("RAIL"))
    line = F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), mode.alias("mode"))
    held = F.transform(F.array_sort(F.collect_list(F.struct(*place, line.alias("line")))), lambda x: x["line"])
    docs = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.to_json(F.struct(F.first("l_orderkey").alias("order"), held.alias("lines"))).alias("doc"))
    return schema.problem_rows(schema.checked(docs, "doc", ORDER), ["order_id"])


def _turns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation, and an earlier version of them: some were missing, some worded otherwise, some elsewhere."""
    turns = read(spark, folder, "conversations").filter("role IS NOT NULL").dropDuplicates(["conv_id", "turn"])
    kind = F.when(F.col("role") == "assistant", "narration").otherwise("dialogue")
    new = turns.select(F.col("conv_id").alias("doc"), F.col("turn").cast("long").alias("place"), kind.alias("kind"), "text")
    draw = F.pmod(F.xxhash64("doc", "place"), F.lit(12))
    was = F.when(draw == 1, F.concat("text", F.lit(" so it was"))).when(draw == 2, F.concat(F.lit("Then "), "text", F.lit("!"))).otherwise(F.col("text"))
    old = new.filter(draw != 0).withColumns({"text": was, "place": F.when(draw == 3, F.col("place") + 1000).otherwise(F.col("place"))})
    return new, old.withColumn("block", F.col("place") + 1)


@query()
def turn_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn against an earlier version of its conversation: its number there, how it was matched, and what has to be done."""
    rows = versions.reconciled(*_turns(spark, folder))
    return rows.select(F.col("doc").alias("conv_id"), F.col("place").alias("turn"), "block", "old_place", "how", "ratio", "status", "reason")


@query()
def version_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many turns of every conversation are new, reused, unchanged, for review, and gone."""
    new, old = _turns(spark, folder)
    return versions.summary(versions.reconciled(new, old), old).withColumnRenamed("doc", "conv_id")


LONGEST = 200
CUTS_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, 0 AS chunk, NULL::VARCHAR AS part, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS rest FROM documents
  UNION ALL
  SELECT doc_id, chunk + 1, left(rest, cut), regexp_replace(substring(rest, cut + 1), '^\s+', '') FROM (
    SELECT doc_id, chunk, rest, CASE WHEN length(rest) <= {LONGEST} THEN length(rest) WHEN strong >= {int(LONGEST * cuts.NATURAL)} THEN strong WHEN weak >= {int(LONGEST * cuts.NATURAL)} THEN weak ELSE {LONGEST} END AS cut
    FROM (SELECT *, length(regexp_extract(left(rest, {LONGEST}), '(?s)^.*[.!?;\n]')) AS strong, length(regexp_extract(left(rest, {LONGEST}), '(?s)^.*[,:]')) AS weak FROM r WHERE rest <> '')))
SELECT doc_id, (chunk - 1)::INTEGER AS chunk, sha256(regexp_replace(part, '\s+$', '')) AS text_hash FROM r WHERE part IS NOT NULL"""


@query(CUTS_SQL)
def speech_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in chunks of 200 characters at most, cut at sentences, else at clauses, else anywhere."""
    rows = cuts.speech_cuts(read(spark, folder, "documents"), "doc_id", "text", LONGEST, ".!?;\n", ",:")
    return rows.select("doc_id", "chunk", F.sha2("text", 256).alias("text_hash"))


@query()
def forced_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn in units of 40 characters around its long words, each of which is a unit of its own."""
    turns = read(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    units, _ = cuts.forced_units(turns.withColumn("wanted", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z]{8,}"), F.lit(0))), "id", "text", "wanted", 40, ".!?;", ",:")
    return units
