"""Blocks of narration, dialogue and verse from the parsed nodes of marked-up texts.

Everything is a scan: running sums over a document's nodes tell paragraphs apart, and running sums over a paragraph's quotes tell speech
from narration, so neither a document nor a paragraph is a loop. Sums of parts add up, so a scan can be cut anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markup import HIDDEN, VERSE

#: Comments and marks that are written out in a text and not spoken.
COMMENT, LITERAL = r"【[^】]*】", r"\[(?:zpsc|zp|mp|sc|fu|wz\d*|T|-)\]"
TITLE = "T"
#: Marks whose text is not spoken; a title is.
UNSPOKEN = tuple(k for k in HIDDEN if k != TITLE)


def spoken(text: Column, lines: bool = False) -> Column:
    """A text without comments and written-out marks, white space as one space; with `lines`, each line for itself and empty ones dropped."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, COMMENT, ""), LITERAL, ""), r"\r\n?", "\n")
    if not lines:
        return F.trim(F.regexp_replace(text, r"[\s\x{feff}\x{a0}\x{3000}]+", " "))
    each = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", ""))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")


def pieces(parsed: DataFrame, key: str) -> DataFrame:
    """(key, node_id, part, role, top, line, piece): what is spoken of each node, in order.

    Plain text at the top falls into lines, each a paragraph of its own; text inside other marks runs on. role is prose, title, or the
    kind of verse mark that all of it lies in; top is the outermost node.
    """
    w = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    outer = F.coalesce(F.get("path", F.lit(0)), F.when(F.col("type") == "mark", F.col("kind")))
    role = F.when(outer == TITLE, "title").when(outer.isin(*VERSE), outer).otherwise("prose")
    rows = parsed.withColumns({"top": F.max(F.when(F.col("depth") == 0, F.col("node_id"))).over(w), "role": role})
    hidden = F.arrays_overlap("path", F.lit(list(UNSPOKEN))) | F.arrays_overlap("path", F.lit(["wz"]))
    rows = rows.filter(F.col("type").isin("text", "hard-break") & ~hidden)
    whole = F.array(F.when(F.col("type") == "hard-break", F.when(F.col("role").isin(*VERSE), "\n").otherwise(" ")).otherwise(F.col("value")))
    cut = F.when((F.col("type") == "text") & (F.col("depth") == 0), F.split("value", "\n", -1)).otherwise(whole)
    return rows.select(key, "node_id", "role", "top", "line", F.posexplode(cut).alias("part", "piece")).withColumn("line", F.col("line") + F.when(F.col("role") == "prose", F.col("part")).otherwise(0))


def paragraphs(parsed: DataFrame, key: str) -> DataFrame:
    """(key, paragraph, role, line, text): pieces joined; a line of prose, a title and a verse mark are a paragraph each. Empty ones are left out."""
    w = Window.partitionBy(key).orderBy("node_id", "part")
    block = F.col("role") != "prose"
    begins = (F.col("part") > 0) | (F.col("role") != F.lag("role").over(w)) | (block & (F.col("top") != F.lag("top").over(w)))
    rows = pieces(parsed, key).withColumn("begins", F.coalesce(begins, F.lit(True)).cast("int"))
    rows = rows.withColumn("paragraph", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("node_id", "part")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "part", "piece"))), lambda p: p["piece"]), "")
    whole = rows.groupBy(key, "paragraph", "role").agg(F.coalesce(F.min_by("line", F.when(F.col("piece") != "", place)), F.min("line")).alias("line"), joined.alias("raw"))
    text = F.when(F.col("role").isin(*VERSE), spoken(F.col("raw"), lines=True)).otherwise(spoken(F.col("raw")))
    return whole.select(key, "paragraph", "role", "line", text.alias("text")).filter("text <> ''")


def quoted(rows: DataFrame, key: str, quotes: tuple[str, str]) -> DataFrame:
    """(key, paragraph, role, line, at, token, level, problem): quotes and what lies between them, with how many quotes are open before each and
    what is wrong with it; a verse is one token without quotes."""
    opening, closing = quotes
    prose = ~F.col("role").isin(*VERSE)
    cut = F.regexp_extract_all("text", F.lit(rf"[\{opening}\{closing}]|[^\{opening}\{closing}]+"), F.lit(0))
    tokens = rows.select(key, "paragraph", "role", "line", F.posexplode(F.when(prose, cut).otherwise(F.array("text"))).alias("at", "token"))
    is_open, is_close = prose & (F.col("token") == opening), prose & (F.col("token") == closing)
    step = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    w = Window.partitionBy(key, "paragraph").orderBy("at")
    leveled = tokens.withColumns({"level": F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_next": F.lead("at").over(w)})
    left = F.col("level") + step
    problem = F.when(is_open & (F.col("level") >= 1), "nested").when(is_close & (F.col("level") <= 0), "not open").when(F.col("_next").isNull() & (left > 0), "not closed")
    return leveled.withColumn("problem", problem).drop("_next")


def quote_problems(rows: DataFrame, key: str, quotes: tuple[str, str] = ("“", "”")) -> DataFrame:
    """(key, line, problem) of paragraphs whose quotes are nested, closed without being open, or left open; the first problem of each."""
    found = quoted(rows, key, quotes).filter("problem IS NOT NULL")
    return found.groupBy(key, "paragraph").agg(F.min("line").alias("line"), F.min_by("problem", "at").alias("problem")).select(key, "line", "problem")


def voice_blocks(rows: DataFrame, key: str, quotes: tuple[str, str] = ("“", "”")) -> DataFrame:
    """(key, order, kind, role, line, text, text_hash, context_hash) of paragraphs (see `paragraphs`), without texts that have a quote problem.

    What lies in quotes is dialogue, the rest of a line or title narration, verse is poetry as a whole. Order runs from 1 in each text;
    the context is the kind and hash of the blocks on both sides. Texts are gone through once: their problems are a window over the same tokens.
    """
    problems = F.count("problem").over(Window.partitionBy(key))
    sound = quoted(rows, key, quotes).withColumn("_problems", problems).filter((F.col("_problems") == 0) | F.col(key).isNull())
    verse = F.col("role").isin(*VERSE)
    kind = F.when(verse, "poetry").when(F.col("level") > 0, "dialogue").otherwise("narration")
    text = F.when(verse, F.col("token")).otherwise(spoken(F.col("token")))
    every = sound.filter(verse | ~F.col("token").isin(*quotes)).select(key, "paragraph", "at", kind.alias("kind"), "role", "line", text.alias("text")).filter("text <> ''")
    w = Window.partitionBy(key).orderBy("paragraph", "at")
    every = every.withColumn("text_hash", F.sha2("text", 256)).withColumn("order", F.row_number().over(w))
    side = lambda f: F.coalesce(F.concat_ws(":", f("kind").over(w), f("text_hash").over(w)), F.lit(""))
    return every.withColumn("context_hash", F.sha2(F.concat_ws("|", side(F.lag), side(F.lead)), 256)).select(key, "order", "kind", "role", "line", "text", "text_hash", "context_hash")
