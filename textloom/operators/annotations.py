"""Annotations of marked-up texts: what stands before each, the place in the text it belongs to, and the proof that none was lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import BLOCK, carried_suffix
from .wording import unwrapped

#: Characters of body text kept before an annotation, and those that its anchor shows.
KEEP, TAIL = 90, 45


def spaced(text: Column) -> Column:
    """A text with runs of white space as single spaces, none at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x0B\x{feff}\x{a0}\x{3000}]+", " "), "^ | $", "")


def anchor(before: Column, tail: int = TAIL) -> Column:
    """The end of what stands before: white space as single spaces, without a leading block of metadata and brackets of comments."""
    return F.right(F.regexp_replace(F.regexp_replace(spaced(before), r"(?s)^---.*?---\s*", ""), "[【】]", ""), F.lit(tail))


def anchored(events: DataFrame, key: str, place: str, body: str, end: str, keep: int = KEEP, tail: int = TAIL, block: int = BLOCK) -> DataFrame:
    """events with `anchor` and `cursor`: the last body text before each and where it ended; see scan.carried_suffix."""
    return carried_suffix(events, [key], place, body, end, keep, block).withColumn("anchor", anchor(F.col("before"), tail)).drop("before")


def annotation_events(parsed: DataFrame, key: str, mark: str = "zp", aside: tuple[str, ...] = ("zp", "mp"), title: str = "T") -> DataFrame:
    """(key, node_id, body, end, marked) of parsed nodes: body text counts from the first title on and outside `aside` marks; a hard break is a space."""
    w = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    titled = F.coalesce(F.max((F.col("type") == "mark") & (F.col("kind") == title)).over(w), F.lit(False))
    counts = titled & ~F.arrays_overlap("path", F.array(*map(F.lit, aside)))
    body = F.when(counts & (F.col("type") == "text"), F.col("value")).when(counts & (F.col("type") == "hard-break"), " ")
    end = F.col("offset") + F.when(F.col("type") == "hard-break", 2).otherwise(F.length("value"))
    marked = (F.col("type") == "mark") & (F.col("kind") == mark)
    return parsed.select(key, "node_id", body.alias("body"), end.alias("end"), F.coalesce(marked, F.lit(False)).alias("marked"), "line", "col", "offset", "path")


def comment_texts(parsed: DataFrame, key: str, mark: str) -> DataFrame:
    """(_k, _mark, _comment): all text below each mark of the kind, by the mark's node; a text below nested marks belongs to each.

    Nodes come in preorder, so the mark that encloses a text at some depth is the last mark of that depth before it: one window a (key, depth).
    """
    value = F.when(F.col("type") == "text", F.col("value")).when(F.col("type") == "hard-break", " ")
    at = F.filter(F.transform("path", lambda k, i: F.when(k == mark, i)), lambda i: i.isNotNull())
    texts = parsed.filter(value.isNotNull()).select(F.col(key).alias("_k"), "node_id", value.alias("_value"), F.explode(at).alias("_depth"), F.lit(None).cast("int").alias("_opens"))
    marks = parsed.filter((F.col("type") == "mark") & (F.col("kind") == mark)).select(F.col(key).alias("_k"), "node_id", F.lit(None).cast("string").alias("_value"), F.col("depth").alias("_depth"), F.col("node_id").alias("_opens"))
    enclosed = texts.unionByName(marks).withColumn("_mark", F.last("_opens", ignorenulls=True).over(Window.partitionBy("_k", "_depth").orderBy("node_id")))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("node_id", "_value")))), lambda x: x["_value"]), "")
    return enclosed.groupBy("_k", "_mark").agg(held.alias("_comment"))


def annotations(parsed: DataFrame, key: str, mark: str = "zp", aside: tuple[str, ...] = ("zp", "mp"), block: int = BLOCK) -> DataFrame:
    """(key, ordinal, annotation, line, col, offset, locus, locus_offset, anchor, comment, embedded): every annotation of parsed texts, nested ones included.

    `locus` names the place by the end of the last body text, so annotations side by side share it; `embedded` lists the asides around one. The
    comment is all text below the mark. `annotation` is an id of the key, the ordinal and eight digits of the comment's hash.
    """
    found = anchored(annotation_events(parsed, key, mark, aside), key, "node_id", "body", "end", block=block).filter("marked")
    texts = comment_texts(parsed, key, mark)
    met = found.join(texts, (F.col(key) == F.col("_k")) & (F.col("node_id") == F.col("_mark")), "left").withColumn("comment", unwrapped(spaced(F.coalesce("_comment", F.lit("")))))
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("node_id"))
    name = F.col(key).cast("string")
    return met.withColumn("ordinal", ordinal).select(
        key, "ordinal", F.concat_ws("-", F.lit(mark), name, F.lpad(F.col("ordinal").cast("string"), 4, "0"), F.left(F.sha2("comment", 256), F.lit(8))).alias("annotation"), "line", "col", "offset",
        F.concat_ws("-", F.lit("loc"), name, F.col("cursor").cast("string")).alias("locus"), F.col("cursor").alias("locus_offset"), "anchor", "comment",
        F.filter("path", lambda k: k.isin(*aside)).alias("embedded"),
    )


def mark_counts(docs: DataFrame, extracted: DataFrame, key: str, text: str, mark: str = "zp") -> DataFrame:
    """(key, marked, extracted): marks that stand in each text against annotations found in it; texts without any have zeros.

    Marks that are escaped stand in the text all the same, so such a text shows a difference: it is for a person to look at.
    """
    found = extracted.groupBy(key).agg(F.count("*").alias("_n"))
    marked = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"\[{mark}\]")).cast("long")
    return docs.select(key, marked.alias("marked")).join(found, key, "left").select(key, "marked", F.coalesce("_n", F.lit(0)).cast("long").alias("extracted"))


def complete(extracted: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """extracted, unchanged, if every text gave as many annotations as it has marks; else the job that reads them fails and names a text.

    The check is a scalar of the same plan, so no reader of these rows goes round it.
    """
    said = F.min(F.concat_ws(" ", F.col(key).cast("string"), F.lit("has"), "marked", F.lit("marks, found"), "extracted"))
    wrong = counts.filter("marked <> extracted").agg(F.count("*").alias("_n"), said.alias("_one"))
    sound = wrong.select(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.lit("annotations are lost: text "), F.col("_one"))).cast("boolean")).otherwise(F.lit(True)))
    return extracted.filter(sound.scalar())
