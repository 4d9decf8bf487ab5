"""Exact deduplication by content sort, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, unused

WHITESPACE = " \t\n\x0b\f\r"
#: Characters of a text in a sampled splitter.
SPLITTER = 48
#: A text with over this share of a range's bytes is cut by id into pieces of that share.
HOT_SHARE = 0.5


def normalised(text: str = "text") -> F.Column:
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), WHITESPACE, F.coalesce(F.col(text), F.lit("")))


def hot_texts(keyed: DataFrame, ranges: int) -> DataFrame | None:
    """(digest, pieces) of texts that would fill much of a range by their copies; at most ranges / HOT_SHARE rows, so that it may be sent to all executors. None if there are none."""
    total = Observation()
    weights = keyed.observe(total, F.sum("weight").alias("weight")).groupBy("digest").agg(F.sum("weight").alias("weight"), F.count("*").alias("copies"))
    most = int(ranges / HOT_SHARE)  # no more can have such a share
    heaviest = weights.filter(F.col("copies") > 1).orderBy(F.desc("weight")).limit(most).collect()
    piece = max(1, total.get["weight"] // most) if heaviest else 1
    found = [(r["digest"], -(-r["weight"] // piece)) for r in heaviest if r["weight"] > piece]
    return keyed.sparkSession.createDataFrame(found, "digest long, pieces long") if found else None


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of rows whose texts are equal once ASCII white space is deleted.

    Sampled splitters deal the rows into ranges of the normalised text (its beginning; a digest tells apart texts that share
    it). Within a range an external sort by the whole text, then by length and id, puts equal texts side by side, and
    each row is compared in full with its neighbour: where they differ, a run begins, and its first row stays. A text
    whose copies would fill much of a range is cut into pieces by id, so its rows lie in several ranges; only
    the pieces' runs, one row each, are merged afterwards. Texts are shuffled once.

    Of equal texts the row with the most code points in the original text stays, then the smallest id.
    Null text counts as empty; empty and blank texts form one class. Rows that repeat an id are rows of
    their own (each counts in group_size, all of them have kept = true if their id stays). A null id
    stays only if the class has no other id. An empty table gives an empty table. A very long text is one row of the sort and is
    compared whole. Only id and text are read, so other columns cannot clash.

    Returns id, keep_id, group_size, kept, text_sha256 (of the normalised text).
    """
    ranges = shuffle_partitions(docs.sparkSession)
    content = normalised("text")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", content.alias("content"), F.length(F.coalesce("text", F.lit(""))).alias("points"), F.xxhash64(content).alias("digest"), (F.octet_length(F.coalesce("text", F.lit(""))) + 64).alias("weight")
    )
    hot = hot_texts(keyed, ranges)
    cut = ["beginning", "digest"]
    if hot is not None:
        piece = F.when(F.col("pieces").isNotNull(), 1 + F.pmod(F.xxhash64("id"), "pieces")).otherwise(0)
        keyed, cut = keyed.join(F.broadcast(hot), "digest", "left").withColumn("piece", piece), [*cut, "piece"]
    dealt = keyed.withColumn("beginning", F.left("content", F.lit(SPLITTER))).select("id", "content", "points", *cut).repartitionByRange(ranges, *cut)

    order = Window.partitionBy(*cut).orderBy("content", F.desc("points"), F.col("id").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = dealt.withColumn("new", ~F.col("content").eqNullSafe(F.lag("content").over(order)))
    runs = sorted_.select(
        "id", *cut, F.sha2("content", 256).alias("text_sha256"), "new",
        F.sum(F.col("new").cast("int")).over(so_far).alias("run"), F.last(F.when(F.col("new"), F.struct("points", "id")), ignorenulls=True).over(so_far).alias("first"),
    )
    rows = runs.withColumn("size", F.count("*").over(Window.partitionBy(*cut, "run")))
    if hot is None:
        keep, size = F.col("first.id"), F.col("size")
    else:
        rows = materialize(rows.select("id", "piece", "new", "text_sha256", "first", "size"), "exact-runs")
        order = F.struct((-F.col("first.points")).alias("fewer"), F.col("first.id").isNull().alias("none"), F.col("first.id").alias("id"))
        merged = (
            rows.filter("new and piece > 0").groupBy("text_sha256")
            .agg(F.min(order).alias("best"), F.sum("size").alias("whole_size"))
        )
        whole = merged.select("text_sha256", F.struct("best", "whole_size").alias("whole"))
        if merged.count() <= 2 * ranges / HOT_SHARE:  # as many as hot has, unless many texts share a digest
            whole = F.broadcast(whole)
        rows = rows.join(whole, "text_sha256", "left")
        keep, size = F.when(F.col("whole").isNotNull(), F.col("whole.best.id")).otherwise(F.col("first.id")), F.coalesce("whole.whole_size", "size")
    return rows.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), "text_sha256").select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Null texts, long texts and ties are as there. Rows that repeat an id stay or go together; of null ids alone all stay. An empty
    table gives an empty table.
    """
    kept_id = unused(docs, "kept_id")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(kept_id))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS content, length(coalesce(text, '')) AS points
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY content) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept,
  sha256(content) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY content ORDER BY points DESC, doc_id)
"""
