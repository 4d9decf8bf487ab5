"""Chapters of several books as one table: read from their folders in one scan, stored by book, and looked up without reading the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a row group at most: what a lookup of one chapter reads of its book.
GROUP_BYTES = 8 << 20


def book_of(path: Column, roots: dict[str, str]) -> Column:
    """The book whose root folder holds a path; of roots within each other the inner one."""
    found = F.lit(None).cast("string")
    for book, root in sorted(roots.items(), key=lambda x: len(x[1])):
        found = F.when(F.contains(path, F.lit("/" + root.strip("/") + "/")), F.lit(book)).otherwise(found)
    return found


def collections(spark: SparkSession, roots: dict[str, str], pattern: str = "*.md") -> DataFrame:
    """(book, source_id, path, body) of the text files below each book's root folder, all of them in one scan.

    `source_id` is the file's path below its root without its ending. A root within another is its own book, so no file counts twice.
    """
    folders = [r.rstrip("/") for r in roots.values()]
    outer = [f for f in folders if not any(f != g and f.startswith(g + "/") for g in folders)]
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(sorted(set(outer)), wholetext=True)
    path = F.col("_metadata.file_path")
    rows = raw.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("body")).withColumn("book", book_of(F.col("path"), roots))
    root = reduce(lambda rest, x: F.when(F.col("book") == x[0], F.lit("/" + x[1].strip("/") + "/")).otherwise(rest), roots.items(), F.lit(None).cast("string"))
    below = F.element_at(F.split(F.col("path"), F.concat(F.lit(r"\Q"), root, F.lit(r"\E")), 2), 2)
    return rows.select("book", F.regexp_replace(below, r"\.[^./]+$", "").alias("source_id"), "path", "body")


def store(chapters: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """Write chapters (book, source_id, ...) as one table: a folder a book, files sorted by source_id, so that a book is pruned by its folder
    and a chapter by the bounds of row groups. Rows are spread by range of (book, source_id), so a large book fills several files."""
    ordered = chapters.repartitionByRange("book", "source_id").sortWithinPartitions("book", "source_id")
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("book").parquet(path)


def load(spark: SparkSession, path: str, book: str | None = None, source_id: str | None = None) -> DataFrame:
    """Chapters of a stored table: all, one book's, or one of them. What is not asked for is not read; an unknown book gives no rows."""
    rows = spark.read.parquet(path)
    if book is not None:
        rows = rows.filter(F.col("book") == book)
    return rows if source_id is None else rows.filter(F.col("source_id") == source_id)


def missing_images(images: DataFrame, files: DataFrame, name: str, by: list[str]) -> DataFrame:
    """(by, name) of each image that a text names and the listing files(name) lacks; once for each text."""
    return images.filter(F.col(name).isNotNull()).select(*by, name).distinct().join(files.select(name).distinct(), name, "left_anti").select(*by, name)


def key_values(text: Column, only: tuple[str, ...] = ()) -> Column:
    """A map of the lines 'key: value' of a front matter block: comments and other lines left out, quotes around values dropped; of a repeated key
    the last line counts. With `only`, no other keys."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), F.trim), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:") & ~x.startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^([\"'])(.*)\1$", "$2").alias("value")))
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]) & (p["key"].isin(*only) if only else F.lit(True)))
    return F.map_from_entries(kept)


def catalog(index: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, card_hash, problem) of a catalogue's entries: index (id, file, version) over cards (file, card_id, card_version, body).

    `problem` is the first of 'listed twice', 'no file', 'other id', 'other version'; cards that no entry names are 'not listed'. Of several cards
    of one file each counts.
    """
    times = index.groupBy("id").agg(F.count("*").alias("_times"))
    listed = index.join(times, "id", "left").withColumn("_listed", F.lit(True))
    met = listed.join(cards.withColumn("_there", F.lit(True)), "file", "full")
    problem = (
        F.when(F.col("_listed").isNull(), "not listed").when(F.col("_times") > 1, "listed twice").when(F.col("_there").isNull(), "no file")
        .when(~F.col("id").eqNullSafe(F.col("card_id")), "other id").when(~F.col("version").eqNullSafe(F.col("card_version")), "other version")
    )
    return met.select(F.coalesce("id", "card_id").alias("id"), F.sha2("body", 256).alias("card_hash"), problem.alias("problem"))
