"""Writing tables: once, only if changed, and as versions of a log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> str:
    """A hash of all rows, whatever their order: counts and sums of two row hashes, so nothing is gathered."""
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"})
    row = df.select(F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.xxhash64(text, F.lit("again")).cast("decimal(38,0)").alias("b"))
    return str(row.agg(F.sha2(F.concat_ws(":", F.lit(",".join(columns)), F.count("*"), F.sum("a"), F.sum("b")), 256)).first()[0])


def write_once(df: DataFrame, folder: str) -> str:
    """Write df under its content hash and return the path; the same content again changes nothing, what an ended job left unfinished is written over."""
    path = f"{folder.rstrip('/')}/{content_hash(df)}"
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as x:
        if x.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        write_if_changed(df, path)
    return path


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write df over the table at path unless its rows are the same; whether it was written."""
    try:
        if content_hash(df.sparkSession.read.parquet(path)) == content_hash(df):
            return False
    except AnalysisException as x:
        if x.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    df.write.mode("overwrite").parquet(path)
    return True


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with changed rows replaced and new ones added; of several changes to a key one stays, the largest."""
    rest = [c for c in table.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
    return table.join(last.select(*keys), keys, "left_anti").select(*table.columns).unionByName(last)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """table and those rows whose key it does not have, the first of each key."""
    first = Window.partitionBy(key).orderBy(*order)
    fresh = rows.join(table.select(key), key, "left_anti").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return table.unionByName(fresh.select(*table.columns))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a line of a Markdown table, with bars and line ends escaped."""
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r?\n", "<br>") for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_report(spark: SparkSession, title: str, parts: list[tuple[str, DataFrame, list[str], list[str]]]) -> DataFrame:
    """(line) of a report: a title and, for each part (heading, rows, columns, order), a heading and a Markdown table in that order.

    Parts are sorted in parallel and follow each other as partitions, so a part of any length is written without being gathered; a part
    without rows says so.
    """

    def lines(*texts: str) -> DataFrame:
        return spark.createDataFrame([(t,) for t in texts], "line string").coalesce(1)

    out = lines(f"# {title}")
    for heading, rows, columns, order in parts:
        none = rows.groupBy().agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("No rows.").alias("line"))
        out = out.union(lines("", f"## {heading}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |")).union(markdown_rows(rows.orderBy(*order), columns)).union(none)
    return out
