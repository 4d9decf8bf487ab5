"""Blind review packages: keys without ids, hashes that bind a package, checks of ratings, which reviews count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A row's hash is added up in so many lanes of so many hex digits: a package of any size is hashed without being gathered.
LANES, DIGITS = 4, 15


def text_hash(*texts: Column) -> Column:
    """SHA-256 of texts with their lengths, so that no two lists of texts share a form; null counts as empty."""
    parts = [F.coalesce(t, F.lit("")) for t in texts]
    return F.sha2(F.concat_ws("", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


def blind(candidates: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(blind_key, text_hash, texts): candidates under keys that do not tell their ids. Repeated rows stay repeated."""
    own = text_hash(*(F.col(t) for t in texts))
    name = F.concat(F.lit("t-"), F.left(F.sha2(F.concat_ws("|", F.col(key).cast("string"), own), 256), F.lit(16)))
    return candidates.select(name.alias("blind_key"), own.alias("text_hash"), *texts)


def package_hashes(rows: DataFrame, by: list[str], row_hash: Column) -> DataFrame:
    """(by, n, package_hash) over each package's rows, whatever their order; repeated rows count each time."""
    lanes = [F.sum(F.conv(F.substring("h", 1 + i * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(LANES)]
    summed = rows.select(*by, row_hash.alias("h")).groupBy(*by).agg(F.count("*").alias("n"), F.concat_ws(":", F.count("*").cast("string"), *lanes).alias("sums"))
    return summed.select(*by, "n", F.sha2("sums", 256).alias("package_hash"))


def changed_packages(manifests: DataFrame, rows: DataFrame, by: str, row_hash: Column) -> DataFrame:
    """(by, problem) of manifests (by, package_hash) whose rows no longer give their hash, or are gone."""
    now = package_hashes(rows, [by], row_hash).select(by, F.col("package_hash").alias("now"))
    problem = F.when(F.col("now").isNull(), "no rows").when(~F.col("package_hash").eqNullSafe(F.col("now")), "hash differs")
    return manifests.select(by, "package_hash").join(now, by, "left").select(by, problem.alias("problem")).filter("problem is not null")


def rating_problems(ratings: DataFrame, candidates: DataFrame, review: str, key: str) -> DataFrame:
    """(review, key, problem) of each rating, null if it is sound: 'rated twice', 'unknown', 'text differs', 'quote not in text'.

    ratings (review, key, text_hash, quote); candidates (key, text_hash, text), one row a key. An empty or null quote is in every text.
    """
    known = candidates.select(key, F.col("text_hash").alias("known_hash"), F.col("text").alias("known_text"))
    twice = F.count("*").over(Window.partitionBy(review, key)) > 1
    rows = ratings.select(review, key, "text_hash", "quote", twice.alias("twice")).join(known, key, "left")
    quoted = F.coalesce("known_text", F.lit("")).contains(F.coalesce("quote", F.lit("")))
    problem = (
        F.when(F.col("twice"), "rated twice").when(F.col("known_hash").isNull(), "unknown")
        .when(~F.col("text_hash").eqNullSafe(F.col("known_hash")), "text differs").when(~quoted, "quote not in text")
    )
    return rows.select(review, key, problem.alias("problem"))


def independent_reviews(reviews: DataFrame, package: str, review: str) -> DataFrame:
    """(package, review, problem): of a package's sound reviews, those whose round and context are both their own count.

    If what is left comes from more than one model snapshot (null is one), none of the package counts.
    """
    rounds = F.count("*").over(Window.partitionBy(package, "round")) > 1
    contexts = F.count("*").over(Window.partitionBy(package, "context")) > 1
    marked = reviews.select(package, review, "round", "context", "snapshot").withColumn("repeated", rounds | contexts)
    name = F.coalesce(F.concat(F.lit("="), "snapshot"), F.lit(""))
    left = marked.filter("not repeated").groupBy(package).agg((F.min(name) != F.max(name)).alias("mixed"))
    problem = F.when(F.col("repeated"), "round or context repeated").when(F.col("mixed"), "snapshots differ")
    return marked.join(left, package, "left").select(package, review, problem.alias("problem"))


def attempts(runs: DataFrame, fields: list[str], fresh: Column) -> DataFrame:
    """Runs with their family (hash of the fields that define them) and attempt: 'initial' again, or a new one if fresh."""
    family = text_hash(*(F.col(f).cast("string") for f in fields))
    return runs.withColumn("family", family).withColumn("attempt", F.when(fresh, F.concat(F.lit("retest-"), F.uuid())).otherwise("initial"))


def all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether each pair is equal, null equalling null."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs), F.lit(True))
