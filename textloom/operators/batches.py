"""Review batches for a remote service: what may be approved by default, what is sent, and what the public may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def default_approved(provider: Column, trusted: tuple[str, ...], auto_passed: Column, same_render: Column, same_file: Column, status: Column, history: Column) -> Column:
    """Whether a target counts as approved without a person: a trusted provider's, its checks passed, render and file still those that were
    checked, still pending and never decided before (history: number of decisions). Anything unknown is not approved."""
    rule = provider.isin(*trusted) & auto_passed & same_render & same_file & (status == "pending_review") & (F.coalesce(history, F.lit(0)) == 0)
    return F.coalesce(rule, F.lit(False))


def review_batch(targets: DataFrame, records: DataFrame, key: str, kinds: tuple[str, ...], prefix: str) -> DataFrame:
    """Targets that a person can listen to, with `object_key`: of a kind that is reviewed, pending in records (key, status), with a file, a
    render and passed checks. Object keys are names by content, so equal files are one object."""
    pending = records.filter("status = 'pending_review'").select(key).distinct()
    whole = F.col("path").isNotNull() & F.col("file_hash").isNotNull() & F.col("render_hash").isNotNull() & F.coalesce("auto_passed", F.lit(False))
    name = F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("file_hash"), F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)))
    return targets.filter(F.col("kind").isin(*kinds) & whole).join(pending, key, "left_semi").select(*targets.columns, name.alias("object_key"))


def uploads(batch: DataFrame) -> DataFrame:
    """(object_key, file_hash, path, targets): one row an object; of several paths with the same content the first is sent."""
    return batch.groupBy("object_key", "file_hash").agg(F.min("path").alias("path"), F.count("*").alias("targets"))


def batch_summary(targets: DataFrame, records: DataFrame, batch: DataFrame, by: str, key: str) -> DataFrame:
    """(by, targets, approved, waiting, pending, playable) of each plan, zeros included."""
    status = records.select(key, "status")
    counts = targets.select(by, key).join(status, key, "left").groupBy(by).agg(
        F.count("*").alias("targets"), F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "planned").alias("waiting"), F.count_if(F.col("status") == "pending_review").alias("pending"),
    )
    playable = batch.groupBy(by).agg(F.count("*").alias("_playable"))
    return counts.join(playable, by, "left").withColumn("playable", F.coalesce("_playable", F.lit(0)).cast("long")).drop("_playable")


def public_view(batch: DataFrame, hidden: tuple[str, ...], secret: Column, expires: Column) -> DataFrame:
    """batch without its internal columns, with `url`: the object's name, when access ends, and a signature over both."""
    until = expires.cast("long").cast("string")
    signature = F.sha2(F.concat_ws("\n", secret, "object_key", until, secret), 256)
    return batch.withColumn("url", F.concat(F.lit("/"), "object_key", F.lit("?until="), until, F.lit("&sig="), signature)).drop(*hidden)
