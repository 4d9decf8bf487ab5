"""Frames of a signal: quiet runs, levels, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import islands


def quiet_runs(frames: DataFrame, by: str, order: list[str], quiet: Column, least: int) -> DataFrame:
    """(by, first, last, n, place) of runs of at least `least` quiet frames; leading, trailing or internal."""
    size = frames.groupBy(by).agg(F.count("*").alias("frames"))
    runs = islands(frames, [by], order, quiet).groupBy(by, "island").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    where = F.when(F.col("first") == 1, "leading").when(F.col("last") == F.col("frames"), "trailing").otherwise("internal")
    return runs.filter(F.col("n") >= least).join(size, by).select(by, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n", where.alias("place"))


def levels(samples: DataFrame, by: str, value: str, floor: float) -> DataFrame:
    """(by, n, rms, peak, active, median_active): root mean square, largest size, share above `floor`, and the upper median of sizes above it."""
    size = F.abs(F.col(value))
    g = samples.groupBy(by).agg(F.count(value).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(size).alias("peak"), F.avg((size > floor).cast("double")).alias("active"))
    # sizes are counted before they are shuffled; the median is where half the count is passed
    counts = samples.filter(size > floor).groupBy(by, size.alias("size")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    passed = counts.withColumns({"upto": F.sum("c").over(w.orderBy("size")), "all": F.sum("c").over(w)})
    median = passed.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(F.col(by).alias("_by")).agg(F.min("size").alias("median"))
    whole = g.join(median, F.col(by).eqNullSafe(F.col("_by")), "left")
    return whole.select(by, "n", *(F.round(c, 6).alias(c) for c in ("rms", "peak", "active")), F.round("median", 6).alias("median_active"))


def decibels(level: Column) -> Column:
    """20 log10; null for silence."""
    return 20 * F.log10(F.nullif(level, F.lit(0.0)))


def gain(rms: Column, peak: Column, target: float, limit: float) -> Column:
    """The gain that reaches the target level without taking the peak past the limit."""
    return F.least(F.lit(target) - rms, F.lit(limit) - peak)


def timeline(rows: DataFrame, by: list[str], order: list[str], duration: str, pause: float) -> DataFrame:
    """rows with start and end: running sums of durations with a pause after each row."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(duration) + pause).over(before), F.lit(0.0))
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.col(duration))


def scoring_windows(rows: DataFrame, key: str, tokens: str, context: int, stride: int) -> DataFrame:
    """(key, begin, end, score_from): windows of `context` tokens, `stride` apart, that score each token but the first once."""
    ends = F.when(F.col(tokens) <= context, F.array(F.col(tokens))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(context), F.greatest(F.col(tokens), F.lit(context)), F.lit(stride)), F.array(F.col(tokens)))))
    w = rows.filter(F.col(tokens) > 1).select(key, F.posexplode(ends).alias("i", "end"), ends.alias("ends"))
    last = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(1)
    return w.select(key, F.greatest(F.col("end") - context, F.lit(0)).alias("begin"), "end", last.alias("score_from"))
