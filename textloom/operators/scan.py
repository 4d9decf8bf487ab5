"""Scans over long groups in two levels: inside blocks of neighbouring places, then over the blocks' summaries.

A window over a whole group is one task's work; here a group is as many tasks as it has blocks, and only one row a block is scanned in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a block; bounds the rows of a task's window and, with the group's length, those of the second level.
BLOCK = 4096


def blocked(rows: DataFrame, by: list[str], place: str, block: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(place) / block))


def running_sums(rows: DataFrame, by: list[str], place: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Rows with the sums, by name, of values up to their place, itself included; null counts as 0. Places are whole numbers, one row each; null keys are a key."""
    own = {f"_own_{name}": F.coalesce(value, F.lit(0)).cast("long") for name, value in values.items()}
    valued = blocked(rows, by, place, block).withColumns(own)
    over = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = valued.groupBy(*by, "_block").agg(*(F.sum(c).alias(c) for c in own))
    before = sums.select(*by, "_block", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_before{c}") for c in own))
    upto = Window.partitionBy(*by, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    met = joined(valued.withColumns({c: F.sum(c).over(upto) for c in own}), before, by)
    return met.withColumns({name: F.col(f"_own_{name}") + F.col(f"_before_own_{name}") for name in values}).drop("_block", *own, *(f"_before{c}" for c in own))


def running_sum(rows: DataFrame, by: list[str], place: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    return running_sums(rows, by, place, {name: value}, block)


def joined(local: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """local with its block's summary; null keys meet too."""
    keys = [*by, "_block"]
    right = summary.select(*(F.col(k).alias(f"_s_{i}") for i, k in enumerate(keys)), *(c for c in summary.columns if c not in keys))
    met = local.join(right, [F.col(k).eqNullSafe(F.col(f"_s_{i}")) for i, k in enumerate(keys)], "left")
    return met.drop(*(f"_s_{i}" for i in range(len(keys))))


def carried_suffix(rows: DataFrame, by: list[str], place: str, body: str, end: str, keep: int, block: int = BLOCK) -> DataFrame:
    """Rows with `before`, the last `keep` characters of all bodies before their place joined in order, and `cursor`, the end of the last of these.

    A body is any text but null and ''; rows without one only look back. No prefix is ever built: a body has a character at least, so the
    last `keep` bodies hold all that can count, and what is passed from row to row and block to block is a text of `keep` characters at most.
    Nothing before gives '' and 0. Places are whole numbers, one row each.
    """
    held = F.nullif(F.right(F.col(body), F.lit(keep)), F.lit(""))
    cut = blocked(rows, by, place, block).withColumns({"_tail": held, "_end": F.when(held.isNotNull(), F.col(end).cast("long"))})
    local = _suffixes(cut, [*by, "_block"], place, keep)
    last = local.groupBy(*by, "_block").agg(F.max_by("_upto", F.when(F.col("_tail").isNotNull(), F.col(place))).alias("_tail"), F.max_by("_end", F.when(F.col("_tail").isNotNull(), F.col(place))).alias("_end"))
    carry = _looking_back(_suffixes(last, by, "_block", keep), by, "_block").select(*by, "_block", F.col("_seen").alias("_carried"), F.col("_at").alias("_carried_at"))
    met = joined(_looking_back(local, [*by, "_block"], place), carry, by)
    before = F.right(F.concat(F.coalesce("_carried", F.lit("")), F.coalesce("_seen", F.lit(""))), F.lit(keep))
    return met.withColumns({"before": before, "cursor": F.coalesce("_at", "_carried_at", F.lit(0).cast("long"))}).drop("_block", "_tail", "_end", "_upto", "_seen", "_at", "_carried", "_carried_at")


def _suffixes(rows: DataFrame, by: list[str], place: str, keep: int) -> DataFrame:
    """Rows with `_upto`: the last characters of the bodies up to each body, itself included; null for rows without one."""
    bodies = Window.partitionBy(*by, F.col("_tail").isNull()).orderBy(place).rowsBetween(1 - keep, 0)
    return rows.withColumn("_upto", F.when(F.col("_tail").isNotNull(), F.right(F.array_join(F.collect_list("_tail").over(bodies), ""), F.lit(keep))))


def _looking_back(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"_seen": F.last("_upto", ignorenulls=True).over(before), "_at": F.last("_end", ignorenulls=True).over(before)})
