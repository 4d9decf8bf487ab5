"""Sharding: best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: For packing, group sizes are rounded up to this many leading bits, so a histogram of sizes has at most
#: 2**(BITS - 1) classes an octave (about 250,000 up to 2**48) whatever the input. Sizes below 2**BITS are exact; others
#: count for at most one part in 2**(BITS - 1) more than they have, and never for less, so no bin is overfilled.
BITS = 14


def rounded_up(size: F.Column) -> F.Column:
    """size rounded up to BITS leading bits."""
    shift = F.greatest(F.length(F.bin(size)) - F.lit(BITS), F.lit(0)).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (F.ceil(size / step) * step).cast("long")


class Rooms:
    """Open bins by remaining room, in a balanced tree (a treap): each step takes a time that is logarithmic in the bins."""

    def __init__(self) -> None:
        self.key: list[tuple[int, int]] = []
        self.rank: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.root, self.dice = -1, random.Random(1)

    def split(self, node: int, key: tuple[int, int]) -> tuple[int, int]:
        """The nodes below `key`, and the others."""
        if node < 0:
            return -1, -1
        if self.key[node] < key:
            self.right[node], other = self.split(self.right[node], key)
            return node, other
        other, self.left[node] = self.split(self.left[node], key)
        return other, node

    def merge(self, a: int, b: int) -> int:
        """One tree of two, all of whose keys are in order."""
        if a < 0 or b < 0:
            return max(a, b)
        if self.rank[a] > self.rank[b]:
            self.right[a] = self.merge(self.right[a], b)
            return a
        self.left[b] = self.merge(a, self.left[b])
        return b

    def add(self, room: int, bin_: int) -> None:
        self.key.append((room, bin_))
        self.rank.append(self.dice.random())
        self.left.append(-1)
        self.right.append(-1)
        below, above = self.split(self.root, (room, bin_))
        self.root = self.merge(self.merge(below, len(self.key) - 1), above)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of `size` or more; of equal rooms the first opened."""
        below, above = self.split(self.root, (size, -1))
        if above < 0:
            self.root = below
            return None
        node = above
        while self.left[node] >= 0:
            node = self.left[node]
        found, rest = self.split(above, (self.key[node][0], self.key[node][1] + 1))
        self.root = self.merge(below, rest)
        return self.key[found]


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Pack (size, count) classes, largest first, each item into the tightest bin that still holds it.

    Returns (size, first rank, last rank + 1, bin); None if more than `bins` bins are needed. Items above
    the capacity get a bin each. Items of one size go into a bin together, since best fit would put them
    there one after the other.
    """
    rooms = Rooms()
    plan, opened = [], 0
    for size, count in sorted(histogram, reverse=True):
        done = 0
        while done < count:
            if size > capacity:
                n, target, left = 1, opened, 0
                opened += 1
            elif (fit := rooms.tightest(size)) is not None:
                left, target = fit
                n = min(count - done, left // size)
                left -= n * size
            else:
                target, n = opened, min(count - done, capacity // size)
                left, opened = capacity - n * size, opened + 1
            if bins is not None and opened > bins:
                return None
            if left:
                rooms.add(left, target)
            plan.append((size, done, done + n, target))
            done += n
    return plan


def tightest_capacity(histogram: list[tuple[int, int]], bins: int) -> int:
    """The smallest capacity (to one part in 10,000) at which best-fit decreasing needs at most `bins` bins.

    A group larger than a fair share has a bin of its own, and the share of the rest is taken anew.
    """
    total, left = sum(s * n for s, n in histogram), bins
    for size, count in sorted(histogram, reverse=True):
        for _ in range(count):
            if left > 1 and size * left > total:
                total, left = total - size, left - 1
            else:
                break
        else:
            continue
        break
    low = max(1, -(-total // left))
    high = low
    while best_fit_decreasing(histogram, high, bins) is None:
        high += max(1, high // 64)
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(histogram, middle, bins) else (middle, high)
    return high


def ranked(rows: DataFrame, key: str, by: F.Column, order: list[str], name: str, chunks: int) -> DataFrame:
    """Number the rows of each key from 0 without gaps, chunk by chunk, so that no task holds a whole key."""
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64(by), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "__chunk").agg(F.count("*").alias("__n"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(key, "__chunk").orderBy(*order)
    return (
        rows.withColumn("__at", F.row_number().over(inside) - 1)
        .join(starts, [key, "__chunk"])
        .withColumn(name, (F.col("__at") + F.col("__start")).cast("long"))
        .drop("__chunk", "__at", "__start")
    )


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack groups of equal texts into shards by best-fit decreasing; a group is never divided.

    With `capacity` (bytes) as few shards as best fit needs are opened; otherwise the smallest capacity is
    searched that fits into `shards` shards, which makes their sizes near equal. A group larger than a
    shard's share has a shard to itself. A row's size is its text's UTF-8 bytes plus 1; null text has no
    bytes and is grouped with empty text. Repeated rows are rows of their own; null ids are numbered like
    any other. An empty table gives an empty table. A long text counts by its bytes only; texts are not shuffled. Only id and text
    are read, so other columns cannot clash. Of groups of one size the order of digests decides, of equal bins the first opened.

    The driver sees the histogram of group sizes alone, whose length BITS bounds whatever the input. Groups
    of one size take their bins by rank, and ranks are counted chunk by chunk.

    Returns id, size, text_crc32, law ('bytes'), shard, slot (from 0 within the shard), grown_shard (null).
    """
    spark = docs.sparkSession
    chunks = max(256, 2 * shuffle_partitions(spark))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")).select("digest", rounded_up(F.col("bytes")).alias("item")), "shard-groups")
    histogram = [(r["item"], r["count"]) for r in groups.groupBy("item").count().collect()]
    plan = best_fit_decreasing(histogram, capacity or tightest_capacity(histogram, shards)) if histogram else []
    plan = spark.createDataFrame(plan, "item long, first long, beyond long, shard int")
    if capacity is None:
        plan = F.broadcast(plan)  # a row for each size class and shard at most; with a capacity the bins grow with the data
    placed = (
        ranked(groups, "item", F.col("digest"), ["digest"], "rank", chunks)
        .join(plan, "item")
        .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
        .select("digest", "shard")
    )
    dealt = rows.join(placed.hint("merge"), "digest").drop("digest")
    return ranked(dealt, "shard", F.col("id"), ["id", "text_crc32"], "slot", chunks).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
