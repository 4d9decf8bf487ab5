"""Connected components of a graph too large for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The smallest node that each node of edges (u, v) reaches, as (node, component).

    Alternates large-star and small-star steps (each one aggregate and one join, both of which combine or
    split a hot node's edges) until the edges stop changing; each step is written to the shared folder, so a lost executor costs
    one step. Nodes without edges have no row; loops are ignored. The number of steps grows with the
    logarithm of the longest chain.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), name)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        e = materialize(small, name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
