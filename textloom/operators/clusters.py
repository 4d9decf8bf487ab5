"""Clusters of points: started from far points, refined in Spark, and a number of clusters chosen by silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import squared_distance
from .stats import IQR, MAD


def clipped(rows: DataFrame, key: str, vector: str, most: float = 5.0) -> DataFrame:
    """(key, point): vectors in robust deviations of each dimension, cut at `most` on both sides; keys are not repeated, null vectors are left out.

    A dimension's scale is 1.4826 MAD, else IQR / 1.349, else 1.
    """
    parts = rows.select(key, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    first = parts.groupBy("i").agg(F.percentile("x", F.lit(0.5)).alias("c"), ((F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))) / IQR).alias("iqr"))
    off = parts.join(first, "i").withColumn("off", F.col("x") - F.col("c"))
    mad = off.groupBy("i").agg((MAD * F.percentile(F.abs("off"), F.lit(0.5))).alias("mad"))
    scale = F.coalesce(F.nullif("mad", F.lit(0.0)), F.nullif("iqr", F.lit(0.0)), F.lit(1.0))
    z = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("off") / scale))
    whole = off.join(mad, "i").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", z.alias("z")))).alias("p"))
    return whole.select(key, F.transform("p", lambda e: e["z"]).alias("point"))


def _constant(center: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in center))


def _label(centers: list[list[float]]) -> Column:
    """The index of the closest centre, the lowest among equals."""
    d = F.array(*(squared_distance(F.col("point"), _constant(c)) for c in centers))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def _means(points: DataFrame, label: Column) -> dict[int, list[float]]:
    """Mean point of each label; only one row a label comes back."""
    parts = points.select(label.alias("l"), F.posexplode("point").alias("i", "x")).groupBy("l", "i").agg(F.avg("x").alias("m"))
    return {r["l"]: [e["m"] for e in r["p"]] for r in parts.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).collect()}


def far_starts(points: DataFrame, key: str, k: int) -> list[list[float]]:
    """k starting centres: the point farthest from the mean, then each time the one farthest from all chosen, the smaller key among equals."""
    against, chosen, names = [_means(points, F.lit(0))[0]], [], []
    while len(chosen) < k:
        d = F.least(*(squared_distance(F.col("point"), _constant(c)) for c in against)) if len(against) > 1 else squared_distance(F.col("point"), _constant(against[0]))
        left = points.filter(~F.col(key).isin(names)) if names else points
        best = left.orderBy(F.desc(d), key).select(key, "point").head(1)
        if not best:
            break
        chosen.append(list(best[0]["point"]))
        names.append(best[0][key])
        against = chosen
    return chosen


def refine(points: DataFrame, centers: list[list[float]], rounds: int = 200) -> list[list[float]]:
    """Centres after rounds of assignment and averaging, until no point changes its cluster; a cluster without points keeps its centre."""
    for _ in range(rounds):
        means = _means(points, _label(centers))
        moved = [means.get(i, c) for i, c in enumerate(centers)]
        if not points.filter(_label(moved) != _label(centers)).head(1):
            return centers
        centers = moved
    return centers


def silhouettes(points: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """(key, cluster, silhouette) of points (key, point, cluster), over the true distances to all other points.

    Points are sent to the executors in blocks; each point gives one sum of distances a cluster and block, by matrix products, so no pairs are
    made. The work grows with the square of the points, which are meant to be means of groups. A point alone in its cluster has 0.
    """
    kind = points.schema[key].dataType.simpleString()
    blocks, parts = max(1, -(-points.count() // block)), None
    for b in range(blocks):
        own = points.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()
        if not len(own):
            continue
        shared = points.sparkSession.sparkContext.broadcast((own[key].to_numpy(), np.stack(own["point"]), own["cluster"].to_numpy()))

        def sums(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, y, clusters = shared.value
            which, at, n = np.unique(clusters, return_inverse=True, return_counts=True)
            member = np.eye(len(which))[at]
            for f in frames:
                for start in range(0, len(f), 512):
                    part = f.iloc[start : start + 512]
                    x = np.stack(part["point"])
                    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))
                    d[part[key].to_numpy()[:, None] == names[None]] = 0
                    yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), len(which)), "cluster": np.repeat(part["cluster"].to_numpy(), len(which)),
                                        "other": np.tile(which, len(part)), "s": (d @ member).ravel(), "n": np.tile(n, len(part))})

        one = points.select(key, "point", "cluster").mapInPandas(sums, f"{key} {kind}, cluster int, other int, s double, n long")
        parts = one if parts is None else parts.unionAll(one)
    if parts is None:
        return points.select(key, "cluster", F.lit(0.0).alias("silhouette"))
    every = parts.groupBy(key, "cluster", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    home = F.col("cluster") == F.col("other")
    both = every.groupBy(key, "cluster").agg(
        F.max(F.when(home & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~home, F.col("s") / F.col("n"))).alias("b"),
    )
    return both.select(key, "cluster", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def clustered(points: DataFrame, key: str, k: int) -> DataFrame:
    """(key, point, cluster): up to k clusters, numbered by their smallest keys."""
    if not points.head(1):
        return points.withColumn("cluster", F.lit(None).cast("int"))
    label = _label(refine(points, far_starts(points, key, k)))
    first = points.groupBy(label.alias("l")).agg(F.min(key).alias("f")).orderBy("f").collect()
    number = F.create_map(*(F.lit(v) for i, r in enumerate(first) for v in (r["l"], i)))
    return points.withColumn("cluster", number[label])


def choices(points: DataFrame, key: str, ks: range = range(2, 7), least: int = 5) -> DataFrame:
    """(k, silhouette, smallest, eligible, chosen): each number of clusters, eligible if all are there with `least` points or more; chosen is the
    eligible one of the best mean silhouette, the smallest among equals."""
    found = []
    for k in ks:
        s = silhouettes(clustered(points, key, k), key)
        sizes = s.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("silhouette").alias("s"))
        row = sizes.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("silhouette"), F.min("n").alias("smallest"), F.count("*").alias("own")).first()
        found.append((k, row["silhouette"], row["smallest"], row["own"] == k and row["smallest"] >= least))
    best = min(((-s, k) for k, s, _, fit in found if fit), default=(None, None))[1]
    schema = "k int, silhouette double, smallest long, eligible boolean, chosen boolean"
    return points.sparkSession.createDataFrame([(*f, f[0] == best) for f in found], schema)
