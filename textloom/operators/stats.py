"""Robust and rank-based statistics, splits, vectors and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import squared_distance

#: The factors that make MAD and IQR estimate a normal deviation.
MAD, IQR = 1.4826, 1.349


def quantiles(counts: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """(by, n, the names of `points`): exact quantiles, interpolated linearly, of distinct values with their counts `c`.

    A group's values are sorted and summed up by a window, which spills; no group is gathered in an aggregate's memory.
    """
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in points.items()}
    held = lambda k: F.max(F.when((F.col("_upto") - F.col("c") <= k) & (k < F.col("_upto")), F.col(value)))
    ends = [c for name in points for c in (held(F.floor(at[name])).alias(f"_low_{name}"), held(F.ceil(at[name])).alias(f"_high_{name}"))]
    found = ranked.groupBy(*by, "n").agg(*ends)
    between = lambda name, low, high: F.when(low == high, low).otherwise((F.ceil(at[name]) - at[name]) * low + (at[name] - F.floor(at[name])) * high)
    return found.select(*by, "n", *(between(name, F.col(f"_low_{name}"), F.col(f"_high_{name}")).alias(name) for name in points))


#: What scale_about asks for.
QUARTILES = {"center": 0.5, "_p25": 0.25, "_p75": 0.75}


def robust_scale(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, center, scale): median, and the first positive of 1.4826 MAD, IQR / 1.349, deviation, 1; rows are reduced to counts of distinct values."""
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("c"))
    return scale_about(counts, quantiles(counts.filter("_v IS NOT NULL"), "_v", by, QUARTILES), by)


def scale_about(counts: DataFrame, first: DataFrame, by: list[str]) -> DataFrame:
    """robust_scale of values `_v` with their counts `c`, given their QUARTILES. A value may be in several rows."""
    off = counts.join(first.select(*by, "center"), by).withColumn("_off", F.col("_v") - F.col("center"))
    # the centre is one of the values or lies between two, so sums about it lose nothing
    mean = F.sum(F.col("c") * F.col("_off")) / F.nullif(F.sum("c"), F.lit(0))
    sd = off.groupBy(*by).agg(F.sqrt(F.greatest(F.sum(F.col("c") * F.col("_off") * F.col("_off")) / F.nullif(F.sum("c"), F.lit(0)) - mean * mean, F.lit(0.0))).alias("sd"))
    spread = quantiles(off.filter("_v IS NOT NULL").select(*by, F.abs("_off").alias("_off"), "c"), "_off", by, {"mad": 0.5}).drop("n")
    zero = F.lit(0.0)
    scale = F.coalesce(F.nullif(MAD * F.col("mad"), zero), F.nullif((F.col("_p75") - F.col("_p25")) / IQR, zero), F.nullif(F.col("sd"), zero), F.lit(1.0))
    return first.join(spread, by).join(sd, by).select(*by, "n", "center", scale.alias("scale"))


def deviations(rows: DataFrame, value: str, by: list[str], keys: list[str], k: int) -> DataFrame:
    """The k rows of each group that lie farthest from its centre, in robust deviations."""
    z = rows.join(robust_scale(rows, value, by), by).withColumn("z", (F.col(value) - F.col("center")) / F.col("scale"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(F.abs("z"), 6)), *keys)
    return z.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, *keys, F.round("z", 6).alias("z"), "rank")


def empirical_share(rows: DataFrame, calibration: DataFrame, value: str) -> DataFrame:
    """rows with `share`: 100 (#{calibration >= value} + 1) / (n + 1); 0 without calibration.

    The calibration values become a step table of distinct values with running counts; rows take their step by a
    window over the union of both, in ranges of the value, so neither side is sent whole to a task.
    """
    n = calibration.filter(F.col(value).isNotNull()).count()
    if not n:
        return rows.withColumn("share", F.lit(0.0))
    steps = calibration.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    wanted = rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct().withColumn("c", F.lit(0).cast("long"))
    every = steps.unionByName(wanted).groupBy("v").agg(F.sum("c").alias("c"))
    low, high = every.agg(F.min("v"), F.max("v")).first()
    width = ((high or 0) - (low or 0)) / 64 or 1.0
    every = every.withColumn("range", F.floor((F.col("v") - F.lit(low)) / F.lit(width)).cast("int"))
    above = every.groupBy("range").agg(F.sum("c").alias("own"))
    above = above.withColumn("higher", F.coalesce(F.sum("own").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("c").over(Window.partitionBy("range").orderBy(F.desc("v")))
    ranked = every.withColumn("within", within).join(above.select("range", "higher"), "range").select("v", (F.col("within") + F.col("higher")).alias("ge"))
    return rows.join(ranked, rows[value] == F.col("v"), "left").withColumn("share", 100.0 * (F.coalesce("ge", F.lit(0)) + 1) / (n + 1)).drop("v", "ge")


def band(share: Column) -> Column:
    """Under 5 alarm, under 20 weak, else in range."""
    return F.when(share < 5, "alarm").when(share < 20, "weak").otherwise("in range")


def aggregate_score(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """0.7 median + 0.3 tenth percentile of each group's scores."""
    score = 0.7 * F.percentile(value, F.lit(0.5)) + 0.3 * F.percentile(value, F.lit(0.1))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(score, 6).alias("score"))


def hash_split(rows: DataFrame, key: str, seed: str = "") -> DataFrame:
    """training, test or calibration by a hash of the key: a pure function of it, so reruns and new rows agree."""
    part = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 6), 16, 10).cast("long") % 3
    return rows.withColumn("split", F.when(part == 0, "training").when(part == 1, "test").otherwise("calibration"))


def covariance(rows: DataFrame, vector: str, shrinkage: float = 0.2, ridge: float = 0.05) -> DataFrame:
    """(i, j, cov): sums of products over n - 1 about the mean, off-diagonals shrunk, the ridge on the diagonal.

    Each Arrow batch gives one partial sum of outer products, so the shuffle carries d x d numbers a batch at most.
    """
    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy()).astype(np.float64)
                d = x.shape[1]
                i, j = np.triu_indices(d)
                yield pd.DataFrame({"i": np.append(i, np.full(d + 1, -1)), "j": np.append(j, np.arange(-1, d)), "s": np.concatenate([(x.T @ x)[i, j], [len(x)], x.sum(axis=0)])})

    got = rows.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x")).mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    means = got.filter("i = -1 and j >= 0").select(F.col("j").alias("k"), F.col("s").alias("m"))
    n = got.filter("i = -1 and j = -1").select(F.col("s").alias("n"))
    cov = (
        got.filter("i >= 0").join(F.broadcast(n)).join(means.select(F.col("k").alias("i"), F.col("m").alias("mi")), "i").join(means.select(F.col("k").alias("j"), F.col("m").alias("mj")), "j")
        .withColumn("c", (F.col("s") - F.col("mi") * F.col("mj") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1.0)))
    )
    return cov.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("c") + ridge).otherwise(F.col("c") * (1 - shrinkage)).alias("cov"))


def centroids(rows: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, centroid): mean vector of each group."""
    means = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))


def nearest(rows: DataFrame, references: DataFrame, key: str, ref_key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """The k references closest to each row, smaller key first among equals.

    References are a stated set, taken in blocks that are each sent to the executors; a block gives k candidates a row, as matrix products, and
    the best of all blocks stay.
    """
    kinds = rows.schema[key].dataType.simpleString(), references.schema[ref_key].dataType.simpleString()
    schema = f"{key} {kinds[0]}, {ref_key} {kinds[1]}, distance double"
    refs = references.filter(F.col(vector).isNotNull()).select(F.col(ref_key).alias("ref"), F.col(vector).cast("array<double>").alias("y"))
    blocks = max(1, -(-refs.count() // block))
    found = None
    for b in range(blocks):
        own = refs.filter(F.pmod(F.xxhash64("ref"), F.lit(blocks)) == b).orderBy("ref").toPandas()
        if not len(own):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((own["ref"].to_numpy(), np.stack(own["y"].to_numpy())))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, y = shared.value
            for f in frames:
                for at in range(0, len(f), 512):
                    part = f.iloc[at : at + 512]
                    x = np.stack(part["x"].to_numpy())
                    rough = np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T)
                    keep = min(k + 8, y.shape[0])
                    near = np.argpartition(rough, keep - 1, axis=1)[:, :keep]
                    exact = np.sqrt(((x[:, None] - y[near]) ** 2).sum(-1)).round(9)
                    order = np.lexsort((ids[near], exact), axis=1)[:, :k]
                    take = np.take_along_axis(near, order, axis=1)
                    yield pd.DataFrame({key: np.repeat(part["key"].to_numpy(), take.shape[1]), ref_key: ids[take].ravel(), "distance": np.take_along_axis(exact, order, axis=1).ravel()})

        one = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")).mapInPandas(search, schema)
        found = one if found is None else found.unionAll(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy(key).orderBy("distance", ref_key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Queries that are compared with a slice of rows at once; bounds the matrices of a worker, however many queries a block has.
ASKED = 256


def nearest_all(queries: DataFrame, rows: DataFrame, key: str, other: str, vector: str, k: int, block: int = 4096, within: str | None = None, cosine: bool = False) -> DataFrame:
    """The k rows closest to each query, of all rows but itself, smaller id first among equals.

    Queries are sent to the executors in blocks; each partition of rows keeps k candidates a query, by matrix products and then
    exactly, and the best of all partitions stay. With `within` only rows of the query's group count; with `cosine` the
    distance is one minus the cosine, and vectors without length have none.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {other} {kind}, distance double"
    columns = [F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), (F.col(within) if within else F.lit(0)).cast("string").alias("group")]
    asked, others = (d.filter(F.col(vector).isNotNull() & (F.col(within).isNotNull() if within else F.lit(True))).select(*columns) for d in (queries, rows))
    blocks = max(1, -(-asked.count() // block))

    def closest(ids: np.ndarray, x: np.ndarray, groups: np.ndarray, names: np.ndarray, y: np.ndarray, of: np.ndarray) -> pd.DataFrame:
        """The nearest few of these rows to each of these queries."""
        rough = x @ y.T
        rough *= -2
        rough += (x * x).sum(1)[:, None]
        rough += (y * y).sum(1)[None]
        rough[(ids[:, None] == names[None]) | np.isnan(rough)] = np.inf
        if within:
            rough[groups[:, None] != of[None]] = np.inf
        keep = min(k + 8, len(y))
        near = np.argpartition(rough, keep - 1, axis=1)[:, :keep]
        i, j = np.nonzero(np.isfinite(np.take_along_axis(rough, near, axis=1)))
        j = near[i, j]
        d = 1 - (x[i] * y[j]).sum(1) if cosine else np.sqrt(((x[i] - y[j]) ** 2).sum(1))
        return pd.DataFrame({key: ids[i], other: names[j], "distance": d.round(9)})

    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if not len(own):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((own["id"].to_numpy(), unit(own["x"]) if cosine else np.stack(own["x"]), own["group"].to_numpy()))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, x, groups = shared.value
            best = None
            for f in frames:
                for at in range(0, len(f), 1024):
                    part = f.iloc[at : at + 1024]
                    y, names, of = unit(part["x"]) if cosine else np.stack(part["x"].to_numpy()), part["id"].to_numpy(), part["group"].to_numpy()
                    new = pd.concat([closest(ids[q : q + ASKED], x[q : q + ASKED], groups[q : q + ASKED], names, y, of) for q in range(0, len(ids), ASKED)])
                    best = new if best is None else pd.concat([best, new])
                    best = best.sort_values([key, "distance", other]).groupby(key).head(k)
            if best is not None and len(best):
                yield best

        one = others.mapInPandas(search, schema)
        found = one if found is None else found.unionAll(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy(key).orderBy("distance", other)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def unit(vectors: pd.Series) -> np.ndarray:
    """Vectors over their lengths; NaN where there is none."""
    x = np.stack(vectors.to_numpy())
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def few_centers(centers: DataFrame, label: str, most: int = 10_000) -> DataFrame | None:
    """One row with an array `centers` of (label, centroid), to be sent to the executors; None if there are more than `most`."""
    if centers.limit(most + 1).count() > most:
        return None
    return centers.agg(F.collect_list(F.struct(F.col(label).alias("label"), "centroid")).alias("centers"))


def assign(rows: DataFrame, centers: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, distance) of the closest centre, the smaller label among equals. Up to 10,000 centres are compared within each row; more are searched in blocks."""
    few = few_centers(centers, label)
    if few is None:
        found = nearest(rows, centers.withColumnRenamed("centroid", vector), key, label, vector, 1)
        return found.select(key, label, F.round("distance", 6).alias("distance"))
    own = rows.filter(F.col(vector).isNotNull()).select(key, F.col(vector).alias("_v")).join(F.broadcast(few))
    d = F.transform("centers", lambda c: F.struct(F.round(F.sqrt(squared_distance(F.col("_v"), c["centroid"])), 9).alias("d"), c["label"].alias("l")))
    best = own.select(key, F.array_min(d).alias("b"))
    return best.select(key, F.col("b.l").alias(label), F.round("b.d", 6).alias("distance"))


def two_means(points: list[tuple[int, list[float]]], rounds: int = 100) -> dict[int, int]:
    """Two clusters of a few group means: the farthest pair starts, the smaller key's cluster is 0; one cluster if
    there are fewer than 6 points or a cluster has fewer than 3."""
    keys, x = [k for k, _ in points], np.array([v for _, v in points], dtype=float)
    if len(keys) < 6:
        return dict.fromkeys(keys, 0)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    i, j = np.unravel_index(np.argmax(d), d.shape)
    centers = x[[min(i, j), max(i, j)]]
    label = np.zeros(len(keys), dtype=int)
    for _ in range(rounds):
        new = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        centers = np.array([x[label == c].mean(0) if (label == c).any() else centers[c] for c in (0, 1)])
    if min((label == 0).sum(), (label == 1).sum()) < 3:
        return dict.fromkeys(keys, 0)
    return {k: int(v != label[int(np.argmin(keys))]) for k, v in zip(keys, label)}


def silhouette(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """Mean simplified silhouette by label: distance to the own centre against the nearest other one."""
    centers = centroids(rows, vector, label)
    few = few_centers(centers, label)
    if few is not None:
        d = F.transform("centers", lambda c: F.struct(c["label"].alias("l"), F.sqrt(squared_distance(F.col(vector), c["centroid"])).alias("d")))
        pairs = rows.select(key, label, vector).join(F.broadcast(few)).select(label, d.alias("d"))
        least = lambda same: F.array_min(F.transform(F.filter("d", lambda x: (x["l"] == F.col(label)) if same else (x["l"] != F.col(label))), lambda x: x["d"]))
        s = pairs.select(label, least(True).alias("own"), least(False).alias("other"))
    else:
        mine = rows.select(key, label, vector).join(centers, label).select(key, label, F.sqrt(squared_distance(F.col(vector), F.col("centroid"))).alias("own"))
        two = nearest(rows, centers.select(F.col(label).alias("_of"), F.col("centroid").alias(vector)), key, "_of", vector, 2)
        s = mine.join(two, key).filter(F.col("_of") != F.col(label)).groupBy(key, label, "own").agg(F.min("distance").alias("other"))
    value = F.coalesce((F.col("other") - F.col("own")) / F.nullif(F.greatest("own", "other"), F.lit(0.0)), F.lit(0.0))
    return s.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("silhouette"))


def inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse of a symmetric positive definite matrix, by sweeping one row after the other.

    LAPACK's threads don't survive the start of the JVM in the driver's process, so no library routine is called here.
    """
    a = matrix.astype(np.float64).copy()
    for k in range(len(a)):
        pivot = a[k, k]
        if pivot < 1e-10:
            raise ValueError(f"the covariance has no inverse (row {k})")
        row, column = a[k] / pivot, a[:, k].copy()
        a -= column[:, None] * row[None]
        a[k], a[:, k] = row, -column / pivot
        a[k, k] = 1 / pivot
    return a


def mahalanobis(rows: DataFrame, vector: str, key: str, shrinkage: float = 0.2, ridge: float = 0.05) -> DataFrame:
    """sqrt(x' C^-1 x / d) and the mean absolute standard score of each vector; C is d x d, inverted on the driver."""
    cov = covariance(rows, vector, shrinkage, ridge).collect()
    if not cov:
        return rows.select(key, F.lit(None).cast("double").alias("mahalanobis"), F.lit(None).cast("double").alias("delta"))
    d = 1 + max(r["j"] for r in cov)
    c = np.zeros((d, d))
    for r in cov:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
    means = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    mean = np.array([m for _, m in sorted((r["i"], r["m"]) for r in means)])
    back, sd = inverse(c), np.sqrt(np.diag(c))

    @F.pandas_udf("struct<mahalanobis:double,delta:double>")
    def distances(xs: pd.Series) -> pd.DataFrame:
        x = np.stack(xs.to_numpy()).astype(float) - mean
        return pd.DataFrame({"mahalanobis": np.sqrt(np.einsum("ni,ij,nj->n", x, back, x) / d).round(6), "delta": np.abs(x / sd).mean(1).round(6)})

    return rows.filter(F.col(vector).isNotNull()).select(key, distances(vector).alias("d")).select(key, "d.*")


def draw(seed: Column | int, k: Column) -> Column:
    """The k-th number in [0, 1) of the counter-based generator with the given seed: a pure function of both."""
    @F.pandas_udf("double")
    def numbers(seeds: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series(mulberry(seeds.to_numpy(dtype=np.int64), ks.to_numpy(dtype=np.int64)))

    return numbers(F.lit(seed).cast("long") if isinstance(seed, int) else seed, k.cast("long"))


def mulberry(seed: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The public-domain Mulberry32 generator's k-th value (k from 1): its state moves by a constant, so any draw is direct."""
    mask = np.uint64(0xFFFFFFFF)
    t = (seed.astype(np.uint64) + k.astype(np.uint64) * np.uint64(0x6D2B79F5)) & mask
    x = ((t ^ (t >> np.uint64(15))) * (t | np.uint64(1))) & mask
    x = (x ^ ((x + ((x ^ (x >> np.uint64(7))) * (x | np.uint64(61)) & mask)) & mask)) & mask
    return ((x ^ (x >> np.uint64(14))) & mask).astype(np.float64) / 2**32


def bootstrap_interval(rows: DataFrame, value: str, key: str, seed: int = 20260918, resamples: int = 500) -> DataFrame:
    """2.5 and 97.5 percent bounds of the mean over resamples; a single row gives its own value.

    Every row takes a Poisson(1) weight in each resample, drawn from its key: resampling needs no join, and each
    partition sums its resamples before the shuffle.
    """
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s = np.zeros(resamples), np.zeros(resamples)
        steps = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))
        for f in frames:
            u = mulberry(np.repeat(f["key"].to_numpy(dtype=np.int64) * 1_000_003 + seed, resamples), np.tile(np.arange(1, resamples + 1), len(f)))
            n = np.searchsorted(steps, u).reshape(len(f), resamples)
            w, s = w + n.sum(0), s + n.T @ f["v"].to_numpy(dtype=float)
        yield pd.DataFrame({"resample": np.arange(resamples), "w": w, "s": s})

    data = rows.filter(F.col(value).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("v"))
    means = data.mapInPandas(sums, "resample int, w double, s double").groupBy("resample").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return data.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).join(F.broadcast(bounds)).select(
        "n", F.round("mean", 6).alias("mean"), *(F.round(F.when(F.col("n") == 1, F.col("mean")).otherwise(F.col(c)), 6).alias(c) for c in ("low", "high"))
    )
