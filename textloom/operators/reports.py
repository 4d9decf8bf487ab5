"""Splits, folds and the counts that reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def hash_rank(rows: DataFrame, key: str, by: list[str] | None = None, seed: str = "") -> DataFrame:
    """rows with `rank`, from 0 in each group, in the order of a seeded hash of the key: a shuffle that a rerun repeats.

    Ranks are counted in 4,096 ranges of the hash and shifted by the ranges before, so that a group of any size is
    dealt to many tasks. Rows of one key follow each other in no stated order. A null key is hashed as an empty text.
    """
    by = by or []
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)))
    dealt = rows.withColumn("_hash", digest).withColumn("_range", F.substring("_hash", 1, 3))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_range"]])
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_hash", key)) - 1
    placed = dealt.withColumn("_own", own)
    return placed.alias("d").join(shift.alias("s"), same).select(*(F.col(f"d.{c}") for c in rows.columns), (F.col("d._own") + F.col("s._shift")).cast("long").alias("rank"))


def stratified_split(rows: DataFrame, key: str, stratum: str, seed: str = "", every: int = 3) -> DataFrame:
    """rows with `rank` and `split`: within a stratum each `every`-th row in hash order, from the first, is test, the rest calibration."""
    ranked = hash_rank(rows, key, [stratum], seed)
    return ranked.withColumn("split", F.when(F.col("rank") % every == 0, "test").otherwise("calibration"))


def group_folds(rows: DataFrame, group: str, folds: int = 5, seed: str = "") -> DataFrame:
    """rows with `fold`: groups are dealt to folds in hash order and stay together; null is a group of its own."""
    dealt = hash_rank(rows.select(group).distinct(), group, seed=seed)
    dealt = dealt.select(F.col(group).alias("_group"), (F.col("rank") % folds).cast("int").alias("fold"))
    return rows.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def fold_metrics(rows: DataFrame, fold: str, group: str, value: str) -> DataFrame:
    """(fold, n, median, p90, held_out, training): the values held out in each fold and the distinct groups on either side."""
    held = rows.groupBy(fold).agg(
        F.count("*").alias("n"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(value, F.lit(0.9)), 6).alias("p90"),
        F.sort_array(F.collect_set(group)).alias("held_out"),
    )
    # a group is in the training of every fold but that which alone holds it
    pairs = rows.filter(F.col(group).isNotNull()).select(fold, group).distinct()
    alone = pairs.groupBy(group).agg(F.count("*").alias("n"), F.min(fold).alias("only")).filter("n = 1").groupBy("only").agg(F.collect_set(group).alias("own"))
    every = pairs.filter(F.col(fold).isNotNull()).agg(F.collect_set(group).alias("every"))
    both = held.join(alone, F.col(fold) == F.col("only"), "left").join(F.broadcast(every))  # one row
    training = F.sort_array(F.array_except("every", F.coalesce("own", F.array().cast("array<string>"))))
    return both.select(*held.columns, F.when(F.col(fold).isNull(), F.array().cast("array<string>")).otherwise(training).alias("training"))


def band_counts(rows: DataFrame, band: str, split: str, bands: tuple[str, ...] = ("in range", "weak", "alarm")) -> DataFrame:
    """(split, n, one count a band) for each split and, as split 'all', for all rows; a null split is 'none'."""
    named = rows.select(F.coalesce(F.col(split), F.lit("none")).alias("split"), band)
    counts = [F.count_if(F.col(band) == b).alias(b.replace(" ", "_")) for b in bands]
    return named.rollup("split").agg(F.count("*").alias("n"), *counts).withColumn("split", F.coalesce("split", F.lit("all")))


def dominant(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the commonest value of each group, the lowest among equals; null values don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b")).select(by, F.col("b.v").alias(value), (-F.col("b.n")).alias("n"))


def lexicon(*names: DataFrame) -> DataFrame:
    """(name, length) of all distinct, non-empty names of one-column tables, longest first."""
    every = reduce(DataFrame.union, names).toDF("name")
    return every.filter(F.length("name") > 0).distinct().withColumn("length", F.length("name").cast("long")).orderBy(F.desc("length"), "name")


def worst(rows: DataFrame, score: str, key: str, k: int = 5) -> DataFrame:
    """The k rows of lowest score; a row without a score comes last."""
    return rows.orderBy(F.asc_nulls_last(score), key).limit(k)


def longest(rows: DataFrame, by: str, text: str) -> DataFrame:
    """(by, text, length): the longest text of each group, the first in order among equals."""
    found = rows.filter(F.col(text).isNotNull()).groupBy(by).agg(F.min(F.struct((-F.length(text)).alias("n"), F.col(text).alias("t"))).alias("b"))
    return found.select(by, F.col("b.t").alias(text), (-F.col("b.n")).cast("long").alias("length"))


def top_signals(centers: DataFrame, key: str, vector: str, k: int = 6) -> DataFrame:
    """(key, i, z, rank): the k coordinates of each centre that lie farthest from 0."""
    parts = centers.select(key, F.posexplode(vector).alias("i", "z"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("z"), 6)), "i")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "i", F.round("z", 6).alias("z"), "rank")


def change_counts(before: DataFrame, after: DataFrame, by: list[str], keys: list[str], text: str) -> DataFrame:
    """(by, unchanged, needs_review, new, removed) of two versions whose keys are not repeated; null texts are equal."""
    a, b = (d.select(*by, *keys, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(h)) for d, h in ((before, "_before"), (after, "_after")))
    both = a.join(b, [*by, *keys], "full")
    old, new = F.col("_before"), F.col("_after")
    return both.groupBy(*by).agg(
        F.count_if(old == new).alias("unchanged"), F.count_if(old != new).alias("needs_review"),
        F.count_if(old.isNull()).alias("new"), F.count_if(new.isNull()).alias("removed"),
    )


def marked_neighbours(rows: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """rows with `before` and `after`: the closest values that are not null on either side, the row's own left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    past, coming = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("before", F.last(value, ignorenulls=True).over(past)).withColumn("after", F.first(value, ignorenulls=True).over(coming))


def aliases(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, names, primary): the distinct names of each id in order, and the first."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("names")).withColumn("primary", F.get("names", F.lit(0)))


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; a null key has none."""
    known = parents.select(F.col(parent_key).alias("_parent"))
    return rows.join(known, rows[key] == F.col("_parent"), "left_anti")


def routed(rows: DataFrame, routes: DataFrame, key: str, route: str) -> DataFrame:
    """rows with their route and `problem` where there is none; routes have one row a key."""
    known = routes.select(F.col(key).alias("_key"), F.col(route))
    found = rows.join(known, rows[key] == F.col("_key"), "left").drop("_key")
    return found.withColumn("problem", F.when(F.col(route).isNull(), "no route"))


#: Rows of a task in `dealt`, on average.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, key: str, per_task: int | None = None) -> DataFrame:
    """rows by key over as many tasks as hold `per_task` of them each, and not fewer than a shuffle has: what windows and groups of a key hold in a task does not grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // (per_task or TASK_ROWS))), key)


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, m, r): the median of each group and how far its values lie apart; null values don't count.

    Equal values are added up first, and the middle is found by running counts over them: rows of fixed width that can be spilled, no list or map a group.
    """
    counts = rows.groupBy(*by, value).agg(F.count(value).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumns({"_upto": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    holds = lambda place: F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col(value))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return placed.groupBy(*by).agg(((F.max(holds(low)).cast("double") + F.max(holds(high))) / 2).alias("m"), (F.max(value) - F.min(value)).alias("r"))


def item_report(ratings: DataFrame, key: str, rounds: int = 3, most_total: float = 10, most_dimension: float = 1) -> DataFrame:
    """(key, rounds, total, total_range, status) of ratings (key, round, dimension, score), one row a round and dimension.

    A round's total is five times the sum of its scores; an item's is five times the sum of its dimensions' medians. An item
    without `rounds` rounds is incomplete and has no total; it is stable if its rounds' totals lie within `most_total`
    and the scores of every dimension within `most_dimension`.
    """
    per_round = ratings.groupBy(key, "round").agg((5 * F.sum("score")).alias("t")).groupBy(key).agg(F.count("*").alias("rounds"), (F.max("t") - F.min("t")).alias("total_range"))
    dims = spread(ratings, [key, "dimension"], "score")
    dims = dims.groupBy(key).agg((5 * F.sum("m")).alias("total"), F.max("r").alias("_widest"))
    whole = F.col("rounds") == rounds
    status = F.when(~whole, "incomplete").when((F.col("total_range") <= most_total) & (F.col("_widest") <= most_dimension), "stable").otherwise("unstable")
    both = per_round.join(dims, key)
    return both.select(key, "rounds", F.when(whole, F.col("total")).cast("double").alias("total"), F.when(whole, F.col("total_range")).cast("double").alias("total_range"), status.alias("status"))


def calibration_status(report: DataFrame, by: str, wanted: int = 12, least: int = 11) -> DataFrame:
    """(by, items, completed, stable, status): incomplete unless `wanted` items are there and complete; passed from `least` stable ones on."""
    g = report.groupBy(by).agg(F.count("*").alias("items"), F.count_if(F.col("status") != "incomplete").alias("completed"), F.count_if(F.col("status") == "stable").alias("stable"))
    status = F.when((F.col("items") != wanted) | (F.col("completed") != wanted), "incomplete").when(F.col("stable") >= least, "passed").otherwise("failed")
    return g.withColumn("status", status)


def both_orders(votes: DataFrame, pair: str, winner: str) -> DataFrame:
    """(pair, rounds, winner, status): a pair shown in both orders is won only if both votes name one winner; null is a tie."""
    g = votes.groupBy(pair).agg(F.count("*").alias("rounds"), F.count(winner).alias("_named"), F.min(winner).alias("_low"), F.max(winner).alias("_high"))
    agreed = (F.col("rounds") == 2) & (F.col("_named") == 2) & (F.col("_low") == F.col("_high"))
    status = F.when(F.col("rounds") < 2, "incomplete").when(agreed, "agreed").otherwise("no agreement")
    return g.select(pair, "rounds", F.when(agreed, F.col("_low")).alias(winner), status.alias("status"))


def exit_code(errors: Column, incomplete: Column, pending: Column) -> Column:
    """1 with errors, else 2 if something is incomplete, else 3 if something is pending, else 0."""
    return F.when(errors > 0, 1).when(incomplete > 0, 2).when(pending > 0, 3).otherwise(0)


def mixed_band(feature: Column, language: Column) -> tuple[Column, Column, Column]:
    """0.6 feature + 0.4 language; its band, alarm where either is under 5; whether they lie more than 20 apart."""
    overall = 0.6 * feature + 0.4 * language
    band = F.when((feature < 5) | (language < 5), "alarm").when(overall < 20, "weak").otherwise("in range")
    return overall, band, F.abs(feature - language) > 20


def group_report(fragments: DataFrame, by: str, key: str, value: str, vector: str, centers: DataFrame, label: str) -> DataFrame:
    """(by, fragments, mean_value, vote, cluster) of each group: the cluster that most fragments are nearest to (ties: the smallest), and the one
    that the mean of their vectors is nearest to. centers (label, centroid). Null vectors don't vote; a group of such only has neither."""
    own = fragments.filter(F.col(vector).isNotNull())
    near = stats.assign(own, centers, key, vector, label)
    votes = own.select(key, by).join(near.select(key, label), key).groupBy(by, label).agg(F.count("*").alias("_n"))
    vote = votes.groupBy(by).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("vote"))
    middle = stats.assign(stats.centroids(own, vector, by).withColumnRenamed("centroid", vector), centers, by, vector, label).select(by, F.col(label).alias("cluster"))
    counts = fragments.groupBy(by).agg(F.count("*").alias("fragments"), F.avg(value).alias("mean_value"))
    return counts.join(vote, by, "left").join(middle, by, "left")


def without_features(rows: DataFrame, feature: str, prefixes: tuple[str, ...], names: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the long form whose feature has none of the prefixes and none of the names."""
    dropped = F.col(feature).isin(*names) if names else F.lit(False)
    for prefix in prefixes:
        dropped = dropped | F.startswith(F.col(feature), F.lit(prefix))
    return rows.filter(~dropped)
