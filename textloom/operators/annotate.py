"""Rule classification, inheritance along a sequence, variants at a place, zero-filled counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of the rules (name, pattern) that a text meets, in the order of the rules."""
    return F.filter(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)) for name, pattern in rules)), lambda x: x.isNotNull())


def classify(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """(key, categories, primary): all matching categories; the first rule's is primary, `other` if none matches."""
    found = rows.select(key, matched_rules(F.col(text), rules).alias("categories"))
    return found.select(key, F.array_join("categories", ",").alias("categories"), F.coalesce(F.get("categories", F.lit(0)), F.lit(other)).alias("primary"))


def count_by(rows: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """(name, n) of a multi-valued column, most frequent first, then by name."""
    return rows.select(F.explode_outer(values).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def inherit(rows: DataFrame, by: list[str], order: list[str], event: Column, name: str = "inherited") -> DataFrame:
    """The last event before each row of its group; an event is any value, null where a row has none.

    A reset is an event with its own value (say, an empty string), so it replaces what was inherited before.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(event, ignorenulls=True).over(w))


def bigrams(text: Column) -> Column:
    """Character pairs of a text, with repeats."""
    n = F.length(text)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Multiset bigram similarity 2 |A and B| / (|A| + |B|); equal texts have 1, others without bigrams 0."""
    x, y = bigrams(a), bigrams(b)
    shared = F.aggregate(
        F.array_intersect(x, y), F.lit(0),
        lambda s, g: s + F.least(F.size(F.filter(x, lambda v: v == g)), F.size(F.filter(y, lambda v: v == g))),
    )
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(total > 0, 2.0 * shared / total).otherwise(0.0)


def collate(rows: DataFrame, place: list[str], text: str, close: float = 0.5) -> DataFrame:
    """(place, variants, most_alike, status) of the distinct texts at each place: 'single', 'variants' or 'mixed'.

    Pairs are of distinct texts within one place; similarity is dice.
    """
    kinds = rows.select(*place, text).filter(F.col(text).isNotNull()).distinct()
    pairs = kinds.join(kinds.select(*place, F.col(text).alias("other")), place).filter(F.col(text) < F.col("other"))
    best = pairs.groupBy(*place).agg(F.max(dice(F.col(text), F.col("other"))).alias("most_alike"))
    n = kinds.groupBy(*place).agg(F.count("*").alias("variants")).join(best, place, "left")
    status = F.when(F.col("variants") == 1, "single").when(F.col("most_alike") >= close, "variants").otherwise("mixed")
    return n.select(*place, "variants", F.round(F.coalesce("most_alike", F.lit(0.0)), 6).alias("most_alike"), status.alias("status"))


def collate_shared(rows: DataFrame, place: list[str], text: str, close: float = 0.5) -> DataFrame:
    """collate by counts of shared bigrams: only texts that share one are paired, and texts are not shuffled with pairs.

    Null places are places of their own. Texts are numbered within their place, and the joins stay shuffled ones: counts of bigrams
    are small as shuffle files, so an adaptive plan would send them to the driver, where they are not.
    """
    kinds = rows.filter(F.col(text).isNotNull()).select(F.to_json(F.struct(*place), {"ignoreNullFields": "false"}).alias("at"), *place, F.col(text).alias("t")).distinct()
    n = kinds.groupBy("at", *place).agg(F.count("*").alias("variants"))
    numbered = kinds.withColumn("id", F.row_number().over(Window.partitionBy("at").orderBy("t")))
    grams = numbered.select("at", "id", F.greatest(F.length("t") - 1, F.lit(0)).alias("size"), F.explode(bigrams(F.col("t"))).alias("g"))
    grams = grams.groupBy("at", "id", "size", "g").agg(F.count("*").alias("n"))
    other = grams.select("at", "g", F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("n").alias("n2"))
    shared = grams.hint("merge").join(other, ["at", "g"]).filter("id < id2").groupBy("at", "id", "id2", "size", "size2").agg(F.sum(F.least("n", "n2")).alias("s"))
    best = shared.groupBy("at").agg(F.max(2.0 * F.col("s") / (F.col("size") + F.col("size2"))).alias("most_alike"))
    most = F.coalesce("most_alike", F.lit(0.0))
    status = F.when(F.col("variants") == 1, "single").when(most >= close, "variants").otherwise("mixed")
    return n.hint("merge").join(best, "at", "left").select(*place, "variants", F.round(most, 6).alias("most_alike"), status.alias("status"))


def histogram(rows: DataFrame, value: Column, width: int, first: int, last: int) -> DataFrame:
    """(bin, n): rows with (value - 1) / width in each bin from first to last, zeros included."""
    bins = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bin"))
    counts = rows.select(F.floor((value - 1) / width).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cross_tab(rows: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """Counts by group and status over a fixed list of statuses, zeros included."""
    return rows.groupBy(by).pivot(status, values).agg(F.count("*")).na.fill(0, values)
