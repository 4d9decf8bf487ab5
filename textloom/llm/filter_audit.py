"""What filters do to each other: Shapley values and survivors from the multilinear extension of removal."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The filters; bit i of a mask is set if filter i fails.
FILTERS = "ABCDE"
#: Fixed values of the failure conditions.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
SPACES = r"[ \t-\r]+"
#: All orders of the filters; sums over them are whole, as every share has a divisor of this number below the line.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SCALE = factorial(len(FILTERS))
#: One row for each order and step: the filter applied, its mask, and the mask of those before it.
STEPS = [(o, k + 1, FILTERS.index(o[k]), 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(c) for c in o[:k])) for o in ORDERS for k in range(len(FILTERS))]


def own_failures() -> Column:
    """The mask of A to D, which a text (column `text`, not null) decides by itself, as an int."""
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * capitals.cast("long") > MOST_CAPITALS * F.length("text").cast("long"),
        F.col("text").rlike(SYMBOLS),
    ]
    return reduce(lambda a, b: a + b, (f.cast("int") * (1 << i) for i, f in enumerate(fails)))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail, with their labels.

    Of equal texts only the smallest id passes E. That is a join on digest and id, so the copies of a hot text lie in
    different tasks. Rows are materialized without their texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = materialize(rows.select("id", "part", own_failures().alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("first")).withColumn("passes", F.lit(True)).withColumnRenamed("digest", "of")
    marked = rows.join(first, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")), "left")
    mask = F.col("mask") + F.when(F.col("passes"), 0).otherwise(1 << FILTERS.index("E"))
    marks = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("good or toxic")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counted = marked.select("id", "part", mask.alias("mask")).join(marks, "id", "left")
    return counted.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def subsets() -> Column:
    return F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))


def total(of: Column, term) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda s, t: s + term(t))


def removal_polynomial(counts: Column) -> Column:
    """Coefficients, by set of filters, of the polynomial R(x) of the documents removed if filter i is applied with probability x_i.

    `counts` is an array by mask. A document that fails the set m stays with probability prod(1 - x_i, i in m); multiplied out,
    the coefficient of a set T other than the empty one is (-1)^(|T| + 1) times the documents that fail all of T.
    """

    def coefficient(t: Column) -> Column:
        all_of = total(F.filter(subsets(), lambda m: m.bitwiseAND(t) == t), lambda m: F.get(counts, m))
        return F.when(t == 0, F.lit(0).cast("long")).otherwise((2 * F.pmod(F.bit_count(t), F.lit(2)) - 1) * all_of)

    return F.transform(subsets(), coefficient)


def corners(polynomial: Column) -> Column:
    """R at each corner of the cube: what a set of filters removes, by set."""
    return F.transform(subsets(), lambda s: total(F.filter(subsets(), lambda t: t.bitwiseAND(s) == t), lambda t: F.get(polynomial, t)))


def shapley(polynomial: Column) -> Column:
    """By filter, SCALE times the integral of dR/dx_i along the diagonal x = (t, ..., t) from 0 to 1.

    The derivative of a term of T is its coefficient times t^(|T| - 1) if i is in T, whose integral is the coefficient over |T|.
    SCALE is a multiple of every |T|, so these fractions are whole numbers over SCALE and nothing is rounded.
    """
    weights = F.lit([0] + [SCALE // k for k in range(1, len(FILTERS) + 1)])

    def value(i: Column) -> Column:
        having = F.filter(subsets(), lambda t: F.getbit(t, i) == 1)
        return total(having, lambda t: F.get(polynomial, t) * F.get(weights, F.bit_count(t)))

    return F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), value)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter removes in each order of the five, for each part of the documents, and its Shapley value.

    Words are runs without ASCII white space. A document fails A with under 200 words, B if under half its words are distinct,
    C if over 2 % of its code points are A-Z, D with any of # $ % & * |, E if a document of smaller id has the same text,
    whatever its part and whether it was removed. A part's counts by mask of failures (32 at most) give the removal
    polynomial; its corners say what any set of filters removes, so no order is ever run over documents. A part, however large, is
    counted by partial aggregates.

    Null text counts as empty, a null part as the empty string. A null id is larger than any other and has no label. Rows
    that repeat the smallest id of a text all pass E. A document counts as good or toxic if any of its labels says so. A long
    text is one row of a task. An empty table gives an empty table. Only the named columns are read, so others cannot clash.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    dense = lambda kind: F.transform(subsets(), lambda m: F.coalesce(F.try_element_at("masks", m)[kind], F.lit(0).cast("long")))
    kinds = ("n", "good", "toxic")
    parts = counts.groupBy("part").agg(by_mask.alias("masks"), F.sum("n").alias("documents")).select("part", "documents", *(removal_polynomial(dense(k)).alias(k) for k in kinds))
    values = parts.select("part", "documents", shapley(F.col("n")).alias("shapley"), *(corners(F.col(k)).alias(k) for k in kinds))
    columns = zip(("filter_order", "step", "bit", "own", "before"), zip(*STEPS))
    steps = F.explode(F.arrays_zip(*(F.lit(list(values)).alias(name) for name, values in columns))).alias("at")
    rows = values.select("*", steps).select("*", "at.*")
    own, after = F.col("own"), F.col("before") + F.col("own")
    removed = lambda kind: F.get(kind, after) - F.get(kind, F.col("before"))
    everything = F.lit(2 ** len(FILTERS) - 1)
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("documents") - F.get("n", after)).alias("kept"), removed("n").alias("removed"),
        (F.get("n", own) - removed("n")).alias("redundant"), (F.get("n", everything) - F.get("n", everything - own)).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("shapley", F.col("bit")).alias("shapley"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY text) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
    CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
  FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT concat(v.x, w.x, y.x, z.x, u.x) AS filter_order FROM x AS v, x AS w, x AS y, x AS z, x AS u
  WHERE len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o),
r AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, contains(fails, filter_order[step]) AS own,
    len(list_intersect(string_split(fails, ''), string_split(filter_order[1:step - 1], ''))) > 0 AND step > 1 AND fails <> '' AS gone, fails = filter_order[step] AS only_own
  FROM m, s),
g AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM g
"""
