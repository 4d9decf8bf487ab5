"""Whether approved recordings cover an ordered list of targets: bindings that still hold, groups without holes, an exact tiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import BLOCK, blocked, running_sum

#: The columns that bind a recording to its target.
BINDING = ["text_hash", "annotation_hash"]


def numbered(targets: DataFrame, by: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """targets with `position`, 0, 1, 2, ... by `order` within each plan; `order` holds whole numbers, one row each."""
    return running_sum(targets, by, order, F.lit(1), "position", block).withColumn("position", F.col("position") - 1)


def cover_problems(targets: DataFrame, covers: DataFrame, by: str, binding: list[str] = BINDING) -> DataFrame:
    """(by, cover, ordinal, target, problem) of covers (by, cover, ordinal, target, binding) over targets (by, target, position, binding).

    A cover is one recording for the targets of its rows, in the order of `ordinal` (0, 1, ...). Problems, every one that holds: 'unknown target';
    a binding's name and ' differs' (null equals null); 'not next' to the target before it in its cover; 'covered twice', by another row;
    'hole', an ordinal that doesn't follow. Null plans meet nothing.
    """
    known = targets.select(by, "target", F.col("position"), *(F.col(b).alias(f"_{b}") for b in binding))
    rows = covers.select(by, "cover", "ordinal", "target", *binding).join(known, [by, "target"], "left")
    times = covers.groupBy(by, "target").agg(F.count("*").alias("_times"))
    before = rows.select(by, "cover", (F.col("ordinal") + 1).alias("ordinal"), F.col("position").alias("_before"), F.lit(True).alias("_follows")).dropDuplicates([by, "cover", "ordinal"])
    met = rows.join(times, [by, "target"], "left").join(before, [by, "cover", "ordinal"], "left")
    here = F.col("position").isNotNull()
    problems = F.array(
        F.when(~here, "unknown target"),
        *(F.when(here & ~F.col(b).eqNullSafe(F.col(f"_{b}")), F.lit(b.replace("_", " ") + " differs")) for b in binding),
        F.when(here & (F.col("position") != F.col("_before") + 1), "not next"),
        F.when(here & (F.col("_times") > 1), "covered twice"),
        F.when((F.col("ordinal") > 0) & F.col("_follows").isNull(), "hole"),
    )
    return met.select(by, "cover", "ordinal", "target", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def segments(targets: DataFrame, covers: DataFrame, by: str) -> DataFrame:
    """(by, cover, begin, end, n): the stretch of positions of each cover, and of each target that no cover has, which stands alone (cover null)."""
    placed = targets.select(by, "target", "position").join(covers.select(by, "cover", "target"), [by, "target"], "left")
    alone = F.when(F.col("cover").isNull(), F.col("position"))
    return placed.groupBy(by, "cover", alone.alias("_alone")).agg(F.min("position").alias("begin"), (F.max("position") + 1).alias("end"), F.count("*").alias("n")).drop("_alone")


def tiling_problems(intervals: DataFrame, totals: DataFrame, by: str, begin: str = "begin", end: str = "end", block: int = BLOCK) -> DataFrame:
    """(by, begin, end, problem): every maximal stretch of 0 to `total` (by, total) that intervals leave open ('gap'), cover more than once
    ('overlap', one row each stretch of equal depth, with its depth), or cover beyond the ends ('outside').

    A sweep over the ends: ends of equal place are added up first, the depth behind each is a running sum in blocks, and a stretch reaches to the
    next place, which is in the same block or the first of the next. Ends are dealt once, by plan and block. A null plan has no stretches. Intervals that are empty or turned round are 'empty' themselves. Plans without intervals are one gap; without a total, all outside.
    """
    sound = intervals.filter(F.col(begin) < F.col(end))
    empty = intervals.filter(~F.coalesce(F.col(begin) < F.col(end), F.lit(False))).select(by, F.col(begin).cast("long").alias("begin"), F.col(end).cast("long").alias("end"), F.lit("empty").alias("problem"), F.lit(0).cast("long").alias("depth"))
    edge = lambda place, step, inside: F.struct(place.cast("long").alias("place"), F.lit(step).alias("step"), F.lit(inside).alias("inside"))
    edges = sound.select(by, F.inline(F.array(edge(F.col(begin), 1, 0), edge(F.col(end), -1, 0))))
    frame = totals.select(by, F.inline(F.array(edge(F.lit(0), 0, 1), edge(F.col("total"), 0, -1))))
    dealt = blocked(edges.unionByName(frame).filter(F.col(by).isNotNull()), [by], "place", block).repartition(by, "_block")
    summed = dealt.groupBy(by, "_block", "place").agg(F.sum("step").alias("step"), F.sum("inside").alias("inside"))
    blocks = Window.partitionBy(by).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    sums = summed.groupBy(by, "_block").agg(F.sum("step").alias("step"), F.sum("inside").alias("inside"), F.min("place").alias("first"))
    carried = sums.select(by, "_block", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("_depth"), F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("_in"), F.lead("first").over(blocks).alias("_first"))
    within = Window.partitionBy(by, "_block").orderBy("place")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = summed.select(by, "_block", "place", F.sum("step").over(upto).alias("depth"), F.sum("inside").over(upto).alias("in"), F.lead("place").over(within).alias("end"))
    met = local.join(carried, [by, "_block"]).withColumn("end", F.coalesce("end", "_first")).filter("end IS NOT NULL")
    stretches = met.select(by, F.col("place").alias("begin"), "end", (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("in") + F.col("_in")).alias("in"))
    problem = F.when((F.col("in") == 0) & (F.col("depth") > 0), "outside").when((F.col("in") == 1) & (F.col("depth") == 0), "gap").when((F.col("in") == 1) & (F.col("depth") > 1), "overlap")
    return stretches.select(by, "begin", "end", problem.alias("problem"), "depth").filter("problem IS NOT NULL").unionByName(empty)


def alignment_counts(rows: DataFrame, by: str, status: str, aligned: str = "aligned", paused: str = "paused") -> DataFrame:
    """(by, blocks, aligned, paused, sound) of each scene; a scene with any paused block, or none at all that is aligned, is not sound."""
    n = rows.groupBy(by).agg(F.count("*").alias("blocks"), F.count_if(F.col(status) == aligned).alias("aligned"), F.count_if(F.col(status) == paused).alias("paused"))
    return n.withColumn("sound", (F.col("paused") == 0) & (F.col("aligned") > 0))


def unpaused(rows: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """rows, unchanged, if no scene of the counts is unsound; else the job that reads them fails and names a scene."""
    bad = counts.filter("NOT sound").agg(F.count("*").alias("_n"), F.min(F.col(by).cast("string")).alias("_one"))
    sound = bad.select(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.lit("blocks are paused in "), F.col("_one"))).cast("boolean")).otherwise(F.lit(True)))
    return rows.filter(sound.scalar())
