"""Matching the blocks of a document with those of its last version, in joins, windows and rounds.

Only places and hashes of blocks meet in a task: a longest increasing run of matched places is found in one pass over numbers, and
everything else is a join or a window, so a document of any number of blocks fits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import FUZZY, change_ratio

#: Rounds of unique matches between anchors before repeated blocks are paired by their number; a round without a match ends them.
ROUNDS = 6
#: What a difference of relative places takes off a score.
FAR = 0.15
#: What pairs of changed blocks lack of a score of 1, in steps: pairs are compared no further than a step needs, and blocks taken in one are in no later one.
STEPS = (0.05, 0.2)
#: Blocks of a document and kind that meet in one place, of each version; more are dealt over several.
LOT = 128
#: Marks that change how a sentence is said; how much of a block may change for its annotations to stay.
CRITICAL = r"[^？！!?…]+"
KEPT = {"narration": 0.3, "dialogue": 0.1}


def settled(df: DataFrame) -> DataFrame:
    """df computed once: written to the checkpoint folder if the session has one, else kept by the executors."""
    held = df.persist()
    if not df.sparkSession.sparkContext.getCheckpointDir():
        return held
    out = held.checkpoint()  # runs its plan twice, the second time for the file: that one reads what is held
    held.unpersist()
    return out


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, x in enumerate(places):
        at = bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(x)
            ends.append(k)
        else:
            tails[at], ends[at] = x, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def longest_runs(pairs: DataFrame) -> DataFrame:
    """Of pairs (doc, segment, i, j) of each segment, a largest set in which i and j grow together; i and j are unique."""

    def whole(rows: pa.Table) -> pa.Table:
        starts, places = np.flatnonzero(rows.column("rank").to_numpy() == 1).tolist(), rows.column("j").to_pylist()
        kept = [start + k for start, end in zip(starts, [*starts[1:], len(places)]) for k in increasing(places[start:end])]
        return rows.take(pa.array(kept, pa.int64())).select(["doc", "i", "j"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments follow each other, each in order from rank 1 on; the last one of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("rank").to_numpy() == 1)
            if len(starts) and (held or starts[-1]):
                yield from whole(pa.Table.from_batches([*held, batch.slice(0, starts[-1])])).to_batches()
                held = []
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held:
            yield from whole(pa.Table.from_batches(held)).to_batches()

    kind = pairs.schema["doc"].dataType.simpleString()
    ranked = pairs.select("doc", "i", "j", F.row_number().over(Window.partitionBy("doc", "segment").orderBy("i")).alias("rank"))
    return ranked.mapInArrow(runs, f"doc {kind}, i long, j long")


def in_order(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc, i, j): equal blocks (doc, i or j, hash) of both versions that keep their order.

    Blocks whose hash occurs once on both sides are matched, a longest increasing set of these stays as anchors, and the same is done
    between anchors, where more blocks are unique. What repeats to the end is paired by its number between anchors. If no
    block repeats, the result is a longest common subsequence.
    """
    whole = F.lit(0).cast("long")
    found, a, b = None, new.withColumn("segment", whole), old.withColumn("segment", whole)
    where = Window.partitionBy("doc", "segment", "hash")

    def met_by(mark, keep: str) -> DataFrame:
        sides = (rows.withColumn("mark", mark(place)).filter(keep) for rows, place in ((a, "i"), (b, "j")))
        left, right = sides
        return settled(longest_runs(left.join(right, ["doc", "segment", "hash", "mark"])))

    for _ in range(ROUNDS):
        met = met_by(lambda place: F.count("*").over(where), "mark = 1")
        if met.isEmpty():
            break
        found = met if found is None else settled(found.union(met))
        a, b = settled(between(new, found, "i")), settled(between(old, found, "j"))
    rest = met_by(lambda place: F.row_number().over(where.orderBy(place)), "mark > 0")
    return rest if found is None else settled(found.union(rest))


def between(rows: DataFrame, anchors: DataFrame, place: str) -> DataFrame:
    """The rows that are no anchors, with the number of anchors before them as their segment."""
    marked = rows.join(anchors.select("doc", place, F.lit(1).alias("anchor")), ["doc", place], "left")
    before = F.count("anchor").over(Window.partitionBy("doc").orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("segment", before).filter("anchor IS NULL").select("doc", place, "hash", "segment")


def dominant(edges: DataFrame) -> DataFrame:
    """Of scored pairs (doc, i, j, score), those that are taken when the best pair goes first and takes both its ends away.

    In each round every pair that is the best of both its ends is taken: whatever the order, no better pair can take one of them. Ties
    go to the smaller i, then j.
    """
    taken, left = None, settled(edges)
    while not left.isEmpty():
        rank = [F.desc("score"), F.col("i"), F.col("j")]
        best = left.withColumns({f"best_{k}": F.row_number().over(Window.partitionBy("doc", k).orderBy(*rank)) for k in ("i", "j")})
        now = settled(best.filter("best_i = 1 AND best_j = 1").drop("best_i", "best_j"))
        taken = now if taken is None else taken.union(now)
        left = left.join(now.select("doc", "i"), ["doc", "i"], "left_anti").join(now.select("doc", "j"), ["doc", "j"], "left_anti")
        left = settled(left.select(*edges.columns))
    return edges.limit(0) if taken is None else taken


def moved(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc, i, j): the first block of each hash, where the other version has left exactly one like it."""
    alone = old.groupBy("doc", "hash").agg(F.count("*").alias("n"), F.min("j").alias("j")).filter("n = 1")
    return new.groupBy("doc", "hash").agg(F.min("i").alias("i")).join(alone, ["doc", "hash"]).select("doc", "i", "j")


def dealt(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc, place, kind, text) that have others of their document and kind in the other version, with their `size` and the lots that they meet in.

    Blocks of each version are dealt over lots of about LOT, and each lot meets each one of the other version.
    """
    lots = lambda rows, name: rows.groupBy("doc", "kind").agg(F.ceil(F.count("*") / LOT).alias(name))
    counts = lots(new, "new_lots").join(lots(old, "old_lots"), ["doc", "kind"])
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda place, n: F.array(F.pmod(F.xxhash64(place), F.col(n)))
    sides = (
        rows.join(counts, ["doc", "kind"]).select("doc", "kind", place, "text", F.length("text").alias("size"), a.alias("new_lot"), b.alias("old_lot"))
        for rows, place, a, b in ((new, "i", own("i", "new_lots"), every("old_lots")), (old, "j", every("new_lots"), own("j", "old_lots")))
    )
    return next(sides), next(sides)


def changed(new: DataFrame, old: DataFrame, sizes: DataFrame, most: float = FUZZY, lack: float | None = None) -> DataFrame:
    """(doc, i, j, ratio, score): blocks of the same kind, as `dealt` gives them, that changed by `most` or less, scored by closeness and relative place.

    With `lack`, only pairs whose score is above 1 - lack: edits are counted no further than such a score allows.
    """
    on = ["doc", "kind", "new_lot", "old_lot"]
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = lambda rows: rows.withColumn("new_lot", F.explode("new_lot")).withColumn("old_lot", F.explode("old_lot")).repartition(tasks, *on)
    pairs = meet(new.join(sizes, "doc")).join(meet(old.withColumnsRenamed({"text": "was", "size": "was_size"})), on)
    far = FAR * F.abs(F.col("i") / F.greatest("new_size", F.lit(1)) - F.col("j") / F.greatest("old_size", F.lit(1)))
    longest = F.greatest("size", "was_size")
    share = F.lit(most) if lack is None else F.least(F.lit(most), lack - far)
    room = F.floor((share + 1e-9) * longest).cast("int")
    edits = F.call_function("levenshtein", F.col("text"), F.col("was"), room)  # -1 above room
    # an explode, as a filter moves below what it only selects, and would count the edits again
    near = pairs.filter(F.abs(F.col("size") - F.col("was_size")) <= room).withColumn("edits", F.explode(F.array(edits))).filter("edits >= 0")
    ratio = F.when(longest == 0, 0.0).otherwise(F.col("edits") / longest)
    rows = near.select("doc", "i", "j", ratio.alias("ratio"), F.round(1 - ratio - far, 9).alias("score")).filter(F.col("ratio") <= most)
    return rows if lack is None else rows.filter(F.col("score") > round(1 - lack, 9))


def closest(new: DataFrame, old: DataFrame, sizes: DataFrame, most: float = FUZZY) -> DataFrame:
    """(doc, i, j, ratio) of the dominant pairs of changed blocks.

    Good scores go first, so a step that knows every pair above a score takes those that all pairs at once would give. Only what is left
    is compared further.
    """
    taken, (a, b) = None, (settled(rows) for rows in dealt(new, old))
    for lack in (*STEPS, None):
        now = dominant(changed(a, b, sizes, most, lack)).select("doc", "i", "j", "ratio")
        taken = now if taken is None else taken.union(now)
        if lack is not None:
            a, b = a.join(now.select("doc", "i"), ["doc", "i"], "left_anti"), b.join(now.select("doc", "j"), ["doc", "j"], "left_anti")
    return taken


def matched(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc, i, j, how, ratio) of blocks (doc, i or j from 0, kind, text) against those of the last version.

    'kept' equal and in order, 'moved' equal elsewhere with no doubt which, 'changed' by the dominant close pairs of the same kind. Each
    step sees what the ones before left. The ratio is that of changed blocks.
    """
    hashed = lambda rows, place: rows.select("doc", place, F.xxhash64(F.coalesce("kind", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"))
    a, b = settled(hashed(new, "i")), settled(hashed(old, "j"))
    sizes = settled(a.groupBy("doc").agg(F.count("*").alias("new_size")).join(b.groupBy("doc").agg(F.count("*").alias("old_size")), "doc"))
    left = lambda rows, place, out: rows.join(out.select("doc", place), ["doc", place], "left_anti")
    out = in_order(a, b).withColumn("how", F.lit("kept"))
    out = settled(out.union(moved(left(a, "i", out), left(b, "j", out)).withColumn("how", F.lit("moved"))))
    full = [left(rows, place, out).select("doc", place, "kind", F.coalesce("text", F.lit("")).alias("text")) for rows, place in ((new, "i"), (old, "j"))]
    met = closest(*full, sizes).select("doc", "i", "j", F.lit("changed").alias("how"), "ratio")
    return settled(out.withColumn("ratio", F.lit(None).cast("double")).union(met))


def contexts(rows: DataFrame, place: str) -> DataFrame:
    """rows with the kind and text hash of both neighbours as one hash."""
    w = Window.partitionBy("doc").orderBy(place)
    own = F.concat_ws(":", "kind", F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.withColumn("context", F.xxhash64(F.coalesce(F.lag(own).over(w), F.lit("^")), F.coalesce(F.lead(own).over(w), F.lit("$"))))


def status(kind: Column, ratio: Column, same_context: Column, same_marks: Column) -> tuple[Column, Column]:
    """(status, reason) of a matched block: unchanged, auto-reused or needs-review; a null ratio is a new block.

    Dialogue whose neighbours or critical marks changed is reviewed, whatever else; a change below the share that its kind allows is reused.
    """
    risk = (kind == "dialogue") & ~(same_context & same_marks)
    allowed = F.coalesce(F.create_map(*(F.lit(x) for pair in KEPT.items() for x in pair))[kind], F.lit(0.0))
    what = F.when(ratio.isNull(), "new").when((ratio == 0) & ~risk, "unchanged").when((ratio > 0) & (ratio < allowed) & ~risk, "auto-reused").otherwise("needs-review")
    why = F.when(ratio.isNull(), "new block").when(what != "needs-review", F.lit(None).cast("string")).when((ratio == 0) & ~same_context, "context changed").when(ratio == 0, "marks changed").when(kind == "poetry", "verse changed")
    return what, why.otherwise(F.format_string("%.1f percent changed", 100 * ratio))


def reconciled(blocks: DataFrame, previous: DataFrame) -> DataFrame:
    """Blocks (doc, place, kind, text) with the identity and state that the last version (doc, place, kind, text, block) gives them.

    A matched block keeps its number; new ones take the next numbers of their document, in order. Places are any ascending numbers, unique in
    a document. Null texts count as empty; documents without a last version are new as a whole.

    Returns doc, place, kind, text, block, old_place, how, ratio, status, reason.
    """
    index = lambda rows, name: rows.withColumn(name, F.row_number().over(Window.partitionBy("doc").orderBy("place")).cast("long") - 1)
    a, b = settled(contexts(index(blocks, "i"), "i")), settled(contexts(index(previous, "j"), "j"))
    pairs = matched(a.select("doc", "i", "kind", "text"), b.select("doc", "j", "kind", "text"))
    was = b.select("doc", "j", F.col("text").alias("was"), F.col("context").alias("old_context"), "block", F.col("place").alias("old_place"))
    rows = a.join(pairs, ["doc", "i"], "left").join(was, ["doc", "j"], "left")
    known = F.coalesce(F.col("ratio"), change_ratio(F.coalesce("text", F.lit("")), F.coalesce("was", F.lit(""))))
    ratio = F.when(F.col("how").isNotNull(), known)
    marks = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), CRITICAL, "")
    what, why = status(F.col("kind"), F.col("ratio"), F.col("context") == F.col("old_context"), marks(F.col("text")) == marks(F.col("was")))
    highest = b.groupBy("doc").agg(F.max("block").alias("highest"))
    fresh = F.sum(F.when(F.col("how").isNull(), 1)).over(Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(highest, "doc", "left").withColumn("ratio", ratio).withColumn("block", F.coalesce("block", F.coalesce("highest", F.lit(0)) + fresh))
    return rows.select("doc", "place", "kind", "text", "block", "old_place", F.coalesce("how", F.lit("new")).alias("how"), F.round("ratio", 4).alias("ratio"), what.alias("status"), why.alias("reason"))


def summary(states: DataFrame, previous: DataFrame) -> DataFrame:
    """(doc, new, auto_reused, needs_review, unchanged, removed) of each document."""
    count = lambda s: F.count_if(F.col("status") == s)
    now = states.groupBy("doc").agg(count("new").alias("new"), count("auto-reused").alias("auto_reused"), count("needs-review").alias("needs_review"), count("unchanged").alias("unchanged"), F.count("old_place").alias("met"))
    return now.join(previous.groupBy("doc").agg(F.count("*").alias("before")), "doc", "left").select("doc", "new", "auto_reused", "needs_review", "unchanged", (F.coalesce("before", F.lit(0)) - F.col("met")).alias("removed"))
