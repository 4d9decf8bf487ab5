"""Coverage, tilings, requests and batches against plain loops and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import assembly, batches, requests


def stretches(intervals, total):
    """(begin, end, problem, depth) by counting over every place between neighbouring ends."""
    out = [(b, e, "empty", 0) for b, e in intervals if b >= e]
    sound = [(b, e) for b, e in intervals if b < e]
    ends = sorted({x for pair in sound for x in pair} | ({0, total} if total is not None else set()))
    for a, b in zip(ends, ends[1:]):
        depth, inside = sum(x <= a < y for x, y in sound), total is not None and 0 <= a < total
        problem = ("gap" if depth == 0 else "overlap" if depth > 1 else None) if inside else "outside" if depth else None
        if problem:
            out.append((a, b, problem, depth))
    return sorted(out)


def test_tilings_are_judged_as_by_counting(spark):
    rng = random.Random(1)
    plans = {}
    for plan in range(40):
        cuts = sorted(rng.sample(range(1, 60), rng.randrange(0, 8)))
        intervals = list(zip([0, *cuts], [*cuts, 60]))
        for _ in range(rng.randrange(0, 4) if plan else 0):
            a = rng.randrange(-5, 65)
            intervals = rng.choice([intervals + [(a, a + rng.randrange(-1, 20))], intervals[1:], intervals + intervals[:1]])
        plans[plan] = intervals
    plans[100], plans[101] = [], [(0, 5)]
    rows = spark.createDataFrame([(p, b, e) for p, held in plans.items() for b, e in held], "plan int, begin int, end int")
    totals = spark.createDataFrame([(p, 60) for p in plans if p != 101], "plan int, total int")
    want = {p: stretches(held, None if p == 101 else 60) for p, held in plans.items()}
    for block in (8, 4096):
        by = {}
        for r in assembly.tiling_problems(rows, totals, "plan", block=block).collect():
            by.setdefault(r["plan"], []).append((r["begin"], r["end"], r["problem"], r["depth"]))
        assert {p: sorted(v) for p, v in by.items()} == {p: v for p, v in want.items() if v}
    assert 0 not in by and by[100] == [(0, 60, "gap", 0)] and by[101] == [(0, 5, "outside", 1)]


def test_covers_that_hold_tile_their_targets(spark):
    targets = assembly.numbered(spark.createDataFrame([("p", i * 10, f"t{i}", "a") for i in range(6)], "plan string, place int, text_hash string, annotation_hash string").withColumn("target", F.col("place")), ["plan"], "place", 2)
    good = [("p", "g", 0, 10, "t1", "a"), ("p", "g", 1, 20, "t2", "a"), ("p", "s", 0, 40, "t4", "a")]
    schema = "plan string, cover string, ordinal int, target int, text_hash string, annotation_hash string"
    covers = spark.createDataFrame(good, schema)
    assert assembly.cover_problems(targets, covers, "plan").count() == 0
    parts = assembly.segments(targets, covers, "plan")
    assert {(r["cover"], r["begin"], r["end"], r["n"]) for r in parts.collect()} == {(None, 0, 1, 1), ("g", 1, 3, 2), (None, 3, 4, 1), ("s", 4, 5, 1), (None, 5, 6, 1)}
    assert assembly.tiling_problems(parts, targets.groupBy("plan").agg(F.count("*").alias("total")), "plan").count() == 0
    bad = [("p", "g", 0, 10, "t1", "a"), ("p", "g", 1, 30, "t3", "a"), ("p", "g", 3, 40, "old", None), ("p", "x", 0, 30, "t3", "a"), ("p", "y", 0, 99, "t9", "a")]
    got = {(r["cover"], r["ordinal"], r["problem"]) for r in assembly.cover_problems(targets, spark.createDataFrame(bad, schema), "plan").collect()}
    assert got == {("g", 1, "not next"), ("g", 1, "covered twice"), ("x", 0, "covered twice"), ("g", 3, "hole"), ("g", 3, "text hash differs"), ("g", 3, "annotation hash differs"), ("y", 0, "unknown target")}


def test_a_paused_block_fails_the_job(spark):
    rows = spark.createDataFrame([("a", "aligned"), ("a", "aligned"), ("b", "aligned"), ("b", "paused"), ("c", None)], "scene string, status string")
    counts = assembly.alignment_counts(rows, "scene", "status")
    assert {tuple(r) for r in counts.collect()} == {("a", 2, 2, 0, True), ("b", 2, 1, 1, False), ("c", 1, 0, 0, False)}
    assert assembly.unpaused(rows, counts.filter("scene = 'a'"), "scene").count() == 5
    with pytest.raises(Exception, match="paused in b"):
        assembly.unpaused(rows, counts, "scene").collect()


def made(spark, blocks):
    rows = spark.createDataFrame(blocks, "block string, block_hash string, text string, speed double")
    said = requests.fanned_out(rows, "block", F.split("text", "/"), F.array(F.lit("v1"), F.lit("v2"))).withColumns({"spoken": F.col("unit"), "voice_hash": F.col("voice"), "instruction": F.lit("i"), "retry": F.lit(0)})
    return requests.hashed(said, "block", "block_hash")


def test_a_change_reaches_its_dependants_only(spark):
    old = made(spark, [("b1", "h", "你好/再见", 1.0), ("b2", "h", "你好", 1.0), ("b3", "h", "走", 1.0), ("b4", "h", None, 1.0)])
    new = made(spark, [("b1", "h", "你好/再会", 1.0), ("b2", "changed", "你好", 1.0), ("b3", "h", "走", 1.5)])
    key = ["block", "unit_index", "voice"]
    got = {(r["block"], r["unit_index"], r["voice"]): r["work"] for r in requests.work(new, old, key, old).collect()}
    want = {("b1", 0): "keep", ("b1", 1): "synthesise", ("b2", 0): "render", ("b3", 0): "synthesise"}
    assert got == {(*k, v): w for k, w in want.items() for v in ("v1", "v2")}
    assert {r["work"] for r in requests.work(new.filter("block = 'b1'"), old, key, old).filter("block > 'b1'").collect()} == {"drop"}
    fresh = requests.to_synthesise(old, old.limit(0), key).collect()
    assert len(fresh) == 6 and {(r["block"], r["uses"]) for r in fresh} == {("b1", 2), ("b1", 1), ("b3", 1)}
    assert requests.to_synthesise(old, old, key).count() == 0


def test_validation_jobs_take_final_files_where_they_count(spark):
    parts = spark.createDataFrame([("b1", 0, "v1", "a.wav", "甲", True), ("b1", 0, "v2", "b.wav", "甲", False)], "block string, unit_index int, voice string, path string, text string, selected boolean")
    mixes = spark.createDataFrame([("b1", 0, "v1", "mix.wav", "甲")], "block string, unit_index int, voice string, path string, text string")
    told = spark.createDataFrame([("n1", "n.wav", "乙"), ("n2", "m.wav", None)], "block string, path string, text string")
    leveled = spark.createDataFrame([("b1", 0, "final.wav"), ("n1", None, "told.wav")], "block string, unit_index int, path string")
    got = {tuple(r) for r in requests.validation_jobs(parts, mixes, told, leveled).select("job", "kind", "path").collect()}
    assert got == {("b1-u1-v1", "component", "final.wav"), ("b1-u1-v2", "component", "b.wav"), ("b1-u1-mix", "mix", "mix.wav"), ("n1-narration", "narration", "told.wav"), ("n2-narration", "narration", "m.wav")}


def test_batches_hold_what_can_be_heard(spark):
    targets = spark.createDataFrame(
        [("p", "t1", "line", "x/a.WAV", "f1", "r1", True), ("p", "t2", "line", "x/b.wav", "f1", "r2", True), ("p", "t3", "line", None, "f3", "r3", True), ("p", "t4", "line", "c.mp3", "f4", "r4", None),
         ("p", "t5", "other", "d.mp3", "f5", "r5", True), ("p", "t6", "line", "e.mp3", "f6", "r6", True), ("q", "t7", "line", "f.mp3", None, "r7", True)],
        "plan string, target string, kind string, path string, file_hash string, render_hash string, auto_passed boolean",
    )
    records = spark.createDataFrame([(f"t{i}", "pending_review") for i in (1, 2, 3, 4, 5)] + [("t6", "approved"), ("t7", "planned")], "target string, status string")
    batch = batches.review_batch(targets, records, "target", ("line",), "audio/")
    assert {(r["target"], r["object_key"]) for r in batch.collect()} == {("t1", "audio/f1.wav"), ("t2", "audio/f1.wav")}
    assert [tuple(r) for r in batches.uploads(batch).collect()] == [("audio/f1.wav", "f1", "x/a.WAV", 2)]
    assert {tuple(r) for r in batches.batch_summary(targets, records, batch, "plan", "target").collect()} == {("p", 6, 1, 0, 5, 2), ("q", 1, 0, 1, 0, 0)}
    shown = batches.public_view(batch, ("file_hash", "render_hash", "path"), F.lit("s"), F.lit(100))
    assert shown.columns == ["plan", "target", "kind", "auto_passed", "object_key", "url"] and shown.select("url").distinct().count() == 1
    assert shown.first()["url"] != batches.public_view(batch, (), F.lit("other"), F.lit(100)).first()["url"]


def test_default_approval_needs_all_of_it(spark):
    rows = [("a", True, True, True, "pending_review", 0), ("a", True, True, True, "pending_review", None), ("b", True, True, True, "pending_review", 0), ("a", None, True, True, "pending_review", 0), ("a", True, False, True, "pending_review", 0),
            ("a", True, True, True, "approved", 0), ("a", True, True, True, "pending_review", 1), (None, True, True, True, "pending_review", 0)]
    df = spark.createDataFrame(rows, "p string, auto boolean, render boolean, file boolean, status string, history int")
    got = df.select(batches.default_approved(F.col("p"), ("a",), F.col("auto"), F.col("render"), F.col("file"), F.col("status"), F.col("history"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False, False]


def test_tilings_deal_their_ends_once(spark):
    """Ends go through one shuffle and what is carried from block to block through its own; a null plan has no stretches."""
    rows = spark.createDataFrame([("a", 0, 3), ("a", 2, 9), (None, 1, 4)], "plan string, begin int, end int")
    found = assembly.tiling_problems(rows, spark.createDataFrame([("a", 9), (None, 9)], "plan string, total int"), "plan", block=4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 5
    assert [tuple(r) for r in found.collect()] == [("a", 2, 3, "overlap", 2)]
