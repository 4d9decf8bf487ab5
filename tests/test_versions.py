"""Version matching against plain loops over one document."""

import random
import time

import pytest

from textloom.operators import versions
from textloom.operators.reconcile import FUZZY, change_ratio, edit_ratio, longest_common

BLOCK, OLD = "doc string, place long, kind string, text string", "doc string, place long, kind string, text string, block long"


def brute(new, old):
    """(i, j, how) of blocks (kind, text) of one document: in order, then moved, then greedily by closeness; order by longest common subsequence."""
    pair = {i: (j, "kept") for i, j in longest_common([repr(x) for x in new], [repr(x) for x in old])}
    free = [j for j in range(len(old)) if j not in {j for j, _ in pair.values()}]
    for i, x in enumerate(new):
        same = [j for j in free if old[j] == x]
        if i not in pair and len(same) == 1:
            pair[i] = (same[0], "moved")
            free.remove(same[0])
    scored = []
    for i, (kind, text) in enumerate(new):
        for j in free:
            ratio = edit_ratio(text, old[j][1])
            if i not in pair and old[j][0] == kind and ratio <= FUZZY:
                scored.append((-round(1 - ratio - 0.15 * abs(i / max(1, len(new)) - j / max(1, len(old))), 9), i, j))
    for _, i, j in sorted(scored):
        if i not in pair and j in free:
            pair[i] = (j, "changed")
            free.remove(j)
    return sorted((i, *p) for i, p in pair.items())


def edited(rng, repeats):
    """A document of blocks and a later version of it; without repeats, every block is another."""
    word = lambda: "".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randrange(5, 12)))
    old = [(rng.choice(["narration", "dialogue", "poetry"]), word()) for _ in range(rng.randrange(1, 14))]
    if repeats:
        old = [rng.choice(old) for _ in old]
    new = list(old)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(new) + 1)
        what = rng.randrange(4)
        if what == 0:
            new.insert(at, (rng.choice(["narration", "dialogue"]), word()))
        elif at < len(new):
            block = new.pop(at)
            if what == 2:
                new.insert(rng.randrange(len(new) + 1), block)
            elif what == 3:
                new.insert(at, (block[0], block[1][:-1] + "新"))
    return new, old


def frames(spark, documents):
    new = [(f"d{k}", 10 * i + 3, *b) for k, (n, _) in enumerate(documents) for i, b in enumerate(n)]
    old = [(f"d{k}", 7 * j, *b, j + 1) for k, (_, o) in enumerate(documents) for j, b in enumerate(o)]
    return spark.createDataFrame(new, BLOCK).repartition(3), spark.createDataFrame(old, OLD).repartition(2)


def test_matches_are_those_of_plain_loops(spark):
    rng = random.Random(21)
    documents = [edited(rng, False) for _ in range(60)]
    got = {}
    for r in versions.reconciled(*frames(spark, documents)).collect():
        if r["how"] != "new":
            got.setdefault(r["doc"], []).append(((r["place"] - 3) // 10, r["old_place"] // 7, r["how"]))
    agree = 0
    for k, (new, old) in enumerate(documents):
        want, mine = brute(new, old), sorted(got.get(f"d{k}", []))
        # where two sequences are longest, either is right: then as many blocks are kept
        assert sum(h == "kept" for *_, h in mine) == sum(h == "kept" for *_, h in want)
        agree += mine == want
    assert agree >= 55


def test_repeated_blocks_keep_their_order_and_identity(spark):
    rng = random.Random(22)
    documents = [edited(rng, True) for _ in range(40)]
    rows = versions.reconciled(*frames(spark, documents)).collect()
    for k, (new, old) in enumerate(documents):
        own = sorted((r for r in rows if r["doc"] == f"d{k}"), key=lambda r: r["place"])
        assert len(own) == len(new) and len({r["block"] for r in own}) == len(own)
        kept = [r["old_place"] for r in own if r["how"] == "kept"]
        assert kept == sorted(set(kept)) and all(old[r["old_place"] // 7] == (r["kind"], r["text"]) for r in own if r["how"] in ("kept", "moved"))
        assert sorted(r["block"] for r in own if r["how"] == "new") == list(range(len(old) + 1, len(old) + 1 + sum(r["how"] == "new" for r in own)))


def test_identities_survive_an_insertion(spark):
    old = [("narration", "甲段。"), ("dialogue", "是。"), ("narration", "乙段。"), ("dialogue", "是。")]
    rows = versions.reconciled(*frames(spark, [([("narration", "新增段。"), *old], old)])).orderBy("place").collect()
    assert [r["block"] for r in rows] == [5, 1, 2, 3, 4] and rows[0]["status"] == "new"


@pytest.mark.parametrize("new, old, want", [
    (("narration", "旁白共有十一个文字。"), ("narration", "旁白共有十个文字。"), ("auto-reused", None)),
    (("poetry", "新诗一句"), ("poetry", "原诗一句"), ("needs-review", "verse changed")),
    (("narration", "同"), ("narration", "同"), ("unchanged", None)),
    (("dialogue", "好极了，真是好极了啊。"), ("dialogue", "好极了，真是好极了呀。"), ("auto-reused", None)),
    (("dialogue", "好极了，真是好极了啊！"), ("dialogue", "好极了，真是好极了啊。"), ("needs-review", "9.1 percent changed")),
])
def test_states_of_matched_blocks(spark, new, old, want):
    row = versions.reconciled(*frames(spark, [([new], [old])])).first()
    assert (row["status"], row["reason"]) == want and row["block"] == 1


def test_dialogue_in_another_context_is_reviewed(spark):
    old = [("narration", "前文一二三"), ("dialogue", "是。")]
    new = [("narration", "完全不同的开头"), ("dialogue", "是。")]
    rows = versions.reconciled(*frames(spark, [(new, old)])).orderBy("place").collect()
    assert (rows[1]["status"], rows[1]["reason"]) == ("needs-review", "context changed")
    total = versions.summary(versions.reconciled(*frames(spark, [(new, old)])), frames(spark, [(new, old)])[1]).first()
    assert (total["new"], total["needs_review"], total["removed"]) == (1, 1, 1)


def test_dominant_pairs_are_the_greedy_ones(spark):
    rng = random.Random(23)
    edges = [(rng.choice("ab"), i, j, rng.choice([0.2, 0.5, 0.9])) for i in range(12) for j in range(12) if rng.random() < 0.5]
    want, used = set(), set()
    for doc, i, j, _ in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if (doc, 0, i) not in used and (doc, 1, j) not in used:
            used |= {(doc, 0, i), (doc, 1, j)}
            want.add((doc, i, j))
    got = versions.dominant(spark.createDataFrame(edges, "doc string, i long, j long, score double"))
    assert {(r["doc"], r["i"], r["j"]) for r in got.collect()} == want


def test_closest_pairs_taken_in_steps_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(versions, "LOT", 3)
    rng = random.Random(24)
    word = lambda: "".join(rng.choice("ab甲😀") for _ in range(rng.choice([0, 3, 20, 60])))
    edited = lambda text: "".join(rng.choice(["", c, c + "x"]) if rng.random() < rng.choice([0, 0.02, 0.1, 0.5]) else c for c in text)
    old = [(doc, j, rng.choice(["narration", "poetry"]), word()) for doc in "abc" for j in range(20)]
    new = [(doc, i, kind, edited(text)) for doc, j, kind, text in old for i in (3 * j, 3 * j + 1) if rng.random() < 0.6]
    want, used = set(), set()
    scored = [(doc, i, j, edit_ratio(a, b)) for doc, i, kind, a in new for d, j, k, b in old if (d, k) == (doc, kind)]
    scored = [(-round(1 - r - versions.FAR * abs(i / 60 - j / 20), 9), doc, i, j) for doc, i, j, r in scored if r <= FUZZY]
    for _, doc, i, j in sorted(scored):
        if (doc, 0, i) not in used and (doc, 1, j) not in used:
            used |= {(doc, 0, i), (doc, 1, j)}
            want.add((doc, i, j))
    sides = (spark.createDataFrame(rows, f"doc string, {place} long, kind string, text string") for rows, place in ((new, "i"), (old, "j")))
    got = versions.closest(*sides, spark.createDataFrame([(doc, 60, 20) for doc in "abc"], "doc string, new_size long, old_size long")).collect()
    assert {(r["doc"], r["i"], r["j"]) for r in got} == want and len(got) == len(want) > 30


def test_edits_of_equal_texts_are_not_counted(spark):
    """Unchanged blocks cost nothing: 20 pairs of 20,000 equal characters took 42 s when their edits were counted."""
    rows = spark.createDataFrame([("x" * 20_000 + str(k),) * 2 for k in range(20)], "a string, b string").repartition(1)
    began = time.time()
    assert rows.filter(change_ratio(rows["a"], rows["b"]) == 0).count() == 20 and time.time() - began < 12


def test_a_run_over_many_batches(spark):
    """Segments that end within Arrow batches, and one that spans several."""
    pairs = spark.range(2_500).selectExpr("'d' AS doc", "CASE WHEN id < 1000 THEN 0 WHEN id < 1007 THEN id ELSE 2000 END AS segment", "id AS i", "id + if(id % 5 = 0, 100000, 0) AS j")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(r["i"] for r in versions.longest_runs(pairs).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {i for i in range(2_500) if i % 5} | {1000, 1005} <= set(got) and len(got) == len(set(got)) <= 2_004


def test_a_long_document_and_empty_tables(spark):
    """100,000 blocks, a third of them alike; one in ten is new."""
    old = spark.range(100_000).selectExpr("'d' AS doc", "id AS place", "'narration' AS kind", "if(id % 3 = 0, '是。', concat('block ', id)) AS text", "id + 1 AS block")
    new = old.filter("place % 10 != 1").drop("block").union(spark.range(0, 100_000, 10).selectExpr("'d'", "id * 10 + 1000000", "'poetry'", "concat('verse ', id)"))
    rows = versions.reconciled(new, old)
    by = {r["how"]: r["count"] for r in rows.groupBy("how").count().collect()}
    assert by["new"] == 10_000 and by["kept"] + by.get("moved", 0) == 90_000
    assert rows.filter("how = 'kept' AND text <> '是。' AND place <> old_place").count() == 0
    none = versions.reconciled(new.limit(0), old)
    assert none.count() == 0 and versions.reconciled(new.limit(5), old.limit(0)).filter("status = 'new'").count() == 5
