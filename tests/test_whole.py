"""Queries over whole texts and tables against brute force on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from textloom import plans
from textloom.operators.reconcile import edit_ratio

RNG = random.Random(3)
TAIL = ["été déjà vu ", "naïve façade ", "größer über ", "plain words "]


def folder(spark, at, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def items():
    same = "the same opening of all items, longer than eighty characters, so that only the rest tells one from another: "
    return [(i, same + "".join(RNG.choice(TAIL) for _ in range(RNG.randrange(1, 60)))) for i in range(16)] + [(16, None), (17, "")]


def test_edit_ratio_of_whole_texts(spark, tmp_path):
    data = items()
    at = folder(spark, tmp_path, benchmark=(data, "item_id long, text string"))
    ratio = {(i, j): edit_ratio(s, t) for i, s in data for j, t in data if i % 2 == 0 and j % 2 == 1 and s is not None and t is not None}
    got = {(r["item_id"], r["old_key"]): r["ratio"] for r in plans.QUERIES["edit_ratio_pairs"](spark, at).collect()}
    assert got == {k: pytest.approx(r, abs=1e-6) for k, r in ratio.items() if r <= 0.8}
    best = {}
    for i in {i for i, _ in ratio}:
        near = sorted((r, j) for (k, j), r in ratio.items() if k == i and r <= 0.8)
        if near and (len(near) == 1 or near[1][0] - near[0][0] >= 0.01):
            best[i] = near[0][1]
    assert {r["item_id"]: r["old_key"] for r in plans.QUERIES["fuzzy_margin"](spark, at).collect()} == best


def test_collation_of_whole_texts_of_all_turns(spark, tmp_path):
    opening = "one opening of more than sixty characters that all of the turns have in common "
    turns = [(c, t, RNG.choice(["user", "assistant"]), opening * RNG.randrange(2) + "".join(RNG.choice(TAIL) for _ in range(RNG.randrange(6)))) for c in range(5) for t in range(12)] + [(9, 0, "user", "a"), (9, 8, "user", "b"), (9, 9, "user", None)]
    at = folder(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))

    def dice(s, t):
        a, b = (Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (s, t))
        n = sum(a.values()) + sum(b.values())
        return 2 * sum((a & b).values()) / n if n else 0.0

    want = {}
    for c, role in {(c, r) for c, _, r, _ in turns}:
        texts = sorted({x for k, _, r, x in turns if (k, r) == (c, role) and x is not None})
        most = max((dice(s, t) for s in texts for t in texts if s < t), default=0.0)
        want[c, role] = (len(texts), pytest.approx(most, abs=1e-6), "single" if len(texts) == 1 else "variants" if most >= 0.5 else "mixed")
    got = {(r["conv_id"], r["role"]): (r["variants"], r["most_alike"], r["status"]) for r in plans.QUERIES["locus_similarity"](spark, at).collect()}
    assert got == want


def test_mixture_of_models_of_all_labelled_documents(spark, tmp_path):
    docs = [(i, "".join(RNG.choice("abcde" if i % 2 else "cdefg") for _ in range(40))) for i in range(30)]
    at = folder(spark, tmp_path, documents=(docs, "doc_id long, text string"), labels=([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int"))

    def model(texts):
        n = Counter(t[i : i + k] for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1))
        x = Counter()
        for g, c in n.items():
            if len(g) > 1:
                x[g[:-1]] += c
        letters = {g for g in n if len(g) == 1}
        total = sum(n[g] for g in letters)

        def bits(t):
            t, out = "".join(c if c in letters else "" for c in t), 0.0
            for i in range(len(t)):
                p = (n[t[i]] + 1) / (total + len(letters) + 1)
                for k in (2, 3):
                    s = t[i - k + 1 : i + 1] if i >= k - 1 else None
                    if s and s[:-1] in x:
                        p = (n[s] + p) / (x[s[:-1]] + 1)
                out -= math.log2(p)
            return out / len(t)

        return bits

    good, bad = (model([t for i, t in docs if i < 24 and i % 2 == q]) for q in (1, 0))
    want = {i: (pytest.approx(-math.log2((2 ** -good(t) + 2 ** -bad(t)) / 2), abs=2e-5), "good" if good(t) <= bad(t) else "bad") for i, t in docs}
    assert {r["doc_id"]: (r["mixture"], r["best"]) for r in plans.QUERIES["lm_mixture"](spark, at).collect()} == want


def test_nearest_of_all_vectors(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(90, 6)).astype(np.float32)
    at = folder(spark, tmp_path, embeddings=([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int"))
    got = {(r["vec_id"], r["rank"]): r["ref_id"] for r in plans.QUERIES["nearest_refs_top3"](spark, at).collect()}
    x = v.astype(float)
    want = {}
    for q in range(0, 90, 20):
        order = sorted((round(float(np.sqrt(((x[q] - x[j]) ** 2).sum())), 9), j) for j in range(90) if j != q)
        want |= {(q, r + 1): j for r, (_, j) in enumerate(order[:3])}
    assert got == want
    assert any(j % 20 for j in got.values())


def test_collation_sends_nothing_to_the_driver(spark, tmp_path):
    at = folder(spark, tmp_path, conversations=([(c, t, "user", f"turn {t} of {c}") for c in range(5) for t in range(4)], "conv_id long, turn long, role string, text string"))
    df = plans.QUERIES["locus_similarity"](spark, at)
    assert len(df.collect()) == 5
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_search_cuts_its_queries(spark, monkeypatch):
    """A worker's matrices are of a slice of queries, and slices give what a whole block gives."""
    from textloom.operators import stats

    monkeypatch.setattr(stats, "ASKED", 3)
    rng = random.Random(2)
    points = [(i, [rng.random(), rng.random()], i % 2) for i in range(40)]
    rows = spark.createDataFrame(points, "id int, x array<double>, side int")
    for within in (None, "side"):
        got = {(r["id"], r["rank"]): r["of"] for r in stats.nearest_all(rows, rows, "id", "of", "x", 2, within=within).collect()}
        for i, p, side in points:
            near = sorted((round(math.dist(p, q), 9), j) for j, q, s in points if j != i and (within is None or s == side))
            assert [got[i, 1], got[i, 2]] == [j for _, j in near[:2]]
