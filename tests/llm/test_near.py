"""Near copies of the pipeline's stage against all pairs."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup import DOC, EDGES, ordered, rows

from textloom.llm import near

WORDS = ["".join(random.Random(i).choice("etaoinsrhldcu") for _ in range(7)) for i in range(400)]


def edited(seed=4, bases=30, copies=5):
    """Texts of 60 to 400 words with copies in which one word in 60 or so is changed."""
    rng = random.Random(seed)
    docs = []
    for _ in range(bases):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(60, 400))]
        docs.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(max(1, len(w) // rng.choice([40, 60, 90, 150]))):
                w[rng.randrange(len(w))] = "changed"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


def brute(docs, words=5, least=0.8):
    """Component by id over all pairs of plain shingle sets."""

    def cut(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}

    sets = [cut(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    of = {}
    for i, (k, _) in enumerate(docs):
        of.setdefault(find(i), []).append(k)
    smallest = {r: min((k for k in v if k is not None), default=None) for r, v in of.items()}
    return [(k, smallest[find(i)]) for i, (k, _) in enumerate(docs)]


@pytest.mark.parametrize("pairwise", [1, 24])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, pairwise):
    """Also where every band is crowded: the components must not depend on how its members are compared."""
    monkeypatch.setattr(near, "PAIRWISE", pairwise)
    docs = edited() + [(1000 + (i or 0) if i is not None else None, t) for i, t in EDGES]
    got = rows(near.near_copies(spark.createDataFrame(docs, DOC)))
    assert ordered(got) == ordered(brute(docs))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_rare_shingles_lose_no_pair(spark, similarity):
    """Sets of all sizes around a common core: each pair that is alike is a candidate."""
    rng = random.Random(11)
    sets = [(i, sorted(rng.sample(range(60), rng.randrange(1, 60)) if i % 3 else rng.sample(range(12), rng.randrange(1, 12)))) for i in range(150)]
    members = spark.createDataFrame([(i, i, rng.random() < 0.5) for i, _ in sets], "node long, component long, apart boolean")
    apart = {r["node"] for r in members.filter("apart").collect()}
    got = set(rows(near.by_rare_shingles(members, spark.createDataFrame(sets, "node long, shingles array<long>"), similarity)))
    want = {(i, j) for i, a in sets for j, b in sets if i != j and i in apart and len(set(a) & set(b)) >= similarity * len(set(a) | set(b))}
    assert want and want <= got


def test_stage_drops_edited_copies(spark):
    docs = edited(seed=9)
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, spark.createDataFrame(docs, DOC), "").collect()}
    want = {i for i, c in brute(docs) if i == c}
    assert kept == want and len(want) < len(docs) / 2


def test_near_copies_of_empty_table(spark):
    assert rows(near.near_copies(spark.createDataFrame([], DOC))) == []


def test_recall_of_pairs_around_the_similarity(spark):
    """Pairs alone, at a similarity of 0.78 to 0.95: of those at 0.8 and more, nearly all are found, of the others none."""
    rng = random.Random(31)
    docs, want = [], set()
    for i in range(300):
        base = [f"{rng.choice(WORDS)}{i}" for _ in range(rng.randrange(80, 300))]
        copy = list(base)
        for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.uniform(0.004, 0.026)))):
            copy[at] = "other"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, copy))
        if len(a & b) >= 0.8 * len(a | b):
            want.add(2 * i + 1)
    got = {r[0] for r in rows(near.near_copies(spark.createDataFrame(docs, DOC))) if r[0] != r[1]}
    assert 100 < len(want) < 290 and got <= want and len(got) >= 0.995 * len(want)


def test_fingerprints_alone_link_the_closest_copies(spark, monkeypatch):
    """With no band in common, what is left is op6's method: fingerprints within two bits, checked on whole sets."""
    rng = random.Random(5)
    docs = []
    for i in range(40):
        base = [f"{rng.choice(WORDS)}{i}" for _ in range(rng.randrange(300, 900))]
        docs += [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(["start", *base[1:]]), " ".join([*base[: len(base) // 2], "middle", *base[len(base) // 2 :]])]
    docs = list(enumerate(docs, 1))
    of = {k: near.shingles(t) for k, t in docs}
    fps = {k: near.fingerprint_of(s) for k, s in of.items()}
    links = {(u, v) for u in fps for v in fps if u < v and (fps[u] ^ fps[v]).bit_count() <= 2 and len(set(of[u]) & set(of[v])) >= 0.8 * len(set(of[u]) | set(of[v]))}
    want = {k: k for k in fps}
    for _ in docs:
        for u, v in links:
            want[u] = want[v] = min(want[u], want[v])
    bands = near.with_bands
    monkeypatch.setattr(near, "with_bands", lambda *a: bands(*a).withColumn("keys", F.array("node")))
    got = dict(rows(near.near_copies(spark.createDataFrame(docs, DOC))))
    assert got == want and len(set(want.values())) < 0.75 * len(docs)
