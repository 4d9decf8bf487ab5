"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest
from conftest import SMALL
from test_dedup import ordered, rows

from textloom.llm import embeddings, queries
from textloom.llm.common import table

VEC = "vec_id long, embedding array<float>"


def brute(vectors, least=0.9):
    """(id, links, smallest id reachable, kept) over all pairs."""
    unit = []
    for _, v in vectors:
        x = np.array(v if v is not None and all(c is not None for c in v) else [], dtype=np.float64)
        unit.append(x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None)
    n = len(vectors)
    near = [[i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least for j in range(n)] for i in range(n)]
    key = lambda k: (vectors[k][0] is None, vectors[k][0] or 0)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j in range(n):
                if near[k][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = vectors[min(seen, key=key)][0]
        out.append((vectors[i][0], sum(near[i]), least_id, vectors[i][0] == least_id))
    return out


def clustered(seed=3, strangers=60, clusters=((40, 0.1), (25, 0.25), (30, 0.4)), d=32):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(d) for _ in range(strangers)]
    for n, noise in clusters:
        base = rng.standard_normal(d)
        base /= np.linalg.norm(base)
        out += [base + noise * rng.standard_normal(d) / math.sqrt(d) * rng.choice([0.5, 1.0, 1.2]) for _ in range(n)]
    out = [out[i] for i in rng.permutation(len(out))]
    return [(int(10 + i), [float(np.float32(c)) for c in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("block", [3, 16, 256])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    """Also where buckets and components are cut into blocks: cores, fringes and the rest."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "RECALL", 0.9999)
    vectors = clustered()
    got = rows(embeddings.near_duplicates(spark.createDataFrame(vectors, VEC).repartition(3)))
    want = brute(vectors)
    assert ordered(got) == ordered(want) and 30 < sum(not r[3] for r in want)


def test_edges(spark):
    base = clustered(4, 5, ((6, 0.1),), 8)
    odd = [(1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] * 8), (5, [None] + [1.0] * 7), (6, [float("inf")] + [1.0] * 7), (7, [1.0] * 9), (8, [1.0] * 8)]
    copies = [(100 + i, base[0][1]) for i in range(20)] + [(200, [2 * x for x in base[0][1]]), (10, base[0][1]), (10, base[0][1]), (None, base[0][1]), (None, None), (300, [-x for x in base[0][1]])]
    tiny = [(400, [1e-30] * 8), (401, [3e38] * 8)]
    vectors = base + odd + copies + tiny
    assert ordered(rows(embeddings.near_duplicates(spark.createDataFrame(vectors, VEC)))) == ordered(brute(vectors))


def test_hot_vector(spark):
    """A third of the rows are one vector."""
    vectors = clustered(5, 40, ((20, 0.1),), 16)
    hot = [(1000 + i, vectors[7][1]) for i in range(200)]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(vectors + hot, VEC)).collect()}
    want = {i: n for i, n, _, _ in brute(vectors + hot[:2])}
    assert got[1000] == got[1199] == want[1000] + 198 and len(got) == 260


def test_empty_table_and_clashing_columns(spark):
    assert rows(embeddings.near_duplicates(spark.createDataFrame([], VEC))) == []
    vectors = clustered(6, 5, ((5, 0.1),), 8)
    frame = spark.createDataFrame(vectors, VEC)
    clash = frame.selectExpr("*", "1 AS id", "2 AS unit", "3 AS node", "'x' AS group", "4 AS component_id")
    assert ordered(rows(embeddings.near_duplicates(clash))) == ordered(brute(vectors))
    doubles = frame.selectExpr("cast(vec_id AS string) AS vec_id", "cast(embedding AS array<double>) AS embedding")
    assert len(rows(embeddings.near_duplicates(doubles))) == 10


def test_recall_over_made_pairs(spark):
    """Pairs spread over cosines from 0.9 up, each found with RECALL or more on average."""
    rng = np.random.default_rng(8)
    vectors, pairs = [], 400
    for i in range(pairs):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9005 + 0.05 * i / pairs
        vectors += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    found = got.filter("NOT kept").count()
    assert 0.95 * pairs <= found <= pairs


def test_query_on_the_smallest_tables(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL, "embeddings").collect()]
    assert ordered(rows(queries.op12_embedding_dedup(spark, SMALL))) == ordered(brute(vectors))
