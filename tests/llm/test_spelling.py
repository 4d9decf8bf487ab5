"""Spelling variants against plain counts and all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL
from test_dedup import DOC, ordered, rows

from textloom.llm import queries, spelling
from textloom.llm.common import table


def brute_words(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(docs):
    n = brute_words(docs)
    # words one edit apart share what is left without one letter
    left = {}
    for w in n:
        for cut in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            left.setdefault(cut, []).append(w)
    near = {w: set() for w in n}
    for group in left.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def made(seed, letters="ab", words=120, length=(5, 9), copies=(3, 400), docs=40):
    """Words over few letters, so that runs of equal letters and many near words occur, dealt over documents."""
    rng = random.Random(seed)
    bag = []
    for _ in range(words):
        bag += ["".join(rng.choice(letters) for _ in range(rng.randrange(*length)))] * rng.choice([copies[0], 5, 6, 30, copies[1]])
    rng.shuffle(bag)
    cut = -(-len(bag) // docs)
    return [(i, rng.choice([" ", ", ", "1"]).join(bag[i * cut : (i + 1) * cut])) for i in range(docs)]


@pytest.mark.parametrize("subtree", [1, 7, 2048])
@pytest.mark.parametrize("letters", ["ab", "aBéÉz"])
def test_variants_agree_with_all_pairs(spark, monkeypatch, subtree, letters):
    """Whether nodes are merged in tasks or by the join above the cuts."""
    monkeypatch.setattr(spelling, "SUBTREE", subtree)
    docs = made(len(letters) + subtree, letters, 120 if len(letters) == 2 else 900, (5, 9) if len(letters) == 2 else (6, 8))
    got = rows(spelling.variants(spark.createDataFrame(docs, DOC).repartition(4)))
    assert ordered(got) == ordered(brute(docs)) and any(r[4] > 2 for r in got)


def test_cuts_deeper_than_one_window(spark, monkeypatch):
    """Words that share more letters than DEPTHS, some of which end at a crowded node."""
    monkeypatch.setattr(spelling, "SUBTREE", 2)
    stem = "prefix" * 4
    words = [stem + x for x in ("", "a", "b", "aa", "ab", "ba", "aba", "abb", "abab", "abba")] + [stem[:-1], stem[:-2] + "x", stem[1:]]
    docs = [(i, " ".join(words)) for i in range(20)]
    assert ordered(rows(spelling.variants(spark.createDataFrame(docs, DOC)))) == ordered(brute(docs))


def test_pairs_of_a_trie_come_once():
    rng = random.Random(2)
    for alphabet in ("a", "ab", "abcd"):
        for _ in range(60):
            words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 8))) for _ in range(rng.randrange(1, 60))})
            found = [frozenset(p) for p in spelling.one_edit_pairs(words, 0)]
            want = {frozenset((i, j)) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and one_edit(a, b)}
            assert set(found) == want and len(found) == len(want)


def test_chains_of_forms_lead_to_the_last(spark):
    counts = {"chainsaaaaa": 5, "chainsaaaab": 25, "chainsaaabb": 125, "chainsaabbb": 625, "chainsabbbb": 3125}
    docs = [(None, (w + " ") * n) for w, n in counts.items()]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {w: r[2] for r in brute(docs) for w in [r[0]]} and len(set(got.values())) < len(got)


def test_edges(spark):
    assert rows(spelling.variants(spark.createDataFrame([], DOC))) == []
    assert rows(spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "few words")], DOC))) == []
    long_word = "x" * 100_000
    docs = [(i, t) for i in range(6) for t in (long_word, long_word + "y", "×÷ÀABCD ×÷Àabce", None)] + [(1, "repeated " * 3), (1, "repeated " * 3), (None, "repeatet " * 40)]
    assert ordered(rows(spelling.variants(spark.createDataFrame(docs, DOC)))) == ordered(brute(docs))
    clash = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS word", "2 AS n", "3 AS id", "'x' AS run")
    assert len(rows(spelling.variants(clash))) == len(brute(docs))


def test_query_on_the_smallest_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    assert ordered(rows(queries.op13_spelling_variants(spark, SMALL))) == ordered(brute(docs))
