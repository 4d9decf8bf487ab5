"""Runs shared with references against a table of common suffixes, and repetitive texts within bounded memory."""

import random
import resource
import time

import numpy as np
import pyarrow as pa

from textloom.operators import ngrams


def longest_common(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for k, y in enumerate(b):
            now.append(before[k] + 1 if x == y else 0)
        best, before = max(best, *now), now
    return best


def test_runs_are_those_of_a_table():
    rng = random.Random(1)
    for trial in range(60):
        letters, order = rng.choice(["ab", "abc", "a"]), rng.choice([1, 3, 5])
        texts, refs = (["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        if trial % 3 == 0:
            refs[0] = "c" * 70 + texts[0]
        held = ngrams.References.of(pa.table({"key": list(range(len(refs))), "t": refs}), order)
        code, lengths = ngrams.code_points(texts)
        for most in (300, 1 << 20):
            got = {(int(r), int(k)): int(n) for r, k, n in zip(*held.runs(code, np.cumsum(lengths) - lengths, lengths, order, most))}
            assert got == {(i, k): n for i, a in enumerate(texts) for k, b in enumerate(refs) if (n := longest_common(a, b) if a and b else 0) >= order}
        once = held.distinct(order)
        grams = [tuple(once.code[p : p + order]) for p in once.place]
        assert len(set(grams)) == len(grams) and set(grams) == {tuple(map(ord, r[i : i + order])) for r in refs for i in range(len(r) - order + 1)}


def test_a_repetitive_text_needs_bounded_memory():
    held = ngrams.References.of(pa.table({"key": [0, 1], "t": ["a" * 2000, "b" * 30]}), 12)
    code, lengths = ngrams.code_points(["a" * 20_000, "ab" * 5_000])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = held.runs(code, np.cumsum(lengths) - lengths, lengths, 12)
    assert [list(map(int, x)) for x in got] == [[0], [0], [2000]]
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400 and time.time() - began < 60
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    whole = ngrams.References.of(pa.table({"key": [0], "t": [text]}), 12)
    code, lengths = ngrams.code_points([text])
    assert int(whole.runs(code, np.zeros(1, dtype=np.int64), lengths, 12)[2][0]) == 300_000


def test_ngrams_are_counted_in_slices_of_a_batch():
    import pyarrow as pa
    from textloom.operators import ngrams

    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * 1000] * 2000)], ["letters"])
    found = list(ngrams.counted(iter([batch]), [], [2]))
    assert len(found) > 2  # 4 MB of text, about a megabyte at once
    assert sum(n for part in found for g, n in zip(part.column("gram").to_pylist(), part.column("n").to_pylist()) if g == "ab") == 2000 * 1000
