"""Exact dedup, SimHash, sharding and repeated substrings against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, graph, sharding, simhash, substring_dedup

DOC = "doc_id long, text string"
#: Null, empty, blank, repeated rows, ties, a long text, and other scripts.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d"), (5, "a  b c d"), (6, "abcd"), (7, "a b\x0bc d"), (7, "a b\x0bc d"), (8, "words " * 20000), (9, "words  " * 20000), (10, " x"), (11, "x"), (None, "x"), (None, None)]


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- exact dedup


def brute_exact(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for i, t in docs:
        same = [(j, u) for j, u in docs if norm(u) == norm(t)]
        keep = min(same, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))[0]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def ordered(x):
    return sorted(x, key=str)


def test_exact_dedup_edges(spark):
    assert ordered(rows(exact_dedup.exact_dedup(spark.createDataFrame(EDGES, DOC)))) == ordered(brute_exact(EDGES))


def test_exact_dedup_random_copies(spark):
    rng = random.Random(1)
    docs = [(i, " " * rng.randrange(3) + rng.choice("abc") * rng.randrange(4) + "\n" * rng.randrange(2)) for i in range(400)]
    assert ordered(rows(exact_dedup.exact_dedup(spark.createDataFrame(docs, DOC)))) == ordered(brute_exact(docs))


def test_exact_dedup_of_a_hot_text_and_a_shared_beginning(spark):
    """A third of the rows have one text, and another third begin alike for longer than a splitter."""
    rng = random.Random(2)
    docs = [(i, "hot text" + " " * rng.randrange(3)) for i in range(300)] + [(i, "x" * 200 + str(rng.randrange(200))) for i in range(300, 600)]
    docs += [(i, str(i)) for i in range(600, 900)] + [(899, "hot  text  "), (900, "hot  text  ")]
    frame = spark.createDataFrame(docs, DOC).repartition(6)
    assert exact_dedup.hot_texts(frame.selectExpr("xxhash64(replace(text, ' ')) AS digest", "octet_length(text) + 64 AS weight"), 4) is not None
    assert ordered(rows(exact_dedup.exact_dedup(frame))) == ordered(brute_exact(docs))


def test_exact_dedup_takes_ids_of_any_kind(spark):
    """String ids, and the least long, also where a text is hot and its pieces' runs are merged."""
    docs = [(f"d{i:04}", "hot text " * 9 + " " * (i % 3)) for i in range(200)] + [(f"e{i:04}", f"own {i}") for i in range(60)]
    got = rows(exact_dedup.exact_dedup(spark.createDataFrame(docs, "doc_id string, text string").repartition(6)))
    assert len(got) == 260 and {r[1] for r in got if r[0].startswith("d")} == {"d0002"}
    least = [(-(2**63) + i, "hot text") for i in range(200)] + [(i, f"own {i}") for i in range(60)]
    got = rows(exact_dedup.exact_dedup(spark.createDataFrame(least, DOC).repartition(6)))
    assert ordered(got) == ordered(brute_exact(least))


@pytest.mark.parametrize("name", ["kept_id", "KEPT_ID", "__id", "__first", "id", "first", "node"])
def test_dropping_takes_columns_of_any_name(spark, name):
    from textloom.llm import near

    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e\tf", 8), (3, "x", 9)], f"doc_id long, text string, `{name}` int")
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, near.drop_near_copies):
        got = drop(docs)
        assert got.columns == docs.columns and ordered(r[0] for r in rows(got)) == [1, 3]


def test_exact_dedup_shuffles_texts_once(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2900) AS text")
    plan = exact_dedup.exact_dedup(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan and "lag(content" in plan


def test_exact_dedup_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (3, "c")], DOC)
    assert ordered(rows(exact_dedup.drop_exact_duplicates(docs))) == [(1, "a b"), (1, "a b"), (3, "c")]


def test_exact_dedup_empty_and_clashing_columns(spark):
    assert rows(exact_dedup.exact_dedup(spark.createDataFrame([], DOC))) == []
    clash = spark.createDataFrame([(1, "x", "y", 3, 4), (2, "x", "z", 5, 6)], "doc_id long, text string, content string, keep_id int, points int")
    assert ordered(r[:2] for r in rows(exact_dedup.exact_dedup(clash))) == [(1, 1), (2, 1)]
    kept = exact_dedup.drop_exact_duplicates(clash)
    assert kept.columns == clash.columns and rows(kept) == [(1, "x", "y", 3, 4)]


def test_exact_dedup_plan_has_no_python(spark):
    plan = exact_dedup.exact_dedup(spark.createDataFrame(EDGES, DOC).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- components


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "u long, v long"))))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == want


def test_components_of_nothing(spark):
    assert rows(graph.components(spark.createDataFrame([], "u long, v long"))) == []


def test_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert dict(rows(graph.components(spark.createDataFrame(edges, "u long, v long")))) == {n: find(n) for n in nodes}


# ---- SimHash


def brute_fingerprint(text, words=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = {f: f for f in fps}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f

    for a, b in itertools.combinations(set(fps), 2):
        if bin(a ^ b).count("1") <= 2:
            label[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in fps]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ABab éÉ \u0085\x1c\t\n\x0b,", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def near_copies(seed=5, n=160):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))) for _ in range(n // 8)]
    docs = []
    for i in range(n):
        w = rng.choice(base).split()
        if w and rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice("xyz")
        docs.append((i + 1, " ".join(w)))
    return docs


def test_near_duplicates_agree_with_brute_force(spark):
    docs = near_copies() + EDGES
    ids, fps = [d[0] for d in docs], [brute_fingerprint(d[1]) for d in docs]
    want = [(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps))]
    assert ordered(rows(simhash.near_duplicates(spark.createDataFrame(docs, DOC)))) == ordered(want)


def test_near_duplicates_with_a_hot_text(spark):
    docs = [(i, "one two three four" if i % 3 == 0 else f"word{i} " * 9) for i in range(1200)]
    got = {r[0]: r[2] for r in rows(simhash.near_duplicates(spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS fp", "2 AS id", "3 AS component_id")))}
    ids, fps = [d[0] for d in docs], [brute_fingerprint(d[1]) for d in docs]
    assert got == dict(zip(ids, brute_components(ids, fps)))


def test_near_duplicates_of_empty_table(spark):
    assert rows(simhash.near_duplicates(spark.createDataFrame([], DOC))) == []


@pytest.mark.parametrize("pairwise", [1, 24])
def test_links_of_crowded_keys(spark, monkeypatch, pairwise):
    """Fingerprints close to each other fill the same keys; the components must not depend on how these are joined."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = rows(simhash.linked(spark.createDataFrame(signed, "fp long")))
    parent = {f[0]: f[0] for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 4  # a star's arms meet at a midpoint
        parent[find(u)] = find(v)
    want = {}
    for f, c in zip([f[0] for f in signed], brute_components(range(len(fps)), [f[0] & (1 << 64) - 1 for f in signed])):
        want.setdefault(c, set()).add(f)
    got = {}
    for (f,) in signed:
        got.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_words_within_two_bits_share_a_codeword():
    """Exhaustive over syndromes and error patterns: the property that the keys rest on."""
    flips = simhash.neighbour_flips()
    assert ((flips >= 0).sum(axis=1) >= 1).all()
    errors = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a, b in itertools.combinations(range(23), 2)]
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, size=3000)
    mine = [set(r[r >= 0].tolist()) for r in simhash.nearby_indices(words, flips)]
    for e in errors:
        other = simhash.nearby_indices(words ^ e, flips)
        for a, r in zip(mine, other):
            assert a & set(r[r >= 0].tolist()), e


def test_codewords_have_distance_seven():
    words = simhash.codewords()
    assert len(set(words.tolist())) == 4096
    assert min(bin(int(w)).count("1") for w in words[1:]) == 7


# ---- sharding


def test_shards_hold_whole_groups_and_are_near_equal(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("abcdef") * int(rng.paretovariate(0.9) * 5 % 4000) + str(i if rng.random() < 0.8 else 0)) for i in range(900)] + [(i, "copy" * 30) for i in range(900, 1000)] + EDGES
    got = rows(sharding.shard(spark.createDataFrame(docs, DOC)))
    assert len(got) == len(docs)
    by_shard = {}
    for i, size, crc, law, shard, slot, grown in got:
        assert law == "bytes" and grown is None and 0 <= shard < 16
        by_shard.setdefault(shard, []).append((slot, size))
    for members in by_shard.values():
        assert sorted(s for s, _ in members) == list(range(len(members)))
    key = lambda t: (zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)
    assert ordered((r[0], r[2], r[1]) for r in got) == ordered((i, *key(t)) for i, t in docs)
    where = {}
    for r in got:
        where.setdefault((r[2], r[1]), set()).add(r[4])
    assert all(len(s) == 1 for s in where.values())
    groups = {}
    for r in got:
        groups.setdefault(r[4], set()).add((r[2], r[1]))
    # shards of one indivisible group above the share stand alone; the others' sizes are near equal
    rest = [sum(size for _, size in m) for shard, m in by_shard.items() if len(groups[shard]) > 1]
    assert len(by_shard) == 16 and len(rest) > 5 and max(rest) - min(rest) <= 0.01 * max(rest)


def test_packing_rounds_sizes_up_within_its_bound(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 1 << rng.randrange(1, 45)) for _ in range(3000)] + [1, (1 << sharding.BITS) - 1, 1 << sharding.BITS]
    for size, item in rows(spark.createDataFrame([(s,) for s in sizes], "size long").select("size", sharding.rounded_up(F.col("size")))):
        assert size <= item <= size * (1 + 2.0 ** (1 - sharding.BITS)) and (item == size or size >= 1 << sharding.BITS)


def test_sharding_with_a_hot_text_and_clashing_columns(spark):
    docs = [(i, "hot " * 5 if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = rows(sharding.shard(spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS size", "2 AS shard", "'x' AS digest", "3 AS slot")))
    assert len(got) == 3000 and len({r[4] for r in got if r[0] % 3 == 0}) == 1
    for k in range(16):
        assert sorted(r[5] for r in got if r[4] == k) == list(range(sum(r[4] == k for r in got)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 30)), max_size=60))
def test_rooms_give_the_tightest(steps):
    rooms, plain = sharding.Rooms(), []
    for i, (add, n) in enumerate(steps):
        if add:
            rooms.add(n, i)
            plain.append((n, i))
        else:
            want = min((x for x in plain if x[0] >= n), default=None)
            assert rooms.tightest(n) == want
            if want:
                plain.remove(want)


def test_sharding_of_empty_table_and_fixed_capacity(spark):
    assert rows(sharding.shard(spark.createDataFrame([], DOC))) == []
    docs = [(i, "x" * n) for i, n in enumerate([59, 49, 39, 29, 19, 9, 99, 9])]
    got = rows(sharding.shard(spark.createDataFrame(docs, DOC), shards=None, capacity=100))
    load = {}
    for r in got:
        load[r[4]] = load.get(r[4], 0) + r[1]
    assert max(load.values()) <= 100 and len(load) == 4


def plain_best_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if s > capacity or not fits:
            room.append(max(0, capacity - s))
        else:
            room[min(fits)[1]] -= s
    return room


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(5, 70))
def test_packing_is_best_fit_decreasing(sizes, capacity):
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    plan = sharding.best_fit_decreasing(histogram, capacity)
    load, ranks = {}, {}
    for size, a, b, shard in plan:
        load[shard] = load.get(shard, 0) + size * (b - a)
        ranks.setdefault(size, []).append((a, b))
    for size, n in histogram:
        spans = sorted(ranks[size])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    room = plain_best_fit(sizes, capacity)
    assert len(load) == len(room)
    assert sorted(max(0, capacity - x) for x in load.values()) == sorted(room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=80), st.integers(1, 12))
def test_tightest_capacity_needs_no_more_bins(sizes, bins):
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    capacity = sharding.tightest_capacity(histogram, bins)
    assert len({b for *_, b in sharding.best_fit_decreasing(histogram, capacity)}) <= bins


# ---- repeated substrings


def brute_removed(docs, length=100):
    """docs: (id, bytes) in order of id."""
    first, out = {}, []
    for i, t in docs:
        for a in range(len(t) - length + 1):
            first.setdefault(t[a : a + length], (i, a))
    for i, t in docs:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] != (i, a):
                gone[a : a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_docs(seed, n=60):
    rng = random.Random(seed)
    phrase = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    shared = [phrase(rng.randrange(80, 400)) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [phrase(rng.randrange(0, 200)) if rng.random() < 0.5 else rng.choice(shared)[rng.randrange(0, 60) :] for _ in range(rng.randrange(0, 8))]
        docs.append((i, "".join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_agree_with_brute_force(spark, seed):
    docs = repeating_docs(seed)
    docs += [(100, "ab" * 400), (101, "a" * 1000), (102, "a" * 99), (103, "a" * 100), (104, None), (105, ""), (106, docs[3][1]), (107, docs[3][1]), (108, "a" * 350 + "b" * 99)]
    rng = random.Random(seed)
    shuffled = rng.sample(docs, len(docs))
    got = rows(substring_dedup.remove_repeats(spark.createDataFrame(shuffled, DOC).repartition(5)).drop("kept"))
    assert sorted(got) == brute_removed([(i, (t or "").encode()) for i, t in docs])


def test_crowded_anchors_agree_with_brute_force(spark, monkeypatch):
    """One line in every document, each time between other words: its windows are dealt out one by one."""
    monkeypatch.setattr(substring_dedup, "CROWDED", 3)
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    around = ["".join(rng.choice("xyz") for _ in range(60)) for _ in range(6)]
    docs = [(i, rng.choice(around) + line + rng.choice(around) + (line if i % 5 == 0 else "")) for i in range(60)] + repeating_docs(4, 0)
    got = rows(substring_dedup.remove_repeats(spark.createDataFrame(docs, DOC).repartition(4)).drop("kept"))
    want = brute_removed([(i, t.encode()) for i, t in docs])
    assert sorted(got) == want and sum(w[2] for w in want) > 1000


def test_buckets_are_read_one_by_one_and_those_of_the_merge_follow_its_segments(spark, monkeypatch):
    """Many buckets meet in a task, which reads them in turn; the merge has as many as its own segments fill, not the text."""
    dealt, merge, seen = substring_dedup.dealt, substring_dedup.merge_buckets, []
    monkeypatch.setattr(substring_dedup, "PARTITION_BYTES", 200)
    monkeypatch.setattr(substring_dedup, "MERGE_SYMBOLS", 300)
    monkeypatch.setattr(substring_dedup, "dealt", lambda rows, n: dealt(rows.repartition(1), n).coalesce(1).sortWithinPartitions("bucket"))
    monkeypatch.setattr(substring_dedup, "merge_buckets", lambda shards, n: seen.append((n, shards.select("bucket").distinct().count())) or merge(shards, n))
    docs = repeating_docs(5)
    got = rows(substring_dedup.remove_repeats(spark.createDataFrame(docs, DOC).repartition(4)).drop("kept"))
    assert sorted(got) == brute_removed([(i, (t or "").encode()) for i, t in docs])
    assert seen[0][0] > substring_dedup.shuffle_partitions(spark) and seen[0][1] > 4
    batch = pa.record_batch({"bucket": [1, 1, 1, 3], "data": [b"a", b"b", b"c", b"d"]}), pa.record_batch({"bucket": [3, 4], "data": [b"e", b"f"]})
    assert list(substring_dedup.by_bucket(iter(batch))) == [[b"a", b"b", b"c"], [b"d", b"e"], [b"f"]]


def test_kept_bytes_are_returned(spark):
    docs = [(1, "x" * 10 + "q" * 100), (2, "head" + "q" * 100 + "tail")]
    got = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {1: ("x" * 10 + "q" * 100).encode(), 2: b"headtail"}


def test_repeats_of_empty_table_nulls_and_repeated_rows(spark):
    assert rows(substring_dedup.remove_repeats(spark.createDataFrame([], DOC))) == []
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(120))
    got = rows(substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text)], DOC)).drop("kept", "kept_sha256"))
    n = len(text)
    assert ordered(got) == ordered([(1, n, 0, 0), (1, n, 0, 0), (None, n, n, 1)])


def test_merge_of_shards_finds_all_repeated_windows():
    rng = random.Random(4)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(10, 60))) for _ in range(6)] + [b"ab" * 20, b"ab" * 20]
        cut = rng.randrange(1, len(texts))
        shards = []
        for part in (texts[:cut], texts[cut:]):
            bwt, ends = substring_dedup.transform(part)
            shards.append((bwt, ends, np.array([len(t) for t in part]), np.zeros(len(part), dtype=np.int64)))
        interval, segment, offset = substring_dedup.merged_repeats(shards, 10)
        got = {}
        for k, s, o in zip(interval.tolist(), segment.tolist(), offset.tolist()):
            got.setdefault(k, set()).add((s, o))
        want = {}
        for s, t in enumerate(texts):
            for o in range(len(t) - 9):
                want.setdefault(t[o : o + 10], set()).add((s, o))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_long_text_in_stretches(monkeypatch):
    text = bytes(random.Random(6).choice(b"abcdefgh") for _ in range(5000))
    whole = substring_dedup.segments_of([text])
    monkeypatch.setattr(substring_dedup, "LONG", 700)
    cut = substring_dedup.segments_of([text])
    windows = lambda s: sorted(w for a, b in zip(s.low.tolist(), s.high.tolist()) for w in range(a, b + 1))
    assert windows(whole) == windows(cut) == list(range(len(text) - 99))
