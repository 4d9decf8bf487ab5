"""Repeated substrings: anchored segments, shard Burrows-Wheeler transforms, merged by interleave refinement.

A string of LENGTH bytes is repeated if it starts earlier too. Where a window's smallest hashed k-mer (its anchor)
falls depends on the window's bytes alone, so equal windows have equal anchors: dealing windows out by
anchor keeps all equal windows together and lets each bucket be settled by itself. The windows of one anchor
overlap and form a segment. Segments equal to an earlier one are removed whole by digest. Of the rest, those whose
anchor occurs in different segments go, as transforms built shard by shard, to the merge. Windows of an anchor that
is in very many different segments are dealt out by their own hashes instead, so that no task has them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, slices

LENGTH, ANCHOR = 100, 24
#: Bytes of text for each partition that anchors are dealt to; bytes of text handled at a time in a task.
PARTITION_BYTES, SLICE_BYTES = 48 << 20, 2 << 20
#: Symbols of segments for each bucket of the merge, which takes some 30 bytes for each. How many segments are to be merged
#: follows from how often anchors meet, which grows faster than the text, so it is counted.
MERGE_SYMBOLS = 4 << 20
#: An anchor in more different segments than this is not merged in one task: its windows are dealt out one by one. A merge
#: takes about 4 kB a segment (some 30 bytes for each of 140 symbols), so this many take 300 MB of a task's memory.
CROWDED = 1 << 16
#: Segments' bytes of a shard after which a task closes it and starts another.
SHARD_BYTES = 8 << 20
#: Places within a slice have 24 bits; a text of more than twice this is taken in stretches of it.
LONG = 2 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LAST = 2**63 - 1

#: What tasks exchange: kind 0 anchors of a bucket (packed), 1 a removed stretch, 2 a segment to be merged, 3 a segment of a crowded anchor.
PARTS = "bucket int, kind int, id long, version long, low long, high long, anchor long, data binary"


@dataclass
class Segments:
    """Anchored segments of a slice: document number, window starts [low, high], and hashes."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray


def segments_of(texts: list[bytes], length: int = LENGTH, k: int = ANCHOR) -> Segments:
    """All segments of some documents, in order of document and place.

    A text that is too long for the packed places is taken in stretches, which cuts a few segments in two.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * LONG:
        cut = [(a, segments_of([texts[0][a : a + LONG - 1 + length]], length, k)) for a in range(0, len(texts[0]), LONG)]
        return Segments(*(np.concatenate([getattr(s, c) + (np.int64(a) if c in ("low", "high") else getattr(s, c).dtype.type(0)) for a, s in cut]) for c in ("doc", "low", "high", "anchor", "digest")))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"".join(texts)
    n, w = len(joined), length - k + 1
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return Segments(z, z, z, z.astype(np.uint64), z.astype(np.uint64))
    data = np.frombuffer(joined, dtype=np.uint8)
    # k-mer hashes: 64-bit words of 8 bytes, mixed and summed; only an order, so quality matters little
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        word |= padded[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    word *= MULTIPLIER
    word ^= word >> np.uint64(29)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    m = n - k + 1
    h = word[:m].copy()
    for j in range(8, k - 7, 8):
        h = (h ^ (h >> np.uint64(31))) * MULTIPLIER + word[j : j + m]
    h ^= h >> np.uint64(32)
    del word, padded
    # smallest hash of each window, with its place: block-wise running minima from both sides
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // w)
    grid = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:m] = key
    grid = grid.reshape(blocks, w)
    del h, key
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    del grid, ahead, behind
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)[:windows]
    valid = np.arange(windows) + length <= ends[doc]
    at = np.flatnonzero(valid)
    if not len(at):
        z = np.zeros(0, dtype=np.int64)
        return Segments(z, z, z, z.astype(np.uint64), z.astype(np.uint64))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    low, high, p = at[first], at[np.append(first[1:], len(at)) - 1], place[at[first]]
    hash64 = xxhash.xxh3_64_intdigest
    digest = np.fromiter((hash64(joined[a : b + length]) for a, b in zip(low.tolist(), high.tolist())), dtype=np.uint64, count=len(low))
    anchor = np.fromiter((hash64(joined[a : a + k], 7) for a in p.tolist()), dtype=np.uint64, count=len(p))
    start = (ends - sizes)[doc[low]]
    return Segments(doc[low], low - start, high - start, anchor, digest)


def union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint stretches that cover the given ones; touching ones become one."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), dtype=bool)
    new[1:] = low[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return low[first], reach[np.append(first[1:], len(low)) - 1]


def part(bucket=(), kind=0, id=(), version=(), low=(), high=(), anchor=(), data=None) -> pa.RecordBatch:
    """A batch of PARTS; columns that a kind doesn't use are null."""
    n = max(len(x) for x in (bucket, id, data or ()))
    column = lambda x, t: pa.array(x, t) if len(x) else pa.nulls(n, t)
    whole = [column(x, pa.int64()) for x in (id, version, low, high, anchor)]
    return pa.RecordBatch.from_arrays(
        [column(bucket, pa.int32()), pa.array(np.full(n, kind), pa.int32()), *whole, pa.array(data, pa.binary()) if data else pa.nulls(n, pa.binary())],
        ["bucket", "kind", "id", "version", "low", "high", "anchor", "data"],
    )


RECORD = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("doc", "<u4"), ("low", "<u4"), ("more", "u1")])


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """PARTS of all documents: their anchors packed by bucket, and stretches repeated within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "version"))
            order = np.lexsort((versions, ids))
            ids, versions = ids[order], versions[order]
            texts = batch.column("text").take(pa.array(order)).to_pylist()
            yield from slice_parts(ids, versions, texts)

    def slice_parts(ids: np.ndarray, versions: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        s = segments_of(texts)
        if not len(s.low):
            return
        _, first, group = np.unique(s.digest, return_index=True, return_inverse=True)
        later = first[group] < np.arange(len(group))
        same = (ids[s.doc] == ids[s.doc[first[group]]]) & (versions[s.doc] == versions[s.doc[first[group]]]) & (s.low == s.low[first[group]])
        later &= ~same  # a document that is given twice doesn't repeat itself
        if later.any():
            stride = int(s.high.max()) + 2 * LENGTH
            low, high = union(s.doc[later] * stride + s.low[later], s.doc[later] * stride + s.high[later] + LENGTH)
            d = low // stride
            yield part(bucket=(ids[d] % buckets).astype(np.int32), kind=1, id=ids[d], version=versions[d], low=low % stride, high=high - d * stride)
        keep = ~later
        bucket = (s.anchor[keep] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rec = np.empty(len(order), dtype=RECORD)
        for name, x in (("anchor", s.anchor), ("digest", s.digest), ("doc", s.doc), ("low", s.low), ("more", s.high - s.low)):
            rec[name] = x[keep][order]
        bucket = bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        data, where = [], []
        for a, b in zip([0, *cuts], [*cuts, len(rec)]):
            if b > a:
                used, rec["doc"][a:b] = np.unique(rec["doc"][a:b], return_inverse=True)
                head = np.stack([ids[used], versions[used]])
                data.append(len(used).to_bytes(4, "little") + head.astype("<i8").tobytes() + rec[a:b].tobytes())
                where.append(bucket[a])
        if data:
            yield part(bucket=np.array(where, dtype=np.int32), data=data)

    return docs.mapInArrow(run, PARTS)


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """rows by bucket, each task's in order: several buckets can meet in a task, the more the more there are, and are read one by one."""
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The data of each bucket of rows in order of bucket, one bucket at a time."""
    held: list[bytes] = []
    last = None
    for batch in batches:
        for small in slices([batch], SLICE_BYTES, "data"):
            for bucket, data in zip(small.column("bucket").to_pylist(), small.column("data").to_pylist()):
                if held and bucket != last:
                    full, held = held, []
                    yield full
                    del full
                last = bucket
                held.append(data)
    if held:
        yield held


def unpack(data: list[bytes]) -> dict[str, np.ndarray]:
    """The records of packed anchors, with their documents' ids and versions."""
    out: dict[str, list] = {c: [] for c in ("id", "version", *RECORD.names)}
    for d in data:
        n = int.from_bytes(d[:4], "little")
        head = np.frombuffer(d, dtype="<i8", count=2 * n, offset=4).reshape(2, n)
        rec = np.frombuffer(d, dtype=RECORD, offset=4 + 16 * n)
        out["id"].append(head[0][rec["doc"]])
        out["version"].append(head[1][rec["doc"]])
        for c in RECORD.names:
            out[c].append(rec[c])
    return {c: np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for c, x in out.items()}


def settle(parts: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: segments equal to an earlier one are removed (kind 1); the first of each digest is to be
    merged (kind 2) if its anchor occurs in another segment too, and is unique otherwise. Those of an anchor
    in more than CROWDED different segments are of kind 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_packed = pc.equal(batch.column("kind"), 0)
                passed.append(batch.filter(pc.invert(is_packed)))
                yield batch.filter(is_packed)

        for data in by_bucket(packed()):
            while passed:
                yield passed.pop()
            yield from settled(unpack(data))
        yield from passed

    def settled(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((r["low"], r["version"], r["id"], r["digest"], r["anchor"]))
        r = {c: x[order] for c, x in r.items()}
        new = np.ones(len(order), dtype=bool)
        new[1:] = (r["anchor"][1:] != r["anchor"][:-1]) | (r["digest"][1:] != r["digest"][:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = (r["id"] == r["id"][head]) & (r["version"] == r["version"][head]) & (r["low"] == r["low"][head])
        low = r["low"].astype(np.int64)
        high = low + r["more"]
        gone = ~new & ~same
        lone = np.ones(int(new.sum()), dtype=bool)
        lead = r["anchor"][new]
        lone[1:] &= lead[1:] != lead[:-1]
        lone[:-1] &= lead[:-1] != lead[1:]
        start = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
        n = np.diff(np.append(start, len(lead)))
        crowded = np.repeat(n > CROWDED, n)
        first = np.flatnonzero(new)
        for kind, at, reach in ((1, np.flatnonzero(gone), LENGTH), (2, first[~lone & ~crowded], 0), (3, first[crowded], 0)):
            for begin in range(0, len(at), 1 << 18):
                i = at[begin : begin + (1 << 18)]
                yield part(kind=kind, id=r["id"][i], version=r["version"][i], low=low[i], high=high[i] + reach, anchor=r["anchor"][i].view(np.int64))

    return dealt(parts, buckets).mapInArrow(run, PARTS)


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of texts, each followed by a separator (0; bytes are 1 to 256), and the row of each separator.

    Suffixes are sorted by doubling until all differ, so that the last-to-first map is exact.
    """
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths) - 1
    symbol = np.zeros(int(lengths.sum()), dtype=np.uint16)
    symbol[np.delete(np.arange(len(symbol)), ends)] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint16) + 1
    n, depth = len(symbol), 7
    padded = np.concatenate([symbol.astype(np.int64), np.zeros(7, dtype=np.int64)])
    rank = np.zeros(n, dtype=np.int64)
    for j in range(7):
        rank = (rank << 9) | padded[j : j + n]
    order = np.argsort(rank, kind="stable")
    while True:
        value = rank[order]
        new = np.ones(n, dtype=bool)
        new[1:] = value[1:] != value[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        ahead = np.concatenate([rank[depth:], np.zeros(min(depth, n), dtype=np.int64)])[:n]
        rank = rank * (n + 1) + ahead
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)  # places of the order that are not settled
        members = order[open_]
        order[open_] = members[np.argsort(rank[members], kind="stable")]
        depth *= 2
    row = np.empty(n, dtype=np.int64)
    row[order] = np.arange(n)
    return symbol[order - 1], row[ends]


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """For each row, the row of the suffix that begins one symbol earlier."""
    lf = np.empty(len(bwt), dtype=np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return lf


def merged_repeats(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur more than once, from shard transforms (bwt, separator rows, segment lengths, segment anchors).

    Equal windows have equal anchors, so the rows of all shards start as one interval an anchor; rows with fewer than
    `length` symbols before them cannot end a window and are left out. Each refinement reads the symbol before every row, keeps rows of
    an interval that share it together and moves them on by their own shard's last-to-first map: after d
    refinements the intervals are the sets of suffixes with a common prefix of d symbols. Intervals of one row are
    dropped, as their extensions would be single too. Nothing is sorted anew.

    Returns (interval, segment, offset) of each window in an interval of two or more; segments are numbered through the shards.
    """
    bwt = np.concatenate([s[0] for s in shards])
    base = np.cumsum([0] + [len(s[0]) for s in shards])
    whole = np.int32 if len(bwt) < 2**31 else np.int64
    lf = np.concatenate([(last_to_first(s[0]) + o).astype(whole) for s, o in zip(shards, base)])
    # where each row stands: walk back from the separators, all segments side by side
    lengths = np.concatenate([s[2] for s in shards])
    anchor = np.unique(np.concatenate([s[3] for s in shards]), return_inverse=True)[1]
    segment, offset = np.full(len(bwt), -1, dtype=whole), np.zeros(len(bwt), dtype=whole)
    cur = np.concatenate([s[1] + o for s, o in zip(shards, base)])
    who, left = np.arange(len(lengths)), lengths.copy()
    segment[cur], offset[cur] = who, left
    while len(who):
        cur, left = lf[cur], left - 1
        segment[cur], offset[cur] = who, left
        more = left > 0
        who, cur, left = who[more], cur[more], left[more]
    row = np.flatnonzero(offset >= length).astype(whole)
    interval = anchor[segment[row]]
    for _ in range(length):
        symbol = bwt[row].astype(np.int64)
        order = np.argsort(interval * 257 + symbol, kind="stable")
        row, symbol, interval = row[order], symbol[order], interval[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        keep = ~alone
        row, interval = lf[row[keep]], np.cumsum(new)[keep]
    return interval, segment[row], offset[row]


META = np.dtype([("id", "<i8"), ("version", "<i8"), ("low", "<u4"), ("length", "<u2"), ("end", "<u4"), ("anchor", "<i8")])


#: What is made of segments: a shard's transform (bucket, data), or a window of a crowded anchor (hash a, b and place).
PIECES = "bucket int, data binary, a long, b long, id long, version long, low long"


def pieces_of(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """PIECES of the wanted segments: transforms, a shard for each task and bucket, and windows of crowded anchors."""
    lists = wanted.groupBy("id", "version").agg(F.collect_list(F.struct("low", "high", "anchor", "kind")).alias("segments"))
    both = docs.join(lists.hint("merge"), ["id", "version"]).select("id", "version", "text", "segments")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def shards(held: list[tuple]) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for anchor, *rest in held:
            by.setdefault(anchor % buckets, []).append((*rest, anchor))
        data = []
        for members in by.values():
            bwt, ends = transform([t for t, *_ in members])
            meta = np.array([(i, v, low, len(t), e, k) for (t, i, v, low, k), e in zip(members, ends)], dtype=META)
            data.append(len(members).to_bytes(4, "little") + meta.tobytes() + bwt.astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(data, pa.binary()), *(pa.nulls(len(data), pa.int64()) for _ in range(5))], names)

    def windows(i: int, v: int, text: bytes, segments: list[dict]) -> pa.RecordBatch:
        at = np.concatenate([np.arange(s["low"], s["high"] + 1) for s in segments])
        digest = b"".join(xxhash.xxh3_128_digest(text[a : a + LENGTH]) for a in at.tolist())
        a, b = np.frombuffer(digest, dtype="<i8").reshape(-1, 2).T
        cols = [pa.array(np.ascontiguousarray(x)) for x in (a, b, np.full(len(at), i), np.full(len(at), v), at)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), *cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, SLICE_BYTES):
            for i, v, text, segments in zip(*(batch.column(c).to_pylist() for c in ("id", "version", "text", "segments"))):
                if crowded := [s for s in segments if s["kind"] == 3]:
                    yield windows(i, v, text, crowded)
                for s in segments:
                    if s["kind"] == 2:
                        held.append((s["anchor"], text[s["low"] : s["high"] + LENGTH], i, v, s["low"]))
                        size += s["high"] + LENGTH - s["low"]
                if size > SHARD_BYTES:
                    yield shards(held)
                    held, size = [], 0
        if held:
            yield shards(held)

    return both.mapInArrow(run, PIECES)


def crowded_repeats(windows: DataFrame) -> DataFrame:
    """(id, version, low, high): repeated windows of crowded anchors, dealt by the windows' own hashes.

    This is the exact way beyond CROWDED: equal windows are combined before the shuffle, and no task has more of an anchor
    than its share.
    """
    place = F.struct("id", "version", "low")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(first.hint("merge"), ["a", "b"]).filter(place > F.col("first"))
    return later.select("id", "version", "low", (F.col("low") + LENGTH).alias("high"))


def merge_buckets(shards: DataFrame, buckets: int) -> DataFrame:
    """(id, version, low, high): stretches of windows that the merge of a bucket's shards finds repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in by_bucket(batches):
            metas = [np.frombuffer(d, dtype=META, count=int.from_bytes(d[:4], "little"), offset=4) for d in data]
            bwts = [np.frombuffer(d, dtype="<u2", offset=4 + META.itemsize * len(m)) for d, m in zip(data, metas)]
            interval, segment, offset = merged_repeats([(b, m["end"].astype(np.int64), m["length"].astype(np.int64), m["anchor"]) for b, m in zip(bwts, metas)])
            meta = np.concatenate(metas)
            start = meta["low"][segment].astype(np.int64) + offset
            ids, versions = meta["id"][segment], meta["version"][segment]
            order = np.lexsort((start, versions, ids, interval))
            interval, start, ids, versions = interval[order], start[order], ids[order], versions[order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = interval[1:] != interval[:-1]
            head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
            gone = (ids != ids[head]) | (versions != versions[head]) | (start != start[head])
            ids, versions, start = ids[gone], versions[gone], start[gone]
            order = np.lexsort((start, versions, ids))
            ids, versions, start = ids[order], versions[order], start[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (start[1:] > start[:-1] + LENGTH)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(order)) - 1 if len(a) else a
            cols = [pa.array(x.astype(np.int64)) for x in (ids[a], versions[a], start[a], start[b] + LENGTH)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "version", "low", "high"])

    return dealt(shards, buckets).mapInArrow(run, "id long, version long, low long, high long")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(id, version, low, high) of docs (id, version, text binary): stretches made of repeated windows."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-int(total) // PARTITION_BYTES))
    parts = materialize(settle(anchors(docs, buckets), buckets), "anchored")
    keys = ["id", "version", "low", "high"]
    found = parts.filter("kind = 1").select(*keys)
    symbols = parts.filter("kind = 2").agg(F.sum(F.col("high") - F.col("low") + LENGTH + 1)).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-int(symbols) // MERGE_SYMBOLS))
    pieces = pieces_of(docs, parts.filter("kind > 1").select(*keys, "anchor", "kind"), buckets)
    if parts.filter("kind = 3").isEmpty():
        return found.unionByName(merge_buckets(pieces.select("bucket", "data"), buckets))
    pieces = materialize(pieces, "segment-pieces")
    merged = merge_buckets(pieces.filter("bucket is not null").select("bucket", "data"), buckets)
    return found.unionByName(merged).unionByName(crowded_repeats(pieces.filter("bucket is null").drop("bucket", "data")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text): null ids come last; the version tells texts under one id apart."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a LENGTH-byte string that also starts earlier (smaller id, or earlier start).

    Texts are UTF-8 bytes, null as empty; strings do not cross documents and are judged on the input, and
    overlapping occurrences count. Shorter texts lose nothing. A null id comes after all others. Rows with
    the same id and text are one document, and each of them gets its result; texts that differ under one id
    are ordered by their hash. An empty table gives an empty table. Only id and text are read.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the remaining bytes), kept_sha256.
    """
    rows = keyed(docs, id_col, text_col)
    gone = repeated_stretches(rows).groupBy("id", "version").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    both = rows.join(gone.hint("merge"), ["id", "version"], "left").select("id", "text", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            out = []
            for text, low, high in zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high"))):
                low, high = union(np.array(low or [], dtype=np.int64), np.array(high or [], dtype=np.int64))
                edges = [0, *(x for s in zip(low.tolist(), high.tolist()) for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(low), kept, hashlib.sha256(kept).hexdigest()))
            n, removed, spans, kept, sha = zip(*out)
            ids = [None if i == LAST else i for i in batch.column("id").to_pylist()]
            cols = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary()), pa.array(sha)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = both.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
m AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM q GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM m),
k AS (SELECT doc_id, count(*) AS n, sum(b - a)::BIGINT AS removed, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
