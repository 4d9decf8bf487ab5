"""Near copies by word shingles: SimHash fingerprints with Golay-code keys (op6's method) link the close ones, MinHash bands find those whose
fingerprints lie further apart; exact Jaccard similarity decides every link."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, slices, unused
from .graph import components

#: The stage's contract: words a shingle, least similarity of a copy.
WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity s shares a band with 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, 0.99999 at 0.85.
BANDS, ROWS = 20, 5
#: Bands with more members than this are linked through centres first; only what these leave apart is looked for by rare shingles.
PAIRWISE = 24
#: Sizes of sets are told apart by this factor when their rare shingles are chosen.
STEP = 1.02
#: Counters of shingles: 2 to this power, whatever the input.
COUNTER_BITS = 18


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 (seed 42) of a text's word shingles, sorted; a text of fewer words is one shingle, a blank one none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    grams = (b" ".join(g) for g in zip(*(tokens[i:] for i in range(words)))) if len(tokens) > words else [b" ".join(tokens)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in grams], dtype=np.uint64))


def node_of(found: np.ndarray) -> int:
    """One number for a set of shingles: equal sets are one node."""
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def fingerprint_of(found: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if over half of them have it; an empty set has 0."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 65536):
        part = np.ascontiguousarray(found[at : at + 65536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(found), bitorder="little").view("<u8")[0])


#: Fixed permutations of shingles: an odd factor and a shift each.
_RNG = np.random.default_rng(20261)
FACTORS = (_RNG.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: its number and its ROWS least values of as many permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        x = found[at : at + 512]
        x = x ^ (x >> np.uint64(31))
        least = np.minimum(least, (x * FACTORS + SHIFTS).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], dtype=np.uint64)


def with_bands(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, node, fp, keys) of every row; a set without shingles has no keys."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            nodes, fps, keys = [], [], []
            for t in batch.column("text").to_pylist():
                found = shingles(t, words)
                nodes.append(node_of(found))
                fps.append(fingerprint_of(found))
                keys.append(band_keys(found).view(np.int64) if len(found) else [])
            numbers = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *numbers, pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(compute, f"id {kind}, node long, fp long, keys array<long>")


def with_sets(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """(node, shingles) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            nodes = np.array([node_of(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(compute, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.distinct().join(a, "u").join(b, "v").withColumn("n", F.size(F.array_intersect("a", "b")))
    return both.filter(F.col("n") / (F.size("a") + F.size("b") - F.col("n")) >= similarity).select("u", "v")


def first_shingles(found: np.ndarray, counts: np.ndarray, similarity: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(own bucket, other's bucket, first shingles) of a set for each bucket of sizes that may be alike; see by_rare_shingles."""
    n, step = len(found), math.log(STEP)
    often = counts[shingle_places(found)]
    rare = found[np.lexsort((found, often))]
    single = int((often <= 1).sum())  # these come first, and no other member has them
    # sizes that may be alike, and the least size of a bucket; small terms keep whole numbers whole
    low, high = math.ceil(n * similarity - 1e-9), math.floor(n / similarity + 1e-9)
    for other in range(math.floor(math.log(low) / step + 1e-9), math.floor(math.log(high) / step + 1e-9) + 1):
        least = max(math.ceil(math.exp(other * step) - 1e-6), low)
        first = min(n, n - math.ceil(similarity / (1 + similarity) * (n + least) - 1e-9) + 1)
        if first > single:
            yield math.floor(math.log(n) / step + 1e-9), other, rare[single:first]


def shingle_places(found: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def by_rare_shingles(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidates (u, v) of `members` (node, component, apart): u is apart, v is of another component, and no link is missed.

    Shingles are put in one order, rare ones first, as a fixed number of counters has them (any one order is right; a good one
    is fast). Sets of n and m shingles that are alike share at least k = s / (1 + s) * (n + m) of them, so the first n - k + 1
    of one and the first m - k + 1 of the other have one in common. How many count as first depends on both sizes, of
    which the other is known to a factor of STEP; sets whose sizes differ too much are not alike. Shingles that only one member
    has are not passed on. In a large group of edited copies, a copy with many edits has its edits first and meets only
    copies that share some of them, not the whole group.
    """
    own = members.join(sets.select("node", "shingles"), "node").filter(F.size("shingles") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            found = batch.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount(shingle_places(found), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["place", "n"])

    got = own.select("shingles").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    counts[got.column("place").to_numpy()] = got.column("n").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, bucket, other, found = [], [], [], [np.zeros(0, dtype=np.uint64)]
                for i, x in enumerate(batch.column("shingles")):
                    for b, o, first in first_shingles(x.values.to_numpy(zero_copy_only=False).view(np.uint64), shared.value, similarity):
                        row += [i] * len(first)
                        bucket += [b] * len(first)
                        other += [o] * len(first)
                        found.append(first)
                at_row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at_row) for c in ("node", "component", "apart")), pa.array(bucket, pa.int32()), pa.array(other, pa.int32()), pa.array(np.concatenate(found).view(np.int64))],
                    ["node", "component", "apart", "bucket", "other", "s"],
                )

    keyed = own.select("node", "component", "apart", "shingles").mapInArrow(emit, "node long, component long, apart boolean, bucket int, other int, s long")
    a = keyed.filter("apart").select(F.col("node").alias("u"), F.col("component").alias("own"), "bucket", "other", "s")
    b = keyed.select(F.col("node").alias("v"), "component", F.col("other").alias("bucket"), F.col("bucket").alias("other"), "s")
    return a.join(b, ["s", "bucket", "other"]).filter("own != component").select("u", "v").distinct()


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v) of nodes (node, fp): those of one fingerprint, and those whose fingerprints simhash.linked links by their Golay keys.

    A fingerprint's nodes meet in the least of them, so many nodes of one fingerprint cost as many rows.
    """
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "golay-nodes")
    same = nodes.join(least, "fp").select(F.col("node").alias("u"), F.col("least").alias("v"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")) for c in "uv")
    return ordered(same.union(simhash.linked(least.select("fp")).join(a, "u").join(b, "v").select("node_u", "node_v"))).distinct()


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by shingle sets of at least `similarity` (Jaccard).

    Words are as in simhash.near_duplicates. Rows with the same set are one node. Candidates are nodes whose SimHash fingerprints are linked by
    their Golay keys and then, as copies of 0.8 mostly differ in more bits than these reach, nodes that share a band and are not
    in one class already; every link is checked on whole sets. A crowded band is not paired whole: all its members are compared with
    two centres (the member that is in most crowded company, and one drawn by hash), and each member that these leave outside the
    band's largest component is looked for among all the others by its rare shingles (see by_rare_shingles), so
    that components are those of all its pairs. Null, empty and blank texts have the same, empty set. A long text is one set of
    shingles in a task. Ids that repeat share their class if their texts do. Only id and text are read.

    Returns id, component_id (the smallest id reachable).
    """
    rows = materialize(with_bands(docs, words, id_col, text_col), "bands")
    nodes = materialize(rows.groupBy("node").agg(F.min("id").alias("first"), F.max("fp").alias("fp"), F.max("keys").alias("keys")), "band-nodes")
    close = materialize(fingerprint_links(nodes.filter(F.size("keys") > 0).select("node", "fp")), "golay-pairs")
    keys = nodes.select("node", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keys.join(sizes, "key"), "band-shared")
    wanted = shared.select("node").union(close.select("u")).union(close.select("v")).distinct().join(nodes, "node").select("node", "first")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = texts.join(wanted.select("first"), F.col("id").eqNullSafe(F.col("first")), "left_semi")
    sets = materialize(with_sets(some, words, "text").dropDuplicates(["node"]), "band-sets")

    close = materialize(verified(close, sets, similarity), "golay-links")
    settled = components(close, "golay").select("node", F.col("component").alias("class"))
    shared = materialize(shared.join(settled, "node", "left").withColumn("class", F.coalesce("class", "node")), "band-classes")
    few = shared.filter(F.col("n") <= PAIRWISE).select("key", F.col("node").alias("u"), F.col("class").alias("own"))
    pairs = few.join(few.select("key", F.col("u").alias("v"), F.col("own").alias("class")), "key").filter("u < v AND own != class").select("u", "v")
    many = shared.filter(F.col("n") > PAIRWISE)
    typical = many.groupBy("node").agg(F.sum("n").alias("typical"))
    many = many.select("key", "node", "class").join(typical, "node")
    centre = F.struct("node", "class")
    centres = many.groupBy("key").agg(F.max_by(centre, F.struct("typical", "node")).alias("c0"), F.min_by(centre, F.xxhash64("node")).alias("c1"))
    stars = many.join(centres, "key").select("node", "class", F.explode(F.array("c0", "c1")).alias("c"))
    stars = stars.filter("class != c.class").select(F.col("node").alias("u"), F.col("c.node").alias("v")).distinct()
    links = materialize(close.union(verified(pairs.union(ordered(stars)), sets, similarity)), "band-links")

    of = components(links, "bands-first").select("node", "component")
    placed = materialize(many.select("key", "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node")), "band-placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    members = placed.join(main, "key").groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("apart"))
    links = links.union(verified(ordered(by_rare_shingles(members, sets, similarity)), sets, similarity)).distinct()

    of = components(links, "bands").select("node", "component")
    labelled = nodes.select("node", "first").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    label = labelled.join(least, "component").select("node", "component_id")
    return rows.select("id", "node").join(label, "node").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whatever their names, with the smallest id of their class; rows that repeat it all stay.

    Null, blank and long texts are as in near_copies. An empty table gives an empty table.
    """
    kept_id = unused(docs, "kept_id")
    kept = near_copies(docs, words, similarity, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(kept_id))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
