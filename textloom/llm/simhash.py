"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, unused
from .graph import components

#: The generator polynomial of the binary Golay code [23, 12, 7]; the covering of a 64-bit
#: fingerprint by three segments (first bit, bits) of at most 23 bits.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Linked fingerprints differ in at most so many bits.
MAX_DISTANCE = 2
#: Keys with more members than this are joined through midpoints, not pair by pair.
PAIRWISE = 24


def codewords() -> np.ndarray:
    """The 4,096 codewords by message index, from the generator polynomial."""
    message = np.arange(4096, dtype=np.int64) << 11
    rest = message.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return message | rest


def neighbour_flips() -> np.ndarray:
    """Row by syndrome: the error patterns of weight up to 4 that lead from a word to a codeword (6 at most).

    Two words at distance 2 or less always share a codeword within distance 4 of both (exhaustively
    checked in the tests), so lists of these codewords' indices meet.
    """
    flips: dict[int, list[int]] = {}
    ones = 1 << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, dtype=np.int64)]
    for _ in range(4):
        last = patterns[-1]
        top = np.where(last > 0, np.floor(np.log2(np.maximum(last, 1))).astype(np.int64) + 1, 0)
        patterns.append(np.concatenate([last[top <= b] | ones[b] for b in range(23)]))
    found = np.concatenate(patterns)
    for s, p in zip(syndrome(found), found):
        flips.setdefault(int(s), []).append(int(p))
    table = np.full((2048, max(map(len, flips.values()))), -1, dtype=np.int64)
    for s, p in flips.items():
        table[s, : len(p)] = p
    return table


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def nearby_indices(words: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word, -1 where there are fewer."""
    chosen = flips[syndrome(words)]
    return np.where(chosen < 0, -1, (words[:, None] ^ chosen) >> 11)


def segment(fp: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return (fp.astype(np.uint64) >> np.uint64(at[0]) & np.uint64((1 << at[1]) - 1)).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's word shingles: a bit is 1 if over half the shingles' XXH64 (seed 42) have it."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(g) for g in zip(*(tokens[i:] for i in range(words)))] if len(tokens) > words else [b" ".join(tokens)]
    total = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(shingles), 65536):
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles[begin : begin + 65536]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(shingles), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(compute, f"id {kind}, fp long")


def golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): for each segment, its exact bits with the nearby codeword indices of the next segment.

    Two differing bits leave one of the three segments intact, and leave two at most in the next one, whose
    codeword lists then meet: linked fingerprints share a key.
    """

    flips = neighbour_flips()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            out, owners = [], []
            for i, at in enumerate(SEGMENTS):
                near = nearby_indices(segment(fp, SEGMENTS[(i + 1) % 3]), flips)
                row, col = np.nonzero(near >= 0)
                out.append((i << 34) | (segment(fp, at)[row] << 12) | near[row, col])
                owners.append(fp[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(owners).view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(keys, "key long, fp long")


def linked(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all within MAX_DISTANCE, and no others.

    Keys with few members are joined and each pair verified by its differing bits. In a key with many, all
    pairs would be quadratic: there each member gives its value and all values one bit away, and members
    that share such a midpoint (exactly those within two bits of each other) are linked to the least of them.
    """
    keys = materialize(golay_keys(fps), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keys.join(sizes, "key"), "golay-shared")
    few = shared.filter(F.col("n") <= PAIRWISE).select("key", "fp")
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)).select("u", "v")
    many = shared.filter(F.col("n") > PAIRWISE).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    mids = many.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp")
    least = mids.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = mids.join(least, "mid").filter("fp != v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by SimHash fingerprints with MAX_DISTANCE or fewer differing bits.

    A-Z are lower-cased and words are runs without ASCII white space. A text with fewer words than a shingle
    is one shingle; null, empty and blank texts have fingerprint zero and link like any other. Rows with the
    same fingerprint are one node of the graph, so copies, repeated rows and ties cost nothing. A null id
    counts as larger than any other; a class of null ids alone has a null component. An empty table gives an
    empty table. Only id and text are read, so other columns cannot clash.

    Returns id, fingerprint (16 hex digits), component_id (the smallest id reachable).
    """
    rows = materialize(with_fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "fingerprint-nodes")
    of = components(linked(nodes.select("fp")), "simhash").select(F.col("node").alias("fp"), F.col("component"))
    labelled = nodes.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    label = labelled.join(least, "component").select("fp", "component_id")
    return rows.join(label.hint("merge"), "fp").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the smallest id of their class; ids must be unique."""
    kept_id = unused(docs, "kept_id")
    kept = near_duplicates(docs, words, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(kept_id))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
