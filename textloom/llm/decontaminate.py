"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

WORD = re.compile(r"\w+")
#: Words of a seed; how often a seed may be expected in the corpus by its words' frequencies.
SEED_WORDS, EXPECTED = 3, 0.5
#: Alignment scores, and the share of an item's perfect score from which a passage is a leak.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
#: Windows of a long stretch, and how far they overlap, in lengths of the item.
WINDOW, REACH = 8, 3
#: Characters of test items that are sent to the executors at a time; a larger benchmark takes several passes.
BLOCK_CHARS = 4 << 20
#: Cells of an alignment row that are computed side by side, over all pairs of a batch; a longer pair goes alone.
CELLS = 1 << 18
#: Places of seeds that are expanded at a time, and words of windows that are gathered before they are aligned.
PLACES, HELD = 1 << 20, 1 << 21
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 18


@dataclass
class Items:
    """A block of test items: word ids by item, and seeds with where they occur."""

    vocabulary: dict[str, int]
    ids: pa.Array
    words: list[np.ndarray]
    seeds: np.ndarray | None = None  # sorted seed codes
    first: np.ndarray | None = None  # by seed: its places [first, next first) below
    item: np.ndarray | None = None
    offset: np.ndarray | None = None

    @cached_property
    def lengths(self) -> np.ndarray:
        """Words of each item."""
        return np.array([len(w) for w in self.words])


def word_ids(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """Ids of a text's words, 0 for words that no item has."""
    get = vocabulary.get
    return np.array([get(w, 0) for w in WORD.findall((text or "").lower())], dtype=np.int64)


def codes(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs of SEED_WORDS known words, and each run as one number."""
    n = len(ids) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    known = ids > 0
    at = np.flatnonzero(reduce(np.logical_and, (known[k : k + n] for k in range(SEED_WORDS))))
    code = np.zeros(len(at), dtype=np.int64)
    for k in range(SEED_WORDS):
        code = code * size + ids[at + k]
    return at, code


def block_of(ids: pa.Array, texts: list[str | None]) -> Items:
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall((t or "").lower())], dtype=np.int64) for t in texts]
    return Items(vocabulary, ids, words)


def with_seeds(items: Items, counts: np.ndarray) -> Items:
    """Choose the seeds: runs of words whose frequencies make them rare, and each item's rarest quarter."""
    size = len(items.vocabulary) + 1
    total = max(1.0, counts[0])
    share = np.log(np.maximum(counts, 1) / total)
    places = []
    for i, w in enumerate(items.words):
        at, code = codes(w, size)
        if len(at):
            expected = np.log(total) + sum(share[w[at + k]] for k in range(SEED_WORDS))
            limit = max(np.log(EXPECTED), np.sort(expected)[(len(at) - 1) // 4])
            keep = expected <= limit
            places.append(np.stack([code[keep], np.full(int(keep.sum()), i), at[keep]]))
    found = np.concatenate(places, axis=1) if places else np.zeros((3, 0), dtype=np.int64)
    found = found[:, np.argsort(found[0], kind="stable")]
    seeds, first = np.unique(found[0], return_index=True)
    items.seeds, items.first, items.item, items.offset = seeds, np.append(first, found.shape[1]), found[1], found[2]
    return items


def stretches(ids: np.ndarray, items: Items) -> np.ndarray:
    """Rows (item, first diagonal, last diagonal): where seeds of an item line up in a document.

    A seed's hits meet all its places in the items. They are expanded PLACES at a time, and of each lot only the stretches stay, so a
    repetitive text against items that share a phrase costs time, not memory.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    at, code = codes(ids, len(items.vocabulary) + 1)
    if not len(at) or not len(items.seeds):
        return none
    k = np.searchsorted(items.seeds, code)
    k[k == len(items.seeds)] = 0
    hit = items.seeds[k] == code
    at, k = at[hit], k[hit]
    if not len(at):
        return none
    n = items.first[k + 1] - items.first[k]
    lot, found = (np.cumsum(n) - 1) // PLACES, none
    for begin, end in zip(edges := np.flatnonzero(np.diff(lot, prepend=-1)), [*edges[1:], len(at)]):
        m, first = n[begin:end], items.first[k[begin:end]]
        place = np.repeat(first - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        item = items.item[place]
        diagonal = np.repeat(at[begin:end], m) - items.offset[place]
        found = chained(np.concatenate([found, np.stack([item, diagonal, diagonal], axis=1)]), items.lengths)
    return found


def chained(found: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches (item, first, last) of an item joined where they overlap or lie half an item or less apart."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    item = found[:, 0]
    # the farthest end so far within the item: items are shifted apart, so one running maximum does
    low = found[:, 1:].min()
    shift = item * (int(found[:, 2].max()) - int(low) + 1)
    reach = np.maximum.accumulate(found[:, 2] - low + shift) - shift + low
    new = np.append(True, (item[1:] != item[:-1]) | (found[1:, 1] - reach[:-1] > length[item[1:]] // 2))
    starts = np.flatnonzero(new)
    return np.stack([item[starts], found[starts, 1], np.maximum.reduceat(found[:, 2], starts)], axis=1)


def candidates(ids: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, begin, end): windows of a document around its stretches."""
    for item, first, last in stretches(ids, items).tolist():
        n = len(items.words[item])
        pad = 4 + n // 4
        begin, end = max(0, first - pad), min(len(ids), last + n + pad)
        # an alignment with a positive score spans at most 3 n words, so each lies whole in one of these windows
        for w in range(begin, max(begin + 1, end - REACH * n), WINDOW * n - REACH * n):
            yield item, w, min(end, w + WINDOW * n)


def batches_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[int]]:
    """Numbers of pairs, by length of the stretch, CELLS padded cells at a time."""
    part: list[int] = []
    for i in sorted(range(len(pairs)), key=lambda i: len(pairs[i][1])):
        if part and (len(part) + 1) * len(pairs[i][1]) > CELLS:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of (item words, stretch words) pairs, and where in the stretch the first best alignment ends.

    One row of all matrices at a time: gaps along a row are a running maximum, so no cell is visited by itself.
    """
    best, end = np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int64)
    for part in batches_of(pairs):
        rows, columns = max(len(pairs[i][0]) for i in part), max(len(pairs[i][1]) for i in part)
        a, b = np.full((len(part), rows), -1, dtype=np.int32), np.full((len(part), columns), -2, dtype=np.int32)
        for k, i in enumerate(part):
            a[k, : len(pairs[i][0])], b[k, : len(pairs[i][1])] = pairs[i]
        b[b == 0] = -2
        slope = -GAP * np.arange(columns + 1, dtype=np.int32)
        h = np.zeros((len(part), columns + 1), dtype=np.int32)
        top, where = np.zeros(len(part), dtype=np.int32), np.zeros(len(part), dtype=np.int64)
        for r in range(rows):
            t = np.maximum(h + GAP, 0)
            t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + np.where(b == a[:, r : r + 1], MATCH, MISMATCH).astype(np.int32))
            h = np.maximum.accumulate(t + slope, axis=1) - slope
            high = h.argmax(axis=1)
            value = h[np.arange(len(part)), high]
            where = np.where(value > top, high, np.where(value == top, np.minimum(where, high), where))
            top = np.maximum(top, value)
        best[part], end[part] = top, where
    return best, end


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; the empty word has the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter[str] = Counter()
        for batch in slices(batches, 8 << 20):
            for t in batch.column("text").to_pylist():
                words = WORD.findall((t or "").lower())
                seen.update(words)
                seen[""] += len(words)
            if len(seen) > COUNTED:
                yield emit()
                seen.clear()
        yield emit()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus_counts(counts: DataFrame, items: Items) -> np.ndarray:
    """How often each word of the items occurs in all documents; at 0, all words."""
    words = counts.sparkSession.createDataFrame([("", 0), *items.vocabulary.items()], "word string, place long")
    out = np.zeros(len(items.vocabulary) + 1)
    for r in counts.join(words, "word").select("place", "n").collect():
        out[r["place"]] = r["n"]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold a test item, verbatim, edited or paraphrased: one row for each such pair.

    Words are lower-cased runs of letters, digits and underscores. Seeds are runs of SEED_WORDS words of an item that the corpus's word
    frequencies make rare (so a leaked passage does not make its own seeds common), and the rarest quarter of
    an item's runs in any case. Around lined-up seeds the item is aligned with the document's words; the score
    is the best local alignment's share of the item's perfect score, `threshold` or more. All seeds and all
    stretches are followed up. The corpus's words are counted in one pass, whatever the size of the benchmark. A benchmark over
    BLOCK_CHARS takes an alignment pass over the documents for each block of it; texts are never shuffled.
    A long text is one row of a task: a stretch that goes on and on is aligned in overlapping windows of WINDOW item lengths,
    of which one holds any alignment whole. Hits are expanded PLACES at a time, windows aligned HELD words at a time and in batches of
    CELLS, so memory follows the length of a text and the number of its stretches, not the number of hits.

    Items with fewer than SEED_WORDS words (null and empty ones too) match nothing, nor do null and empty
    documents. Repeated documents or items give a row each. Empty tables give an empty table. Only ids and
    texts are read, so other columns cannot clash.

    Returns id, item id, score (0 to 1), end_word (where in the document the best alignment ends).
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kinds[0]}, item {kinds[1]}, score double, end_word long"
    found = [texts.mapInArrow(aligner(shared, threshold), schema) for shared in item_blocks(texts, benchmark, item_col, item_text)]
    out = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def item_blocks(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> Iterator:
    """Broadcasts of the test items with their seeds, BLOCK_CHARS characters or so at a time."""
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    blocks = -(-int(tests.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    if blocks:
        own_words = word_counts(tests).select("word")
        counts = materialize(word_counts(texts).join(own_words, "word", "left_semi"), "leak-words")
    for block in range(blocks):
        own = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").toArrow().combine_chunks()
        items = block_of(pa.concat_arrays(own.column("item").chunks or [pa.array([], own.schema.field("item").type)]), own.column("text").to_pylist())
        yield texts.sparkSession.sparkContext.broadcast(with_seeds(items, corpus_counts(counts, items)))


def best_alignments(texts: list[str | None], items: Items, threshold: float) -> dict[tuple[int, int], tuple[float, int]]:
    """(text number, item number): best score of `threshold` or more, and minus the word where it ends.

    Windows are aligned as soon as HELD words of them are gathered; only the best score of each text and item stays.
    """
    best: dict[tuple[int, int], tuple[float, int]] = {}
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    owners: list[tuple[int, int, int]] = []

    def settle() -> None:
        score, end = align(pairs)
        for (row, item, begin), s, e in zip(owners, score, end):
            share = float(s) / (MATCH * len(items.words[item]))
            if share >= threshold:
                best[row, item] = max(best.get((row, item), (0.0, -(1 << 62))), (share, -(begin + int(e))))
        pairs.clear()
        owners.clear()

    held = 0
    for row, text in enumerate(texts):
        ids = word_ids(text, items.vocabulary)
        for item, begin, end in candidates(ids, items):
            pairs.append((items.words[item], ids[begin:end]))
            owners.append((row, item, begin))
            held += end - begin
            if held >= HELD:
                settle()
                held = 0
    settle()
    return best


def aligner(shared, threshold: float):
    """The map over Arrow batches of documents against a block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in slices(batches, 8 << 20):
            best = best_alignments(batch.column("text").to_pylist(), items, threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array([r for r, _ in best], pa.int64())), items.ids.take(pa.array([i for _, i in best], pa.int64())),
                 pa.array([s for s, _ in best.values()], pa.float64()), pa.array([-e for _, e in best.values()], pa.int64())], ["id", "item", "score", "end_word"]
            )

    return run


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no test item; nothing is shuffled. See leaks."""
    out = docs

    def keeper(shared):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 8 << 20, text_col):
                leaked = {row for row, _ in best_alignments(batch.column(text_col).to_pylist(), shared.value, threshold)}
                yield batch.filter(pa.array([i not in leaked for i in range(batch.num_rows)], pa.bool_()))

        return keep

    for shared in item_blocks(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text):
        out = out.mapInArrow(keeper(shared), docs.schema)
    return out
