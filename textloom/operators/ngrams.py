"""Character n-grams: counts, top lists, the interpolated language model, and copy detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.charset import LETTERS, Charset, only_letters

#: Characters outside a model's vocabulary count as this one.
UNSEEN = "\ue000"
#: Bytes of model tables that may be sent to the executors; larger models are joined.
BROADCAST_BYTES = 64 << 20


#: Distinct n-grams that a task holds before it sends their counts on.
HELD_GRAMS = 1 << 18


def gram_counts(docs: DataFrame, orders: list[int], keys: list[str] | None = None, charset: Charset = LETTERS) -> DataFrame:
    """(keys, order, gram, n): counts of character n-grams over all texts.

    Slices of about a megabyte of text are counted before anything is shuffled, so a shuffle carries distinct n-grams, not characters,
    and a task's memory doesn't follow the number of texts in an Arrow batch.
    """
    keys = keys or []
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    rows = docs.select(*keys, only_letters("text", charset).alias("letters"))
    partial = rows.mapInArrow(lambda batches: counted(batches, keys, orders), f"{kinds + ', ' if keys else ''}order int, gram string, n long")
    return partial.groupBy(*keys, "order", "gram").agg(F.sum("n").alias("n"))


def counted(batches: Iterator[pa.RecordBatch], keys: list[str], orders: list[int]) -> Iterator[pa.RecordBatch]:
    """(keys, order, gram, n) of the column `letters`, counted slice by slice and sent once HELD_GRAMS are there."""
    held: dict[tuple, dict[str, int]] = {}
    fields: list[pa.Field] = []

    def sent() -> Iterator[pa.RecordBatch]:
        for (order, *group), found in held.items():
            own = [pa.array([v] * len(found), f.type) for f, v in zip(fields, group)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(found), order, dtype=np.int32)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], [*keys, "order", "gram", "n"])
        held.clear()

    for batch in batches_of(batches, "letters"):
        frame, fields = batch.to_pandas(), [batch.schema.field(k) for k in keys]
        for group, texts in frame.groupby(keys, dropna=False)["letters"] if keys else [((), frame["letters"])]:
            named = [None if pd.isna(v) else int(v) if pa.types.is_integer(f.type) else v for f, v in zip(fields, group)]
            for order in orders:
                found = held.setdefault((order, *named), {})
                for gram, n in zip(*(x if isinstance(x, list) else x.tolist() for x in distinct_grams(list(texts), order))):
                    found[gram] = found.get(gram, 0) + n
        if sum(map(len, held.values())) > HELD_GRAMS:
            yield from sent()
    yield from sent()


def distinct_grams(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams of some texts and their counts; n-grams do not cross texts."""
    code, lengths = code_points(texts)
    n = len(code) - order + 1
    if n <= 0:
        return [], np.zeros(0, dtype=np.int64)
    letters = np.flatnonzero(np.bincount(code)).astype(np.uint32)
    number = Places(letters).of(code)
    inside = np.arange(n) + order <= np.repeat(np.cumsum(lengths), lengths)[:n]
    if len(letters) ** order < 2**63:
        key = np.zeros(n, dtype=np.int64)
        for k in range(order):
            key = key * len(letters) + number[k : k + n]
        key = key[inside]
        if len(letters) ** order <= 4 * len(key):
            counts = np.bincount(key)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(key, return_counts=True)
        grid = np.stack([found // len(letters) ** k % len(letters) for k in reversed(range(order))], axis=1)
    else:
        grid, counts = np.unique(np.stack([number[k : k + n] for k in range(order)], axis=1)[inside], axis=0, return_counts=True)
    text = letters[grid].tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + order] for i in range(0, len(text), order)], counts.astype(np.int64)


def top_grams(docs: DataFrame, order: int, k: int, charset: Charset = LETTERS) -> DataFrame:
    """The k most frequent n-grams of an order; of equal counts the smaller in binary order comes first."""
    rows = gram_counts(docs, [order], charset=charset).select("gram", "n").orderBy(F.desc("n"), "gram").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "gram")).cast("long"))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some texts, one text after the other, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.array([len(t) for t in texts], dtype=np.int64)


def found_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted numbers in sorted keys; -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


#: Sorted numbers below this are looked up in a table.
TABLE = 1 << 21


class Places:
    """Places of wanted numbers in sorted keys, -1 where they are not: found_in for keys that are asked for often."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, None
        if len(keys) and keys[0] >= 0 and keys[-1] < TABLE:
            self.table = np.full(int(keys[-1]) + 2, -1, dtype=np.int32)
            self.table[keys] = np.arange(len(keys))

    def of(self, wanted: np.ndarray) -> np.ndarray:
        if self.table is None:
            return found_in(self.keys, wanted)
        wanted = wanted.view(np.uint64) if wanted.dtype == np.int64 else wanted  # below zero is beyond the table
        return self.table[np.minimum(wanted, wanted.dtype.type(len(self.table) - 1))].astype(np.int64)


@dataclass
class Counts:
    """An interpolated character model in sorted arrays.

    An n-gram of order k is the number (place of its first k - 1 characters among those of order k - 1) * (letters + 1) +
    (number of its last character), so any order and any alphabet fit in 64 bits; letters + 1 stands for the unseen.
    """

    alpha: float
    letters: np.ndarray  # sorted code points
    keys: list[np.ndarray]  # by order from 2 on: sorted n-gram numbers
    n: list[np.ndarray]  # by order from 1 on: counts
    followed: list[np.ndarray]  # by order from 1 on: how often each n-gram is followed by another letter

    @classmethod
    def of(cls, frame: pd.DataFrame, order: int, alpha: float) -> Counts:
        """From a model table (order, gram, n, context_n)."""
        letters, keys, counts, followed = np.zeros(0, dtype=np.uint32), [], [], []
        for k in range(1, order + 1):
            part = frame[frame["order"] == k]
            grid = code_points(list(part["gram"]))[0].reshape(-1, k)
            if k == 1:
                letters = np.unique(grid)
            key = np.searchsorted(letters, grid[:, 0])
            for i in range(1, k):
                key = key * (len(letters) + 1) + np.searchsorted(letters, grid[:, i])
                key = found_in(keys[i - 1], key) if i < k - 1 else key
            sort = np.argsort(key)
            if k > 1:
                keys.append(key[sort])
            counts.append(part["n"].to_numpy(dtype=np.float64)[sort])
            followed.append(part["context_n"].to_numpy(dtype=np.float64)[sort])
        return cls(alpha, letters, keys, counts, followed)

    @cached_property
    def places(self) -> list[Places]:
        return [Places(self.letters), *(Places(k) for k in self.keys)]

    def bits(self, texts: list[str]) -> np.ndarray:
        """Bits for a character of each text; NaN for an empty one."""
        return self.bits_by_alpha(texts, [self.alpha])[0]

    @cached_property
    def complete(self) -> bool:
        """Whether the end of every n-gram is an n-gram of the order below, as it is where all of some texts' n-grams were counted."""
        return all((s >= 0).all() for s in self.shorter)

    @cached_property
    def shorter(self) -> list[np.ndarray]:
        """By order from 2 on: the place, in the order below, of each n-gram without its first character; -1 if it is not there."""
        size, out = len(self.letters) + 1, []
        for k, keys in enumerate(self.keys):
            prefix, letter = keys // size, keys % size
            before = out[-1][prefix] if k else None
            out.append(letter if before is None else np.where(before >= 0, self.places[k].of(before * size + letter), -1))
        return out

    def known(self, alpha: float) -> list[np.ndarray]:
        """By order: the probability of each n-gram's last character after the others; the last place of order 1 is for the unseen."""
        size = len(self.letters) + 1
        out = [(np.append(self.n[0], 0.0) + alpha) / (self.n[0].sum() + alpha * size)]
        for keys, n, followed, below in zip(self.keys, self.n[1:], self.followed, self.shorter):
            context = followed[keys // size]
            out.append(np.where(context > 0, (n + alpha * out[-1][below]) / (context + alpha), out[-1][below]))
        return out

    def bits_by_alpha(self, texts: list[str], alphas: list[float]) -> list[np.ndarray]:
        """The same under several alphas; n-grams are looked up once.

        P1 = (c + a) / (N + a (V + 1)); longer contexts that were seen refine it, each order over the one below. An n-gram that was seen
        has one probability, wherever it stands; only the others are worked out place by place.
        """
        code, lengths = code_points(texts)
        size = len(self.letters) + 1
        begin = (np.cumsum(lengths) - lengths)[lengths > 0]
        number = self.places[0].of(code)
        here, context = [number], []  # by order: places of the n-grams that end at each character, how often what comes before it is followed
        for k, followed in enumerate(self.followed[: len(self.keys)]):
            prefix = np.append(-1, here[-1][:-1])
            prefix[begin] = -1
            here.append(self.places[k + 1].of(np.where((prefix >= 0) & (number >= 0), prefix * size + number, -1)))
            context.append(np.append(followed, 0.0)[prefix])
        out = []
        rare = [np.flatnonzero(h < 0) for h in here[1:]]
        for a in alphas:
            known = [np.append(p, 0.0) if k else p for k, p in enumerate(self.known(a))]
            p = known[0][number]
            if self.complete:
                for k, (at, c) in enumerate(zip(rare, (c[at] for c, at in zip(context, rare)))):
                    lower = np.where(here[k][at] >= 0, known[k][here[k][at]], p[at])
                    p[at] = np.where(c > 0, a * lower / (c + a), lower)
                p = np.where(here[-1] >= 0, known[-1][here[-1]], p)
            else:
                for n, h, c in zip(self.n[1:], here[1:], context):
                    p = np.where(c > 0, (np.append(n, 0.0)[h] + a * p) / (c + a), p)
            total = np.zeros(len(lengths))
            if len(begin):
                total[lengths > 0] = np.add.reduceat(np.log2(p), begin)  # of each text by itself, so that equal texts tie
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(-total / lengths)
        return out


def fit_counts(docs: DataFrame, order: int = 5, charset: Charset = LETTERS) -> DataFrame:
    """(order, gram, n, context_n): the model's table; context_n counts how often a gram is followed."""
    return with_contexts(gram_counts(docs, list(range(1, order + 1)), charset=charset))


def with_contexts(grams: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, order, gram, n, context_n) from counts (keys, order, gram, n)."""
    keys = keys or []
    followed = grams.filter(F.col("order") > 1).groupBy(*keys, F.expr("substring(gram, 1, length(gram) - 1)").alias("gram")).agg(F.sum("n").alias("context_n"))
    return grams.join(followed, [*keys, "gram"], "left").select(*keys, "order", "gram", "n", F.coalesce("context_n", F.lit(0)).alias("context_n"))


def score_bits(docs: DataFrame, model: DataFrame, key: str = "doc_id", order: int = 5, alpha: float = 1.0, charset: Charset = LETTERS) -> DataFrame:
    """Bits per character of each text under a model table. A model over BROADCAST_BYTES is joined instead of sent."""
    return _score_sent(docs, model, key, order, alpha, charset) if model.count() * 24 <= BROADCAST_BYTES else score_joined(docs, model, key, order, alpha, charset)


def batches_of(batches: Iterator[pa.RecordBatch], column: str, characters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's texts have about so many bytes together, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // characters
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def in_slices(rows: DataFrame, keep: list[str], inputs: list[Column], f: Callable[..., list], name: str, kind: str) -> DataFrame:
    """(keep, name): a list function of columns, the first of which is a text, over slices of about a megabyte of it.

    An Arrow batch has a fixed number of rows, whatever their texts' length; so have the values of a pandas function, which it holds all at once.
    """
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_0"):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(f(*(batch.column(c).to_pylist() for c in names)), out)], [*keep, name])

    out, names = to_arrow_type(DataType.fromDDL(kind)), [f"_{i}" for i in range(len(inputs))]
    return rows.select(*keep, *(c.alias(n) for c, n in zip(inputs, names))).mapInArrow(run, f"{kinds}`{name}` {kind}")


def _score_sent(docs: DataFrame, model: DataFrame, key: str, order: int, alpha: float, charset: Charset) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Counts.of(model.toPandas(), order, alpha))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared.value.bits(batch.column("t").to_pylist()), pa.float64(), from_pandas=True)], ["key", "bpc"])

    rows = docs.select(F.col(key).alias("key"), only_letters("text", charset).alias("t"))
    return rows.mapInArrow(score, f"key {docs.schema[key].dataType.simpleString()}, bpc double").select(F.col("key").alias(key), F.round("bpc", 6).alias("bpc"))


def score_joined(docs: DataFrame, model: DataFrame, key: str = "doc_id", order: int = 5, alpha: float = 1.0, charset: Charset = LETTERS) -> DataFrame:
    """score_bits by joins: distinct windows are scored once each, by one join for every order."""
    chars = model.filter("order = 1").select("gram")
    total, size = model.filter("order = 1").agg(F.sum("n"), F.count("*")).first()
    letters = docs.select(key, only_letters("text", charset).alias("t"))
    window = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring("t", F.greatest(i - (order - 1), F.lit(1)), F.least(i, F.lit(order))))
    windows = letters.filter(F.length("t") > 0).select(key, F.explode(window).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    kinds = windows.select("w").distinct()
    spelled = (
        kinds.select("w", F.posexplode(F.split("w", "")).alias("i", "c")).join(chars.withColumn("known", F.lit(True)), F.col("c") == F.col("gram"), "left")
        .groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("known"), F.col("c")).otherwise(UNSEEN).alias("c")))), lambda x: x["c"]), "").alias("s"))
    )
    p = F.lit(None).cast("double")
    for k in range(1, order + 1):
        gram = F.expr(f"right(s, {k})")
        g = model.select(F.col("gram").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
        spelled = spelled.join(g, gram == F.col(f"g{k}"), "left")
        if k > 1:
            c = model.filter("context_n > 0").select(F.col("gram").alias(f"c{k}"), F.col("context_n").alias(f"x{k}"))
            spelled = spelled.join(c, F.expr(f"left(right(s, {k}), {k - 1})") == F.col(f"c{k}"), "left")
            refined = (F.coalesce(f"n{k}", F.lit(0)) + alpha * p) / (F.col(f"x{k}") + alpha)
            p = F.when((F.length("s") >= k) & F.col(f"x{k}").isNotNull(), refined).otherwise(p)
        else:
            p = (F.coalesce("n1", F.lit(0)) + alpha) / (total + alpha * (size + 1))
    scored = spelled.select("w", F.log2(p).alias("l"))
    sums = windows.join(scored, "w").groupBy(key).agg((-F.sum(F.col("l") * F.col("n")) / F.sum("n")).alias("bpc"))
    return docs.select(key).join(sums, key, "left").select(key, F.round("bpc", 6).alias("bpc"))


def mixture_bits(bits: list[F.Column]) -> F.Column:
    """-log2 of the mean of 2^-bits: the geometric-mean mixture of models' scores."""
    return -F.log2(sum((F.pow(F.lit(2.0), -b) for b in bits[1:]), F.pow(F.lit(2.0), -bits[0])) / len(bits))


#: Pairs of places that a task holds at once, and letters compared in a round.
LOT, STEP = 1 << 20, 64
#: Odd factor of the n-gram hash, a polynomial in 64 bits.
FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(code: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit number of the n-gram that begins at each place; those that run over the end are left out."""
    n = max(0, len(code) - order + 1)
    out, factor = np.zeros(n, dtype=np.uint64), np.uint64(FACTOR)
    for k in range(order):
        out = out * factor + code[k : k + n] + np.uint64(1)
    return out ^ (out >> np.uint64(29))


@dataclass
class References:
    """Texts whose n-grams are looked for: their letters, and the n-grams' hashes with where they begin."""

    ids: pa.Array
    code: np.ndarray
    start: np.ndarray  # by text: where its letters begin
    hashes: np.ndarray  # sorted
    place: np.ndarray  # by hash: where the n-gram begins

    @classmethod
    def of(cls, table: pa.Table, order: int) -> References:
        texts = table.column("t").to_pylist()
        code, lengths = code_points(texts)
        hashes = gram_hashes(code, order)
        inside = np.repeat(np.cumsum(lengths), lengths)[: len(hashes)] - np.arange(len(hashes)) >= order
        place = np.flatnonzero(inside)
        sort = np.argsort(hashes[place], kind="stable")
        ids = table.column("key").combine_chunks()
        return cls(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, code, np.cumsum(lengths) - lengths, hashes[place][sort], place[sort])

    def matches(self, code: np.ndarray, at: np.ndarray, hashes: np.ndarray, order: int, most: int = LOT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in code, places in the references) of equal n-grams among those at `at`, in lots: equal letters, not only hashes.

        A lot has `most` pairs, or those of one place: a text and a reference that repeat themselves have pairs by the product of their lengths.
        """
        first, beyond = (np.searchsorted(self.hashes, hashes, side=x) for x in ("left", "right"))
        hit = np.flatnonzero(beyond > first)
        n = (beyond - first)[hit]
        upto = np.cumsum(n)
        a = 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
            own = np.repeat(at[hit[a:b]], n[a:b])
            skip = first[hit[a:b]] - (upto[a:b] - n[a:b] - (upto[a - 1] if a else 0))
            other = self.place[np.repeat(skip, n[a:b]) + np.arange(len(own))]
            same = np.ones(len(own), dtype=bool)
            for k in range(order):
                same &= code[own + k] == self.code[other + k]
            yield own[same], other[same]
            a = b

    def distinct(self, order: int) -> References:
        """These references with the first place of each n-gram only: enough to tell whether it is there."""
        start = np.flatnonzero(np.append(True, self.hashes[1:] != self.hashes[:-1])) if len(self.hashes) else np.zeros(0, dtype=np.int64)
        head = np.repeat(self.place[start], np.diff(np.append(start, len(self.hashes))))
        again = np.ones(len(self.hashes), dtype=bool)
        for k in range(order):
            again &= self.code[self.place + k] == self.code[head + k]
        again[start] = False
        return References(self.ids, self.code, self.start, self.hashes[~again], self.place[~again])

    def runs(self, code: np.ndarray, begin: np.ndarray, lengths: np.ndarray, order: int, most: int = LOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, reference, length) of the longest run of `order` letters or more that each text has in common with each reference.

        Of the pairs of a lot only those that can't be extended to the left begin a run; these are extended to the right, STEP letters a round.
        """
        hashes, row = gram_hashes(code, order), np.repeat(np.arange(len(lengths)), lengths)
        end, other_end = begin + lengths, np.append(self.start[1:], len(self.code))
        at = np.flatnonzero(end[row[: len(hashes)]] - np.arange(len(hashes)) >= order)
        found = [np.zeros((0, 3), dtype=np.int64)]
        for own, other in self.matches(code, at, hashes[at], order, most):
            ref = np.searchsorted(self.start, other, side="right") - 1
            heads = (own == begin[row[own]]) | (other == self.start[ref]) | (code[own - 1] != self.code[other - 1])
            own, other, ref = own[heads], other[heads], ref[heads]
            length = extended(code, self.code, own, other, np.minimum(end[row[own]] - own, other_end[ref] - other), order)
            found.append(longest(np.concatenate([found.pop(), np.stack([row[own], ref, length], axis=1)])))
        return tuple(found[0].T)


def extended(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray, known: int) -> np.ndarray:
    """How many letters from a[i] and b[j] on are equal, of at most `room`, of which the first `known` are."""
    out, open_ = np.full(len(i), known, dtype=np.int64), np.flatnonzero(room > known)
    step = np.arange(STEP)
    while len(open_):
        for part in np.array_split(open_, max(1, len(open_) * STEP // LOT)):
            at = out[part][:, None] + step
            inside = at < room[part][:, None]
            at = np.minimum(at, room[part][:, None] - 1)
            equal = inside & (a[i[part][:, None] + at] == b[j[part][:, None] + at])
            out[part] += np.where(equal.all(axis=1), STEP, equal.argmin(axis=1))
        open_ = open_[(out[open_] < room[open_]) & (a[np.minimum(i[open_] + out[open_], len(a) - 1)] == b[np.minimum(j[open_] + out[open_], len(b) - 1)])]
    return out


def longest(rows: np.ndarray) -> np.ndarray:
    """Of rows (row, reference, length) the longest of each (row, reference)."""
    rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows


def references_of(references: DataFrame, ref_key: str, order: int, charset: Charset, distinct: bool = False):
    """The references, or their distinct n-grams, as a broadcast variable, or None if their letters need more than BROADCAST_BYTES."""
    rows = references.select(F.col(ref_key).alias("key"), only_letters("text", charset).alias("t"))
    size = rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    if size * 24 > BROADCAST_BYTES:
        return None
    held = References.of(rows.toArrow(), order)
    return references.sparkSession.sparkContext.broadcast(held.distinct(order) if distinct else held)


def first_of_each(code: np.ndarray, hashes: np.ndarray, order: int) -> np.ndarray:
    """Places of the first of each distinct n-gram; letters are compared wherever hashes are equal."""
    sort = np.argsort(hashes, kind="stable")
    equal = np.flatnonzero(hashes[sort][1:] == hashes[sort][:-1])
    a, b = sort[equal], sort[equal + 1]
    if all((code[a + k] == code[b + k]).all() for k in range(order)):
        new = np.ones(len(sort), dtype=bool)
        new[equal + 1] = False
        return sort[new]
    return np.unique(np.lib.stride_tricks.sliding_window_view(code, order), axis=0, return_index=True)[1]


def positions(docs: DataFrame, key: str, order: int, charset: Charset = LETTERS) -> DataFrame:
    """(key, gram, place) of every n-gram of each text's letters."""
    rows = docs.select(F.col(key).alias("key"), only_letters("text", charset).alias("t")).filter(F.length("t") >= order)
    return rows.select("key", "t", F.explode(F.sequence(F.lit(0), F.length("t") - order)).alias("place")).select("key", F.substring("t", F.col("place") + 1, F.lit(order)).alias("gram"), F.col("place").cast("long"))


def copy_matches(docs: DataFrame, references: DataFrame, key: str, ref_key: str, order: int = 12, charset: Charset = LETTERS) -> DataFrame:
    """(key, ref, place, ref_place): places where a text and a reference have the same n-gram.

    References of up to BROADCAST_BYTES are sent to the texts, of which nothing is shuffled; larger ones are joined.
    """
    shared = references_of(references, ref_key, order, charset)
    if shared is None:
        a = positions(docs, key, order, charset)
        b = positions(references, ref_key, order, charset).select(F.col("key").alias("ref"), "gram", F.col("place").alias("ref_place"))
        return a.join(b, "gram").select("key", "ref", "place", "ref_place")
    kinds = docs.schema[key].dataType.simpleString(), references.schema[ref_key].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in batches_of(batches, "t"):
            code, lengths = code_points(batch.column("t").to_pylist())
            hashes, begin = gram_hashes(code, order), np.cumsum(lengths) - lengths
            row = np.repeat(np.arange(len(lengths)), lengths)
            at = np.flatnonzero((begin + lengths)[row[: len(hashes)]] - np.arange(len(hashes)) >= order)
            for own, other in refs.matches(code, at, hashes[at], order):
                ref = np.searchsorted(refs.start, other, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(row[own])), refs.ids.take(pa.array(ref)), pa.array(own - begin[row[own]]), pa.array(other - refs.start[ref])], ["key", "ref", "place", "ref_place"]
                )

    rows = docs.select(F.col(key).alias("key"), only_letters("text", charset).alias("t"))
    return rows.mapInArrow(match, f"key {kinds[0]}, ref {kinds[1]}, place long, ref_place long")


def copy_overlap(docs: DataFrame, references: DataFrame, key: str = "doc_id", ref_key: str = "item_id", order: int = 12, charset: Charset = LETTERS) -> DataFrame:
    """Distinct n-grams of each text, how many any reference has, and their share (0 for short texts). Rows that repeat a key are texts of their own."""
    shared = references_of(references, ref_key, order, charset, distinct=True)
    rows = docs.select(F.col(key).alias("key"), only_letters("text", charset).alias("t"))
    if shared is None:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        own = rows.withColumn("text", F.col("t")).transform(lambda d: positions(d, "row", order, charset)).select(F.col("key").alias("row"), "gram").distinct()
        known = positions(references, ref_key, order, charset).select("gram").distinct().withColumn("hit", F.lit(1))
        sums = own.join(known, "gram", "left").groupBy("row").agg(F.count("*").alias("grams"), F.sum(F.coalesce("hit", F.lit(0))).alias("shared"))
        counted = rows.select("row", "key").join(sums, "row", "left").na.fill(0, ["grams", "shared"])
    else:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            refs = shared.value
            for batch in batches_of(batches, "t"):
                grams, hits = [], []
                for t in batch.column("t").to_pylist():
                    code, _ = code_points([t])
                    hashes = gram_hashes(code, order)
                    at = first_of_each(code, hashes, order) if len(hashes) else np.zeros(0, dtype=np.int64)
                    grams.append(len(at))
                    hits.append(len(np.unique(np.concatenate([at[:0], *(own for own, _ in refs.matches(code, at, hashes[at], order))]))))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(grams, pa.int64()), pa.array(hits, pa.int64())], ["key", "grams", "shared"])

        counted = rows.mapInArrow(count, f"key {docs.schema[key].dataType.simpleString()}, grams long, shared long")
    share = F.when(F.col("grams") > 0, F.col("shared") / F.col("grams")).otherwise(0.0)
    return counted.select(F.col("key").alias(key), "grams", "shared", F.round(share, 6).alias("overlap"))


def copy_runs(docs: DataFrame, references: DataFrame, key: str = "doc_id", ref_key: str = "item_id", order: int = 12, charset: Charset = LETTERS) -> DataFrame:
    """The longest run of characters that each text shares with each reference, if it is `order` or longer; of rows that repeat a key, the longest.

    References of up to BROADCAST_BYTES are sent to the texts, and a task holds LOT pairs of places at once; larger ones are joined place by place.
    """
    shared = references_of(references, ref_key, order, charset)
    if shared is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            refs = shared.value
            for batch in batches_of(batches, "t"):
                code, lengths = code_points(batch.column("t").to_pylist())
                row, ref, length = refs.runs(code, np.cumsum(lengths) - lengths, lengths, order)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), refs.ids.take(pa.array(ref)), pa.array(length)], ["key", "ref", "longest"])

        kinds = docs.schema[key].dataType.simpleString(), references.schema[ref_key].dataType.simpleString()
        found = docs.select(F.col(key).alias("key"), only_letters("text", charset).alias("t")).mapInArrow(run, f"key {kinds[0]}, ref {kinds[1]}, longest long")
        return found.groupBy(F.col("key").alias(key), F.col("ref").alias(ref_key)).agg(F.max("longest").alias("longest"))
    m = copy_matches(docs, references, key, ref_key, order, charset).withColumn("diagonal", F.col("ref_place") - F.col("place"))
    island = F.col("place") - F.row_number().over(Window.partitionBy("key", "ref", "diagonal").orderBy("place"))
    runs = m.withColumn("island", island).groupBy("key", "ref", "diagonal", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("key", "ref").agg((F.max("n") + order - 1).alias("longest")).select(F.col("key").alias(key), F.col("ref").alias(ref_key), "longest")
