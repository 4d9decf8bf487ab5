"""A style model of reference texts, and the audit of other texts against it.

Training texts give a vocabulary, robust scales, an inverse covariance, two clusters of their groups and one character
model for each cluster; calibration texts say how usual a distance is. Scoring is one pass over each text.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.charset import Charset
from . import clusters, ngrams, stats, wording
from .profile import code_profile

#: Every character counts, also in n-grams.
WHOLE = Charset(letter=r"\s\S", ends="", clauses="", tokens=(), quotes=("", ""))
#: Group means that the driver clusters from their farthest pair; more are started from far points and refined in Spark.
DRIVER_GROUPS = 4096
TOO_LARGE = "the character models are larger than ngrams.BROADCAST_BYTES"


@dataclass(frozen=True)
class Style:
    """What is counted: a class of letters, characters that end sentences and clauses or quote speech, tokens, and the numbers of n-grams by order."""

    letter: str
    ends: str
    clauses: str
    opening: str
    closing: str
    functions: tuple[str, ...]
    formulas: tuple[str, ...]
    punctuation: tuple[str, ...]
    grams: tuple[int, ...] = (48, 64, 64)
    window: int = 100
    shrinkage: float = 0.2
    ridge: float = 0.05
    order: int = 5
    alphas: tuple[float, ...] = (0.1, 0.3, 1.0, 3.0)


#: Function words, formulas and punctuation of vernacular Chinese narration.
HAN = Style(
    letter=r"\p{Script=Han}",
    ends="。！？；",
    clauses="，、：；。！？",
    opening="“‘「『",
    closing="”’」』",
    functions=(
        "的", "了", "着", "过", "也", "又", "还", "便", "就", "才", "只", "但", "却", "竟", "倒",
        "且", "并", "亦", "皆", "俱", "遂", "方", "正", "已", "未", "莫", "不", "无", "非", "若",
        "虽", "因", "为", "与", "同", "向", "于", "把", "将", "被", "给", "替", "连", "再", "越",
        "甚", "颇", "原", "果", "偏", "究竟", "何尝", "那里", "怎么", "如何", "什么", "如此", "这般",
        "那般", "罢了", "而已", "而且", "所以", "因此", "不免", "未免", "不过", "只得", "不得",
        "可知", "谁知", "岂知", "哪知", "若是", "倘若", "纵然", "一面", "一壁", "一则", "二则",
    ),
    formulas=(
        "话说", "且说", "却说", "原来", "谁知", "不想", "不料", "一时", "少时", "半晌", "良久",
        "只见", "忽见", "忽听", "听见", "看见", "不多时", "说话间", "正说着", "正想着",
        "一语未了", "言犹未了", "忙道", "笑道", "说道", "问道", "答道", "叹道", "哭道",
        "心下", "暗想", "不在话下", "按下不提", "后事如何", "下回分解",
    ),
    punctuation=("，", "。", "；", "：", "！", "？", "、", "“", "”", "‘", "’", "——", "……"),
)

PLAIN = (
    "structure.characters_log", "structure.letter_ratio", "structure.dialogue_ratio", "structure.dialogue_turns_per_1000",
    "sentence.mean", "sentence.p25", "sentence.median", "sentence.p75", "sentence.p90", "clause.mean", "clause.median",
    "lexical.mattr", "lexical.entropy", "lexical.unique_ratio",
)


def vocabulary(texts: DataFrame, style: Style, counts: DataFrame | None = None) -> list[list[str]]:
    """By order, the most frequent n-grams of whole texts that are not white space alone; of equal counts the smaller in binary order.

    counts (order, gram, n) are those of the texts, if they are there already.
    """
    if counts is None:
        counts = ngrams.gram_counts(texts, list(range(1, len(style.grams) + 1)), charset=WHOLE)
    counts = counts.filter((F.col("order") <= len(style.grams)) & ~F.col("gram").rlike(r"^\s+$"))
    rank = F.row_number().over(Window.partitionBy("order").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= max(style.grams)).select("order", "rank", "gram").collect()
    return [[r["gram"] for r in sorted(top, key=lambda r: r["rank"]) if r["order"] == k and r["rank"] <= most] for k, most in enumerate(style.grams, 1)]


def feature_names(style: Style, grams: list[list[str]]) -> list[str]:
    kinds = (("function", style.functions), ("formula", style.formulas), ("punctuation", style.punctuation))
    return [*PLAIN, *(f"{kind}.{t}" for kind, tokens in kinds for t in tokens), *(f"ngram.{k}.{g}" for k, found in enumerate(grams, 1) for g in found)]


#: So many tokens of a length are looked for one by one.
FEW = 4


class Counter:
    """Counts fixed tokens in many texts at once: tokens of one length are sorted numbers, and every window of that length is looked up."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.letters = np.unique(ngrams.code_points(tokens)[0]) if tokens else np.zeros(0, dtype=np.uint32)
        self.places = ngrams.Places(self.letters)
        self.by_length: dict[int, tuple[ngrams.Places, np.ndarray]] = {}
        self.long = []
        for m in sorted({len(t) for t in tokens}):
            own = [i for i, t in enumerate(tokens) if len(t) == m]
            if (len(self.letters) + 1) ** m >= 2**63:
                self.long += own
                continue
            grid = self.places.of(ngrams.code_points([tokens[i] for i in own])[0]).reshape(-1, m)
            keys = grid @ (len(self.letters) + 1) ** np.arange(m - 1, -1, -1, dtype=np.int64)
            sort = np.argsort(keys)
            self.by_length[m] = ngrams.Places(keys[sort]), np.array(own)[sort]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Occurrences, overlaps included, of each token (columns) in each text (rows)."""
        code, lengths = ngrams.code_points(texts)
        out = np.zeros((len(texts), len(self.tokens)))
        row, end = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths), lengths)
        letter = self.places.of(code)
        letter[letter < 0] = len(self.letters)  # a character of no token has the last number
        number, reach = np.zeros(len(code), dtype=np.int64), 0  # of the characters from each place on
        for m, (places, columns) in self.by_length.items():
            for k in range(reach, m):
                number = number[: max(0, len(code) - k)] * (len(self.letters) + 1) + letter[k:]
            reach = m
            if len(columns) <= FEW:
                each = [np.flatnonzero(number == key) for key in places.keys]
                at, hit = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
            else:
                found = places.of(number)
                at = np.flatnonzero(found >= 0)
                hit = found[at]
            inside = at + m <= end[at]
            at, hit = at[inside], hit[inside]
            found = np.bincount(row[at] * len(columns) + hit, minlength=len(texts) * len(columns))
            out[:, columns] = found.reshape(len(texts), len(columns))
        for i in self.long:
            t = self.tokens[i]
            out[:, i] = [sum(text.startswith(t, k) for k in range(len(text) - len(t) + 1)) for text in texts]
        return out


def overlaps_itself(token: str) -> bool:
    return any(token[:k] == token[-k:] for k in range(1, len(token)))


#: The mark of a character whose kind is known.
KNOWN = 1 << 7


class Record:
    """The feature record of texts."""

    def __init__(self, style: Style, grams: list[list[str]]):
        import regex

        self.style, self.grams = style, grams
        self.named = [*style.functions, *style.formulas, *style.punctuation]
        tokens = list(dict.fromkeys([*self.named, *(g for found in grams for g in found)]))
        self.counter, column = Counter(tokens), {t: i for i, t in enumerate(tokens)}
        self.named_at = [column[t] for t in self.named]
        self.grams_at = [[column[g] for g in found] for found in grams]
        self.letter = regex.compile(f"[{style.letter}]")
        self.marks = [frozenset(map(ord, s)) for s in (style.ends, style.clauses, style.opening, style.closing)]
        self.kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)  # by character, once it was met: KNOWN and what it is

    def of(self, texts: list[str]) -> np.ndarray:
        """One row a text, in the order of feature_names."""
        counts = self.counter.counts(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.float64)
        plain = np.array(self._plain(texts)).reshape(len(texts), len(PLAIN) + 1)
        letters = plain[:, -1:]
        named = counts[:, self.named_at]
        for j, token in enumerate(self.named):
            if overlaps_itself(token):
                named[:, j] = [t.count(token) for t in texts]
        with np.errstate(invalid="ignore", divide="ignore"):
            named = np.where(letters > 0, named * 1000 / letters, 0.0)
        rates = [counts[:, at] * 1000 / np.maximum(1, lengths - k)[:, None] for k, at in enumerate(self.grams_at)]
        return np.concatenate([plain[:, :-1], named, *rates], axis=1)

    def _plain(self, texts: list[str]) -> list[list[float]]:
        code, lengths = ngrams.code_points(texts)
        for c in np.flatnonzero(np.bincount(code[self.kinds[code] == 0])).tolist():
            self.kinds[c] = KNOWN | sum(1 << k for k, held in enumerate(self._kind(c)) if held)
        kind = self.kinds[code]
        is_letter, ends, clauses, opens, closes = ((kind & 1 << k) > 0 for k in range(5))
        before = np.append(0, np.cumsum(is_letter))  # letters before each place
        bound = np.append(0, np.cumsum(lengths))
        sentences, clause_cuts = np.flatnonzero(ends), np.flatnonzero(clauses)
        steps = opens.astype(np.int8) - closes.astype(np.int8)
        out = []
        for n, a, b in zip(lengths.tolist(), bound.tolist(), bound[1:].tolist()):
            if not n:
                out.append([0.0] * (len(PLAIN) + 1))
                continue
            own, letters, inside, turns = is_letter[a:b], int(before[b] - before[a]), 0, 0
            if opens[a:b].any():
                walk = np.cumsum(steps[a:b], dtype=np.int64)
                depth = walk - np.minimum(0, np.minimum.accumulate(walk))  # a closing mark too many is ignored
                inside = int((own & (depth > 0)).sum())
                turns = int((opens[a:b] & (depth == 1)).sum())
            sentence, clause = (np.sort(self._segments(before, cuts, a, b)) for cuts in (sentences, clause_cuts))
            entropy, unique, mattr = code_profile(code[a:b][own], self.style.window)
            out.append([
                math.log1p(n), letters / n, inside / letters if letters else 0.0, turns * 1000 / letters if letters else 0.0,
                mean(sentence), *(quantile(sentence, p) for p in (0.25, 0.5, 0.75, 0.9)), mean(clause), quantile(clause, 0.5),
                mattr, entropy, unique, letters,
            ])
        return out

    def _kind(self, c: int) -> tuple[bool, ...]:
        """Whether a character is a letter, ends a sentence or a clause, opens or closes speech."""
        return self.letter.match(chr(c)) is not None, *(c in m for m in self.marks)

    @staticmethod
    def _segments(before: np.ndarray, cuts: np.ndarray, a: int, b: int) -> np.ndarray:
        """Letters between the cuts from a to b; segments without any are dropped."""
        first, beyond = np.searchsorted(cuts, (a, b))
        found = np.diff(before[np.concatenate([[a], cuts[first:beyond], [b]])])
        return found[found > 0]


def mean(values: np.ndarray) -> float:
    return float(values.mean()) if len(values) else 0.0


def quantile(ordered: np.ndarray, p: float) -> float:
    """Linear between neighbours, as np.quantile has it for sorted values."""
    if not len(ordered):
        return 0.0
    at = (len(ordered) - 1) * p
    low = int(at)
    a, b, t = float(ordered[low]), float(ordered[min(low + 1, len(ordered) - 1)]), at - low
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def records(docs: DataFrame, style: Style, grams: list[list[str]], keep: list[str]) -> DataFrame:
    """(keep, values): the feature record of each row's text, in the order of feature_names; null counts as empty. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((style, grams))
    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = Record(*shared.value)
        for whole in batches:
            for batch in ngrams.batches_of(iter([whole]), "style_text"):
                x = record.of([t or "" for t in batch.column("style_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), arrays(x)], [*keep, "values"])

    return docs.select(*keep, F.col("text").alias("style_text")).mapInArrow(extract, f"{kinds}values array<double>")


def kept(rows: DataFrame) -> DataFrame:
    """rows that several passes read: worked out once and kept on the executors' disks."""
    return rows.persist(StorageLevel.DISK_ONLY)


def arrays(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def long_form(rows: DataFrame, names: list[str], keep: list[str], vector: str = "values") -> DataFrame:
    """(keep, feature, value): one row for each feature."""
    return rows.select(*keep, F.posexplode(vector).alias("i", "value")).select(*keep, F.get(F.lit(names), F.col("i")).alias("feature"), "value")


def scales(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, center, scale) over all records. Their values are counted by batch once and kept on the executors' disks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + 0.0  # one zero
            found = [np.unique(column, return_counts=True) for column in x.T]
            i = np.repeat(np.arange(len(found), dtype=np.int32), [len(v) for v, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(i), *(pa.array(np.concatenate(y)) for y in zip(*found))], ["i", "_v", "c"])

    counts = kept(rows.select("values").mapInArrow(count, "i int, _v double, c long"))
    first = kept(stats.quantiles(counts, "_v", ["i"], stats.QUARTILES))
    return stats.scale_about(counts, F.broadcast(first), ["i"]).select(F.get(F.lit(names), F.col("i")).alias("feature"), "center", "scale")


def gram_matrix(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Sum of products of vectors `z`, and how many there are: each task adds up one d x d matrix, and only these are shuffled."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            x = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            total, n = total + x.T @ x, n + len(x)
        i, j = np.triu_indices(d)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(total[i, j], n))], ["i", "j", "s"])

    got = rows.select("z").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((d, d))
    cells = got[got["i"] >= 0]
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells["s"]
    return out, int(got.loc[got["i"] < 0, "s"].sum())


@dataclass
class Features:
    """The part of a model that measures distances."""

    style: Style
    grams: list[list[str]]
    names: list[str]
    center: np.ndarray
    scale: np.ndarray
    inverse: np.ndarray
    centroids: np.ndarray
    groups: list[list] = field(default_factory=list)  # by cluster: the training groups in it

    def standardized(self, values: np.ndarray) -> np.ndarray:
        return (values - self.center) / self.scale

    def distances(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean absolute deviation, covariance distance and the mean of both from each centroid: (rows, clusters) each."""
        off = z[:, None, :] - self.centroids[None]
        delta = np.abs(off).mean(axis=2)
        far = np.sqrt(np.maximum(0, np.einsum("rci,ij,rcj->rc", off, self.inverse, off, optimize=True)) / z.shape[1])
        return delta, far, 0.5 * delta + 0.5 * far


def fit_features(training: DataFrame, style: Style, group: str, counts: DataFrame | None = None) -> Features:
    """Vocabulary, scales, inverse covariance and clusters of the training texts (columns `text` and a group).

    Of the texts only counts, one matrix a task and one mean a group are gathered; the matrix has a side of as many numbers as there are features.
    """
    grams = vocabulary(training, style, counts)
    names = feature_names(style, grams)
    rows = kept(records(training, style, grams, [group]))
    if rows.count() < 2:
        raise ValueError("a style model needs two training texts")
    found = {r["feature"]: (r["center"], r["scale"]) for r in scales(rows, names).collect()}
    center, scale = (np.array([found[n][k] for n in names]) for k in (0, 1))
    z = rows.select(group, standardize(F.col("values"), center, scale).alias("z"))
    product, n = gram_matrix(z, len(names))
    cov = product / max(1, n - 1) * (1 - style.shrinkage)
    np.fill_diagonal(cov, np.diag(product) / max(1, n - 1) + style.ridge)
    model = Features(style, grams, names, center, scale, stats.inverse(cov), np.zeros((1, len(names))))
    points = stats.centroids(z.filter(F.col(group).isNotNull()), "z", group)
    labels = two_clusters(points, group)
    groups = sorted(labels)
    model.groups = [[g for g in groups if labels[g] == c] for c in range(1 + max(labels.values(), default=0))] or [[]]
    if len(model.groups) == 2:
        at = F.create_map(*(F.lit(x) for g in groups for x in (g, labels[g])))
        means = stats.centroids(points.withColumn("cluster", at[F.col(group)]), "centroid", "cluster").collect()
        model.centroids = np.array([r["centroid"] for r in sorted(means, key=lambda r: r["cluster"])])
    rows.unpersist()
    return model


def standardize(values: Column, center: np.ndarray, scale: np.ndarray) -> Column:
    pairs = F.lit([float(c) for c in center]), F.lit([float(s) for s in scale])
    return F.zip_with(F.zip_with(values, pairs[0], lambda v, c: v - c), pairs[1], lambda v, s: v / s)


def two_clusters(points: DataFrame, group: str) -> dict:
    """Cluster by group of (group, centroid): two, or one if there are fewer than 6 groups or a cluster has fewer than 3."""
    if points.count() <= DRIVER_GROUPS:
        return stats.two_means(sorted((r[group], r["centroid"]) for r in points.collect()))
    found = clusters.clustered(points.select(group, F.col("centroid").alias("point")), group, 2)
    labels = {r[group]: r["cluster"] for r in found.select(group, "cluster").collect()}
    return labels if min(sum(v == c for v in labels.values()) for c in (0, 1)) >= 3 else dict.fromkeys(labels, 0)


def counts_by_fold(training: DataFrame, style: Style, fold: str) -> DataFrame:
    """(order, gram, n, n of each fold in order as _0, _1, ...): n-grams of all orders that a model asks for, kept on the executors' disks."""
    counts = ngrams.gram_counts(training, list(range(1, max(style.order, len(style.grams)) + 1)), keys=[fold], charset=WHOLE)
    own = [F.coalesce(F.sum(F.when(F.col(fold) == f, F.col("n"))), F.lit(0)).alias(f"_{k}") for k, f in enumerate(fold_values(training, fold))]
    return kept(counts.groupBy("order", "gram").agg(F.sum("n").alias("n"), *own))


def fold_values(training: DataFrame, fold: str) -> list:
    return sorted(r[0] for r in training.select(fold).filter(F.col(fold).isNotNull()).distinct().collect())


def choose_alpha(training: DataFrame, style: Style, fold: str, counts: DataFrame | None = None) -> list[tuple[float, float]]:
    """(alpha, bits for a character), the best first: each fold is scored by the model of the others, weighted by length.

    N-grams are counted once, by fold; the counts of the other folds are a sum. One candidate alone if there are fewer than two folds.
    """
    folds = fold_values(training, fold)
    if len(folds) < 2:
        return [(style.alphas[0], math.nan)]
    table = (counts_by_fold(training, style, fold) if counts is None else counts).filter(F.col("order") <= style.order)
    size = table.count()
    if size * 24 > ngrams.BROADCAST_BYTES:
        raise ValueError(TOO_LARGE)
    total, length = np.zeros(len(style.alphas)), 0.0
    at_once = max(1, ngrams.BROADCAST_BYTES // max(1, 24 * size))  # models that are sent together
    for begin in range(0, len(folds), at_once):
        models = {}
        for k, f in list(enumerate(folds))[begin : begin + at_once]:
            rest = table.select("order", "gram", (F.col("n") - F.col(f"_{k}")).alias("n")).filter("n > 0").toPandas()
            models[f] = ngrams.Counts.of(rest.assign(context_n=followed(rest)), style.order, 1.0)
        scored = fold_bits(training.filter(F.col(fold).isin(*models)), models, fold, list(style.alphas))
        sums = scored.filter("n_points > 0").agg(F.sum("n_points"), *(F.sum(F.get("bits", F.lit(k)) * F.col("n_points")) for k in range(len(style.alphas)))).first()
        if sums[0]:
            total, length = total + np.array([float(x) for x in sums[1:]]), length + sums[0]
    return sorted(((a, t / max(1.0, length)) for a, t in zip(style.alphas, total)), key=lambda x: (x[1], x[0]))


def followed(table: pd.DataFrame) -> pd.Series:
    """How often each n-gram of a whole table (order, gram, n) is followed by another character, as ngrams.with_contexts has it."""
    longer = table[table["order"] > 1]
    return table["gram"].map(longer["n"].groupby(longer["gram"].str[:-1]).sum()).fillna(0)


def fold_bits(docs: DataFrame, models: dict, fold: str, alphas: list[float]) -> DataFrame:
    """(n_points, bits): bits for a character of each row's text by the model of its fold, under each alpha, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ngrams.batches_of(batches, "style_text"):
            folds, texts = batch.column("fold").to_pylist(), [t or "" for t in batch.column("style_text").to_pylist()]
            for f in dict.fromkeys(folds):
                own = [t for t, g in zip(texts, folds) if g == f]
                bits = np.stack(shared.value[f].bits_by_alpha(own, alphas), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([len(t) for t in own], pa.int64()), arrays(np.where(np.isnan(bits), np.inf, bits))], ["n_points", "bits"])

    return docs.select(F.col(fold).alias("fold"), F.col("text").alias("style_text")).mapInArrow(score, "n_points long, bits array<double>")


def bits_of(models: list[ngrams.Counts], texts: list[str]) -> np.ndarray:
    found = np.stack([m.bits(texts) for m in models], axis=1)
    return np.where(np.isnan(found), np.inf, found)


@dataclass
class StyleModel:
    """A fitted model: features, one character model a cluster (cluster, order, gram, n, context_n), and what calibration texts score."""

    features: Features
    alpha: float
    language: DataFrame
    calibration: DataFrame  # distance, bpc_off
    bpc_center: float
    bpc_scale: float

    def version(self) -> str:
        """A digest of all that the model holds; the order of rows has no part in it."""
        f = self.features
        held = [dataclasses.asdict(f.style), f.grams, f.groups, self.alpha, *(np.asarray(a).round(9).tolist() for a in (f.center, f.scale, f.inverse, f.centroids)), round(self.bpc_center, 9), round(self.bpc_scale, 9)]
        for table in (self.language, self.calibration.select(F.round("distance", 9), F.round("bpc_off", 9))):
            held.append([str(x) for x in table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *table.columns).cast("decimal(38,0)"))).first()])
        return hashlib.sha256(json.dumps(held, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()

    def save(self, folder: str) -> str:
        """Write the model under folder/<version>; returns the version. A version that is there already is left as it is."""
        version = self.version()
        spark, f, at = self.language.sparkSession, self.features, f"{folder}/{version}"
        facts = {"style": dataclasses.asdict(f.style), "grams": f.grams, "groups": f.groups, "alpha": self.alpha, "bpc_center": self.bpc_center, "bpc_scale": self.bpc_scale}
        rows = [("center", 0, f.center), ("scale", 0, f.scale), *(("inverse", i, r) for i, r in enumerate(f.inverse)), *(("centroid", i, r) for i, r in enumerate(f.centroids))]
        self.language.write.mode("ignore").parquet(f"{at}/language")
        self.calibration.write.mode("ignore").parquet(f"{at}/calibration")
        spark.createDataFrame([(k, i, [float(x) for x in v]) for k, i, v in rows], "kind string, i int, vector array<double>").write.mode("ignore").parquet(f"{at}/vectors")
        # the facts come last: a version without them was not finished
        spark.createDataFrame([(json.dumps(facts, ensure_ascii=False),)], "facts string").write.mode("ignore").parquet(f"{at}/facts")
        return version

    @staticmethod
    def load(spark: SparkSession, folder: str, version: str) -> StyleModel:
        at = f"{folder}/{version}"
        facts = json.loads(spark.read.parquet(f"{at}/facts").first()["facts"])
        vectors = spark.read.parquet(f"{at}/vectors").orderBy("kind", "i").collect()
        of = lambda kind: np.array([r["vector"] for r in vectors if r["kind"] == kind])
        style = Style(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts["style"].items()})
        grams = facts["grams"]
        features = Features(style, grams, feature_names(style, grams), of("center")[0], of("scale")[0], of("inverse"), of("centroid"), facts["groups"])
        return StyleModel(features, facts["alpha"], spark.read.parquet(f"{at}/language"), spark.read.parquet(f"{at}/calibration"), facts["bpc_center"], facts["bpc_scale"])


def fit(training: DataFrame, calibration: DataFrame | None, style: Style, group: str, fold: str | None = None, alpha: float | None = None) -> StyleModel:
    """A style model of training texts (text, group, fold), calibrated on other texts (text).

    The smoothing is `alpha`, or that of choose_alpha over the folds. Texts whose group is in no cluster (a null group) count for
    the vocabulary and scales alone. Null texts count as empty ones. Without calibration texts the model is to be `calibrated` before it audits.
    """
    chosen = alpha is None and fold is not None
    counts = counts_by_fold(training, style, fold) if chosen else None
    features = fit_features(training, style, group, counts)
    if alpha is None:
        alpha = choose_alpha(training, style, fold, counts)[0][0] if chosen else style.alphas[0]
    if counts is not None:
        counts.unpersist()
    at = F.create_map(*(F.lit(x) for c, groups in enumerate(features.groups) for g in groups for x in (g, c))) if any(features.groups) else None
    own = training.withColumn("cluster", at[F.col(group)] if at is not None else F.lit(0)).filter("cluster IS NOT NULL")
    counts = kept(ngrams.gram_counts(own, list(range(1, style.order + 1)), keys=["cluster"], charset=WHOLE))
    language = ngrams.with_contexts(counts, ["cluster"]).persist()
    model = StyleModel(features, alpha, language, calibration, 0.0, 1.0)
    return model if calibration is None else calibrated(model, calibration)


def calibrated(model: StyleModel, calibration: DataFrame) -> StyleModel:
    """The model with what calibration texts score; rows of `distances` are taken as they are."""
    scored = kept((calibration if measured(calibration) else distances(calibration, model, [])).select("distance", "bpc"))
    bpc = stats.robust_scale(scored.withColumn("all", F.lit(1)), "bpc", ["all"]).first()
    if bpc:
        model.bpc_center, model.bpc_scale = bpc["center"], bpc["scale"]
    model.calibration = scored.select("distance", bpc_off(model).alias("bpc_off"))
    return model


def bpc_off(model: StyleModel) -> Column:
    return F.round(F.abs(F.col("bpc") - model.bpc_center) / model.bpc_scale, 9)


def distances(docs: DataFrame, model: StyleModel, keep: list[str], most: int = 8) -> DataFrame:
    """(keep, cluster, delta, mahalanobis, distance, bpc, language_cluster, cluster_bits, deviations) of each row's text, in one pass over it.

    The nearest centroid counts (the first of equals), and the mean likelihood of all clusters' character models; deviations are the `most`
    features farthest from the centre, as (feature, z). Numbers are rounded to 9 places, so that equal texts tie wherever they lie.
    """
    tables = [model.language.filter(F.col("cluster") == c).drop("cluster") for c in range(len(model.features.groups))]
    if model.language.count() * 24 > ngrams.BROADCAST_BYTES:
        raise ValueError(TOO_LARGE)
    counts = [ngrams.Counts.of(t.toPandas(), model.features.style.order, model.alpha) for t in tables]
    shared = docs.sparkSession.sparkContext.broadcast((model.features, counts))
    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    schema = f"{kinds}cluster int, delta double, mahalanobis double, distance double, bpc double, language_cluster int, cluster_bits array<double>, deviations array<struct<feature:string,z:double>>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, language = shared.value
        record, names = Record(features.style, features.grams), np.array(features.names, dtype=object)
        by_name = np.argsort(np.argsort(names))
        for batch in ngrams.batches_of(batches, "style_text", 1 << 19):
            texts = [t or "" for t in batch.column("style_text").to_pylist()]
            z = features.standardized(record.of(texts))
            delta, far, both = features.distances(z)
            bits = bits_of(language, texts)
            i, c = np.arange(len(texts)), both.argmin(axis=1)
            mixed = -np.log2(np.maximum(np.exp2(-bits).mean(axis=1), 5e-324))
            top = np.lexsort((np.broadcast_to(by_name, z.shape), -np.abs(z).round(9)), axis=1)[:, :most]
            pairs = [[{"feature": names[k], "z": float(z[r, k])} for k in top[r]] for r in i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(c.astype(np.int32)), *(pa.array(a[i, c].round(9)) for a in (delta, far, both)), pa.array(mixed.round(9)), pa.array(bits.argmin(axis=1).astype(np.int32)), arrays(bits),
                 pa.array(pairs, pa.list_(pa.struct([("feature", pa.string()), ("z", pa.float64())])))],
                [*keep, "cluster", "delta", "mahalanobis", "distance", "bpc", "language_cluster", "cluster_bits", "deviations"],
            )

    return docs.select(*keep, F.col("text").alias("style_text")).mapInArrow(measure, schema)


def measured(rows: DataFrame) -> bool:
    """Whether rows are those of `distances`."""
    return {"distance", "bpc", "cluster_bits", "deviations"} <= set(rows.columns)


def band(feature: Column, language: Column, overall: Column) -> Column:
    """alarm if either channel is under 5, weak if both together are under 20."""
    return F.when((feature < 5) | (language < 5), "alarm").when(overall < 20, "weak").otherwise("in range")


def overall(feature: Column, language: Column) -> Column:
    return 0.6 * feature + 0.4 * language


def audit(docs: DataFrame, model: StyleModel, keep: list[str]) -> DataFrame:
    """Each row's text against the model: distances, shares of calibration texts at least as far off, band, and what to look at.

    Shares are 0 to 100; suggestions come from the five largest deviations, each once. Every text is measured once: the shares read
    the distances again, not the texts. Rows of `distances` are taken as they are.
    """
    rows = kept((docs if measured(docs) else distances(docs, model, keep)).withColumn("bpc_off", bpc_off(model)))
    rows = stats.empirical_share(rows, model.calibration, "distance").withColumnRenamed("share", "feature_share")
    rows = stats.empirical_share(rows, model.calibration, "bpc_off").withColumnRenamed("share", "language_share")
    both = overall(F.col("feature_share"), F.col("language_share"))
    told = F.array_distinct(F.transform(F.slice("deviations", 1, 5), lambda d: wording.suggestion(d["feature"], d["z"])))
    return rows.withColumn("overall", both).withColumn("band", band(F.col("feature_share"), F.col("language_share"), F.col("overall"))).withColumn("suggestions", told)


def aggregate(audited: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, feature, language, overall, band): 0.7 median + 0.3 tenth percentile of each channel, and of both together."""
    score = lambda c: 0.7 * F.percentile(c, F.lit(0.5)) + 0.3 * F.percentile(c, F.lit(0.1))
    rows = audited.groupBy(*by).agg(F.count("*").alias("n"), score("feature_share").alias("feature"), score("language_share").alias("language"))
    rows = rows.withColumn("overall", overall(F.col("feature"), F.col("language")))
    return rows.withColumn("band", band(F.col("feature"), F.col("language"), F.col("overall")))


def validation(audited: DataFrame, group: str, most: float = 0.1) -> DataFrame:
    """(rate, status): the share of held-out groups that raise an alarm; validated up to `most`, else experimental; no groups count as a rate of 1."""
    rate = F.coalesce(F.avg((F.col("band") == "alarm").cast("double")), F.lit(1.0))
    return aggregate(audited, [group]).agg(rate.alias("rate")).withColumn("status", F.when(F.col("rate") <= most, "validated").otherwise("experimental"))


def cross_validation(training: DataFrame, style: Style, group: str, fold: str) -> DataFrame:
    """(fold, n, median, p90) of the distances of each fold's texts from a feature model of the other folds."""
    out = None
    for own in sorted(r[0] for r in training.select(fold).filter(F.col(fold).isNotNull()).distinct().collect()):
        model = fit_features(training.filter(~F.col(fold).eqNullSafe(F.lit(own))), style, group)
        held = out_of_fold(training.filter(F.col(fold) == own), model)
        row = held.agg(F.count("*").alias("n"), F.percentile("distance", F.lit(0.5)).alias("median"), F.percentile("distance", F.lit(0.9)).alias("p90")).select(F.lit(own).alias(fold), "n", "median", "p90")
        out = row if out is None else out.unionAll(row)
    if out is None:
        return training.sparkSession.createDataFrame([], f"{fold} int, n long, median double, p90 double")
    return out


def out_of_fold(docs: DataFrame, model: Features, keep: list[str] | None = None) -> DataFrame:
    """(keep, distance): distances alone, without character models."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value
        for batch in batches:
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at in range(0, len(x), 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(features.distances(features.standardized(x[at : at + 512]))[2].min(axis=1).round(9))], [*keep, "distance"])

    return records(docs, model.style, model.grams, keep).mapInArrow(measure, f"{kinds}distance double")
