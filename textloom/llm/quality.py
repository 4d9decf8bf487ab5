"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .langid import remainder

#: Bounds of the fitted sample (in expectation): trusted positives, unlabelled texts.
POSITIVES, UNLABELLED = 8_000, 16_000
EPOCHS, BATCH, RATE, DECAY = 60, 1024, 0.01, 1e-4
#: Estimating the class prior: steps of the classifier that tells positives from unlabelled texts, and how sure its bound is.
PRIOR_STEPS, PRIOR_SLACK, PRIOR_DELTA = 300, 0.01, 0.1
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Character classes: other, space, line end, lower, upper, digit, then each ASCII punctuation mark.
CLASSES = 6 + len(PUNCTUATION)
#: Pairs of classes share this many hashed columns.
PAIRS = 160
FEATURES = CLASSES + PAIRS + 6


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def character_classes() -> np.ndarray:
    """The class of each code point of the basic plane; all others count as class 0."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for i in range(0x10000):
        c = chr(i)
        table[i] = 2 if c in "\r\n" else 1 if c.isspace() else 3 if c.islower() else 4 if c.isupper() else 5 if c.isdigit() else 0
    for k, c in enumerate(PUNCTUATION):
        table[ord(c)] = 6 + k
    return table


def features(text: str | None, table: np.ndarray) -> np.ndarray:
    """Class and class-pair shares on a root scale, and word statistics, of a whole text."""
    out = np.zeros(FEATURES, dtype=np.float32)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], 0).astype(np.int32)
    out[:CLASSES] = np.sqrt(np.bincount(c, minlength=CLASSES) / len(c))
    pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    column = (np.arange(CLASSES * CLASSES, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(PAIRS)
    out[CLASSES : CLASSES + PAIRS] = np.sqrt(np.bincount(column.astype(np.int64), weights=pairs, minlength=PAIRS) / max(1, len(c) - 1))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    gap = (c == 1) | (c == 2)
    words_len = (len(c) - int(gap.sum())) / n
    out[-6:] = (np.log1p(len(c)), len(set(words)) / n, words_len / 10, len(set(lines)) / len(lines), np.log1p(len(c) / len(lines)), np.log1p(n / len(lines)))
    return out


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """The share of positives among the unlabelled, from these two samples alone.

    A logistic model learns on half of each sample to tell positives from unlabelled texts. In the other halves, above any
    threshold, the share of the unlabelled over the share of the positives bounds the prior from above; the bound
    is taken at the threshold where it and its sampling error together are least (the best top bin).
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    every = np.concatenate([p, u])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    p, u = (np.hstack([(x - mean) / scale, np.ones((len(x), 1))]) for x in (p, u))
    fit_p, fit_u, p, u = p[::2], u[::2], p[1::2], u[1::2]
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for step in range(1, PRIOR_STEPS + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (fit_p, fit_u))
        g = -fit_p.T @ (1 - sp) / len(fit_p) + fit_u.T @ su / len(fit_u) + 1e-2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    p, u = np.sort(p @ w), np.sort(u @ w)
    cuts = np.unique(p)
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
    error = sum(np.sqrt(np.log(4 / PRIOR_DELTA) / (2 * len(x))) for x in (p, u))
    best = np.argmin((above_u + (1 + PRIOR_SLACK) * error) / above_p)
    return float(min(0.99, max(0.01, above_u[best] / above_p[best])))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the sigmoid loss, by Adam.

    Where a batch's negative part falls below zero, its gradient is reversed, as the non-negative
    estimator asks, so the fit cannot gain from calling the positives negative risk.
    """
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(p.shape[1] + 1), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    step = 0
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    for _ in range(EPOCHS):
        order = rng.permutation(len(u))
        for begin in range(0, len(u), BATCH):
            ub = u[order[begin : begin + BATCH]]
            pb = p[rng.integers(0, len(p), size=min(len(p), BATCH))]
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (pb, ub))
            gp = pb.T @ (sp * (1 - sp)) / len(pb)  # of the mean sigmoid over positives
            gu = ub.T @ (su * (1 - su)) / len(ub)
            negative = su.mean() - prior * sp.mean()
            g = -prior * gp + (gu - prior * gp) if negative >= 0 else -(gu - prior * gp)
            g = g + DECAY * np.append(w[:-1], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def featurise(rows: DataFrame, keep: str) -> DataFrame:
    """(keep, x): the features of each row's text, computed where the row is."""
    table = rows.sparkSession.sparkContext.broadcast(character_classes())

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            x = [features(t, table.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(x, pa.list_(pa.float32()))], [keep, "x"])

    return rows.select(keep, "text").mapInArrow(compute, f"{keep} {rows.schema[keep].dataType.simpleString()}, x array<float>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on rows of docs; labels has (id, label) of those that may be learnt from. None without positives.

    Trusted positives are labelled 1, unlabelled texts come from all rows of docs, whatever their label. The class prior is
    estimated from these two (see class_prior); no other label is read. Both samples are taken by a hash of the id and bounded by
    POSITIVES and UNLABELLED in expectation; the driver holds their feature vectors only.
    """
    labels = labels.filter(F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(id_col).distinct()
    ones = labels.count()
    rows = docs.filter(F.col(id_col).isNotNull()).count()
    if not ones or not rows:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 30))
    text = docs.select(id_col, F.col(text_col).alias("text"))
    trusted = labels.filter(draw < int(min(1, POSITIVES / ones) * (1 << 30))).select(id_col, F.lit(1).alias("trusted"))
    other = F.pmod(F.xxhash64(F.col(id_col), F.lit("unlabelled")), F.lit(1 << 30)) < int(min(1, UNLABELLED / rows) * (1 << 30))
    # POSITIVES bounds the ids that are sent along, so no text is shuffled
    sample = text.join(F.broadcast(trusted), id_col, "left").withColumn("unlabelled", other).filter("trusted = 1 or unlabelled")
    sample = sample.withColumn("kind", F.coalesce("trusted", F.lit(0)) * 2 + F.col("unlabelled").cast("int"))
    got = featurise(sample, "kind").toPandas()
    x = np.stack(got["x"].to_numpy())
    positive, unlabelled = x[got["kind"] >= 2], x[got["kind"] % 2 == 1]
    return fit(positive, unlabelled, class_prior(positive, unlabelled)) if len(positive) and len(unlabelled) else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row's whole text; score is 0 to 1, higher for likelier quality.

    Null text counts as empty, and empty texts are scored like others (no features). Without a model the score is 0.5. Rows are
    scored one by one, so ties and repeated rows make no difference. A long text is one row, whose features have a fixed length.
    An empty table gives an empty table. Only id and text are read, so other columns cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, character_classes()))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value
        for batch in slices(batches, 8 << 20):
            s = np.full(batch.num_rows, 0.5)
            if m is not None:
                x = np.stack([features(t, table) for t in batch.column("text").to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(((x - m.mean) / m.scale) @ m.weights + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(compute, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents with a model learnt from rows whose crc32(id) mod 3 is not 1.

    Labels of the other rows are neither read for the fit nor for the prior. Null ids are scored but not
    learnt from; an id that repeats among the labels is positive if one of its labels is 1. Returns id, held_out, score, predicted.
    """
    held = F.coalesce(remainder(id_col, 3) == 1, F.lit(False))
    model = train(docs.filter(~held), labels.filter(~held), id_col, text_col)
    return score(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "score", "predicted")
