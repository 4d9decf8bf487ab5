"""Language identification with string kernels: Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bounds of what a model is fitted on: landmark texts and training texts a language, in expectation. Texts are whole.
LANDMARKS, TRAINING = 24, 600
#: Letters are told apart by their code points, whatever the script; n-grams are numbered by a hash of this many bits.
BITS = 20
#: Odd factors that spread n-grams of one, two and three letters over the numbers.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
RIDGE = 1e-3
UNKNOWN = "und"
#: Documents whose presence rows form one matrix product.
ROWS = 256


@dataclass
class Model:
    """All that scoring needs: code of each letter, column of each n-gram, landmark matrices and weights."""

    codes: np.ndarray  # by code point: 0 not a letter, else its own code
    columns: np.ndarray  # by n-gram number: its column in the landmark matrix, or -1
    landmarks: np.ndarray  # n-grams x landmarks: whether the landmark has the n-gram
    norms: np.ndarray  # by landmark: root of its number of n-grams
    weights: np.ndarray | None = None  # landmarks x languages
    bias: np.ndarray | None = None
    languages: tuple[str, ...] = ()


def letter_codes(text: str, codes: np.ndarray) -> np.ndarray:
    """The codes of a lower-cased text, each run of other characters as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = codes[points]
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    return c[keep].astype(np.uint64)


def present_grams(c: np.ndarray) -> np.ndarray:
    """Numbers of the distinct n-grams of 1 to 3 codes, in order."""
    grams, found = c, []
    for n, factor in enumerate(SPREAD):
        if n:
            grams = grams[:-1] << np.uint64(21) | c[n:]
        found.append((grams * np.uint64(factor) >> np.uint64(64 - BITS)).astype(np.uint32))
    every = np.concatenate(found)
    every.sort()
    return every[np.append(True, every[1:] != every[:-1])[: len(every)]].astype(np.int64)


def every_letter() -> np.ndarray:
    """By code point: its own number plus one for a letter, else 0."""
    return np.fromiter((i + 1 if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def landmark_model(grams: list[np.ndarray], codes: np.ndarray) -> Model:
    """A model without weights from the n-grams of landmark texts."""
    every = np.unique(np.concatenate(grams))
    columns = np.full(1 << BITS, -1, dtype=np.int32)
    columns[every] = np.arange(len(every))
    matrix = np.zeros((len(every), len(grams)), dtype=np.uint8)
    for i, g in enumerate(grams):
        matrix[columns[g], i] = 1
    return Model(codes, columns, matrix, np.sqrt([len(g) for g in grams]).astype(np.float32))


def kernel(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised presence kernel of texts against landmarks, and whether each text has letters.

    One matrix product of the texts and the landmarks, over the n-grams that some text has.
    """
    held, lettered = [], np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        c = letter_codes(t, model.codes)
        lettered[i] = bool((c > 0).any())
        held.append(present_grams(c) if lettered[i] else np.zeros(0, dtype=np.int64))
    at = [model.columns[g] for g in held]
    at = [a[a >= 0] for a in at]
    used = np.zeros(len(model.landmarks), dtype=bool)
    for a in at:
        used[a] = True
    used = np.flatnonzero(used)
    place = np.zeros(len(model.landmarks), dtype=np.int32)
    place[used] = np.arange(len(used))
    rows = np.zeros((len(texts), len(used)), dtype=np.float32)
    for i, (a, g) in enumerate(zip(at, held)):
        rows[i, place[a]] = 1 / np.sqrt(max(1, len(g)))
    return rows @ model.landmarks[used].astype(np.float32) / model.norms, lettered


def fit(model: Model, k: np.ndarray, labels: list[str]) -> Model:
    """Kernel ridge regression on Nyström features, one regression a language against the rest."""
    kmm = np.zeros((len(model.norms), len(model.norms)))
    for at in range(0, len(model.landmarks), 1 << 15):
        part = model.landmarks[at : at + (1 << 15)].astype(np.float64)
        kmm += part.T @ part
    kmm /= np.outer(model.norms, model.norms)
    values, vectors = np.linalg.eigh(kmm)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k.astype(np.float64) @ root
    languages = tuple(sorted(set(labels)))
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = np.array([1 / labels.count(x) for x in labels])
    balance *= len(labels) / balance.sum()
    mean = (balance[:, None] * phi).sum(axis=0) / balance.sum()
    centre = (balance[:, None] * y).sum(axis=0) / balance.sum()
    x = phi - mean
    w = np.linalg.solve((x * balance[:, None]).T @ x + RIDGE * len(labels) * np.eye(x.shape[1]), (x * balance[:, None]).T @ (y - centre))
    return Model(model.codes, model.columns, model.landmarks, model.norms, (root @ w).astype(np.float32), (centre - mean @ w).astype(np.float32), languages)


def remainder(id_col: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def train(docs: DataFrame, usable: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a sample of the usable rows, about LANDMARKS landmarks and TRAINING texts a language; None without any.

    Rows are taken by a hash of their id and text against their language's count, so no language is passed over. N-grams and
    kernels are computed where the rows are; the driver sees a landmark's n-gram numbers and one short vector a training text.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)).alias("draw")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None

    def below(wanted: int) -> F.Column:
        share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1, wanted / n) * (1 << 20)))))
        return F.col("draw") < share[F.col("lang")]

    codes = docs.sparkSession.sparkContext.broadcast(every_letter())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = [present_grams(letter_codes(t, codes.value)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g.astype(np.int32) for g in found], pa.list_(pa.int32()))], ["g"])

    drawn = rows.filter(below(LANDMARKS)).orderBy("draw", "lang", "text").select("text").mapInArrow(grams, "g array<int>").collect()
    marks = [np.array(r["g"], dtype=np.int64) for r in drawn if r["g"]]
    if not marks:
        return None
    model = landmark_model(marks, codes.value)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            k, _ = kernel(shared.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(list(k), pa.list_(pa.float32()))], ["lang", "k"])

    sample = rows.filter(below(TRAINING)).select("text", "lang").mapInArrow(kernels, "lang string, k array<float>").collect()
    return fit(model, np.array([r["k"] for r in sample], dtype=np.float32), [r["lang"] for r in sample]) if sample else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text: the language with the largest margin.

    Null texts, empty ones and texts without a letter are 'und' with score 0, as is every text if the model is
    None (nothing to learn from). Of equal margins the first language by name wins. The score is the best margin's softmax share.
    Rows are scored one by one, so repeated rows and ids make no difference; a long text is one row, and leaves no more than its
    distinct n-grams. Only id and text are read, so other columns cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            langs, scores = label(shared.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs), pa.array(scores)], ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def label(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its score."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    k, lettered = kernel(model, [t or "" for t in texts])
    margin = (k @ model.weights + model.bias).astype(np.float64)
    share = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
    return [model.languages[j] if ok else UNKNOWN for j, ok in zip(margin.argmax(axis=1), lettered)], np.where(lettered, 1 / share.sum(axis=1), 0.0)


def parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most, and of bounded text."""
    for batch in slices(batches, 4 << 20, column):
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict every document's language from a model fitted on rows whose crc32(id) mod 4 is not 2.

    The string kernel of two texts is the number of 1- to 3-grams of letters that both have (presence, not
    counts), over the root of what each has. An empty table gives an empty table; null ids are scored but
    neither learnt from nor held out. Returns id, held_out, lang_pred, score.
    """
    held = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    model = train(docs, ~held & F.col(id_col).isNotNull(), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose language can be told (not 'und'); nothing is shuffled.

    Where there is nothing to learn from, all texts with letters stay.
    """
    held = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ~held & F.col(id_col).isNotNull(), id_col, text_col, lang_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text_col):
            texts = part.column(text_col).to_pylist()
            if shared.value is None:
                told = [any(c.isalpha() for c in t or "") for t in texts]
            else:
                told = [x != UNKNOWN for x in label(shared.value, texts)[0]]
            yield part.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
