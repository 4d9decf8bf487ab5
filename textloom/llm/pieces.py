"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of scored pieces."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the format: the white-space marker, and how far below the worst piece an unknown character scores.
MARKER, UNKNOWN_PENALTY = "▁", 10.0
#: Distinct words whose segmentations a task keeps before it starts afresh; bytes of new words segmented at a time.
CACHE, TOGETHER = 150_000, 1 << 18
#: Bytes of text that a task encodes at a time.
SLICE_BYTES = 1 << 20
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """Pieces with scores and a double-array trie over their UTF-8 bytes; bounded by the vocabulary's size."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # by trie state: the piece that ends there, or -1
    scores: np.ndarray
    byte_ids: np.ndarray  # by byte: the piece that stands for it
    piece_bytes: np.ndarray  # all pieces' bytes, one after the other
    piece_starts: np.ndarray
    unit: str  # pattern of the units that can be segmented by themselves


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of a trie: state s goes by byte c to base[s] + c if check of that is s."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, i in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = i
    size = 4 * len(children) + 1024
    base, check, value = np.full(size, size - 256, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    used = bytearray(size)
    used[0] = 1
    value[0] = ends[0]
    queue, wide, narrow = [(0, 0)], 1, 1
    for node, state in queue:
        codes = sorted(children[node])
        if not codes:
            continue  # its base leads to states that nobody owns
        b = max(1, (narrow if len(codes) == 1 else wide) - codes[0])
        tries = 0
        while any(used[b + c] for c in codes):
            b, tries = b + 1, tries + 1
        if len(codes) == 1:
            narrow = b + codes[0]
        elif tries > 64:
            wide = b + codes[0]  # the space before is nearly full
        base[state] = b
        for c in codes:
            used[b + c], check[b + c], value[b + c] = 1, state, ends[children[node][c]]
            queue.append((children[node][c], b + c))
    return base, check, value


def load(path: str = MODEL_PATH) -> Vocabulary:
    """The pieces of a model file with byte fallback; its scores count as the pieces' log scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)], dtype=np.float64)
    byte_ids = np.full(256, model.unk_id(), dtype=np.int32)
    raw, plain = [], []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            raw.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            raw.append(b"")
        else:
            raw.append(name.replace(MARKER, " ").encode())
            plain.append(i)
    base, check, value = double_array([(names[i].encode(), i) for i in plain])
    inner = any(MARKER in names[i].lstrip(MARKER) for i in plain)
    apart = "".join(c for c in "\n\t\r" if not any(c in names[i] for i in plain))
    unit = r"(?s).+" if inner else f"[{apart}]|{MARKER}+[^{MARKER}{apart}]*|[^{MARKER}{apart}]+" if apart else f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+"
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    scores = np.append(scores, scores[plain].min() - UNKNOWN_PENALTY)
    return Vocabulary(base, check, value, scores, byte_ids, np.frombuffer(b"".join(raw), dtype=np.uint8), starts, unit)


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs [start, start + length), one after the other."""
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def viterbi(units: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of each unit: all piece ids, one unit after the other, and ids per unit.

    All units advance together: every character start walks the trie at once, then positions are relaxed in
    order of their offset. Of equal sums the path whose last piece is longer wins, as in left-to-right relaxation with '>'.
    """
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    text = np.frombuffer(b"\0".join(units) + b"\0", dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]).astype(np.int64)
    ends = starts + lengths
    lead = (text & 0xC0) != 0x80
    lead[ends] = False
    origin = np.flatnonzero(lead)
    after = np.append(origin[1:], len(text) - 1)
    unit_of = np.repeat(np.arange(len(units)), lengths + 1)
    after = np.minimum(after, ends[unit_of[origin]])
    state, at = np.zeros(len(origin), dtype=np.int64), origin
    single_end = after
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    single = np.zeros(len(text) + 1, dtype=bool)
    index = np.arange(len(origin))
    while len(index):
        byte = text[at]
        to = v.base[state] + byte
        ok = v.check[to] == state
        index, state, at = index[ok], to[ok].astype(np.int64), at[ok] + 1
        piece = v.value[state]
        hit = piece >= 0
        o, e = origin[index[hit]], at[hit]
        found.append((o, e, piece[hit]))
        single[o[e == single_end[index[hit]]]] = True
        inside = at < len(text)
        index, state, at = index[inside], state[inside], at[inside]
    lone = ~single[origin]
    found.append((origin[lone], after[lone], np.full(int(lone.sum()), -1, dtype=np.int32)))
    o, e, piece = (np.concatenate(x) for x in zip(*found))
    offset = o - starts[unit_of[o]]
    order = np.argsort(offset, kind="stable")
    o, e, piece, offset = o[order], e[order], piece[order], offset[order]
    gain = v.scores[piece]
    best = np.full(len(text) + 1, -np.inf)
    back, by = np.zeros(len(text) + 1, dtype=np.int64), np.zeros(len(text) + 1, dtype=np.int32)
    best[starts] = 0
    cuts = np.flatnonzero(np.diff(offset)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(o)]):
        cand = best[o[a:b]] + gain[a:b]
        better = cand > best[e[a:b]]
        target = e[a:b][better]
        best[target], back[target], by[target] = cand[better], o[a:b][better], piece[a:b][better]
    who, cur = np.flatnonzero(lengths > 0), ends[lengths > 0]
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        steps.append((who, back[cur], cur))
        cur = back[cur]
        more = cur > starts[who]
        who, cur = who[more], cur[more]
    if not steps:
        return np.zeros(0, dtype=np.int32), np.zeros(len(units), dtype=np.int64)
    who, first, last = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(first, kind="stable")
    who, first, last = who[order], first[order], last[order]
    ids = by[last]
    spread = np.where(ids < 0, last - first, 1)
    out = np.repeat(ids, spread)
    unknown = np.repeat(ids < 0, spread)
    out[unknown] = v.byte_ids[text[flat(first[ids < 0], (last - first)[ids < 0])]]
    return out, np.bincount(who, weights=spread, minlength=len(units)).astype(np.int64)


def groups(units: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Consecutive units of about `most` bytes together (one at least)."""
    begin, held = 0, 0
    for i, u in enumerate(units):
        if i > begin and held + len(u) > most:
            yield units[begin:i]
            begin, held = i, 0
        held += len(u)
    if begin < len(units):
        yield units[begin:]


class Encoder:
    """Encodes texts; remembers the segmentations of up to CACHE distinct units."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unit = re.compile(vocabulary.unit)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after the other, and the number of ids of each."""
        if len(self.known) > CACHE:
            self.reset()
        known, before = self.known, len(self.known)
        used: list[int] = []
        per_text = []
        for t in texts:
            if t:
                units = self.unit.findall(MARKER + t.replace(" ", MARKER))
                used += [known.setdefault(u, len(known)) for u in units]
                per_text.append(len(units))
            else:
                per_text.append(0)
        new = [u.encode("utf-8", "surrogatepass") for u in list(known)[before:]] if len(known) > before else []
        for part in groups(new, TOGETHER):
            ids, lengths = viterbi(part, self.v)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        use = np.array(used, dtype=np.int64)
        n = self.lengths[use]
        total = np.concatenate([[0], np.cumsum(n)])
        edges = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        return self.ids[flat(self.starts[use], n)], np.diff(total[edges])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids: pieces joined, markers as spaces, the first one dropped."""
        sizes = (self.v.piece_starts[1:] - self.v.piece_starts[:-1])[ids]
        data = self.v.piece_bytes[flat(self.v.piece_starts[ids], sizes)].tobytes()
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def encode(docs: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row's whole text.

    Spaces become markers and one is put in front; pieces are chosen by the largest sum of scores; characters
    that no piece has are spelt in byte pieces. Since no piece goes on past a marker or a line end, units
    between these are segmented by themselves (if the vocabulary has such pieces, whole texts are). Null and
    empty texts have no ids. Rows are encoded one by one, so repeated rows and ids make no difference; an empty
    table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slices(batches, SLICE_BYTES):
            ids, n = encoder.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, text) of encoded rows. Null or empty ids give an empty text; ids in texts that held the marker
    itself come back as spaces, and bytes that are not UTF-8 as U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                ids = batch.column("ids")
                n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = encoder.decode(ids.flatten().to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array(texts)], ["id", "ids", "text"])

    out = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, ids array<int>, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row, decode the ids again and compare, in one pass over the rows; see encode and decode.

    Returns id, n_tokens, ids, text_sha256, decoded_sha256, lossless (only texts with the marker itself are not).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slices(batches, SLICE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, n = encoder.encode(texts)
            before, after = ([sha(t) for t in x] for x in (texts, encoder.decode(ids, n)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), lists, pa.array(before), pa.array(after)], ["id", "n_tokens", "ids", "text_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, text_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col).withColumn("lossless", F.col("text_sha256") == F.col("decoded_sha256"))
