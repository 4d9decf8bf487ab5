"""One form of a text for comparison, with a map back to the source: stages that drop or change characters, composed.

A map is a list of runs (clean, raw, length): the characters clean, clean + 1, ... of the result come from raw, raw + 1, ... of
the source. All offsets are in code points from 0. Maps of stages compose run by run, never character by character.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import batches_of, code_points

RUNS = "array<struct<clean:int,raw:int,length:int>>"
SPACE = re.compile(r"[\s﻿]")


@dataclass(frozen=True)
class Rules:
    """comments and heading are patterns (empty: none) of what is dropped; marks maps single ASCII marks; kept characters have no
    compatibility form taken; variants maps single characters after that; no space is put before `opening` or after `closing` marks."""

    comments: str = ""
    heading: str = ""
    marks: dict[str, str] = field(default_factory=dict)
    kept: str = ""
    variants: dict[str, str] = field(default_factory=dict)
    opening: str = ""
    closing: str = ""
    double: tuple[str, str] = ("“", "”")
    single: tuple[str, str] = ("‘", "’")


#: Bracketed comments, chapter headings and marks of Chinese texts. The table of variant characters is a parameter.
HAN = Rules(
    comments=r"【[^】]*】",
    heading=r"^\s*第[〇零一二两三四五六七八九十百0-9]+回[^\n]*(?:\n|$)",
    marks={",": "，", ":": "：", ";": "；", "!": "！", "?": "？"},
    kept="，。；：！？、“”‘’「」『』（）《》〈〉【】…",
    opening="“‘「『（《",
    closing="，。；：！？、”’」』）》",
)

Runs = np.ndarray  # rows of clean, raw, length


def runs_of(raw: np.ndarray) -> Runs:
    """The map in which character i comes from raw[i]."""
    if not len(raw):
        return np.zeros((0, 3), dtype=np.int64)
    begin = np.flatnonzero(np.append(True, np.diff(raw) != 1))
    return np.stack([begin, raw[begin], np.diff(np.append(begin, len(raw)))], axis=1)


def after(outer: Runs, inner: Runs) -> Runs:
    """The map of the stage `outer` applied to the result of the stage `inner`: each run is cut where it crosses runs of the other."""
    if not len(outer) or not len(inner):
        return np.zeros((0, 3), dtype=np.int64)
    first = np.searchsorted(inner[:, 0], outer[:, 1], side="right") - 1
    last = np.searchsorted(inner[:, 0], outer[:, 1] + outer[:, 2] - 1, side="right") - 1
    n = last - first + 1
    own = np.repeat(np.arange(len(outer)), n)
    other = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    begin = np.maximum(outer[own, 1], inner[other, 0])
    end = np.minimum(outer[own, 1] + outer[own, 2], inner[other, 0] + inner[other, 2])
    found = np.stack([outer[own, 0] + begin - outer[own, 1], inner[other, 1] + begin - inner[other, 0], end - begin], axis=1)
    joins = np.append(False, (found[1:, 0] == found[:-1, 0] + found[:-1, 2]) & (found[1:, 1] == found[:-1, 1] + found[:-1, 2]))
    starts = np.flatnonzero(~joins)
    return np.stack([found[starts, 0], found[starts, 1], np.add.reduceat(found[:, 2], starts)], axis=1)


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[str, Runs]:
    """The text without these ranges, which are in order."""
    edges = [0, *(x for r in ranges for x in r), len(text)]
    kept = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]
    lengths = np.array([b - a for a, b in kept], dtype=np.int64)
    return "".join(text[a:b] for a, b in kept), np.stack([np.cumsum(lengths) - lengths, np.array([a for a, _ in kept], dtype=np.int64), lengths], axis=1)


def one_line_end(text: str) -> tuple[str, Runs]:
    """Without a byte order mark at the beginning; CR and CR LF as LF."""
    begin = 1 if text.startswith("﻿") else 0
    bare, runs = without(text, [(0, 1)] * begin + [(m.start(), m.start() + 1) for m in re.finditer(r"\r(?=\n)", text)])
    return bare.replace("\r", "\n"), runs


class Form:
    """The character stage: spaces, quotes, marks, compatibility forms and variants."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.known: dict[int, str] = {}

    def of(self, code: int) -> str:
        if code not in self.known:
            c, r = chr(code), self.rules
            plain = r.marks.get(c) or (c if c in r.kept else unicodedata.normalize("NFKC", c))
            self.known[code] = "".join(r.variants.get(x, x) for x in plain)
        return self.known[code]

    def __call__(self, text: str) -> tuple[str, Runs, int]:
        """(result, map, characters that changed).

        Straight quotes open and close in turn, double and single ones apart, whatever lies between. A run of white space is one
        space, from its last character, unless it ends the text, begins it, or touches a mark on its inner side.
        """
        code, _ = code_points([text])
        kinds, which = np.unique(code, return_inverse=True)
        white = np.array([SPACE.match(chr(c)) is not None for c in kinds], dtype=bool)[which]
        at = np.flatnonzero(~white)
        if not len(at):
            return "", runs_of(at), 0
        forms, plain = [self.of(c) for c in kinds.tolist()], [chr(c) for c in kinds.tolist()]
        form = which[at]  # the number of each character's form
        for mark, pair in (('"', self.rules.double), ("'", self.rules.single)):
            place = np.flatnonzero(code[at] == ord(mark))
            form[place[::2]], form[place[1::2]] = len(forms), len(forms) + 1
            forms += pair
            plain += [mark, mark]
        changed = int(np.array([f != c for f, c in zip(forms, plain)])[form].sum())
        opens = np.array([any(c in self.rules.opening for c in f) for f in forms])[form]
        closes = np.array([f[-1:] in self.rules.closing if f else False for f in forms])[form]
        space = np.append(False, (np.diff(at) > 1) & ~opens[1:] & ~closes[:-1])
        sizes = np.array([len(f) for f in forms])[form]
        written = [*forms, *(" " + f for f in forms)]
        out = "".join(map(written.__getitem__, (form + space * len(forms)).tolist()))
        raw = np.repeat(at, sizes + space)
        raw[(np.cumsum(sizes + space) - sizes - space)[space]] = at[space] - 1
        kept = out.strip()
        begin = len(out) - len(out.lstrip())
        return kept, runs_of(raw[begin : begin + len(kept)]), changed


def normalise(text: str, form: Form) -> tuple[str, Runs, int]:
    """(result, map to the text, characters changed): line ends, comments, a leading heading, then characters."""
    out, runs = one_line_end(text)
    if form.rules.comments:
        out, stage = without(out, [m.span() for m in re.finditer(form.rules.comments, out)])
        runs = after(stage, runs)
    if form.rules.heading and (m := re.match(form.rules.heading, out)):
        out, stage = without(out, [m.span()])
        runs = after(stage, runs)
    out, stage, changed = form(out)
    return out, after(stage, runs), changed


def normalised(rows: DataFrame, keep: list[str], text: str, rules: Rules) -> DataFrame:
    """(keep, normal, changes, runs) of each row's text: its normal form, how many characters changed, and the map to the text.

    Null counts as empty. One pass, no shuffle; a long text is one row of a task, and its map has a run for each stretch that is
    copied, not one for each character.
    """
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Form(rules)
        for batch in batches_of(batches, "normal_text"):
            found = [normalise(t or "", form) for t in batch.column("normal_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64()), listed([f[1] for f in found])], [*keep, "normal", "changes", "runs"])

    return rows.select(*keep, F.col(text).alias("normal_text")).mapInArrow(run, f"{kinds}normal string, changes long, runs {RUNS}")


def listed(maps: list[Runs]) -> pa.Array:
    """Maps as an array of lists of runs."""
    flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *maps]).astype(np.int32)
    offsets = np.append(0, np.cumsum([len(m) for m in maps])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["clean", "raw", "length"]))


def composed(rows: DataFrame, outer: str, inner: str, name: str) -> DataFrame:
    """rows with `name`: the map of column `outer` after that of column `inner`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in (outer, inner):
                column = batch.column(side)
                flat, ends = column.flatten(), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                grid = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("clean", "raw", "length")], axis=1).astype(np.int64)
                sides.append([grid[a:b] for a, b in zip(ends, ends[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, listed([after(a, b) for a, b in zip(*sides)])], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, {name} {RUNS}")


def source_of(runs: Column, at: Column) -> Column:
    """Where the character `at` of a result comes from; null beyond its end."""
    run = F.element_at(F.filter(runs, lambda r: r["clean"] <= at), -1)
    return F.when(at < run["clean"] + run["length"], run["raw"] + at - run["clean"])


def source_range(runs: Column, begin: Column, end: Column) -> Column:
    """(begin, end) in the source of a stretch [begin, end) of the result that isn't empty."""
    return F.struct(source_of(runs, begin).alias("begin"), (source_of(runs, end - 1) + 1).alias("end"))
