"""Texts cut for synthesis: at natural boundaries within a limit, and around units that a director has set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import code_points, in_slices
from .speech import ENDS, SOFT, units_of

#: Where long narration may be cut, first choice and second; the longest chunk, and the share of it that a natural cut must fill.
STRONG, WEAK = "\n。！？!?；;", "，,、：:"
MOST, NATURAL = 1600, 0.4


def bounded_cuts(text: str, most: int = MOST, strong: str = STRONG, weak: str = WEAK, natural: float = NATURAL) -> list[tuple[int, int]]:
    """(begin, end) of chunks of at most `most` characters, without white space at their ends; only that is lost.

    A chunk ends at the last strong mark that fits, else at the last weak one, if that fills `natural` of the limit, else at the limit. Tables
    of the last mark before each place and of the next place that isn't blank make every cut a lookup: the work is one pass and a step a chunk.
    """
    if most < 20:
        raise ValueError("chunks have 20 characters or more")
    code, _ = code_points([text])
    n = len(code)
    kinds, which = np.unique(code, return_inverse=True)
    solid = ~np.array([chr(c).isspace() or c == 0xFEFF for c in kinds], dtype=bool)[which]
    place = np.arange(n)
    if not solid.any():
        return []
    last = [np.append(0, np.maximum.accumulate(np.where(np.isin(code, list(map(ord, marks))), place + 1, 0))) for marks in (strong, weak)]
    next_solid = np.append(np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1], n)
    after_solid = np.append(0, np.maximum.accumulate(np.where(solid, place + 1, 0)))  # by end: where the last solid character before it ends
    least, end, at, out = int(most * natural), int(after_solid[n]), int(next_solid[0]), []
    while end - at > most:
        cut = next((int(t[at + most]) for t in last if t[at + most] - at >= least), at + most)
        if after_solid[cut] > at:
            out.append((at, int(after_solid[cut])))
        at = int(next_solid[cut])
    return [*out, (at, end)] if end > at else out


def speech_cuts(rows: DataFrame, key: str, text: str, most: int = MOST, strong: str = STRONG, weak: str = WEAK) -> DataFrame:
    """(key, chunk, begin, end, text) of every text, see bounded_cuts; offsets in code points. Null and blank texts have no chunks."""

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"begin": a, "end": b} for a, b in bounded_cuts(t or "", most, strong, weak)])

    found = rows.select(key, F.col(text).alias("_text"), F.posexplode(cut(text)).alias("chunk", "at"))
    return found.select(key, "chunk", "at.begin", "at.end", F.substring("_text", F.col("at.begin") + 1, F.col("at.end") - F.col("at.begin")).alias("text"))


def directed_units(text: str, forced: list[str], most: int, ends: str = ENDS, soft: str = SOFT) -> tuple[list[tuple[str, int]], int | None]:
    """((unit, number of the forced unit or -1) ..., number of the first forced unit that is not there).

    Forced units are excerpts in order; what lies between them is cut as usual, so the units are the text, and a unit that can't be placed is
    reported rather than passed over.
    """
    out, at = [], 0
    for number, unit in enumerate(forced):
        found = text.find(unit, at) if unit else -1
        if found < 0:
            return [], number
        out += [(u, -1) for u in units_of(text[at:found], most, ends, soft)] + [(unit, number)]
        at = found + len(unit)
    return [*out, *((u, -1) for u in units_of(text[at:], most, ends, soft))], None


def forced_units(rows: DataFrame, key: str, text: str, forced: str, most: int = 30, ends: str = ENDS, soft: str = SOFT) -> tuple[DataFrame, DataFrame]:
    """((key, unit_index, unit, forced), (key, missing)): units of each text around those of the array column `forced`, and texts of which
    a forced unit is not there or not in order, with its number. Null texts count as empty, a null array as none."""

    def cut(texts: list[str | None], wanted: list[list[str] | None]) -> list[dict]:
        found = (directed_units(t or "", w or [], most, ends, soft) for t, w in zip(texts, wanted))
        return [{"units": [{"unit": u, "forced": k} for u, k in units], "missing": m} for units, m in found]

    judged = in_slices(rows, [key], [F.col(text), F.col(forced)], cut, "cut", "struct<units:array<struct<unit:string,forced:int>>,missing:int>")
    units = judged.select(key, F.posexplode("cut.units").alias("unit_index", "u")).select(key, "unit_index", "u.unit", F.nullif(F.col("u.forced"), F.lit(-1)).alias("forced"))
    return units, judged.filter("cut.missing IS NOT NULL").select(key, F.col("cut.missing").alias("missing"))
