"""Checks and forms of single texts, as column expressions without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_difference(a: Column, b: Column) -> Column:
    """(offset, line, column) where two texts first differ, in code points, offset from 0, line and column from 1; null for equal texts. Null counts as empty."""
    a, b = (F.coalesce(x, F.lit("")) for x in (a, b))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.when((a == "") | (b == ""), F.lit(0)).otherwise(F.array_position(same, F.lit(False)) - 1).cast("int")
    head = F.substring(a, F.lit(1), at)
    line, own = F.size(F.split(head, "\n", -1)), F.length(F.substring_index(head, "\n", -1))
    return F.when(a != b, F.struct(at.alias("offset"), line.alias("line"), (own + 1).alias("column")))


def spoken_words(text: Column) -> Column:
    """A text without white space and punctuation."""
    return F.regexp_replace(text, r"[\s\p{P}\p{Z}]", "")


def ssml_problem(text: Column, ssml: Column) -> Column:
    """Why marked-up speech is not the text with pauses alone: 'root', 'tags' or 'words'; null if it is. Null texts count as empty."""
    text, ssml = F.coalesce(text, F.lit("")), F.coalesce(ssml, F.lit(""))
    roots = F.regexp_count(ssml, F.lit(r"</?speak>"))
    inner = F.regexp_replace(ssml, r"^<speak>|</speak>$", "")
    spoken = F.regexp_replace(inner, r'<break time="[0-9]+(\.[0-9]+)?(ms|s)"\s*/>', "")
    rooted = ssml.startswith("<speak>") & ssml.endswith("</speak>") & (roots == 2)
    return F.when(~rooted, "root").when(spoken.rlike("[<>]"), "tags").when(spoken_words(spoken) != spoken_words(text), "words")


def plausible_seconds(text: Column) -> Column:
    """The longest that reading a text may take: 0.8 s a character and 3 s, at least 6 s, at most 120 s."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))
    return F.least(F.lit(120.0), F.greatest(F.lit(6.0), n * 0.8 + 3))


def format_issues(first: Column, second: Column, wanted: int, letter: str = r"\p{IsHan}") -> Column:
    """Of a pair of lines: 'length' unless both have `wanted` characters, 'unequal', 'characters' unless all are letters of the class."""
    first, second = (F.coalesce(x, F.lit("")) for x in (first, second))
    m, n = F.length(first), F.length(second)
    only = first.rlike(f"^{letter}+$") & second.rlike(f"^{letter}+$")
    found = F.array(F.when((m != wanted) | (n != wanted), F.lit("length")), F.when(m != n, F.lit("unequal")), F.when(~only, F.lit("characters")))
    return F.filter(found, lambda x: x.isNotNull())


def attributions(rows: DataFrame, key: str, text: str, mark: str = "——") -> DataFrame:
    """(key, ordinal, name): what follows each mark up to the end of its line, trimmed; empty ones are left out but keep their ordinal."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\Q{mark}\E[ \t]*([^\n]*)"), 1)
    rows = rows.select(key, F.posexplode(found).alias("ordinal", "name"))
    return rows.withColumn("name", F.regexp_replace("name", r"[ \t\r]+$", "")).filter("name <> ''")


def transcript_form(text: Column) -> Column:
    """Lower case without white space, punctuation and symbols, to compare transcripts."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{P}\p{S}\p{Z}]", ""))


def slug(name: Column, empty: str = "input") -> Column:
    """Letters, digits and hyphens; any other run is one hyphen, none at either end; `empty` if nothing is left."""
    kept = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^-|-$", ""), F.lit("")), F.lit(empty))


def alternating_quotes(text: Column, straight: str = '"', opening: str = "“", closing: str = "”") -> Column:
    """Straight quotes as opening and closing ones in turn; null stays null."""
    pieces = F.split(text, rf"\Q{straight}\E", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i % 2 == 1, opening).otherwise(closing), p))), "")


def orthography(text: Column, variants: dict[str, str]) -> tuple[Column, Column]:
    """Single characters by their variants, and how many changed; the table is a parameter. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    pairs = {k: v for k, v in variants.items() if k != v}
    if any(len(k) != 1 or len(v) != 1 for k, v in pairs.items()):
        raise ValueError("variants are of one character each")
    if not pairs:
        return text, F.lit(0)
    old, new = "".join(pairs), "".join(pairs.values())
    return F.translate(text, old, new), F.length(text) - F.length(F.translate(text, old, ""))


@F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("clean", "raw", "length")]))
def _placed(parts: pa.Array, gaps: pa.Array) -> pa.Array:
    """Running sums within rows, over flat arrays of a few rows at once; no number becomes a Python object."""
    found = []
    for at in range(0, max(1, len(parts)), 256):
        p, g = (x.slice(at, 256).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (parts, gaps))
        sizes = parts.slice(at, 256).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        clean, lost = np.cumsum(p) - p, np.cumsum(g) - g
        for x in (clean, lost):
            x -= np.append(x, 0)[first][row]
        kept = p > 0
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[kept], minlength=len(sizes)))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[kept].astype(np.int32))) for x in (clean, clean + lost, p)]
        found.append(pa.StructArray.from_arrays(lists, ["clean", "raw", "length"]))
    return pa.concat_arrays(found)


def kept_ranges(text: Column, dropped: str) -> Column:
    """Where the parts of a text lie that a pattern leaves: an array of (clean, raw, length), offsets in code points from 0.

    The map of cleaned to raw offsets holds one entry a part, not one a character; running sums of a row's lengths are taken in
    Arrow batches, as an array of growing length would cost the square of its parts. The pattern may not match nothing.
    Null counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    parts = F.transform(F.split(text, dropped, -1), F.length)
    gaps = F.concat(F.transform(F.regexp_extract_all(text, F.lit(dropped), 0), F.length), F.array(F.lit(0)))
    placed = _placed(parts, gaps)
    return F.arrays_zip(placed["clean"].alias("clean"), placed["raw"].alias("raw"), placed["length"].alias("length"))


def raw_offsets(rows: DataFrame, key: str, text: str, dropped: str, every: int) -> DataFrame:
    """(key, clean, raw): the raw offset of each `every`-th character that a pattern leaves; parts are looked up within the row."""
    part = rows.select(key, F.explode(kept_ranges(F.col(text), dropped)).alias("p")).select(key, "p.*")
    first = F.ceil(F.col("clean") / every).cast("int") * every
    hits = part.filter(first < F.col("clean") + F.col("length")).select(key, "clean", "raw", F.explode(F.sequence(first, F.col("clean") + F.col("length") - 1, F.lit(every))).alias("at"))
    return hits.select(key, F.col("at").alias("clean"), (F.col("raw") + F.col("at") - F.col("clean")).alias("raw"))


def safe_path(path: Column) -> Column:
    """Whether a path is relative, without drive, backslash, empty, '.' or '..' parts."""
    return F.coalesce(path.rlike(r"^[^/\\:\x00]+(/[^/\\:\x00]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)"), F.lit(False))


def iso_instant(text: Column) -> Column:
    """Whether a text is a UTC instant with milliseconds that exists, as 2024-02-29T10:00:00.000Z."""
    form = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    return F.coalesce(form & F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")).isNotNull(), F.lit(False))


def comment_parts(text: Column, colon: str = "：", most: int = 60) -> tuple[Column, Column]:
    """The source before the first colon of a comment, of up to `most` characters on one line, and what follows it, unwrapped."""
    flat = F.coalesce(text, F.lit(""))
    head = rf"^([^\Q{colon}\E\n]{{1,{most}}})\Q{colon}\E"
    core = F.regexp_replace(F.regexp_replace(flat, head, ""), r"^\s+|\s+$", "")
    return F.trim(F.regexp_extract(flat, head, 1)), unwrapped(core)


def unwrapped(text: Column) -> Column:
    """A text without the one pair of brackets that holds all of it."""
    inner = F.trim(F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))))
    wrapped = [text.startswith(a) & text.endswith(b) & (F.length(text) > 1) for a, b in ("【】", "（）", "[]")]
    return F.when(wrapped[0] | wrapped[1] | wrapped[2], inner).otherwise(text)


def suggestion(feature: Column, z: Column) -> Column:
    """What to look at for a feature that lies off its centre; the feature's group is the part before its first dot."""
    way, name = F.when(z > 0, "high").otherwise("low"), F.regexp_replace(feature, r"^[a-z]+\.([0-9]\.)?", "")

    def say(before: str, after: str) -> Column:
        return F.concat(F.lit(before), way, F.lit(after))

    return (
        F.when(feature.startswith("sentence.") | feature.startswith("clause."), say("sentence rhythm ", ": vary long and short sentences"))
        .when(feature.isin("structure.dialogue_ratio", "structure.dialogue_turns_per_1000"), say("dialogue ", ": weigh narration against speech"))
        .when(feature.startswith("lexical."), say("vocabulary ", ": look for repetition or strain"))
        .when(feature.startswith("punctuation.") | feature.startswith("formula.") | feature.startswith("function."), F.concat(name, F.lit(" "), say("", ": check how often it is used")))
        .otherwise(F.concat(F.lit("characters "), name, F.lit(" "), say("", ": check the wording")))
    )
