"""Matching the blocks of two versions of a document, and building only what changed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Change ratio above which texts are not the same block; room that the best match must have over the next.
FUZZY, MARGIN = 0.65, 0.08


def context_hashes(rows: DataFrame, by: list[str], order: list[str], kind: str, text: str) -> DataFrame:
    """rows with text_hash, and context_hash of the (kind, hash) before and after in the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    own = F.concat_ws(":", kind, F.col("text_hash"))
    near = F.concat_ws("|", F.coalesce(F.lag(own).over(w), F.lit("^")), F.coalesce(F.lead(own).over(w), F.lit("$")))
    return rows.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256)).withColumn("context_hash", F.sha2(near, 256))


def neighbours(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `previous` and `following` values in the group; null at its ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))


def pauses(rows: DataFrame, by: list[str], order: list[str], kind: str, same: int, change: int, end: int) -> DataFrame:
    """rows with `pause`: `end` after the last of a group, else `same` or `change` by the next one's kind."""
    after = F.lead(kind).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("pause", F.when(after.isNull(), end).when(after == F.col(kind), same).otherwise(change))


def change_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((longest == 0) | (a == b), 0.0).otherwise(F.levenshtein(a, b) / longest)


def fuzzy_pairs(rows: DataFrame, previous: DataFrame, kind: str, key: str, text: str, most: float = FUZZY) -> DataFrame:
    """Pairs of same-kind texts with a change ratio of `most` or less; (key, old_key, ratio).

    A length difference alone gives a lower bound of the ratio, so lengths are cut into bands of the log scale and
    only bands within reach are joined; edit distances are computed inside those.
    """
    import math

    step = math.log(1 / (1 - most)) if most < 1 else 1.0
    of = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / F.lit(step)).cast("int")
    a = rows.filter(F.col(text).isNotNull()).select(F.col(kind).alias("kind"), key, F.col(text).alias("a"), F.explode(F.array(of(text) - 1, of(text), of(text) + 1)).alias("reach"))
    b = previous.filter(F.col(text).isNotNull()).select(F.col(kind).alias("kind"), F.col(key).alias("old_key"), F.col(text).alias("b"), of(text).alias("reach"))
    near = F.abs(F.length("a") - F.length("b")) <= most * F.greatest(F.length("a"), F.length("b"))
    return a.join(b, ["kind", "reach"]).filter(near).select(key, "old_key", change_ratio(F.col("a"), F.col("b")).alias("ratio")).filter(F.col("ratio") <= most)


def best_matches(pairs: DataFrame, key: str, margin: float = MARGIN) -> DataFrame:
    """(key, old_key, ratio, gap) of each key's best match if no other comes within `margin` of it."""
    w = Window.partitionBy(key).orderBy("ratio", "old_key")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.lead("ratio").over(w) - F.col("ratio"))
    return ranked.filter((F.col("rank") == 1) & (F.coalesce("gap", F.lit(1.0)) >= margin)).select(key, "old_key", F.round("ratio", 6).alias("ratio"), F.round("gap", 6).alias("gap"))


def unique_matches(rows: DataFrame, previous: DataFrame, on: list[str], key: str) -> DataFrame:
    """(key, old_key) of rows that match on all columns, where both sides are unique."""
    a = rows.withColumn("n", F.count("*").over(Window.partitionBy(*on))).filter("n = 1").select(*on, key)
    b = previous.withColumn("n", F.count("*").over(Window.partitionBy(*on))).filter("n = 1").select(*on, F.col(key).alias("old_key"))
    return a.join(b, on).select(key, "old_key")


def align(rows: DataFrame, previous: DataFrame, by: str, key: str) -> DataFrame:
    """(key, old_key, how, ratio) of rows (by, key, kind, text, text_hash, context_hash) against the last version of their document `by`.

    'exact' where kind, text and context are unique on both sides, then 'moved' where kind and text are, then 'changed' by
    the best close text of the same kind, if no other comes near and no other row wants it; the rest is 'paused' for a person.
    Each step sees only what the steps before left, and edit distances are of the changed blocks of one document alone.
    """
    place = F.to_json(F.struct(by, "kind")).alias("kind")
    found = []
    left, free = (d.select(key, place, "text", "text_hash", "context_hash") for d in (rows, previous))
    for how, on in (("exact", ["kind", "text_hash", "context_hash"]), ("moved", ["kind", "text_hash"])):
        met = unique_matches(left, free, on, key).select(key, "old_key", F.lit(how).alias("how"), F.lit(0.0).alias("ratio"))
        found.append(met)
        left = left.join(met.select(key), key, "left_anti")
        free = free.join(met.select(F.col("old_key").alias(key)), key, "left_anti")
    close = best_matches(fuzzy_pairs(left, free, "kind", key, "text"), key)
    alone = close.withColumn("wanted", F.count("*").over(Window.partitionBy("old_key"))).filter("wanted = 1")
    found.append(alone.select(key, "old_key", F.lit("changed").alias("how"), "ratio"))
    met = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.select(key).join(met, key, "left").select(key, "old_key", F.coalesce("how", F.lit("paused")).alias("how"), "ratio")


def longest_common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    import numpy as np

    best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def match_status(kind: Column, ratio: Column, same_context: Column) -> Column:
    """What to do with a matched block: exact ones are kept; narration under 30 and dialogue under 10 percent changed
    is reused if its context is the same; poetry and all else needs review."""
    light = ((kind == "narration") & (ratio < 0.3)) | ((kind == "dialogue") & (ratio < 0.1))
    return F.when(ratio.isNull(), "new").when(ratio == 0, "exact").when(light & same_context, "auto-reused").otherwise("needs-review")


def reconcile(blocks: DataFrame, previous: DataFrame) -> DataFrame:
    """Match the blocks (chapter, order, kind, text) of each chapter with the last version's, which have block_id too.

    In order: a longest common subsequence of equal (kind, text); what is left over and equal, if a single candidate remains; then, greedily by
    closeness and order, changed texts of the same kind. New blocks get the next free ids. Chapters are bounded documents,
    so each is one group. Returns chapter, order, kind, text, block_id, old_id, ratio, match_status.
    """

    def match(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new, old = new.sort_values("order").reset_index(drop=True), old.sort_values("order").reset_index(drop=True)
        a, b = list(zip(new["kind"], new["text"])), list(zip(old["kind"], old["text"]))
        pair: dict[int, tuple[int, float]] = {i: (j, 0.0) for i, j in longest_common(a, b)}
        for i, x in enumerate(a):
            left = [j for j, y in enumerate(b) if y == x and j not in {k for k, _ in pair.values()}]
            if i not in pair and len(left) == 1:
                pair[i] = (left[0], 0.0)
        used = {j for j, _ in pair.values()}
        scored = []
        for i, (kind, text) in enumerate(a):
            for j, (other, was) in enumerate(b):
                if i not in pair and j not in used and kind == other:
                    ratio = edit_ratio(text, was)
                    if ratio <= FUZZY:
                        far = abs(i / max(1, len(a) - 1) - j / max(1, len(b) - 1))
                        scored.append((-(1 - ratio - 0.15 * far), i, j, ratio))
        for _, i, j, ratio in sorted(scored):
            if i not in pair and j not in used:
                pair[i] = (j, ratio)
                used.add(j)
        free = max([0, *old["block_id"]]) + 1
        rows = []
        for i, r in new.iterrows():
            j, ratio = pair.get(i, (None, None))
            block, free = (int(old["block_id"][j]), free) if j is not None else (free, free + 1)
            near = lambda s, k, n: (s[k - 1] if k else None, s[k + 1] if k + 1 < n else None)
            same = j is not None and near(a, i, len(a)) == near(b, j, len(b))
            light = (r["kind"] == "narration" and (ratio or 0) < 0.3) or (r["kind"] == "dialogue" and (ratio or 0) < 0.1)
            status = "new" if j is None else "exact" if not ratio else "auto-reused" if light and same else "needs-review"
            rows.append((r["chapter"], r["order"], r["kind"], r["text"], block, None if j is None else block, ratio, status))
        return pd.DataFrame(rows, columns=["chapter", "order", "kind", "text", "block_id", "old_id", "ratio", "match_status"]).astype({"old_id": "Int64", "ratio": "Float64"})

    schema = "chapter long, order int, kind string, text string, block_id long, old_id long, ratio double, match_status string"
    return blocks.groupBy("chapter").cogroup(previous.groupBy("chapter")).applyInPandas(match, schema)


def edit_ratio(a: str, b: str) -> float:
    """Edit distance over the longer length of two short texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] / max(1, len(a), len(b))


def cache_split(wanted: DataFrame, cache: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash is in the cache, and distinct rows that are still to be made."""
    return wanted.join(cache.select(on).distinct(), on, "left_semi"), wanted.join(cache.select(on), on, "left_anti").dropDuplicates([on])


def islands(rows: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """(by, island, first order, n) of maximal runs of flagged rows: places less their number among the flagged."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    flagged = rows.withColumn("place", place).filter(flag)
    return flagged.withColumn("island", F.col("place") - F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def similar_opcodes(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with `ratio` and `changes` (operation, range in a, range in b) of a sequence matcher, for short texts."""
    import difflib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ratio, changes = [], []
            for x, y in zip(f[a], f[b]):
                m = difflib.SequenceMatcher(None, x or "", y or "", autojunk=False)
                ratio.append(round(m.ratio(), 6))
                changes.append([f"{t}:{i}-{j}:{k}-{n}" for t, i, j, k, n in m.get_opcodes() if t != "equal"])
            yield f.assign(ratio=ratio, changes=changes)

    from pyspark.sql import types as T

    return pairs.mapInPandas(run, T.StructType([*pairs.schema, T.StructField("ratio", T.DoubleType()), T.StructField("changes", T.ArrayType(T.StringType()))]))


#: The longest span that is looked for, and the longest one that must follow itself at once.
LONGEST_SPAN, SHORT_SPAN = 20, 3


def returning_spans(text: str, longest: int = LONGEST_SPAN) -> Iterator[tuple[str, list[int]]]:
    """Spans of two to `longest` characters that come back after their own end, each with the places from which they do.

    The beginnings of all suffixes are sorted once; suffixes that share a beginning of a given length are neighbours then.
    """
    order = sorted(range(len(text)), key=lambda i: text[i : i + longest])
    shared = [len(commonprefix([text[i : i + longest], text[j : j + longest]])) for i, j in zip(order, order[1:])]
    for size in range(2, longest + 1):
        for together, run in groupby(range(len(shared)), key=lambda k: shared[k] >= size):
            if together:
                run = list(run)
                places = sorted(order[run[0] : run[-1] + 2])
                ends = set(places) if size <= SHORT_SPAN else None
                again = [p for p in places if (p + size in ends if ends is not None else p + size <= places[-1])]
                if again:
                    yield text[places[0] : places[0] + size], again


def repeated_span(expected: str, heard: str, longest: int = LONGEST_SPAN) -> str | None:
    """The longest, then first, span that was said twice although its text does not repeat it.

    A span counts if it is heard more often than it is written, unless what is written at its place is twice the same as well. Spans of
    up to SHORT_SPAN characters must follow themselves; longer ones may come back anywhere later.
    """

    def written_twice(place: int, size: int) -> bool:
        first, second = expected[place : place + size], expected[place + size : place + 2 * size]
        return first == second and len(second) == size

    found = [
        (-len(span), place, span)
        for span, places in returning_spans(heard, longest)
        if heard.count(span) > expected.count(span)
        for place in places
        if not written_twice(place, len(span))
    ]
    return min(found)[2] if found else None


def repeated_spans(pairs: DataFrame, key: str, expected: str, heard: str) -> DataFrame:
    """(key, span) of transcripts that say something twice; null texts count as empty."""

    @F.pandas_udf("string")
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([repeated_span(x or "", y or "") for x, y in zip(a, b)], dtype=object)

    return pairs.select(key, find(expected, heard).alias("span"))
