"""Stylometric features of whole texts: one pass over each row, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import array_mean, array_quantile, occurrences
from ..functions.charset import LETTERS, Charset, only_letters

WINDOW = 100


def character_profile(chars: str, window: int = WINDOW) -> tuple[float, float, float]:
    """Entropy in bits, share of distinct characters, and moving-average share of distinct ones.

    The moving average has a closed form: a place adds to each window that holds it and no earlier place of the
    same character. Up to `window` characters it is the plain share; an empty text has 0 throughout.
    """
    return code_profile(np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), window)


def code_profile(code: np.ndarray, window: int = WINDOW) -> tuple[float, float, float]:
    """character_profile of code points."""
    n = len(code)
    if not n:
        return 0.0, 0.0, 0.0
    code = code.astype(np.uint16) if code.max() < 1 << 16 else code  # 16 bits are sorted by counting
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:][same]] = order[:-1][same]
    counts = np.diff(np.append(np.flatnonzero(np.append(True, ~same)), n))
    share = counts / n
    entropy, ratio = float(-(share * np.log2(share)).sum()), len(counts) / n
    if n <= window:
        return entropy, ratio, ratio
    i = np.arange(n)
    held = np.minimum(i, n - window) - np.maximum(np.maximum(0, i - window + 1), before + 1) + 1
    return entropy, ratio, float(np.maximum(0, held).sum() / (window * (n - window + 1)))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("entropy", "unique_ratio", "mattr")]))
def _profiles(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([character_profile(t or "") for t in texts], columns=["entropy", "unique_ratio", "mattr"])


def letter_stats(docs: DataFrame, key: str = "doc_id", charset: Charset = LETTERS) -> DataFrame:
    """Characters, letters and the share of distinct letters of each text."""
    letters = only_letters("text", charset)
    chars = F.split(letters, "")
    ratio = F.when(F.length(letters) > 0, F.size(F.array_distinct(chars)) / F.length(letters)).otherwise(0.0)
    return docs.select(key, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("characters"), F.length(letters).cast("long").alias("letters"), F.round(ratio, 6).alias("unique_ratio"))


def character_features(docs: DataFrame, key: str = "doc_id", charset: Charset = LETTERS) -> DataFrame:
    """entropy, unique_ratio and mattr of each text's letters."""
    return docs.select(key, _profiles(only_letters("text", charset)).alias("p")).select(key, "p.*")


def whole_profile(docs: DataFrame, keep: list[str], charset: Charset = LETTERS) -> DataFrame:
    """keep, characters, letters, entropy, unique_ratio and mattr of each text, in one pass over it."""
    letters = only_letters("text", charset)
    rows = docs.select(*keep, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("characters"), letters.alias("l"))
    return rows.select(*keep, "characters", F.length("l").cast("long").alias("letters"), _profiles("l").alias("p")).select(*keep, "characters", "letters", "p.*")


def segment_lengths(text: Column, charset: Charset, ends: str) -> Column:
    """Sorted letter counts of a text's segments; segments without letters are dropped."""
    lengths = F.transform(F.split(F.coalesce(text, F.lit("")), ends), lambda s: F.length(only_letters(s, charset)).cast("double"))
    return F.array_sort(F.filter(lengths, lambda n: n > 0))


def sentence_stats(docs: DataFrame, key: str = "doc_id", charset: Charset = LETTERS) -> DataFrame:
    """Number, mean and quartiles of sentence lengths, and the mean clause length."""
    rows = docs.select(key, segment_lengths(F.col("text"), charset, charset.ends).alias("s"), segment_lengths(F.col("text"), charset, charset.clauses).alias("c"))
    quantiles = [F.round(array_quantile(F.col("s"), p), 6).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75, 0.9)]
    return rows.select(key, F.size("s").cast("long").alias("sentences"), F.round(array_mean(F.col("s")), 6).alias("mean"), *quantiles, F.round(array_mean(F.col("c")), 6).alias("clause_mean"))


def token_rates(docs: DataFrame, key: str = "doc_id", charset: Charset = LETTERS) -> DataFrame:
    """Occurrences of each of the profile's tokens for 1,000 characters; 0 for empty texts."""
    text = F.coalesce("text", F.lit(""))
    rates = [F.round(F.when(F.length(text) > 0, 1000 * occurrences(text, t) / F.length(text)).otherwise(0.0), 6).alias(f"rate_{t}") for t in charset.tokens]
    return docs.select(key, *rates)


def quote_stats(docs: DataFrame, key: str = "doc_id", charset: Charset = LETTERS) -> DataFrame:
    """Turns, characters inside quotes, their share and what is left open, by a fold over the characters.

    A closing mark without an open one is ignored (the depth never falls below 0).
    """
    opening, closing = charset.quotes

    def step(a: Column, c: Column) -> Column:
        opens, closes = c == opening, (c == closing) & (a["depth"] > 0)
        return F.struct(
            F.when(opens, a["depth"] + 1).when(closes, a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
            (a["turns"] + opens.cast("int")).alias("turns"),
            (a["inside"] + ((a["depth"] > 0) & ~opens & ~closes).cast("int")).alias("inside"),
        )

    marked = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s)[\\{opening}\\{closing}]|[^\\{opening}\\{closing}]"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("turns"), F.lit(0).alias("inside"))
    rows = docs.select(key, F.length(F.coalesce("text", F.lit(""))).alias("n"), F.aggregate(marked, start, step).alias("f"))
    share = F.when(F.col("n") > 0, F.col("f.inside") / F.col("n")).otherwise(0.0)
    return rows.select(key, F.col("f.turns").cast("long").alias("turns"), F.col("f.inside").cast("long").alias("quoted"), F.round(share, 6).alias("ratio"), F.col("f.depth").cast("long").alias("unclosed"))


def normalize_text(text: Column | str) -> Column:
    """White space collapsed and trimmed, ASCII punctuation as full-width marks, straight quotes kept."""
    column = F.col(text) if isinstance(text, str) else text
    spaced = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    # ASCII marks and the CJK marks that stand for them.
    return F.translate(spaced, ",.;:!?()", "，。；：！？（）")


def mask_entities(text: Column | str, lexicon: list[str], mark: str = "○") -> Column:
    """Each name of the lexicon, longest first, as a run of marks of the same length."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for name in sorted(set(lexicon), key=lambda x: (-len(x), x)):
        column = F.replace(column, F.lit(name), F.lit(mark * len(name)))
    return column


@F.pandas_udf(T.StringType())
def compatibility_form(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def greedy_chunks(docs: DataFrame, key: str = "doc_id", least: int = 900, target: int = 1200, most: int = 1500, rest: int = 600, charset: Charset = LETTERS) -> DataFrame:
    """Sentences packed in order into chunks: a chunk closes at `target` characters, or earlier (from `least` on) if
    the next sentence would take it past `most`; a remainder under `rest` joins the chunk before. One row a chunk."""
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).+?(?:{charset.ends}|$)"), 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, s: Column) -> Column:
        n, m = F.length(a["open"]), F.length(s)
        close_first = (n >= least) & (n + m > most)
        joined = F.when(close_first, s).otherwise(F.concat(a["open"], s))
        done = F.when(close_first, F.array_append(a["done"], a["open"])).otherwise(a["done"])
        full = F.length(joined) >= target
        return F.struct(F.when(full, F.array_append(done, joined)).otherwise(done).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    def finish(a: Column) -> Column:
        short = (F.length(a["open"]) < rest) & (F.size(a["done"]) > 0)
        last = F.concat(F.element_at(a["done"], -1), a["open"])
        merged = F.array_append(F.slice(a["done"], 1, F.greatest(F.size(a["done"]) - 1, F.lit(0))), last)
        return F.when(F.length(a["open"]) == 0, a["done"]).when(short, merged).otherwise(F.array_append(a["done"], a["open"]))

    rows = docs.select(key, F.posexplode(F.aggregate(pieces, start, step, finish)).alias("chunk", "chunk_text"))
    return rows.select(key, "chunk", F.length("chunk_text").alias("characters"), F.sha2("chunk_text", 256).alias("text_hash"))
