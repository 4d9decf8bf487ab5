"""Personal data: base patterns, then bootstrapped contextual extraction over a pattern-instance graph."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

KINDS = ("email", "ip", "card", "phone")
#: A kind without a base pattern: passwords, keys and tokens. Its seed entities are words of SECRET_FORM (as long as
#: common digests and keys), which are only PRIOR likely to be secrets until their contexts confirm them.
SECRET, SECRET_FORM, PRIOR = "secret", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$", 0.8
#: Rounds of scoring; seeds that a pattern must have met; what a pattern and an instance need to be trusted.
ROUNDS, SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 3, 0.6, 0.9
#: Weight of doubt in a pattern's score: it counts as so many fillers that are not of the kind.
DOUBT = 0.5
#: A longer part of a pattern is told by its digest, so that patterns stay short and equal parts stay equal.
LONG_PART = 64

#: The base patterns, in forms that read a text once: the domain is matched where a run of local characters
#: meets its @, and digit runs are not entered in the middle.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
#: Candidates lie between white space, quotes, brackets and marks that join a label and its value.
CANDIDATE = re.compile(r"""[^\s"'`<>(){}\[\],;:=|#*&$%!?]+""")
AFTER = re.compile(r"(\W*)(\w*)")
TRIM = ".-/\\~"

FOUND = "id {kind}, base array<struct<start:int,end:int,kind:string>>, seen array<struct<start:int,end:int,kind:string,filler:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Base spans (start, end, kind) in code points, by start and then kind as listed."""
    if not text or not MARKED.search(text):
        return []
    out = [(a, b, 0) for a, b in emails(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def part(text: str) -> str:
    return text if len(text) <= LONG_PART else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def word_before(text: str, end: int) -> tuple[str, int]:
    """The last word that ends at `end` or before it, lower-cased, with the marks up to `end`; and where it starts."""
    b = end
    while b and not (text[b - 1].isalnum() or text[b - 1] == "_"):
        b -= 1
    a = b
    while a and (text[a - 1].isalnum() or text[a - 1] == "_"):
        a -= 1
    return part(text[a:b].lower() or "^") + part("".join(text[b:end].split())), a


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, two words before, and the words on both sides, each with the marks between."""
    one, at = word_before(text, start)
    two, _ = word_before(text, at)
    m = AFTER.match(text, end)
    after = part("".join(m[1].split())) + part(m[2].lower() or "$")
    return [f"{one} _", f"{two} {one} _", f"{one} _ {after}"]


def found(text: str | None) -> tuple[list[dict], list[dict]]:
    """Base spans, and all fillers: base spans and identifier-like words beside them, with their patterns."""
    spans = base_spans(text)
    seen = [{"start": a, "end": b, "kind": k, "filler": text[a:b].lower(), "patterns": contexts(text, a, b)} for a, b, k in spans]
    if text and MARKED.search(text):
        at = 0
        for m in CANDIDATE.finditer(text):
            if not MARKED.search(m[0]):
                continue
            word = m[0].strip(TRIM)
            a = m.start() + len(m[0]) - len(m[0].lstrip(TRIM))
            b = a + len(word)
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            if word and not any(s < b and a < e for s, e, _ in spans[max(0, at - 4) : at + 4]):
                seen.append({"start": a, "end": b, "kind": None, "filler": word.lower(), "patterns": contexts(text, a, b)})
    return [{"start": a, "end": b, "kind": k} for a, b, k in spans], seen


def bootstrap(seen: DataFrame) -> DataFrame:
    """(filler, kind, score) of fillers that trusted patterns point to and no base pattern knows.

    Seeds are the base spans' texts (score 1) and words of SECRET_FORM (score PRIOR). In each round a pattern's trust
    for a kind is the summed score of its fillers over their number plus DOUBT, and counts once SUPPORT distinct
    scored fillers of that kind have met it and it reaches PATTERN_SCORE. A filler's score is then the chance that its
    prior or one of its patterns is right (noisy or), for fillers whose form a seed of the kind has; from
    INSTANCE_SCORE on, a filler counts in the next round's patterns, as the seeds do in any case. Edges are summed by
    (pattern, filler) before anything is joined; each round is two aggregates and two joins.
    """
    # the tables here hold identifiers and their contexts, not texts
    secret = F.when(F.col("filler").rlike(SECRET_FORM), SECRET)
    edges = materialize(
        seen.select("kind", "filler", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "filler").agg(F.max("kind").alias("base"))
        .select("pattern", "filler", "base", F.coalesce("base", secret).alias("seed"), shape_column(F.col("filler")).alias("form")), "pii-edges"
    )
    forms = edges.filter("seed is not null").select(F.col("form"), F.col("seed").alias("kind")).distinct()
    prior = F.when(F.col("base").isNull(), PRIOR).otherwise(1.0)
    seeds = edges.filter("seed is not null").select("filler", F.col("seed").alias("kind"), prior.alias("score")).distinct()
    new = edges.filter("base is null").select("pattern", "filler", "form", "seed")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("fillers"))
    scores = seeds
    for _ in range(ROUNDS):
        pattern = (
            edges.select("pattern", "filler").join(scores, "filler")
            .groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("support"))
            .filter(F.col("support") >= SUPPORT).join(totals, "pattern")
            .select("pattern", "kind", (F.col("sum") / (F.col("fillers") + DOUBT)).alias("trust")).filter(F.col("trust") >= PATTERN_SCORE)
        )
        doubted = F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999)))) + F.max(F.when(F.col("seed") == F.col("kind"), math.log1p(-PRIOR)).otherwise(0.0))
        found_now = (
            new.join(pattern, "pattern").join(forms, ["form", "kind"], "left_semi")
            .groupBy("filler", "kind").agg((1 - F.exp(doubted)).alias("score")).filter(F.col("score") >= INSTANCE_SCORE)
        )
        scores = materialize(seeds.unionByName(found_now).groupBy("filler", "kind").agg(F.max("score").alias("score")), "pii-scores")
    known = edges.filter("base is not null").select("filler").distinct()
    return scores.filter(F.col("score") >= INSTANCE_SCORE).join(known, "filler", "left_anti")


def shape_column(filler: F.Column) -> F.Column:
    """The coarse form of a filler: has an @, is a number with separators, or neither."""
    return F.when(F.contains(filler, F.lit("@")), "at").when(filler.rlike(r"^[+(]?[0-9][0-9 ().:/-]*$"), "number").otherwise("mixed")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of every row's whole text, and further identifiers that their contexts give away.

    Base spans are leftmost and non-overlapping in each kind; those that fail their check (parts over 255,
    Luhn, digit count) are dropped without another try. Discovered spans are words with a digit or an @,
    trimmed of punctuation, that overlap no base span (see bootstrap); they are added and displace nothing, and may be of
    the kind `secret` too, which is listed after the others. Null and empty texts have no spans. Rows are kept apart by an
    internal number, so repeated rows and ids each have their own result; a filler trusted as several kinds is of the
    best scored, then the last by name; an empty table gives an empty table. A long text is read once, by one task, and leaves
    only its spans with their contexts. Only id and text are read, so other columns cannot clash.

    Returns id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_found (discovered spans).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        fill = pa.struct([*span, ("filler", pa.string()), ("patterns", pa.list_(pa.string()))])
        for batch in slices(batches, 8 << 20):
            base, seen = zip(*(found(t) for t in batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, pa.list_(span)), pa.array(seen, pa.list_(fill))], ["id", "base", "seen"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, FOUND.format(kind=kind))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    seen = rows.filter(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    known = bootstrap(seen).groupBy("filler").agg(F.max_by("kind", F.struct("score", "kind")).alias("new_kind"))
    added = (
        seen.filter("kind is null").join(known, "filler")
        .groupBy("row").agg(F.collect_list(F.struct("start", "end", F.col("new_kind").alias("kind"))).alias("added"))
    )
    rank = F.create_map(*(F.lit(x) for i, k in enumerate((*KINDS, SECRET)) for x in (k, i)))

    def joined(spans: F.Column) -> F.Column:
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = rows.select("row", "id", "base").join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(
        F.col("id").alias(id_col), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_found"),
    )
