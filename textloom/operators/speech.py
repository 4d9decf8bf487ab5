"""Planning of spoken text: prosody, instructions, units, scenes, targets and what of them can be used again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngrams import in_slices
from .packages import all_equal, text_hash

# How tags shift a voice's rate (%), pitch (Hz) and volume (%), and the bounds of each.
PACE = {"slow": -10, "medium": 0, "fast": 8, "urgent": 15, "broken": -12}
PITCH = {"low": -3, "medium": 0, "high": 3}
ENERGY = {"light": -10, "medium": 0, "heavy": 8}
#: Modifiers of which any one shifts rate and volume.
MODIFIERS = [(("whispering",), -5, -20), (("dream-murmur",), -10, -12), (("crying", "sobbing"), -6, 0), (("choked", "hesitating"), -5, 0)]
BOUNDS = {"rate": (-50, 100), "pitch": (-20, 20), "volume": (-50, 50)}
#: Milliseconds after a unit, by its last mark.
PAUSES, PAUSE = [("[！？!?]", 130), ("[；;]", 120), ("[。]", 165)], 95
ENDS, SOFT = "。！？!?；;", "，、：,:"


def lookup(values: dict, key: Column, default=None) -> Column:
    """A value by name; the default for other names and null."""
    found = F.lit(default)
    for name, value in values.items():
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def signed_value(text: Column, unit: str, fallback: int = 0) -> Column:
    """The number of a text such as '-7%' or '+2Hz'; the fallback for anything else."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), rf"^([+-]?[0-9]+){re.escape(unit)}\z", 1).try_cast("int"), F.lit(fallback))


def signed_text(value: Column, unit: str) -> Column:
    """A number as '+2Hz' or '-7%', halves rounded up."""
    return F.format_string(f"%+d{unit.replace('%', '%%')}", F.floor(value + F.lit(0.5)).cast("int"))


def prosody(rows: DataFrame, modifiers: Column) -> DataFrame:
    """Rows (rate, pitch, volume as signed texts; pace, tone, energy as tags) with the three shifted and held in bounds.

    Unknown tags and null modifiers shift nothing.
    """
    tags = F.coalesce(modifiers, F.array().cast("array<string>"))
    rate = signed_value(F.col("rate"), "%") + lookup(PACE, F.col("pace"), 0)
    pitch = signed_value(F.col("pitch"), "Hz") + lookup(PITCH, F.col("tone"), 0)
    volume = signed_value(F.col("volume"), "%") + lookup(ENERGY, F.col("energy"), 0)
    for names, slower, softer in MODIFIERS:
        met = F.arrays_overlap(tags, F.array(*map(F.lit, names))).cast("boolean")
        rate, volume = rate + F.when(met, slower).otherwise(0), volume + F.when(met, softer).otherwise(0)
    held = {n: F.least(F.greatest(v, F.lit(BOUNDS[n][0])), F.lit(BOUNDS[n][1])) for n, v in (("rate", rate), ("pitch", pitch), ("volume", volume))}
    return rows.withColumns({n: signed_text(v, "Hz" if n == "pitch" else "%") for n, v in held.items()})


def instruction(parts: list[tuple[Column, dict[str, str]]], closing: str, joint: str = ", ") -> Column:
    """The phrases of tags (array, phrase by tag), in order, then the closing one; null arrays and unknown tags say nothing."""

    def phrases(tags: Column, words: dict[str, str]) -> Column:
        return F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: lookup(words, t))

    said = [phrases(tags, words) for tags, words in parts]
    return F.array_join(F.filter(F.concat(*said, F.array(F.lit(closing))), lambda x: x.isNotNull()), joint)


def substitute(text: Column, replacements: Column) -> Column:
    """A text after each replacement (struct text, replacement) in turn; null replacements change nothing."""
    return F.aggregate(F.coalesce(replacements, F.array().cast("array<struct<text:string,replacement:string>>")), text, lambda t, r: F.when(r["text"] != "", F.replace(t, r["text"], r["replacement"])).otherwise(t))


def pause_after(text: Column) -> Column:
    """Milliseconds of silence after a unit, by its last mark."""
    pause = F.lit(PAUSE)
    for mark, length in reversed(PAUSES):
        pause = F.when(F.coalesce(text, F.lit("")).rlike(mark + r"\z"), F.lit(length)).otherwise(pause)
    return pause


def packed(pieces: list[str], most: int) -> list[str]:
    """Neighbouring pieces joined while they have at most so many characters together."""
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + len(piece) <= most:
            out[-1] += piece
        else:
            out.append(piece)
    return out


def units_of(text: str, most: int, ends: str = ENDS, soft: str = SOFT) -> list[str]:
    """A text in units of at most `most` characters that end at sentences, else at soft marks, else anywhere; nothing is lost."""

    def parts(t: str, marks: str) -> list[str]:
        m = re.escape(marks)
        return re.findall(rf"[^{m}]*[{m}]+|[^{m}]+", t)

    clauses: list[str] = []
    for clause in parts(text, ends):
        if len(clause) > most:
            fit = [p[i : i + most] for p in parts(clause, soft) for i in range(0, len(p), most)]
            clauses += packed(fit, most)
        else:
            clauses.append(clause)
    return packed(clauses, most)


def speech_units(rows: DataFrame, key: str, text: str, most: int = 30, ends: str = ENDS, soft: str = SOFT) -> DataFrame:
    """(key, unit_index, unit) of each text; null and empty texts have none."""

    def cut(texts: list[str | None]) -> list[list[str]]:
        return [units_of(t or "", most, ends, soft) for t in texts]

    return in_slices(rows, [key], [F.col(text) if isinstance(text, str) else text], cut, "units", "array<string>").select(key, F.posexplode("units").alias("unit_index", "unit"))


def render_targets(units: DataFrame, keys: list[str], voice: Column) -> DataFrame:
    """Units with two hashes: `request_hash` of what is spoken by whom, `target_hash` of that at its place."""
    request = text_hash(voice, F.col("unit"))
    return units.withColumn("request_hash", request).withColumn("target_hash", text_hash(*(F.col(k).cast("string") for k in keys), request))


def scene_bounds(blocks: DataFrame, anchors: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, first, last, problem) of the scenes that anchors (by, start_anchor, end_anchor) cut out of ordered blocks.

    The first block starts with one anchor, the last ends with the other; each must be found once and in that order, or
    the problem says so and the bounds are null. Null texts hold no anchor.
    """
    own = blocks.select(by, F.col(order).alias("at"), F.col(text).alias("said"))
    rows = anchors.select(by, "start_anchor", "end_anchor").join(own, by, "left")
    starts, ends = F.col("said").startswith(F.col("start_anchor")), F.col("said").endswith(F.col("end_anchor"))
    found = rows.groupBy(by).agg(
        F.count_if(starts).alias("starts"), F.count_if(ends).alias("ends"), F.min(F.when(starts, F.col("at"))).alias("a"), F.min(F.when(ends, F.col("at"))).alias("b")
    )
    problem = F.when(F.col("starts") != 1, "start not unique").when(F.col("ends") != 1, "end not unique").when(F.col("b") < F.col("a"), "end before start")
    return found.withColumn("problem", problem).select(by, *(F.when(F.col("problem").isNull(), F.col(c)).alias(n) for c, n in (("a", "first"), ("b", "last"))), "problem")


def scene_rows(blocks: DataFrame, bounds: DataFrame, by: str, order: str) -> DataFrame:
    """Blocks within the bounds of their scene."""
    kept = bounds.filter("problem is null").select(by, F.col("first").alias("_first"), F.col("last").alias("_last"))
    return blocks.join(kept, by).filter(F.col(order).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def excerpt(targets: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """(key, wanted_order, order, problem) of wanted targets (key, wanted_order): 'missing', 'wanted twice' or 'out of order'.

    Out of order is a target that comes before the one wanted just ahead of it.
    """
    known = targets.select(key, F.col(order).alias("at"))
    rows = wanted.select(key, "wanted_order").join(known, key, "left").withColumn("twice", F.count("*").over(Window.partitionBy(key)) > 1)
    # the one before is found by its number, so that no window runs over all rows
    before = rows.filter("at is not null").select((F.col("wanted_order") + 1).alias("wanted_order"), F.col("at").alias("ahead")).groupBy("wanted_order").agg(F.max("ahead").alias("ahead"))
    problem = F.when(F.col("at").isNull(), "missing").when(F.col("twice"), "wanted twice").when(F.col("at") <= F.col("ahead"), "out of order")
    return rows.join(before, "wanted_order", "left").select(key, "wanted_order", F.col("at").alias(order), problem.alias("problem"))


def group_problems(targets: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, n, problem) of groups (group_id, ordinal, target_id, binding) over targets (target_id, position, binding).

    A group must cover known targets that follow each other, as they were when it was approved, and none that another
    row covers too. Members are told apart by sums and extremes, so a group of any size is never gathered.
    """
    known = targets.select("target_id", "position", F.col("binding").alias("now"))
    rows = groups.select("group_id", "ordinal", "target_id", "binding").withColumn("covered", F.count("*").over(Window.partitionBy("target_id")))
    rows = rows.join(known, "target_id", "left").withColumn("step", F.col("position") - F.col("ordinal"))
    span = F.max("ordinal") - F.min("ordinal") + 1
    g = rows.groupBy("group_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("position").isNull()).alias("unknown"), (F.min("step").eqNullSafe(F.max("step")) & (span == F.count("*"))).alias("contiguous"),
        F.count_if(~F.col("binding").eqNullSafe(F.col("now"))).alias("changed"), F.max("covered").alias("covered"),
    )
    problem = F.when(F.col("unknown") > 0, "unknown target").when(~F.col("contiguous"), "not contiguous").when(F.col("changed") > 0, "binding changed").when(F.col("covered") > 1, "covered twice")
    return g.select("group_id", "n", problem.alias("problem"))


def run_classes(targets: DataFrame, sources: list[tuple[str, DataFrame]], key: str, other: str = "new") -> DataFrame:
    """(key, run_class): the first source that holds each target, in the order given; repeated keys of a source count once."""
    rows, classes = targets.select(key), F.lit(other)
    for name, held in reversed(sources):
        flag = f"_in_{name}"
        rows = rows.join(held.select(key).distinct().withColumn(flag, F.lit(True)), key, "left")
        classes = F.when(F.col(flag), F.lit(name)).otherwise(classes)
    return rows.select(key, classes.alias("run_class"))


def reusable(rows: DataFrame, previous: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(key, reusable): whether the row of the same key was the same in every named column, null equalling null."""
    old = previous.select(key, F.lit(True).alias("_was"), *(F.col(c).alias(f"_{c}") for c in same))
    return rows.select(key, *same).join(old, key, "left").select(key, (F.coalesce("_was", F.lit(False)) & all_equal([(F.col(c), F.col(f"_{c}")) for c in same])).alias("reusable"))


def same_sequence(rows: DataFrame, previous: DataFrame, by: str, order: list[str], same: list[str]) -> DataFrame:
    """(by, same): whether two ordered lists are as long and equal at every place."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    now, old = (d.select(by, at.alias("_at"), F.struct(*same).alias(n)) for d, n in ((rows, "_now"), (previous, "_old")))
    met = now.join(old, [by, "_at"], "full")
    return met.groupBy(by).agg(F.bool_and(F.col("_now").isNotNull() & F.col("_old").isNotNull() & F.col("_now").eqNullSafe(F.col("_old"))).alias("same"))


def review_sources(fragments: DataFrame, levels: DataFrame, transcripts: DataFrame, on: list[str]) -> DataFrame:
    """Fragments with the file hash of levels (on, file_hash, rms) and the status of transcripts (on, status), and the milestones met."""
    joined = fragments.join(levels.select(*on, "file_hash", "rms"), on, "left").join(transcripts.select(*on, "status"), on, "left")
    rendered = F.col("file_hash").isNotNull()
    return joined.withColumns({"rendered": rendered, "auto_passed": rendered & F.coalesce(F.col("status") == "passed", F.lit(False))})


def structural_pass(expected: Column, heard: Column, repeats: Column, longest_edit: Column) -> Column:
    """Whether a transcript has the structure of its text: nothing repeated, nothing above one character put in or left out,
    and a length of 0.94 to 1.04 of the text's or at most one character off. Lengths are of normalised texts."""
    ratio = heard / F.nullif(expected, F.lit(0))
    near = F.coalesce(ratio.between(0.94, 1.04), F.lit(False)) | (F.abs(expected - heard) <= 1)
    return ~repeats & near & (longest_edit <= 1)


def group_fallback(rows: DataFrame, by: list[str], bad: Column) -> DataFrame:
    """Rows with `fallback`: whether any row of their group is bad. Groups are joined back, so a hot one is not one task's."""
    bad_groups = rows.filter(bad).select(*by).distinct().withColumn("fallback", F.lit(True))
    return rows.join(bad_groups, by, "left").withColumn("fallback", F.coalesce("fallback", F.lit(False)))


def term_hits(rows: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term) for each term that a text holds, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return rows.select(key, F.explode(F.filter(F.array(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms)), lambda t: t.isNotNull())).alias("term"))


def counts_over(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """(by, n) over a fixed list of values, zeros included, others left out."""
    wanted = rows.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return wanted.join(rows.groupBy(by).agg(F.count("*").alias("n")), by, "left").select(by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def carry_over(rows: DataFrame, old: DataFrame, file_hash: str, values: list[str]) -> DataFrame:
    """Rows with the values that an earlier run found for the same file; null for files that are new to it.

    Of several old rows of one file the greatest counts; null hashes are no file's.
    """
    kept = old.groupBy(file_hash).agg(F.max(F.struct(*values)).alias("_old"))
    return rows.join(kept, file_hash, "left").select(rows.columns + [F.col(f"_old.{v}").alias(v) for v in values])


def range_label(number: Column, ranges: list[tuple[str, int, int]]) -> Column:
    """The name of the range (name, first, last) that a number is in, and null beyond all."""
    label = F.lit(None).cast("string")
    for name, first, last in reversed(ranges):
        label = F.when(number.between(first, last), F.lit(name)).otherwise(label)
    return label
