"""Requests for synthesis: blocks fanned out to units and voices, with one hash for what is synthesised and one for its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packages import text_hash

#: Columns that decide what is synthesised; a request's place and block decide the rest of what is rendered.
SPOKEN = ["spoken", "voice", "voice_hash", "instruction", "speed", "retry"]


def fanned_out(blocks: DataFrame, block: str, units: Column, voices: Column) -> DataFrame:
    """blocks with (unit_index, unit, voice_index, voice): one row for each unit and each voice that says it. A block without either has none."""
    first = blocks.select("*", F.posexplode(units).alias("unit_index", "unit"))
    return first.select("*", F.posexplode(voices).alias("voice_index", "voice"))


def hashed(components: DataFrame, block: str, block_hash: str, spoken: list[str] = SPOKEN) -> DataFrame:
    """components with `synthesis_hash` of what is said, by whom and how, and `render_hash` of that with its block's hash and the unit's place.

    Equal speech shares one synthesis wherever it stands; a change of the block's annotation that doesn't reach the speech changes renders only.
    """
    said = text_hash(*(F.col(c).cast("string") for c in spoken))
    there = components.withColumn("synthesis_hash", said)
    return there.withColumn("render_hash", text_hash(F.col("synthesis_hash"), F.col(block).cast("string"), F.col(block_hash), F.col("unit_index").cast("string"), F.col("unit")))


def to_synthesise(requests: DataFrame, cache: DataFrame, order: list[str]) -> DataFrame:
    """One row each synthesis that the cache (synthesis_hash) lacks: the first request by `order` stands for all, `uses` says how many."""
    first = requests.groupBy("synthesis_hash").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("uses"))
    return first.join(cache.select("synthesis_hash"), "synthesis_hash", "left_anti").select("synthesis_hash", *(F.col(f"_first.{c}").alias(c) for c in order), "uses")


def work(requests: DataFrame, previous: DataFrame, key: list[str], syntheses: DataFrame) -> DataFrame:
    """(key, work) of each request against those of the previous run: 'keep' (same render), 'render' (its synthesis is in the cache
    syntheses(synthesis_hash)), 'synthesise', and 'drop' for requests that are gone. Keys are unique in each run."""
    now = requests.select(*key, "render_hash", "synthesis_hash")
    old = previous.select(*key, F.col("render_hash").alias("_was"))
    held = syntheses.select("synthesis_hash").distinct().withColumn("_held", F.lit(True))
    met = now.join(old, key, "full").join(held, "synthesis_hash", "left")
    todo = F.when(F.col("render_hash").isNull(), "drop").when(F.col("render_hash").eqNullSafe(F.col("_was")), "keep").when(F.col("_held"), "render").otherwise("synthesise")
    return met.select(*key, todo.alias("work"))


def validation_jobs(components: DataFrame, mixes: DataFrame, narration: DataFrame, leveled: DataFrame) -> DataFrame:
    """(job, block, unit_index, kind, voice, path, expected): one list of what is to be heard again.

    components (block, unit_index, voice, path, text, selected), mixes (block, unit_index, voice, path, text), narration (block, path, text);
    leveled (block, unit_index, path) holds final files, unit_index null for narration: they replace the path of selected components and of
    narration. A mix is checked as it is.
    """
    final = leveled.select(F.col("block").alias("_b"), F.col("unit_index").alias("_u"), F.col("path").alias("_final"))

    def named(rows: DataFrame, kind: str, job: Column, voice: Column, unit: Column, chosen: Column) -> DataFrame:
        met = rows.join(final, (F.col("block") == F.col("_b")) & unit.eqNullSafe(F.col("_u")), "left")
        return met.select(job.alias("job"), "block", unit.cast("int").alias("unit_index"), F.lit(kind).alias("kind"), voice.alias("voice"), F.coalesce(F.when(chosen, F.col("_final")), "path").alias("path"), F.col("text").alias("expected"))

    place, block = F.concat(F.lit("u"), (F.col("unit_index") + 1).cast("string")), F.col("block").cast("string")
    voiced = named(components, "component", F.concat_ws("-", block, place, "voice"), F.col("voice"), F.col("unit_index"), F.col("selected"))
    mixed = named(mixes, "mix", F.concat_ws("-", block, place, F.lit("mix")), F.col("voice"), F.col("unit_index"), F.lit(False))
    told = named(narration, "narration", F.concat_ws("-", block, F.lit("narration")), F.lit("narrator"), F.lit(None).cast("int"), F.lit(True))
    return voiced.unionByName(mixed).unionByName(told)
