"""Review workflow: hash-bound targets, an append-only log of decisions, status, gates, and rated rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of the columns as compact JSON with sorted names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def first_decisions(log: DataFrame, known: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """Decisions that are not known yet, each id once: its first row by order. The idempotent insert."""
    fresh = log if known is None else log.join(known.select(key), key, "left_anti")
    return fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def latest(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each record by order: a sorted maximum, which is combined before the shuffle."""
    rest = [c for c in log.columns if c not in by and c not in order]
    top = log.groupBy(*by).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return top.select(*by, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def collapse_repeats(log: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Events without those that repeat the one before them."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return log.withColumn("__b", before).filter(F.col("__b").isNull() | ~F.col("__b").eqNullSafe(F.col(value))).drop("__b")


def status_counts(rows: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """Counts of each status of a fixed list in each group, zeros included."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))


def gates(rows: DataFrame, by: list[str], approved: Column, blocked: Column) -> DataFrame:
    """(by, n, approved, all_approved, any_blocked, open): a group is open if all are approved and none is blocked."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(approved).alias("approved"), F.bool_and(approved).alias("all_approved"), F.bool_or(blocked).alias("any_blocked"))
    return g.withColumn("open", F.col("all_approved") & ~F.col("any_blocked"))


def reconcile_approvals(targets: DataFrame, records: DataFrame, key: str, binding: str, status: str) -> DataFrame:
    """(key, outcome): full outer join of the plan with what was approved.

    'inserted' has no record, 'removed' no target, 'superseded' another binding; the rest keep their status.
    """
    a = targets.select(F.col(key).alias("k"), F.col(binding).alias("now"))
    b = records.select(F.col(key).alias("o"), F.col(binding).alias("was"), F.col(status).alias("status"))
    outcome = F.when(F.col("o").isNull(), "inserted").when(F.col("k").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("was")), "superseded").otherwise(F.col("status"))
    return a.join(b, F.col("k") == F.col("o"), "full").select(F.coalesce("k", "o").alias(key), outcome.alias("outcome"))


def apply_decisions(records: DataFrame, log: DataFrame, plan_hash: str) -> DataFrame:
    """Status of each record after a log (decision_id, target_id, plan_hash, action, decided_at).

    Rows of another plan and repeated ids are ignored; notes change nothing; of the rest the last decides.
    """
    valid = first_decisions(log.filter(F.col("plan_hash") == plan_hash), None, "decision_id", ["decided_at", "decision_id"])
    last = valid.filter("action != 'note'").groupBy("target_id").agg(F.max_by("action", F.struct("decided_at", "decision_id")).alias("action"))
    notes = valid.groupBy("target_id").agg(F.count("*").alias("history"))
    # What each action makes of a record.
    became = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "rerecord", "rerecord_requested").when(F.col("action") == "reset", "pending_review")
    return records.join(last, "target_id", "left").join(notes, "target_id", "left").select(*(c for c in records.columns if c != "status"), F.coalesce(became, F.col("status")).alias("status"), F.coalesce("history", F.lit(0)).alias("history"))


def next_undecided(targets: DataFrame, log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first target by order that no decision names."""
    return targets.join(log.select(key), key, "left_anti").orderBy(*order).limit(1)


def upsert_active(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """rows with `active`: only the latest version of each group is."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order), F.desc(key))
    return rows.withColumn("active", F.row_number().over(w) == 1)


def missing(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Numbers from first to last that no row has."""
    return rows.sparkSession.range(first, last + 1).select(F.col("id").alias(key)).join(rows.select(F.col(key).cast("long")), key, "left_anti")


def rounds(ratings: DataFrame, by: list[str], value: str, wanted: int = 3, most: float = 1.0) -> DataFrame:
    """(by, rounds, median, range, status): incomplete without `wanted` ratings, stable within `most`, else unstable."""
    g = ratings.groupBy(*by).agg(F.count(value).alias("rounds"), F.percentile(value, F.lit(0.5)).alias("median"), (F.max(value) - F.min(value)).alias("range"))
    status = F.when(F.col("rounds") != wanted, "incomplete").when(F.col("range") <= most, "stable").otherwise("unstable")
    return g.select(*by, "rounds", F.round("median", 6).alias("median"), F.round("range", 6).alias("range"), status.alias("status"))


def gated_pairs(rows: DataFrame, by: str, key: str, value: str, gap: float) -> DataFrame:
    """(by, better, worse, gap): pairs in a group whose values lie `gap` or more apart. Groups are small
    by nature (candidates for one place); all their qualifying pairs are the result."""
    a = rows.select(by, F.col(key).alias("better"), F.col(value).alias("high"))
    b = rows.select(by, F.col(key).alias("worse"), F.col(value).alias("low"))
    return a.join(b, by).filter(F.col("high") - F.col("low") >= gap).select(by, "better", "worse", F.round(F.col("high") - F.col("low"), 6).alias("gap"))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with `violations`: names of the checks that do not hold (null counts as not)."""
    found = F.array(*(F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()))
    return rows.withColumn("violations", F.filter(found, lambda x: x.isNotNull()))


def verified(configs: DataFrame, decisions: DataFrame, denied: DataFrame) -> DataFrame:
    """(speaker, approval_id, file_hash, problem) of voices (speaker, approval_id, file_hash) against what was approved.

    decisions (approval_id, decision, file_hash), ids not repeated; denied (file_hash). A voice without an approval is
    'not approved', one on the list is 'denied', one whose file is another than the approved is 'changed'.
    """
    approved = decisions.filter("decision = 'approved'").select("approval_id", F.col("file_hash").alias("_approved"))
    listed = denied.select("file_hash").distinct().withColumn("_denied", F.lit(True))
    rows = configs.select("speaker", "approval_id", "file_hash").join(approved, "approval_id", "left").join(listed, "file_hash", "left")
    problem = F.when(F.col("_approved").isNull(), "not approved").when(F.col("_denied"), "denied").when(~F.col("_approved").eqNullSafe(F.col("file_hash")), "changed")
    return rows.select("speaker", "approval_id", "file_hash", problem.alias("problem"))


def availability(rows: DataFrame, offered: DataFrame, on: str) -> DataFrame:
    """rows with `status`: 'available' where the offer has their value, else 'missing'; null is never offered."""
    known = offered.select(on).distinct().withColumn("_has", F.lit(True))
    return rows.join(known, on, "left").select(*rows.columns, F.when(F.col("_has"), "available").otherwise("missing").alias("status"))


def overridden(rows: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """rows with what overrides (key, expected, replacement) put in place of `value`, and `problem` where the value is not the expected one.

    Rows without an override keep their value; overrides have one row a key.
    """
    o = overrides.select(key, F.col("expected").alias("_expected"), F.col("replacement").alias("_new"), F.lit(True).alias("_is"))
    fits = F.col("_expected").eqNullSafe(F.col(value))
    kept = [c for c in rows.columns if c != value]
    return rows.join(o, key, "left").select(*kept, F.when(F.col("_is") & fits, F.col("_new")).otherwise(F.col(value)).alias(value), F.when(F.col("_is") & ~fits, "not the expected value").alias("problem"))


#: Fixed names of the two versions of a manifest of published tracks.
TRACK_V1 = "struct<path:string,buildHash:string,fileHash:string,bytes:long,durationSeconds:double>"
TRACK_V2 = "struct<defaultVariant:string,variants:map<string,struct<url:string,trackHash:string,fileHash:string,bytes:long,durationSeconds:double>>>"


def manifest_tracks(manifests: DataFrame, text: str) -> DataFrame:
    """(chapter, variant, url, track_hash, file_hash, bytes, seconds) of manifests in JSON, in either version.

    An entry of version 1 is the only variant, 'female', and has a url by its chapter if it has none. Other versions
    and broken JSON give no rows.
    """
    version = F.get_json_object(text, "$.version").try_cast("int")
    first = F.from_json(F.when(version == 1, F.get_json_object(text, "$.chapters")), f"map<string,{TRACK_V1}>")
    second = F.from_json(F.when(version == 2, F.get_json_object(text, "$.chapters")), f"map<string,{TRACK_V2}>")
    old = manifests.select(F.explode(first).alias("chapter", "t")).select(
        "chapter", F.lit("female").alias("variant"), F.coalesce("t.path", F.concat(F.lit("/audio/"), "chapter", F.lit(".mp3"))).alias("url"), "t.buildHash", "t.fileHash", "t.bytes", "t.durationSeconds"
    )
    new = manifests.select(F.explode(second).alias("chapter", "c")).select("chapter", F.explode("c.variants").alias("variant", "t"))
    new = new.select("chapter", "variant", "t.url", "t.trackHash", "t.fileHash", "t.bytes", "t.durationSeconds")
    return old.union(new).toDF("chapter", "variant", "url", "track_hash", "file_hash", "bytes", "seconds")
