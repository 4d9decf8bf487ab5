"""The decision log as a stream: idempotent replay, a fold of status by target, and an upsert of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import latest

LOG = "decision_id string, target_id string, plan_hash string, action string, decided_at timestamp"
STATUS = "target_id string, status string, history long, decided_at timestamp"
#: What each action makes of a record; a note changes nothing.
BECOMES = {"approve": "approved", "rerecord": "rerecord_requested", "reset": "pending_review"}


def read_log(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The decisions that arrive in a folder as JSON lines."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_at_once).json(path)


def valid_decisions(log: DataFrame, plans: DataFrame, late: str = "7 days") -> DataFrame:
    """Decisions of a current plan, each id once; an id is remembered for as long as a decision may be late.

    plans (plan_hash) is a static table: a decision of a superseded plan is dropped by the join.
    """
    current = log.join(plans.select("plan_hash").distinct(), "plan_hash", "left_semi")
    return current.withWatermark("decided_at", late).dropDuplicatesWithinWatermark(["decision_id"])


def fold_status(decisions: DataFrame) -> DataFrame:
    """(target_id, status, history, decided_at): each target's status after the decisions so far, as updates.

    State is one row a target. Decisions of one batch apply in order of (decided_at, decision_id); an older one than
    what was applied counts in the history but changes nothing.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, history, at, by = state.get if state.exists else ("pending_review", 0, None, None)
        rows = pd.concat(list(frames)).sort_values(["decided_at", "decision_id"])
        for action, when, decision in zip(rows["action"], rows["decided_at"], rows["decision_id"]):
            history += 1
            now = (when.to_pydatetime(), decision)
            if action in BECOMES and (at is None or now >= (at, by)):
                status, (at, by) = BECOMES[action], now
        state.update((status, history, at, by))
        yield pd.DataFrame({"target_id": [key[0]], "status": [status], "history": [history], "decided_at": [at]}).astype({"decided_at": "datetime64[us]"})

    return decisions.groupBy("target_id").applyInPandasWithState(fold, STATUS, "status string, history long, at timestamp, by string", "update", GroupStateTimeout.NoTimeout)


def follow(updates: DataFrame, table: str, checkpoint: str):
    """Start the stream that keeps the Parquet table `table` at each target's newest status; returns the query.

    Each batch is written as a version of its own (overwritten if it is replayed), so a lost batch leaves no half-written table.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest status of each target in a table that `follow` keeps."""
    rows = spark.read.parquet(table)
    return latest(rows.select("target_id", "batch", "status", "history", "decided_at"), ["target_id"], ["batch"]).drop("batch")


def windowed_counts(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, action, n): decisions by action and tumbling window; windows close once they cannot change."""
    n = log.withWatermark("decided_at", late).groupBy(F.window("decided_at", width).alias("w"), "action").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), "action", "n")
