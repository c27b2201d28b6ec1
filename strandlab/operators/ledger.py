"""An experiment ledger as event-sourced Parquet: events are appended, each with the hash of the one before; the current state is
their fold. Plain Parquet has no transactions over several writers: one process at a time may append to a ledger."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Allowed transitions of the nine states (fixed values).
TRANSITIONS = {
    "PENDING": {"RUNNING", "REJECTED"}, "RUNNING": {"COMPLETE", "FAILED"}, "COMPLETE": {"REVIEW_LOCAL"}, "FAILED": {"PENDING"},
    "REVIEW_LOCAL": {"REJECTED", "PROMISING", "REPLICATE", "ESCALATE_CODEX"}, "PROMISING": {"REPLICATE", "ESCALATE_CODEX"},
    "REPLICATE": {"RUNNING", "REJECTED", "ESCALATE_CODEX"}, "REJECTED": set(), "ESCALATE_CODEX": set(),
}
#: Parts of an experiment that a transition may change (fixed values).
PATCHABLE = {"normalization", "parameters", "train_split", "heldout_split", "null_model", "metrics", "effects", "artifacts", "local_review", "escalation", "notes"}
KIND = "event_seq long, experiment_id string, occurred_at string, actor string, from_status string, to_status string, details string, previous_hash string, event_hash string"
PARTS = ("event_seq", "experiment_id", "occurred_at", "actor", "from_status", "to_status", "details", "previous_hash")


def event_hash(row: dict) -> str:
    return hashlib.sha256("\x1f".join("" if row[k] is None else str(row[k]) for k in PARTS).encode()).hexdigest()


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(KIND).parquet(self.path)
        except Exception as e:  # an empty ledger has no folder yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], KIND)
            raise

    def states(self) -> DataFrame:
        """experiment_id, status, updated_at, details of the last event of each experiment, newest first."""
        last = F.max_by(F.struct("to_status", "occurred_at", "details"), "event_seq").alias("e")
        return self.events().groupBy("experiment_id").agg(last).select("experiment_id", F.col("e.to_status").alias("status"), F.col("e.occurred_at").alias("updated_at"), "e.details").orderBy(F.desc("updated_at"), "experiment_id")

    def _append(self, experiment_id: str, actor: str, before: str | None, after: str, details: dict) -> str:
        last = self.events().orderBy(F.desc("event_seq")).first()
        row = {"event_seq": last.event_seq + 1 if last else 0, "experiment_id": experiment_id, "occurred_at": datetime.now(UTC).isoformat(), "actor": actor, "from_status": before, "to_status": after, "details": json.dumps(details, sort_keys=True), "previous_hash": last.event_hash if last else None}
        row["event_hash"] = event_hash(row)
        self.spark.createDataFrame([row], KIND).coalesce(1).write.mode("append").parquet(self.path)
        return row["event_hash"]

    def register(self, experiment_id: str, details: dict, actor: str = "lab") -> str:
        if self.events().where(F.col("experiment_id") == experiment_id).limit(1).count():
            raise ValueError(f"{experiment_id} is registered already")
        return self._append(experiment_id, actor, None, "PENDING", details)

    def transition(self, experiment_id: str, to: str, details: dict | None = None, actor: str = "lab") -> str:
        row = self.states().where(F.col("experiment_id") == experiment_id).first()
        if row is None:
            raise KeyError(experiment_id)
        if to not in TRANSITIONS[row.status]:
            raise ValueError(f"{row.status} -> {to} is not allowed")
        if unknown := set(details or {}) - PATCHABLE - {"owner"}:
            raise ValueError(f"a transition can't change {sorted(unknown)}")
        return self._append(experiment_id, actor, row.status, to, details or {})

    def heartbeat(self, experiment_id: str, owner: str) -> str:
        row = self.states().where(F.col("experiment_id") == experiment_id).first()
        if row is None or row.status != "RUNNING":
            raise ValueError(f"{experiment_id} is not running")
        held = json.loads(row.details or "{}").get("owner")
        if held is not None and held != owner:
            raise ValueError(f"{experiment_id} is run by {held}")
        return self._append(experiment_id, owner, "RUNNING", "RUNNING", {"heartbeat": True, "owner": owner})

    def stale(self, seconds: float) -> DataFrame:
        age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp("updated_at"))
        return self.states().where((F.col("status") == "RUNNING") & (age > seconds))

    def errors(self) -> DataFrame:
        return chain_errors(self.events())


def chain_errors(events: DataFrame) -> DataFrame:
    """event_seq, error of every event whose own hash or link to the one before doesn't hold. The order is global, so it runs over
    one partition: a ledger has a few events for each experiment."""
    own = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PARTS)), 256)
    before = F.lag("event_hash").over(Window.orderBy("event_seq"))
    rows = events.withColumn("own", own).withColumn("before", before)
    error = F.when(F.col("own") != F.col("event_hash"), "event hash").when(~F.col("previous_hash").eqNullSafe(F.col("before")), "previous hash")
    return rows.withColumn("error", error).where("error is not null").select("event_seq", "error")
