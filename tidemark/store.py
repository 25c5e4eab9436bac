"""A store of feature snapshots and its audit log on disk: what is written, and the reads that never look ahead."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import day_key
from tidemark.governance import audit
from tidemark.operators import history as H
from tidemark.operators import windows as W
from tidemark.sources import sinks

TIME = "snapshot_time"
#: Of the rows of one call, which share their time.
ORDER = ["timestamp", "event_id"]


def _at(value) -> Column:
    return F.lit(value).cast("timestamp_ntz")


@dataclass
class FeatureStore:
    """Snapshots lie in `folder`/snapshots by day, the log in `folder`/audit as JSON lines.

    Reads give lazy frames, so that further filters and projections reach the files. A repeated snapshot of an account
    and time replaces the earlier one: the later `created_at` counts.
    """

    spark: SparkSession
    folder: str
    #: If given, a read is logged under this user.
    user: str | None = None

    # Writing

    def compute(self, transactions: DataFrame) -> DataFrame:
        """Vectors of transactions, one for each id: the latest version of a repeated one counts, if it has versions."""
        once = H.replacing(transactions, ["transaction_id"], ["version"]).drop("version") if "version" in transactions.columns else transactions.dropDuplicates(["transaction_id"])
        return W.rolling_features(once)

    def insert_feature_snapshots(self, vectors: DataFrame, computation_version: str = "1.0", created_at=None) -> None:
        """Appends vectors as snapshots; features that are missing are 0."""
        created = _at(created_at) if created_at is not None else F.current_timestamp().cast("timestamp_ntz")
        sinks.write_snapshots(sinks.snapshots(vectors, computation_version).withColumn("created_at", created), f"{self.folder}/snapshots")

    def log_audit(self, operation: str, rows: DataFrame, latency_ms: float = 0.0, details: list[str] | None = None) -> None:
        """Each call appends a chain of its own, named by `segment`; verify_audit_log() checks them all."""
        log = audit.entry(rows, operation, "feature_snapshots", F.lit(self.user), F.lit(latency_ms), details or [], F.current_timestamp())
        # The text of a time as it is stored, so that what is read again is what was hashed.
        log = log.withColumns({"timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "segment": F.lit(uuid.uuid4().hex)})
        sinks.write_lines(audit.chain(log, ["segment"], ORDER), f"{self.folder}/audit")

    # Reading

    def snapshots(self, until=None) -> DataFrame:
        """All snapshots, or those up to a time, one for each account and time."""
        rows = self.spark.read.parquet(f"{self.folder}/snapshots")
        if until is not None:
            rows = rows.filter((F.col(TIME) <= _at(until)) & (F.col("day").cast("string") <= day_key(_at(until))))
        return H.replacing(rows.drop("day"), ["account_id", TIME], ["created_at"])

    def _names(self, rows: DataFrame, names: list[str] | None) -> list[str]:
        known = [c for c in rows.columns if c not in ("account_id", TIME, "created_at")]
        return known if names is None else [n for n in names if n in known]

    def get_features_as_of(self, account_ids: list | None, at, names: list[str] | None = None) -> DataFrame:
        """Of each account, or each of the given ones, its latest snapshot of `at` or before. Unknown names are left
        out; an account without such a snapshot has no row."""
        rows = self.snapshots(at)
        if account_ids is not None:
            rows = rows.filter(F.col("account_id").isin(list(account_ids)))
        found = H.as_of(rows, "account_id", TIME, _at(at)).select("account_id", TIME, *self._names(rows, names))
        if self.user:
            # Read once: the log and the caller get the same rows, and what is logged has been read.
            found = found.persist()
            self.log_audit("PIT_QUERY", found.select("account_id", TIME), details=[TIME])
        return found

    def get_feature_as_of(self, account_id, at, names: list[str] | None = None) -> dict | None:
        """The same for one account, as a dictionary; None without a snapshot."""
        row = self.get_features_as_of([account_id], at, names).first()
        return row.asDict() if row else None

    def get_historical_features(self, spine: DataFrame, names: list[str], entity: str = "account_id", time: str = "event_time", chunk_seconds: int | None = None) -> DataFrame:
        """The rows of `spine` with each account's features as they were at each row's time."""
        rows = self.snapshots().withColumnRenamed("account_id", entity)
        return H.asof_join(spine, rows, [entity], time, TIME, self._names(rows, names), ties=["created_at"], chunk_seconds=chunk_seconds)

    def get_online_features(self, account_ids: list | None, names: list[str]) -> DataFrame:
        """Each account's latest snapshot."""
        rows = self.snapshots()
        if account_ids is not None:
            rows = rows.filter(F.col("account_id").isin(list(account_ids)))
        return H.latest(rows, "account_id", TIME, self._names(rows, names))

    def get_lineage(self, account_id, start, stop) -> DataFrame:
        """An account's snapshots of an inclusive range with what they were made from, in order."""
        rows = self.snapshots(stop).filter((F.col("account_id") == account_id) & (F.col(TIME) >= _at(start)))
        return rows.select("account_id", TIME, "computation_version", "source_event_count", "created_at").orderBy(TIME)

    def verify_no_future_leakage(self, at, account_id=None) -> bool:
        """Whether no snapshot of after `at` had been made before it."""
        rows = self.spark.read.parquet(f"{self.folder}/snapshots")
        rows = rows if account_id is None else rows.filter(F.col("account_id") == account_id)
        return bool(H.leakage(rows, TIME, "created_at", _at(at)).first()["passed"])

    def audit_log(self) -> DataFrame:
        columns = "timestamp string, operation string, user_id string, account_id string, resource string, action string, status string, latency_ms double, metadata string, event_id string, segment string, prev_checksum string, checksum string"
        return self.spark.read.schema(columns).json(f"{self.folder}/audit")

    def verify_audit_log(self) -> bool:
        """Whether every row is as it was written and follows the one before it; true of an empty log."""
        return bool(audit.verify(self.audit_log(), ["segment"], ORDER).first()["intact"])
