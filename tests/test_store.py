"""The store's reads over what it has written."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.model import transactions, with_duplicates
from tidemark.store import FeatureStore

AT = "2024-01-20 12:00:00"


@pytest.fixture(scope="module")
def store(spark, sf, tmp_path_factory):
    made = FeatureStore(spark, str(tmp_path_factory.mktemp("store")), user="tester")
    vectors = made.compute(with_duplicates(transactions(spark, sf)))
    made.insert_feature_snapshots(vectors, created_at="2024-02-01")
    made.insert_feature_snapshots(vectors.filter("account_id = 3").withColumn("risk_score", F.lit(0.9)), "1.1", created_at="2024-02-02")
    return made


def test_as_of(store, spark, sf):
    tx = transactions(spark, sf).filter(F.col("event_time") <= F.lit(AT).cast("timestamp_ntz"))
    latest = {r["account_id"]: r["t"] for r in tx.groupBy("account_id").agg(F.max("event_time").alias("t")).collect()}
    found = store.get_features_as_of(None, AT, ["transaction_count_24h", "no_such_feature"])
    assert found.columns == ["account_id", "snapshot_time", "transaction_count_24h"]
    assert {r["account_id"]: r["snapshot_time"] for r in found.collect()} == latest
    assert store.get_feature_as_of(3, AT)["risk_score"] == 0.9  # the later computation of the same snapshot
    assert store.get_feature_as_of(3, "2000-01-01") is None and store.get_feature_as_of(-1, AT) is None


def test_historical_and_online(store, spark):
    spine = spark.createDataFrame([(3, dt.datetime(2024, 1, 20, 12)), (3, dt.datetime(2000, 1, 1))], "account_id long, event_time timestamp_ntz")
    rows = {r["event_time"].year: r["risk_score"] for r in store.get_historical_features(spine, ["risk_score"]).collect()}
    assert rows == {2024: 0.9, 2000: None}
    chunked = {r["event_time"].year: r["risk_score"] for r in store.get_historical_features(spine, ["risk_score"], chunk_seconds=86400).collect()}
    assert chunked == rows
    online = store.get_online_features([3, 4], ["transaction_count_1h"]).collect()
    assert {r["account_id"] for r in online} == {3, 4}


def test_lineage_leakage_and_log(store):
    rows = store.get_lineage(3, "2024-01-01", "2024-02-01").collect()
    assert rows and all(r["computation_version"] == "1.1" for r in rows) and rows == sorted(rows, key=lambda r: r["snapshot_time"])
    assert store.verify_no_future_leakage(AT) and store.verify_no_future_leakage(AT, 3)


def test_leakage_is_found(spark, sf, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    store.insert_feature_snapshots(store.compute(transactions(spark, sf)), created_at="2024-01-10")
    assert not store.verify_no_future_leakage(AT) and store.verify_no_future_leakage("2024-01-09")


def test_the_log(store):
    before = store.audit_log().count()
    store.get_feature_as_of(3, AT)
    log = store.audit_log()
    assert log.count() == before + 1 and log.filter("operation = 'PIT_QUERY' and user_id = 'tester'").count() > 0


def test_the_log_is_chained(spark, sf, tmp_path):
    """What was logged verifies as it was read from disk; a changed, a removed or an added row is found."""
    store = FeatureStore(spark, str(tmp_path), user="tester")
    rows = transactions(spark, sf).select("account_id").distinct()
    store.log_audit("INSERT", rows)
    store.log_audit("PIT_QUERY", rows.limit(5))
    assert store.verify_audit_log()
    log = store.audit_log().cache()
    assert log.groupBy("segment").count().count() == 2
    some = log.filter("operation = 'INSERT'").orderBy("event_id").collect()[3]["event_id"]
    for changed in (log.withColumn("status", F.when(F.col("event_id") == some, "BAD").otherwise(F.col("status"))), log.filter(F.col("event_id") != some), log.unionByName(log.filter(F.col("event_id") == some).withColumn("event_id", F.lit("f" * 16)))):
        folder = tmp_path / f"copy{id(changed)}"
        changed.write.json(f"{folder}/audit")
        assert not FeatureStore(spark, str(folder)).verify_audit_log()
