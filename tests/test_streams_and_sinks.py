"""Feeds, sinks and streams on disk: repeated, interrupted and late."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.model import transactions
from tidemark.operators import states
from tidemark.sources import readers, sinks
from tidemark.streaming import features, run

BASE = dt.datetime(2024, 1, 15, 8)


class Crash(Exception):
    pass


def crashing(monkeypatch, after: int):
    """File operations of an upserted table fail after so many; a failed one isn't done."""
    left = [after]
    for name in ("delete", "rename", "touch"):
        own = getattr(sinks._Folder, name)

        def counted(self, *names, own=own):
            if not left[0]:
                raise Crash
            left[0] -= 1
            return own(self, *names)

        monkeypatch.setattr(sinks._Folder, name, counted)


@pytest.mark.parametrize("after", range(0, 11))
def test_an_interrupted_batch_loses_nothing(spark, tmp_path, monkeypatch, after):
    folder = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int, x string")
    write = sinks.upsert_batch(folder, ["k"], "v", buckets=3)
    before = [(k, 1, "a") for k in range(9)]
    write(frame(before), 0)
    second = frame([(k, 2, "b") for k in range(0, 9, 2)] + [(9, 1, "new")])
    want = sorted([(k, 2, "b") if k % 2 == 0 else (k, 1, "a") for k in range(9)] + [(9, 1, "new")])
    with monkeypatch.context() as m:
        crashing(m, after)
        try:
            write(second, 1)
            done = True
        except Crash:
            done = False
    read = lambda: sorted(map(tuple, sinks.upserted(spark, folder).select("k", "v", "x").collect()))
    assert read() in ([want] if done else [before, want])
    write(second, 1)
    assert read() == want


def test_only_the_buckets_of_a_batch_are_rewritten(spark, tmp_path):
    folder = tmp_path / "t"
    write = sinks.upsert_batch(str(folder), ["k"], "v", buckets=8)
    write(spark.range(100).selectExpr("id AS k", "1 AS v"), 0)
    files = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    write(spark.createDataFrame([(5, 2)], "k long, v int"), 1)
    assert sum(p not in files for p in folder.rglob("*.parquet")) == 1 and spark.read.parquet(str(folder)).count() == 100
    write(spark.createDataFrame([], "k long, v int"), 2)
    assert spark.read.parquet(str(folder)).count() == 100


def test_a_feed_remembers_what_was_sent(spark, tmp_path):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    rows = [("t1", "a", "2024-01-15 10:00:05", "X", 1.0), ("t1", "a", "2024-01-15 10:00:00", "X", 2.0), ("t2", "a", "2024-01-15 10:00:00", "X", 1.0), ("t3", None, "2024-01-15 10:00:00", "X", 1.0)]
    events = spark.createDataFrame(rows, "transaction_id string, account_id string, event_time string, event_type string, amount double")
    first = sinks.outgoing(events, at)
    assert {(r["transaction_id"], r["amount"]) for r in first.collect()} == {("t1", 2.0), ("t2", 1.0)}
    sent = spark.createDataFrame([("t1", "2024-01-15 11:30:00"), ("t2", "2024-01-15 10:30:00")], "_dedup_key string, processing_time string").withColumn("processing_time", F.col("processing_time").cast("timestamp"))
    assert {r["transaction_id"] for r in sinks.outgoing(events, at, sent).collect()} == {"t2"}
    sinks.write_feed(events, str(tmp_path))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path)).collect()]
    assert {x["transaction_id"] for x in lines} == {"t1", "t2"} and all(x["_dedup_key"] and x["processing_time"] for x in lines)


def test_a_stream_of_json_files(spark, tmp_path):
    for k in range(3):
        line = json.dumps({"transaction_id": f"t{k}", "account_id": "a", "event_time": "2024-01-15T12:00:00Z", "data": {"amount": k}})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    got = run.drain(readers.event_stream(spark, str(tmp_path / "in")).select("transaction_id", "amount"), str(tmp_path / "out"))
    assert {(r["transaction_id"], r["amount"]) for r in got.collect()} == {("t0", 0.0), ("t1", 1.0), ("t2", 2.0)}


SCHEMA = "transaction_id string, account_id string, event_time timestamp, amount double, merchant_id string, processing_time timestamp"


def arriving(spark, folder, batches):
    for batch in batches:
        rows = [(i, "acc", BASE + dt.timedelta(minutes=t), 1.0, None, BASE + dt.timedelta(minutes=p)) for i, t, p in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_routes_in_folders_and_periodic_batches(spark, tmp_path):
    """With state in RocksDB and a batch each so often; what comes too late is put aside."""
    folder, before = str(tmp_path), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run.use_rocksdb(spark)
    try:
        stream = arriving(spark, folder, [[("a", 0, 0), ("b", 30, 30)], [("late", 28, 31), ("gone", 1, 32)]])
        query = run.follow(features.rolling(stream, 5, 300), folder, features.split_by_route(folder), every="1 second")
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {r["transaction_id"]: r["route"] for r in spark.read.parquet(f"{folder}/vectors").collect()} == {"a": "on_time", "b": "on_time", "late": "late"}
    assert [r["transaction_id"] for r in spark.read.parquet(f"{folder}/late").collect()] == ["gone"]


def test_counters_of_a_stream(spark, tmp_path):
    folder, seen = str(tmp_path), []
    stream = features.ingest_metrics(arriving(spark, folder, [[("a", 0, 0), ("a", 0, 0), ("b", 0, 15), ("c", 20, 21)]]), "event_time")
    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    seen = [p["observedMetrics"]["ingest"] for p in query.recentProgress if p["observedMetrics"]]
    total = json.loads(seen[0].json) if hasattr(seen[0], "json") and not callable(seen[0].json) else dict(seen[0].asDict() if hasattr(seen[0], "asDict") else seen[0])
    assert (total["rows"], total["late"], total["lag_seconds"], total["duplicates"], total["without_time"]) == (4, 1, 900, 1, 0)


def test_delay_over_clock_skew():
    assert run.watermark_delay(5) == "5 seconds" and run.watermark_delay(5, 10) == "15 seconds"


def test_random_ids(spark):
    ids = [r["transaction_id"] for r in readers.generate(spark, 50, random_ids=True).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 36 and i[14] == "4" for i in ids)


def test_sketches_are_within_their_error(spark, sf):
    """The sketch of lg 12 has a standard error of 1.6 %; merged ones, too."""
    rows = spark.range(60_000).selectExpr("id % 3 AS account_id", "timestamp_ntz'2024-01-15' + make_dt_interval(0, CAST(id % 24 AS INT)) AS event_time", "1.0D AS amount", "CAST(id % 20000 AS STRING) AS merchant_id")
    for r in states.merge(states.hourly_states(rows), ["account_id"]).collect():
        exact = rows.filter(F.col("account_id") == r["account_id"]).select("merchant_id").distinct().count()
        assert abs(r["merchants"] - exact) <= 0.06 * exact
    small = transactions(spark, sf)
    exact = {r["account_id"]: r["n"] for r in small.groupBy("account_id").agg(F.countDistinct("merchant_id").alias("n")).collect()}
    assert all(abs(r["merchants"] - exact[r["account_id"]]) <= 1 for r in states.merge(states.hourly_states(small), ["account_id"]).collect())
