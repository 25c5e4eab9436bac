"""Point-in-time correctness, idempotency and lateness on literal events."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import risk_score
from tidemark.operators import history as H
from tidemark.operators import windows as W
from tidemark.sources import readers, sinks
from tidemark.streaming import features, run

BASE = dt.datetime(2024, 1, 15, 12)
SCHEMA = "transaction_id string, account_id string, event_time timestamp_ntz, amount double, merchant_id string"


def events(spark, rows):
    return spark.createDataFrame([(i, "acc_001", t, a, None) for i, t, a in rows], SCHEMA)


def hourly(order=(1, 2, 3, 4, 5)):
    return [(f"tx_{i}", BASE - dt.timedelta(hours=i), 100.0 * i) for i in order]


def vector(spark, rows, at):
    found = H.as_of(W.rolling_features(events(spark, rows)), "account_id", "feature_timestamp", F.lit(at)).collect()
    return found[0] if found else None


@pytest.mark.parametrize("order", [(1, 2, 3, 4, 5), (5, 1, 3, 2, 4)])
def test_no_future_leakage(spark, order):
    assert vector(spark, hourly(order), BASE - dt.timedelta(hours=3))["transaction_count_24h"] == 3


def test_before_and_after_all_events(spark):
    assert vector(spark, [], BASE) is None
    assert vector(spark, hourly(), BASE - dt.timedelta(hours=9)) is None
    last = vector(spark, hourly(), BASE)
    assert last["transaction_count_24h"] == 5 and last["total_amount_24h"] == 1500.0 and last["avg_amount_24h"] == 300.0


def test_an_event_of_the_future_changes_nothing(spark):
    at = BASE - dt.timedelta(hours=1)
    assert vector(spark, [*hourly(), ("tx_f", BASE + dt.timedelta(hours=1), 10000.0)], at) == vector(spark, hourly(), at)


def test_replay_and_permutation(spark):
    rows = hourly()
    shuffled = random.Random(1).sample(rows, len(rows))
    once = W.rolling_features(events(spark, rows))
    again = W.rolling_features(events(spark, shuffled + rows).dropDuplicates(["transaction_id"]))
    assert H.changelog(once, again).count() == 0


@pytest.mark.parametrize("by_account", [False, True])
def test_rolling_features_by_hand(spark, by_account):
    """Frames over block bounds, ties, repeats, nulls in any column, times before 1970, all compared in plain Python."""
    rng = random.Random(7)
    at = lambda: rng.choice([BASE, dt.datetime(1969, 12, 30)]) + dt.timedelta(minutes=20 * rng.randrange(400), microseconds=rng.choice([0, 0, 1, 999_999]))
    rows = [(str(i), rng.choice(["a", "b", None]), at() if i % 40 else None, rng.choice([None, 1.25, -2.5, 700.0]), rng.choice([None, "", "m", "n", "o"])) for i in range(400)]
    rows += [("x", "a", BASE + dt.timedelta(hours=24), 5.0, "m"), ("x", "a", BASE + dt.timedelta(hours=24), 5.0, "m"), ("y", "a", BASE, 1.0, "only")]
    got = W.rolling_features(spark.createDataFrame(rows, SCHEMA), by_account=by_account)
    names = ["transaction_id", "transaction_count_1h", "transaction_count_24h", "total_amount_1h", "total_amount_24h", "unique_merchants_24h", "max_amount_24h", "min_amount_24h"]

    def vector(i, account, time, *_):
        inside = lambda hours: [r for r in rows if r[1] == account and (r[2] is None if time is None else r[2] is not None and time - dt.timedelta(hours=hours) <= r[2] <= time)]
        short, long = ([r[3] for r in inside(h) if r[3] is not None] for h in (1, 24))
        known = lambda f, values: f(values) if values else None
        return (i, len(inside(1)), len(inside(24)), known(sum, short), known(sum, long), len({r[4] for r in inside(24) if r[4]}), known(max, long), known(min, long))

    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted((vector(*r) for r in rows), key=repr)
    assert W.rolling_features(spark.createDataFrame([], SCHEMA), by_account=by_account).count() == 0


@pytest.mark.parametrize("by_account", [False, True])
def test_totals_are_added_up_in_order_of_time(spark, by_account):
    """500 in cents is a little more when added up as doubles from first to last, wherever a block ends, so SQL has it above
    500; the last two may be at the same time, then by id."""
    amounts = [7.36, 9.2, 110.29, 132.31, 111.78, 118.11, 10.95]
    assert math.fsum(amounts) == 500 < list(itertools.accumulate(amounts))[-1]
    hours = lambda start, i: dt.timedelta(hours=start + (min(i, 5) if start % 2 else i))
    rows = [(f"{start}_{i}", str(start), BASE + hours(start, i), amounts[i], None) for start in range(24) for i in (6, 2, 0, 5, 1, 3, 4)]
    got = W.rolling_features(spark.createDataFrame(rows, SCHEMA), by_account=by_account).filter("transaction_count_24h = 7")
    assert [(r["total_amount_24h"], round(r["risk_score"], 6)) for r in got.collect()] == [(500.0, 0.3)] * 36


def test_duplicates_count_once(spark):
    total = lambda rows: events(spark, rows).dropDuplicates(["transaction_id"]).agg(F.sum("amount")).first()[0]
    rows = [("tx1", BASE, 100.0), ("tx1", BASE, 100.0), ("tx2", BASE, 200.0)]
    assert total(rows) == total([rows[2], rows[0], rows[1]]) == 300


@pytest.mark.parametrize("start", [BASE, BASE.replace(microsecond=900_000)])
def test_both_kinds_of_sessions_count_whole_seconds(spark, start):
    """A gap of 1,800 boundaries goes on whatever the microseconds, one of 1,801 doesn't."""
    times, at = [start], start.replace(microsecond=0)
    for seconds, micros in ((1800, 0), (1800, 999_999), (1801, 0), (1800, 999_999), (1800, 0), (1801, 999_999)):
        at += dt.timedelta(seconds=seconds)
        times.append(at + dt.timedelta(microseconds=micros))
    want = [("acc_001", times[i], times[j - 1], j - i) for i, j in ((0, 3), (3, 6), (6, 7))]
    df = events(spark, [(str(i), t, 1.0) for i, t in enumerate(times)])
    for found in (W.session_windows(df, "account_id", "event_time"), W.sessions(df, "account_id", "event_time")):
        assert sorted(map(tuple, found.select("account_id", "session_start", "session_end", "n_events").collect())) == want


def test_lateness_policies(spark):
    late = events(spark, [("tx_old", BASE - dt.timedelta(hours=1), 100.0)])
    route = late.select(W.lateness(late, "event_time", F.lit(BASE) - F.expr("INTERVAL 5 SECONDS"), "60 SECONDS").alias("r")).first()["r"]
    assert route == "too_late"
    near = events(spark, [("tx_late", BASE - dt.timedelta(minutes=2), 50.0)])
    assert near.select(W.lateness(near, "event_time", F.lit(BASE) - F.expr("INTERVAL 5 SECONDS"), "300 SECONDS").alias("r")).first()["r"] == "late"


@pytest.mark.parametrize(("n", "total", "want"), [(0, 0.0, 0.0), (1, 100.0, 0.0), (6, 600.0, 0.3), (11, 1100.0, 0.7), (2, 900.0, 0.3), (2, 1200.0, 0.7), (11, 9000.0, 1.0)])
def test_risk(spark, n, total, want):
    assert spark.range(1).select(risk_score(F.lit(n), F.lit(total)).alias("r")).first()["r"] == pytest.approx(want)


def test_ties_and_nulls_in_asof_joins(spark):
    left = spark.createDataFrame([(1, "a", BASE), (2, None, BASE), (3, "b", BASE)], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", BASE, 1.0, 1), ("a", BASE, None, 2), (None, BASE, 9.0, 1), ("b", BASE + dt.timedelta(seconds=1), 5.0, 1)], "k string, t timestamp_ntz, v double, seq int")
    got = {r["id"]: (r["v"], r["seq"]) for r in H.asof_join(left, right, ["k"], "t", "t", ["v", "seq"], ties=["seq"]).collect()}
    # The last right row of the same time counts, null value and all; a null key matches none.
    assert got == {1: (None, 2), 2: (None, None), 3: (None, None)}
    ahead = {r["id"]: r["v"] for r in H.asof_join(left, right, ["k"], "t", "t", ["v"], forward=True, tolerance="1 SECONDS").collect()}
    assert ahead[3] == 5.0 and ahead[2] is None


def test_bad_events_are_quarantined(spark):
    from tidemark.governance.quality import errors, quarantine

    lines = spark.createDataFrame([("{}",), ('{"account_id": "acc"}',), ('{"account_id": null}',), ('{"transaction_id": "t", "account_id": "a", "event_time": "invalid-date"}',), ("not json",), ('{"account_id": "a", "event_time": "2024-01-15T12:00:00Z", "data": {"amount": 5}}',)], "value string")
    good, bad = quarantine(readers.events_from_json(lines), errors(["account_id", "event_time"], "amount", "event_time"))
    assert good.count() == 1 and bad.count() == 5


def test_snapshots_on_disk(spark, tmp_path):
    v = W.rolling_features(events(spark, hourly()))
    sinks.write_snapshots(sinks.snapshots(v), str(tmp_path / "s"))
    got = sinks.read_snapshots(spark, str(tmp_path / "s"), "2024-01-15 09:30:00")
    assert got.count() == 3
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()


def test_upsert_batches(spark, tmp_path):
    write = sinks.upsert_batch(str(tmp_path / "t"), ["k"], "v")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int, x string")
    for batch in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (2, 0, "old")], [(1, 2, "c"), (2, 0, "old")]):
        write(frame(batch), 0)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, 2, "c"), (2, 1, "b")]


def stream_of(spark, folder, rows):
    schema = "transaction_id string, account_id string, event_time timestamp, amount double, merchant_id string, processing_time timestamp"
    for k, batch in enumerate(rows):
        data = [(i, "acc_001", t, a, None, p) for i, t, a, p in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_a_late_event_replaces_vectors(spark, tmp_path):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    folder = str(tmp_path)
    batches = [[("a", at(0), 100.0, at(0)), ("b", at(3), 10.0, at(3))], [("late", at(1), 5000.0, at(4)), ("gone", at(-60), 1.0, at(5)), ("b", at(3), 10.0, at(6))]]
    out = run.drain(features.rolling(stream_of(spark, folder, batches), 5, 300, corrections=True), folder).collect()
    by = {(r["transaction_id"], r["op"]): r for r in out}
    assert by["late", 1]["route"] == "late" and by["gone", 0]["route"] == "too_late"
    old, new = by["b", -1], next(r for r in out if r["transaction_id"] == "b" and r["op"] == 1 and r["route"] == "retraction")
    assert new["total_amount_24h"] == old["total_amount_24h"] + 5000 and new["transaction_count_24h"] == 3
    assert sum(r["transaction_id"] == "b" and r["route"] == "on_time" for r in out) == 1


def test_events_out_of_order_on_a_stream(spark, tmp_path):
    """Every vector has the events that came before it and are in its frame, in whatever order of time they came."""
    rng = random.Random(3)
    came = [(f"t{i:03}", BASE + dt.timedelta(minutes=rng.randrange(4000)), float(rng.randrange(100)), BASE + dt.timedelta(days=9, seconds=i)) for i in range(120)]
    out = {r["transaction_id"]: r for r in run.drain(features.rolling(stream_of(spark, str(tmp_path), [came[:50], came[50:]]), policy="none"), str(tmp_path)).collect()}
    assert len(out) == 120
    for k, (i, t, _, _) in enumerate(came):
        inside = lambda hours: [a for _, u, a, _ in came[: k + 1] if t - dt.timedelta(hours=hours) <= u <= t]  # noqa: B023, E731
        r = out[i]
        assert (r["transaction_count_1h"], r["transaction_count_24h"], r["total_amount_1h"], r["total_amount_24h"]) == (len(inside(1)), len(inside(24)), sum(inside(1)), sum(inside(24)))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder = str(tmp_path)
    at = lambda m: BASE + dt.timedelta(minutes=m)
    first = stream_of(spark, folder, [[("a", at(0), 1.0, at(0))]])
    assert run.drain(features.rolling(first, policy="none"), folder).count() == 1
    second = stream_of(spark, folder, [[("a", at(0), 1.0, at(1)), ("c", at(2), 2.0, at(2))]])
    out = {r["transaction_id"]: r["transaction_count_24h"] for r in run.drain(features.rolling(second, policy="none"), folder).collect()}
    assert out == {"a": 1, "c": 2}
    state = run.saved_state(spark, folder).first()
    assert state["key"]["account_id"] == "acc_001" and len(state["value"]["groupState"]["ids"]) == 2
