"""Event-time features on a stream: deduplication, windows, and rolling vectors with explicit lateness."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Units of state times.
MICRO = 1_000_000
#: The time of an event that is held in state.
TIME = itemgetter(0)


def deduplicated(stream: DataFrame, key: str, time: str, bound: str) -> DataFrame:
    """Each key once within `bound` of event time, which also bounds the state."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, bound).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, entity: str, time: str, value: str, size: str) -> DataFrame:
    """Counts and sums by tumbling window, after deduplicated()."""
    w = F.window(time, size)
    return stream.groupBy(entity, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(entity, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


def tumbling_categories(stream: DataFrame, entity: str, time: str, category: str, size: str) -> DataFrame:
    w = F.window(time, size)
    return stream.groupBy(entity, w.alias("w"), category).agg(F.count("*").alias("n")).select(entity, F.col("w.start").cast("timestamp_ntz").alias("window_start"), category, "n")


STATE = "ids array<string>, times array<bigint>, amounts array<double>, merchants array<string>, latest bigint, dropped bigint"
VECTOR = (
    "account_id {kind}, transaction_id string, feature_timestamp timestamp, transaction_count_1h bigint, transaction_count_24h bigint, "
    "total_amount_1h double, total_amount_24h double, unique_merchants_24h bigint, route string, op int"
)


def rolling(stream: DataFrame, delay_seconds: int = 5, allowed_seconds: int = 300, policy: str = "monotone", corrections: bool = False) -> DataFrame:
    """A vector per accepted transaction (transaction_id, account_id, event_time, amount, merchant_id) and its route.

    The watermark of an account is its latest event time less the delay. Policy `monotone`: an event below it is late,
    one below it by more than what is allowed too late; that is routed, not counted, and not remembered. Policy `none`
    takes all events as on time. State holds an account's last 24 hours and what is allowed, each id once; a repeated
    id gives no vector. With `corrections` a late event also takes back and replaces the vectors of the events of the
    24 hours after it: rows of op -1 and +1.
    """
    hour, day = 3600 * MICRO, 86400 * MICRO
    kind = stream.schema["account_id"].dataType.simpleString()
    keep = day + (delay_seconds + allowed_seconds) * MICRO

    def between(events, low, high):
        return events[bisect_left(events, low, key=TIME) : bisect_right(events, high, key=TIME)]

    def vector(key, events, event, route, op):
        at, tid, _, _ = event
        long = between(events, at - day, at)
        short = between(long, at - hour, at)
        return (key, tid, pd.Timestamp(at, unit="us"), len(short), len(long), round(sum(e[2] for e in short), 2), round(sum(e[2] for e in long), 2), len({e[3] for e in long if e[3]}), route, op)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times, amounts, merchants, latest, dropped = state.get if state.exists else ([], [], [], [], None, 0)
        # In order of time throughout, so that frames are found by bisection.
        events = sorted(zip(times, ids, amounts, merchants, strict=True), key=TIME)
        seen, out = set(ids), []
        rows = pd.concat(list(batches)).sort_values(["arrival", "transaction_id"])
        for tid, at, amount, merchant in zip(rows["transaction_id"], rows["at"], rows["amount"], rows["merchant_id"], strict=True):
            at = int(at)
            if tid in seen:
                continue
            route = "on_time"
            if policy == "monotone" and latest is not None and at < latest - delay_seconds * MICRO:
                route = "late" if at >= latest - (delay_seconds + allowed_seconds) * MICRO else "too_late"
            if route == "too_late":
                dropped += 1
                out.append((key[0], tid, pd.Timestamp(at, unit="us"), 0, 0, 0.0, 0.0, 0, route, 0))
                continue
            stale = between(events, at + 1, at + day) if corrections and route == "late" else []
            out += [vector(key[0], events, e, "retraction", -1) for e in stale]
            seen.add(tid)
            event = (at, tid, float(amount), merchant)
            insort(events, event, key=TIME)
            out.append(vector(key[0], events, event, route, 1))
            out += [vector(key[0], events, e, "retraction", 1) for e in stale]
            latest = at if latest is None else max(latest, at)
        if policy == "monotone" and latest is not None:
            events = events[bisect_left(events, latest - keep, key=TIME) :]
        times, ids, amounts, merchants = [list(x) for x in zip(*events, strict=True)] if events else [[], [], [], []]
        state.update((ids, times, amounts, merchants, latest, dropped))
        yield pd.DataFrame(out, columns=["account_id", "transaction_id", "feature_timestamp", "transaction_count_1h", "transaction_count_24h", "total_amount_1h", "total_amount_24h", "unique_merchants_24h", "route", "op"])

    at = F.unix_micros(F.col("event_time").cast("timestamp"))
    arrival = F.unix_micros(F.col("processing_time").cast("timestamp")) if "processing_time" in stream.columns else at
    rows = stream.select(F.col("account_id"), F.col("transaction_id").cast("string").alias("transaction_id"), at.alias("at"), arrival.alias("arrival"), F.col("amount").cast("double").alias("amount"), F.coalesce("merchant_id", F.lit("")).alias("merchant_id"))
    return rows.groupBy("account_id").applyInPandasWithState(step, VECTOR.format(kind=kind), STATE, "append", GroupStateTimeout.NoTimeout)


def split_by_route(folder: str):
    """For foreachBatch: vectors and dropped events to tables of their own, a batch replacing itself when repeated."""

    def run(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        rows.filter("route <> 'too_late'").write.mode("overwrite").parquet(f"{folder}/vectors/batch={batch_id}")
        rows.filter("route = 'too_late'").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        rows.unpersist()

    return run


def ingest_metrics(stream: DataFrame, time: str, arrival: str = "processing_time", key: str = "transaction_id", late: str = "10 MINUTES") -> DataFrame:
    """Counters that each batch reports with its progress: rows, nulls, the latest event time, rows that arrived `late` or
    later, the greatest lag in seconds, and about how many rows repeat a key of the batch."""
    lag = F.unix_timestamp(F.col(arrival).cast("timestamp")) - F.unix_timestamp(F.col(time).cast("timestamp"))
    return stream.observe(
        "ingest", F.count("*").alias("rows"), F.count(F.when(F.col(time).isNull(), 1)).alias("without_time"), F.max(time).alias("latest"),
        F.count(F.when(F.col(arrival) >= F.col(time) + F.expr(f"INTERVAL {late}"), 1)).alias("late"), F.max(lag).alias("lag_seconds"),
        F.greatest(F.count(key) - F.approx_count_distinct(key, 0.01), F.lit(0)).alias("duplicates"),
    )
