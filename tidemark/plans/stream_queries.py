"""Streaming queries, run over the events as files that arrive one after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.model import transactions, with_duplicates
from tidemark.plans.base import TX, query
from tidemark.streaming import features, run

NTZ = "timestamp_ntz"
SCHEMA = "transaction_id bigint, account_id bigint, event_time timestamp, category string, amount double, merchant_id string, processing_time timestamp, version bigint"


def arriving(spark, sf, folder: str, rows=None):
    """A stream over the events in four files by processing time, every tenth event twice; one file a batch."""
    d = rows if rows is not None else with_duplicates(transactions(spark, sf))
    d = d.withColumns({c: F.col(c).cast("timestamp") for c in ("event_time", "processing_time")}).select(*[x.split()[0] for x in SCHEMA.split(", ")])
    cuts = ["2024-01-08", "2024-01-15", "2024-01-22"]
    for i in range(4):
        part = d
        part = part.filter(F.col("processing_time") >= F.lit(cuts[i - 1]).cast("timestamp")) if i else part
        part = part.filter(F.col("processing_time") < F.lit(cuts[i]).cast("timestamp")) if i < 3 else part
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query(f"WITH {TX} SELECT account_id, date_trunc('hour', event_time) AS window_start, count(*) AS n, round(sum(amount), 2) AS total FROM tx GROUP BY ALL")
def stream_tumbling_1h(spark, sf):
    """Deduplicated hourly windows on a stream; the last state of each window is what a batch gives."""
    folder = run.workspace(spark)
    once = features.deduplicated(arriving(spark, sf, folder), "transaction_id", "event_time", "1 day")
    out = run.drain(features.tumbling(once, "account_id", "event_time", "amount", "1 hour"), folder, "update")
    last = out.groupBy("account_id", "window_start").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("account_id", "window_start", "x.n", F.round("x.total", 2).alias("total"))


@query(
    f"WITH {TX} SELECT transaction_id::VARCHAR AS transaction_id, count(*) OVER s AS transaction_count_1h, count(*) OVER l AS transaction_count_24h, round(sum(amount) OVER l * 100)::BIGINT AS total_cents_24h, count(DISTINCT nullif(merchant_id, '')) OVER l AS unique_merchants_24h FROM tx WINDOW s AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), l AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)"
)
def stream_rolling_vectors(spark, sf):
    """Vectors from a stateful operator, events in the order of their times, duplicates passed over: as in a batch."""
    folder = run.workspace(spark)
    t = with_duplicates(transactions(spark, sf)).withColumn("processing_time", F.col("event_time"))
    out = run.drain(features.rolling(arriving(spark, sf, folder, t), policy="none"), folder)
    return out.select("transaction_id", "transaction_count_1h", "transaction_count_24h", F.round(F.col("total_amount_24h") * 100).cast("bigint").alias("total_cents_24h"), "unique_merchants_24h")


@query(
    f"WITH {TX}, m AS (SELECT *, max(event_time) OVER (PARTITION BY account_id ORDER BY processing_time, transaction_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 SECOND AS wm FROM tx) SELECT CASE WHEN wm IS NULL OR event_time >= wm THEN 'on_time' WHEN event_time >= wm - INTERVAL 300 SECOND THEN 'late' ELSE 'too_late' END AS route, count(*) AS n FROM m GROUP BY ALL"
)
def stream_late_routing(spark, sf):
    """Routes of events that arrive out of order, from the stateful operator."""
    folder = run.workspace(spark)
    t = transactions(spark, sf).withColumn("version", F.lit(1).cast("bigint"))
    out = run.drain(features.rolling(arriving(spark, sf, folder, t)), folder)
    return out.groupBy("route").agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT account_id, category, count(*) AS n FROM tx GROUP BY ALL")
def stream_category_counts(spark, sf):
    folder = run.workspace(spark)
    once = features.deduplicated(arriving(spark, sf, folder), "transaction_id", "event_time", "1 day")
    out = run.drain(features.tumbling_categories(once, "account_id", "event_time", "category", "1 day"), folder, "update")
    last = out.groupBy("account_id", "window_start", "category").agg(F.max_by("n", "batch").alias("n"))
    return last.groupBy("account_id", "category").agg(F.sum("n").alias("n"))
