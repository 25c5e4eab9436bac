"""Schemas of the data model and the canonical columns that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A change event as it arrives, JSON.
EVENT = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("processing_time", T.StringType()),
        T.StructField("watermark", T.StringType()),
        T.StructField("_dedup_key", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("amount", T.DoubleType()),
                    T.StructField("currency", T.StringType()),
                    T.StructField("merchant_id", T.StringType()),
                    T.StructField("category", T.StringType()),
                ]
            ),
        ),
    ]
)

#: The other wire shape: event_id, payload, schema_version.
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("account_id", T.StringType()),
                    T.StructField("amount", T.DoubleType()),
                    T.StructField("currency", T.StringType()),
                    T.StructField("merchant_id", T.StringType()),
                    T.StructField("category", T.StringType()),
                ]
            ),
        ),
    ]
)

FEATURES = ("transaction_count_1h", "transaction_count_24h", "total_amount_1h", "total_amount_24h", "avg_amount_1h", "avg_amount_24h", "unique_merchants_24h", "max_amount_24h", "min_amount_24h", "risk_score")

AUDIT = "timestamp timestamp, event_id string, operation string, user_id string, account_id string, resource string, action string, status string, latency_ms double, metadata string, prev_checksum string, checksum string"
TOKENS = "token_id string, original_value string, pii_type string, created_at timestamp, expires_at timestamp"


def flatten(events: DataFrame) -> DataFrame:
    """Nested events to flat ones, with the defaults '' / 0.0 / 'USD' / NULL for what is absent."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return events.select(
        text("transaction_id"),
        text("account_id"),
        text("event_time"),
        text("event_type"),
        F.coalesce("data.amount", F.lit(0.0)).alias("amount"),
        F.coalesce("data.currency", F.lit("USD")).alias("currency"),
        F.col("data.merchant_id").alias("merchant_id"),
        F.col("data.category").alias("category"),
        "processing_time",
        "watermark",
    )


def from_envelope(events: DataFrame) -> DataFrame:
    """The other wire shape to the same flat columns."""
    return events.select(
        F.coalesce("event_id", F.lit("")).alias("transaction_id"),
        F.coalesce("payload.account_id", F.lit("")).alias("account_id"),
        F.coalesce("event_time", F.lit("")).alias("event_time"),
        F.coalesce("event_type", F.lit("")).alias("event_type"),
        F.coalesce("payload.amount", F.lit(0.0)).alias("amount"),
        F.coalesce("payload.currency", F.lit("USD")).alias("currency"),
        F.col("payload.merchant_id").alias("merchant_id"),
        F.col("payload.category").alias("category"),
        F.lit(None).cast("string").alias("processing_time"),
        F.lit(None).cast("string").alias("watermark"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table in canonical columns; processing time follows event time by up to 15 minutes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("category"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").alias("merchant_id"),
        (F.col("ts") + F.make_dt_interval(secs=F.pmod(F.col("event_id") * 7919, F.lit(900)))).alias("processing_time"),
    )


def with_duplicates(tx: DataFrame) -> DataFrame:
    """Every tenth event a second time, as a retry would deliver it: later, in a higher version."""
    again = tx.filter("transaction_id % 10 = 0").withColumn("version", F.lit(2).cast("bigint"))
    again = again.withColumn("processing_time", F.col("processing_time") + F.expr("INTERVAL 60 SECONDS"))
    return tx.withColumn("version", F.lit(1).cast("bigint")).unionByName(again)
