"""Where rows come from: tables, JSON change feeds, database changes, generated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import new_id
from tidemark.model import EVENT, flatten


# Payloads that ingestion is tried with.
MALFORMED = [
    {},
    {"account_id": None},
    {"transaction_id": ""},
    {"account_id": "acc", "event_time": "not-a-date"},
    {"account_id": "acc", "amount": "Infinity"},
    {"account_id": "acc", "amount": "NaN"},
    {"account_id": "acc" * 1000},
    {chr(i): "value" for i in range(32, 256)},
]
SQL_TEXTS = ["'; DROP TABLE users; --", "' OR '1'='1", "1; DELETE FROM features", "UNION SELECT * FROM secrets", "'; EXEC xp_cmdshell('rm -rf /'); --"]
SCRIPT_TEXTS = ["<script>alert('xss')</script>", "<img src=x onerror=alert(1)>", "javascript:alert(document.cookie)", "<svg onload=alert(1)>"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """A query with bound parameters; values never become part of its text."""
    return spark.sql(sql, args=parameters)


def events_from_json(lines: DataFrame, column: str = "value", schema: T.StructType = EVENT) -> DataFrame:
    """Flat events from JSON text, batch or stream. What isn't JSON has only defaults, for validation to find."""
    parsed = lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return flatten(parsed)


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of flat events from JSON lines that arrive as files; a new query begins with the earliest."""
    return flatten(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder))


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from Kafka, offsets tracked by the query's checkpoint. Needs Spark's Kafka connector."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return events_from_json(raw.select(F.col("value").cast("string").alias("value")))


def database_table(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], partitions: int, **options) -> DataFrame:
    """A full read of a source table over JDBC in key ranges, to begin with before changes are followed."""
    return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=options)


def unwrap_changes(changes: DataFrame, row: T.StructType, column: str = "value", keep_tombstones: bool = False) -> DataFrame:
    """Change records {op, ts_ms, before, after} as rows of their new state: deletes keep the old values with
    __deleted = true, null records are tombstones. Adds connect_timestamp."""
    schema = T.StructType([T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("before", row), T.StructField("after", row)])
    parsed = changes.withColumn("r_", F.from_json(column, schema))
    if not keep_tombstones:
        parsed = parsed.filter(F.col(column).isNotNull())
    state = F.coalesce("r_.after", "r_.before")
    values = [state[f.name].alias(f.name) for f in row.fields]
    return parsed.select(*values, (F.col("r_.op") == "d").alias("__deleted"), F.timestamp_millis(F.col("r_.ts_ms")).alias("connect_timestamp"))


def generate(spark: SparkSession, n: int = 1000, base: str = "2024-01-15 12:00:00", partitions: int | None = None, random_ids: bool = False) -> DataFrame:
    """Sample events: 1000 accounts, 100 merchants, 4 categories, one a second backwards from `base`. Their ids are
    numbers, or random."""
    i = F.col("id")
    categories = F.array(*map(F.lit, ("retail", "food", "travel", "entertainment")))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select(
        (new_id() if random_ids else F.concat(F.lit("tx_"), i)).alias("transaction_id"),
        F.format_string("ACC_%06d", F.pmod(i, F.lit(1000))).alias("account_id"),
        (F.lit(base).cast("timestamp_ntz") - F.make_dt_interval(secs=F.pmod(i, F.lit(86400)))).alias("event_time"),
        F.lit("TRANSACTION").alias("event_type"),
        (F.pmod(i, F.lit(10000)) / 100).alias("amount"),
        F.lit("USD").alias("currency"),
        F.format_string("MERCHANT_%03d", F.pmod(i, F.lit(100))).alias("merchant_id"),
        F.element_at(categories, (F.pmod(i, F.lit(4)) + 1).cast("int")).alias("category"),
    )


def adversarial_payloads(spark: SparkSession, now: str = "2024-01-15T12:00:00Z") -> DataFrame:
    """202 payloads (type, payload as JSON, expected), the same each time: 50 malformed events, 30 SQL injections,
    32 script injections, 20 traversals, 20 overflows, 25 poisoned schemas, 25 events from the future."""
    import json
    from datetime import datetime, timedelta

    odd, sql, scripts = MALFORMED, SQL_TEXTS, SCRIPT_TEXTS
    at = datetime.fromisoformat(now.replace("Z", "+00:00"))
    rows = [("malformed", odd[i % len(odd)], "rejected") for i in range(50)]
    rows += [("sql_injection", {"field": f"account_{i}", "value": sql[i % len(sql)]}, "tokenised") for i in range(30)]
    rows += [("xss", {"field": f"field_{i}", "value": scripts[i % len(scripts)]}, "tokenised") for i in range(32)]
    rows += [("path_traversal", {"path": "/".join([".."] * (1 + i % 10)) + "/etc/passwd"}, "blocked") for i in range(20)]
    rows += [("buffer_overflow", {"data": "A" * (1_000 + 5_210 * i)}, "truncated") for i in range(20)]
    rows += [("schema_poisoning", {"transaction_id": f"tx_{i}", "account_id": "acc_001", "event_time": "invalid-date-format", "amount": "not_a_number", "__proto__": "polluted", "constructor": {"prototype": {"admin": True}}}, "rejected") for i in range(25)]
    rows += [("future_timestamp", {"transaction_id": f"tx_future_{i}", "account_id": "acc_001", "event_time": (at + timedelta(days=365 + 130 * i)).isoformat(), "event_type": "TRANSACTION", "data": {"amount": 999999.99, "currency": "USD"}}, "watermarked") for i in range(25)]
    return spark.createDataFrame([(a, json.dumps(b), c) for a, b, c in rows], "type string, payload string, expected string")
