"""Queries over ingestion: parsing, keys, validation, change records, feeds, adversarial payloads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as X
from tidemark.governance import quality as Q
from tidemark.governance import registry as R
from tidemark.model import from_envelope, transactions, with_duplicates
from tidemark.plans.base import DUP, TX, query
from tidemark.sources import readers, sinks

NTZ = "timestamp_ntz"
BASE = "2024-01-15 12:00:00"


def as_json(spark, sf):
    """The events as they would arrive: nested JSON, every 13th without its amount, every 17th with a bad time, every
    19th without an account, every 23rd with text for an amount."""
    t = transactions(spark, sf)
    i = F.col("transaction_id")
    time = F.when(i % 17 == 0, "invalid-date").otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    amount = F.when(i % 13 == 0, F.lit(None)).when(i % 23 == 0, F.lit('"many"')).otherwise(F.round("amount", 2).cast("string"))
    account = F.when(i % 19 == 0, F.lit(None)).otherwise(F.concat(F.lit('"account_id":"acc_'), F.col("account_id"), F.lit('",')))
    return t.select(
        i.alias("id"),
        F.concat(F.lit('{"transaction_id":"tx_'), i, F.lit('",'), F.coalesce(account, F.lit("")), F.lit('"event_time":"'), time, F.lit('","event_type":"TRANSACTION","data":{'), F.coalesce(F.concat(F.lit('"amount":'), amount, F.lit(",")), F.lit("")), F.lit('"merchant_id":"m'), "merchant_id", F.lit('","category":"'), "category", F.lit('"}}')).alias("value"),
    )


@query(
    f"WITH {TX} SELECT 'tx_' || transaction_id AS transaction_id, CASE WHEN transaction_id % 19 = 0 THEN '' ELSE 'acc_' || account_id END AS account_id, CASE WHEN transaction_id % 17 <> 0 THEN event_time END AS event_time, CASE WHEN transaction_id % 13 = 0 OR transaction_id % 23 = 0 THEN 0::DOUBLE ELSE round(amount, 2) END AS amount, 'USD' AS currency, 'm' || merchant_id AS merchant_id, category FROM tx"
)
def flat_events_from_json(spark, sf):
    flat = readers.events_from_json(as_json(spark, sf))
    return flat.select("transaction_id", "account_id", X.parse_event_time(F.col("event_time")).cast(NTZ).alias("event_time"), "amount", "currency", "merchant_id", "category")


@query(f"WITH {TX} SELECT 'tx_' || transaction_id AS transaction_id, 'acc_' || account_id AS account_id, round(amount, 2) AS amount, 'EUR' AS currency FROM tx")
def envelope_events(spark, sf):
    t = transactions(spark, sf)
    payload = F.struct(F.concat(F.lit("acc_"), "account_id").alias("account_id"), F.round("amount", 2).alias("amount"), F.lit("EUR").alias("currency"), "merchant_id", "category")
    lines = t.select(F.to_json(F.struct(F.concat(F.lit("tx_"), "transaction_id").alias("event_id"), F.lit("T").alias("event_type"), payload.alias("payload"))).alias("value"))
    from tidemark.model import ENVELOPE

    return from_envelope(lines.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")).select("transaction_id", "account_id", "amount", "currency")


@query(f"WITH {TX} SELECT transaction_id % 17 = 0 AS bad_time, transaction_id % 19 = 0 AS no_account, count(*) AS n FROM tx WHERE transaction_id % 17 = 0 OR transaction_id % 19 = 0 GROUP BY ALL")
def quarantined_events(spark, sf):
    """Events that fail the boundary's rules, by what is wrong with them."""
    flat = readers.events_from_json(as_json(spark, sf))
    _, bad = Q.quarantine(flat, Q.errors(["account_id", "event_time"], "amount", "event_time"))
    has = lambda m: F.array_contains("errors", m)
    return bad.groupBy(has("event_time can't be read").alias("bad_time"), has("missing account_id").alias("no_account")).agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT count(*) FILTER (transaction_id % 17 <> 0 AND transaction_id % 19 <> 0) AS valid FROM tx")
def valid_events(spark, sf):
    flat = readers.events_from_json(as_json(spark, sf))
    good, _ = Q.quarantine(flat, Q.errors(["account_id", "event_time"], "amount", "event_time"))
    return good.agg(F.count("*").alias("valid"))


@query(
    f"WITH {TX} SELECT transaction_id AS id, rtrim(CASE WHEN transaction_id % 19 = 0 THEN 'missing account_id;' ELSE '' END || CASE WHEN transaction_id % 13 = 0 THEN '' WHEN transaction_id % 23 = 0 THEN 'type of data.amount;' ELSE '' END, ';') AS errors FROM tx"
)
def registry_validation(spark, sf):
    """Events against the registered schema, records included."""
    registry = R.Registry()
    registry.register("transactions", R.TRANSACTION)
    found = R.validate_json(as_json(spark, sf), "value", registry.schema("transactions"))
    return found.select("id", F.array_join("errors", ";").alias("errors"))


@query(
    f"WITH {TX} SELECT transaction_id, CASE WHEN transaction_id % 5 = 0 THEN substr(sha256(account_id || '|' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || '|' || category || '|' || CAST(round(amount * 100)::BIGINT AS VARCHAR)), 1, 32) ELSE transaction_id::VARCHAR END AS dedup_key, concat_ws(':', 'pg', 'transactions', transaction_id::VARCHAR, strftime(event_time, '%Y-%m-%d %H:%M:%S'), version::VARCHAR) AS change_key FROM (SELECT *, 1 AS version FROM tx)"
)
def dedup_keys(spark, sf):
    t = transactions(spark, sf)
    time = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")
    given = F.when(F.col("transaction_id") % 5 != 0, F.col("transaction_id"))
    cents = F.round(F.col("amount") * 100).cast("bigint")
    key = X.dedup_key(given, F.col("account_id"), time, F.col("category"), cents)
    return t.select("transaction_id", key.alias("dedup_key"), X.change_key(F.lit("pg"), F.lit("transactions"), F.col("transaction_id"), time, F.lit(1)).alias("change_key"))


@query(f"WITH {TX}, {DUP} SELECT account_id::VARCHAR AS key, count(DISTINCT transaction_id) AS n FROM dup WHERE transaction_id % 19 <> 0 GROUP BY ALL")
def outgoing_feed(spark, sf):
    """What an idempotent producer sends of events that partly come twice and partly lack a field."""
    d = with_duplicates(transactions(spark, sf)).withColumn("event_type", F.when(F.col("transaction_id") % 19 != 0, F.col("category")))
    return sinks.outgoing(d).groupBy("key").agg(F.count("*").alias("n"))


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("account", T.LongType()), T.StructField("amount", T.DoubleType())])


@query(f"WITH {TX} SELECT transaction_id AS id, account_id AS account, round(amount, 2) AS amount, transaction_id % 3 = 0 AS __deleted, make_timestamp((1700000000000 + transaction_id) * 1000) AS connect_timestamp FROM tx WHERE transaction_id % 11 <> 0")
def unwrapped_changes(spark, sf):
    """Change records to rows: deletes keep their last values, tombstones go."""
    t = transactions(spark, sf)
    row = F.struct(F.col("transaction_id").alias("id"), F.col("account_id").alias("account"), F.round("amount", 2).alias("amount"))
    deleted = F.col("transaction_id") % 3 == 0
    record = F.to_json(F.struct(F.when(deleted, "d").otherwise("c").alias("op"), (F.col("transaction_id") + 1700000000000).alias("ts_ms"), F.when(deleted, row).alias("before"), F.when(~deleted, row).alias("after")))
    changes = t.select(F.when(F.col("transaction_id") % 11 != 0, record).alias("value"))
    out = readers.unwrap_changes(changes, ROW)
    return out.withColumn("connect_timestamp", F.col("connect_timestamp").cast(NTZ))


@query("SELECT 'tx_' || i AS transaction_id, printf('ACC_%06d', i % 1000) AS account_id, TIMESTAMP '2024-01-15 12:00:00' - to_seconds(i % 86400) AS event_time, (i % 10000) / 100.0::DOUBLE AS amount, printf('MERCHANT_%03d', i % 100) AS merchant_id, ['retail', 'food', 'travel', 'entertainment'][(i % 4) + 1] AS category FROM range(5000) t(i)")
def generated_events(spark, sf):
    return readers.generate(spark, 5000).select("transaction_id", "account_id", "event_time", "amount", "merchant_id", "category")


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, date_trunc('second', ts) AS second, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day, strftime(ts, '%Y%m%d') AS day_key, strftime(ts, '%Y%m') AS month_key, date_diff('second', TIMESTAMP '2024-01-01', ts) AS seconds, CASE WHEN date_diff('second', TIMESTAMP '2024-01-15', ts) > 0 THEN 1 ELSE 0 END AS later FROM events"
)
def time_functions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    cut = lambda unit: F.date_trunc(unit, ts).cast(NTZ)
    gap = X.second_difference(F.lit("2024-01-01").cast(NTZ), F.col("ts"))
    later = F.when(X.second_difference(F.lit("2024-01-15").cast(NTZ), F.col("ts")) > 0, 1).otherwise(0)
    return e.select("event_id", X.iso_format(ts).alias("iso"), cut("second").alias("second"), cut("hour").alias("hour"), cut("day").alias("day"), X.day_key(F.col("ts")).alias("day_key"), X.month_key(F.col("ts")).alias("month_key"), gap.alias("seconds"), later.alias("later"))


@query("SELECT event_id, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '%Y-%m-%dT%H:%M:%S.%f') AS from_z, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '%Y-%m-%dT%H:%M:%S.%f') - INTERVAL 2 HOUR AS from_offset, NULL::TIMESTAMP AS from_garbage FROM events")
def parsed_times(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    read = lambda c: X.parse_event_time(c).cast(NTZ)
    return e.select("event_id", read(F.concat(text, F.lit("Z"))).alias("from_z"), read(F.concat(text, F.lit("+02:00"))).alias("from_offset"), read(F.concat(text, F.lit("?"))).alias("from_garbage"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS encoded, user_id AS decoded FROM events")
def json_round_trip(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    decoded = F.from_json(F.to_json(F.struct("user_id")), "user_id bigint")["user_id"]
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("encoded"), decoded.alias("decoded"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL AS is_int, TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS is_double, true AS is_string FROM events")
def type_checks(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", X.is_of_type(F.get_json_object("props", "$.k"), "int").alias("is_int"), X.is_of_type(F.col("event_type"), "double").alias("is_double"), X.is_of_type(F.col("event_type"), "string").alias("is_string"))


@query("SELECT event_id, value AS amount, 'USD' AS currency, CASE WHEN event_type = 'click' THEN 'yes' ELSE 'no' END AS clicked FROM events")
def map_defaults(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    m = F.create_map(F.lit("amount"), F.col("value").cast("string"), F.when(F.col("event_type") == "click", "clicked").otherwise("other"), F.lit("yes"))
    return e.select("event_id", X.with_default(m, "amount", "0").cast("double").alias("amount"), X.with_default(m, "currency", "USD").alias("currency"), X.with_default(m, "clicked", "no").alias("clicked"))


@query("SELECT doc_id, substr(text, 1, 10000) AS text, length(text) > 10000 AS truncated FROM documents")
def truncated_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.substring("text", 1, Q.MAX_TEXT).alias("text"), (F.length("text") > Q.MAX_TEXT).alias("truncated"))


@query("SELECT * FROM (VALUES ('buffer_overflow', 20::BIGINT, 20::BIGINT, 1::DOUBLE), ('future_timestamp', 25, 25, 1), ('malformed', 50, 50, 1), ('path_traversal', 20, 20, 1), ('schema_poisoning', 25, 25, 1), ('sql_injection', 30, 30, 1), ('xss', 32, 32, 1)) t(type, n, passed, rate)")
def adversarial_tally(spark, sf):
    """202 payloads, how many of each kind are handled as expected, and the rate."""
    judged = Q.verdict_on_payload(readers.adversarial_payloads(spark), F.lit("2024-01-15 12:00:00").cast("timestamp"), b"0123456789abcdef" * 2)
    return judged.groupBy("type").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("rate"))


COMPATIBLE = """
WITH f(change, side, name, kind, optional) AS (VALUES
 ('same', 'old', 'a', 'int', false), ('same', 'new', 'a', 'int', false),
 ('add_optional', 'old', 'a', 'int', false), ('add_optional', 'new', 'a', 'int', false), ('add_optional', 'new', 'b', 'string', true),
 ('add_required', 'old', 'a', 'int', false), ('add_required', 'new', 'a', 'int', false), ('add_required', 'new', 'b', 'string', false),
 ('drop_optional', 'old', 'a', 'int', false), ('drop_optional', 'old', 'b', 'string', true), ('drop_optional', 'new', 'a', 'int', false),
 ('drop_required', 'old', 'a', 'int', false), ('drop_required', 'old', 'b', 'string', false), ('drop_required', 'new', 'a', 'int', false),
 ('widen_type', 'old', 'a', 'int', false), ('widen_type', 'new', 'a', 'double', false),
 ('narrow_type', 'old', 'a', 'double', false), ('narrow_type', 'new', 'a', 'int', false)),
rank(kind, family, level) AS (VALUES ('int', 'number', 1), ('long', 'number', 2), ('float', 'number', 3), ('double', 'number', 4), ('string', 'text', 1), ('bytes', 'text', 2)),
m AS (SELECT coalesce(o.change, n.change) AS change, o.name IS NULL AS added, n.name IS NULL AS dropped, coalesce(o.optional, n.optional) AS optional,
 coalesce(ro.family = rn.family AND ro.level <= rn.level, false) AS promotable
 FROM (SELECT * FROM f WHERE side = 'old') o FULL JOIN (SELECT * FROM f WHERE side = 'new') n ON o.change = n.change AND o.name = n.name
 LEFT JOIN rank ro ON ro.kind = o.kind LEFT JOIN rank rn ON rn.kind = n.kind)
SELECT change, bool_and(CASE WHEN added THEN true WHEN dropped THEN optional ELSE promotable END) AS backward,
 bool_and(CASE WHEN dropped THEN true WHEN added THEN optional ELSE promotable END) AS forward,
 bool_and(CASE WHEN added OR dropped THEN optional ELSE promotable END) AS full_mode
FROM m GROUP BY change"""


@query(COMPATIBLE)
def schema_compatibility(spark, sf):
    """The compatibility rules over changes of a schema: fields in, fields out, types."""
    f = lambda name, kind="string", **more: {"name": name, "type": kind} | more
    schema = lambda *fields: {"type": "record", "fields": list(fields)}
    a, opt = f("a", "int"), f("b", nullable=True)
    changes = {
        "same": (schema(a), schema(a)),
        "add_optional": (schema(a), schema(a, opt)),
        "add_required": (schema(a), schema(a, f("b"))),
        "drop_optional": (schema(a, opt), schema(a)),
        "drop_required": (schema(a, f("b")), schema(a)),
        "widen_type": (schema(a), schema(f("a", "double"))),
        "narrow_type": (schema(f("a", "double")), schema(a)),
    }
    rows = [(k, *(R.compatible(old, new, m) for m in ("BACKWARD", "FORWARD", "FULL"))) for k, (old, new) in changes.items()]
    return spark.createDataFrame(rows, "change string, backward boolean, forward boolean, full_mode boolean")
