"""Queries over personal data, the audit log, metrics, retention and access."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidemark.functions import pii
from tidemark.functions.scalars import derive_key, hmac_sha256
from tidemark.governance import audit, quality
from tidemark.model import transactions
from tidemark.operators import history as H
from tidemark.plans.base import TX, query

NTZ = "timestamp_ntz"
NOW = "2024-01-31 00:00:00"
#: For queries only: a key made from a fixed password, not one to keep anything secret with.
DEMO_SALT = b"tidemark-demo-salt"
DEMO_PASSWORD = "tidemark-demo"
KEY_HEX = "00112233445566778899aabbccddeeff"


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _people(spark, sf):
    """Values of each category, made from the customers' keys."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.format_string("%03d-%02d-%04d", k % 900, k % 90, k % 9000).alias("ssn"),
        F.format_string("ACC_%09d", k).alias("account"),
        F.concat(F.lower("c_mktsegment"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.format_string("555-%03d-%04d", k % 900, k % 9000).alias("phone"),
        F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("name"),
        F.format_string("%05d", k % 90000).alias("zip"),
    )


PEOPLE = """p AS (SELECT c_custkey, printf('%03d-%02d-%04d', c_custkey % 900, c_custkey % 90, c_custkey % 9000) AS ssn, printf('ACC_%09d', c_custkey) AS account,
 lower(c_mktsegment) || c_custkey || '@example.com' AS email, printf('555-%03d-%04d', c_custkey % 900, c_custkey % 9000) AS phone,
 CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name, printf('%05d', c_custkey % 90000) AS zip FROM customer)"""


@query(f"""WITH {PEOPLE} SELECT c_custkey, '***-**-' || right(ssn, 4) AS ssn, '****' || right(account, 4) AS account, left(email, 1) || '***@' || split_part(email, '@', 2) AS email,
 '***-***-' || right(phone, 4) AS phone, CASE WHEN name IS NULL THEN NULL WHEN length(name) > 4 THEN left(name, 1) || '***' || right(name, 2) ELSE '***' END AS name, left(zip, 3) || '**' AS zip FROM p""")
def masked_people(spark, sf):
    kinds = {"ssn": "ssn", "account": "account_number", "email": "email", "phone": "phone", "name": "custom", "zip": "zip"}
    return _people(spark, sf).select("c_custkey", *[pii.mask(F.col(c), k).alias(c) for c, k in kinds.items()])


def _rlike(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


_MESSAGES = ", ".join(f"CASE WHEN {_rlike('text', p)} THEN 'text may contain {k}' END" for k, p in pii.PATTERNS.items())


@query(f"SELECT doc_id, concat_ws(';', {_MESSAGES}) AS leaks FROM documents WHERE NOT starts_with(text, '***')")
def leak_scan(spark, sf):
    return _docs(spark, sf).filter(~F.col("text").startswith("***")).select("doc_id", F.array_join(pii.scan(["text"]), ";").alias("leaks"))


_CARDS = "SELECT c_custkey, printf('4%015d', c_custkey * 7919) AS bare, printf('4%015d', c_custkey * 7919)[1:4] || '-' || printf('4%015d', c_custkey * 7919)[5:8] || '-' || printf('4%015d', c_custkey * 7919)[9:12] || '-' || printf('4%015d', c_custkey * 7919)[13:16] AS spaced FROM customer"
_IS_CARD = f"regexp_matches(card, '{pii.PATTERNS['credit_card']}')"


@query(
    f"WITH c AS ({_CARDS}), x AS (SELECT c_custkey, unnest([bare, spaced]) AS card FROM c) SELECT c_custkey, card, CASE WHEN {_IS_CARD} THEN 'card may contain credit_card' ELSE '' END AS strict,"
    f" CASE WHEN {_IS_CARD} AND NOT regexp_matches(card, '^[0-9A-Za-z]+$') THEN 'card may contain credit_card' ELSE '' END AS legacy FROM x"
)
def leak_scan_legacy(spark, sf):
    """Card numbers, bare and with dashes: the strict rule reports both, the legacy rule passes over the bare ones."""
    bare = F.format_string("4%015d", F.col("c_custkey") * 7919)
    dashed = F.concat_ws("-", *[F.substring(bare, k, 4) for k in (1, 5, 9, 13)])
    cards = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.explode(F.array(bare, dashed)).alias("card"))
    return cards.select("c_custkey", "card", F.array_join(pii.scan(["card"]), ";").alias("strict"), F.array_join(pii.scan(["card"], legacy=True), ";").alias("legacy"))


_PREVIEWS = " UNION ALL ".join(f"SELECT doc_id, 'text' AS field, '{k}' AS pii_type, substr(text, 1, 4) || '***' AS value_preview FROM documents WHERE {_rlike('text', p)}" for k, p in pii.PREVIEW_PATTERNS.items())


@query(_PREVIEWS)
def leak_previews(spark, sf):
    return _docs(spark, sf).select("doc_id", F.inline(pii.scan_with_preview(["text"])))


@query(f"WITH {PEOPLE}, x AS (SELECT c_custkey, unnest([ssn, account, name]) AS value FROM p) SELECT count(*) AS n, count(*) FILTER (regexp_matches(value, '^(?:{'|'.join(pii.FEATURE_PATTERNS)})')) AS rejected FROM x")
def features_with_pii(spark, sf):
    values = _people(spark, sf).select(F.explode(F.array("ssn", "account", "name")).alias("value"))
    return values.agg(F.count("*").alias("n"), F.count_if(pii.begins_with_pii(F.col("value"))).alias("rejected"))


def _pad(key: bytes, byte: int) -> str:
    return bytes(b ^ byte for b in key.ljust(64, b"\0")).hex()


@query(f"WITH {PEOPLE} SELECT c_custkey, sha256(unhex('{_pad(b'tidemark', 0x5C)}') || unhex(sha256(unhex('{_pad(b'tidemark', 0x36)}') || encode(ssn)))) AS hash FROM p")
def keyed_hashes(spark, sf):
    return _people(spark, sf).select("c_custkey", hmac_sha256(F.col("ssn"), b"tidemark").alias("hash"))


def _hmac_sql(message: str) -> str:
    key = derive_key(DEMO_PASSWORD, DEMO_SALT)
    return f"sha256(unhex('{_pad(key, 0x5C)}') || unhex(sha256(unhex('{_pad(key, 0x36)}') || encode({message}))))"


def _nonce(token):
    """The first 12 bytes of a token, in hex."""
    return F.lower(F.substring(F.hex(F.unbase64(F.translate(token, "-_", "+/"))), 1, 24))


def _size(token):
    return F.octet_length(F.unbase64(F.translate(token, "-_", "+/"))).cast("bigint")


@query(f"WITH {PEOPLE} SELECT c_custkey, account, account AS back, left({_hmac_sql("'account_number:' || account")}, 24) AS nonce, 28 + strlen(account)::BIGINT AS size FROM p")
def account_tokens(spark, sf):
    """Repeatable tokens, joined on and turned back: every account finds itself."""
    key = derive_key(DEMO_PASSWORD, DEMO_SALT)
    token = pii.tokenize(F.col("account"), "account_number", F.lit(key), key)
    p = _people(spark, sf).select("c_custkey", "account")
    a, b = p.select("c_custkey", token.alias("token")), p.select(F.col("account"), token.alias("token"))
    return a.join(b, "token").select("c_custkey", "account", pii.decrypt(F.col("token"), F.lit(key)).alias("back"), _nonce(F.col("token")).alias("nonce"), _size(F.col("token")).alias("size"))


@query(f"WITH {PEOPLE} SELECT c_custkey, account AS back, 28 + strlen(account)::BIGINT AS size, NULL::VARCHAR AS of_garbage FROM p")
def random_tokens(spark, sf):
    """Tokens with a random nonce: no two alike, all turned back; what isn't a token gives null."""
    key = F.lit(derive_key(DEMO_PASSWORD, DEMO_SALT))
    p = _people(spark, sf).select("c_custkey", "account", pii.encrypt(F.col("account"), key).alias("t"))
    return p.select("c_custkey", pii.decrypt(F.col("t"), key).alias("back"), _size(F.col("t")).alias("size"), pii.decrypt(F.lit("bm90IGEgdG9rZW4"), key).alias("of_garbage"))


_DIGITS = f"""h AS (SELECT c_custkey, account, sha256('{KEY_HEX}:' || regexp_replace(account, '[^0-9]', '', 'g')) AS x FROM p),
d AS (SELECT c_custkey, account, x, unnest(string_split(account, '')) AS c, generate_subscripts(string_split(account, ''), 1) AS i FROM h),
n AS (SELECT *, (count(*) FILTER (c BETWEEN '0' AND '9') OVER (PARTITION BY c_custkey ORDER BY i)) - 1 AS k FROM d)"""


@query(f"WITH {PEOPLE}, {_DIGITS} SELECT c_custkey, string_agg(CASE WHEN c BETWEEN '0' AND '9' THEN ((c::INT + ('0x' || substr(x, 1 + (k % 64)::INT, 1))::INT % 10) % 10)::VARCHAR ELSE c END, '' ORDER BY i) AS shifted FROM n GROUP BY ALL")
def shifted_digits(spark, sf):
    return _people(spark, sf).select("c_custkey", pii.shift_digits(F.col("account"), KEY_HEX).alias("shifted"))


@query(f"WITH {PEOPLE} SELECT c_custkey, left(zip, 3) || '**' AS zip, left({_hmac_sql("'ssn:' || ssn")}, 24) AS ssn_nonce, CASE WHEN name <> '' THEN left({_hmac_sql("'CUSTOM:' || name")}, 24) ELSE name END AS name_nonce FROM p")
def sanitized_people(spark, sf):
    key = derive_key(DEMO_PASSWORD, DEMO_SALT)
    p = pii.sanitize(_people(spark, sf), ["ssn"], {"zip": "zip"}, F.lit(key), key)
    p = pii.tokenize_fields(p, ["name", "no_such_field"], {}, F.lit(key), key)
    return p.select("c_custkey", "zip", _nonce(F.col("ssn_token")).alias("ssn_nonce"), F.when(F.col("name") != "", _nonce(F.col("name"))).otherwise(F.col("name")).alias("name_nonce"))


@query(f"WITH {TX} SELECT transaction_id, date_trunc('hour', event_time) AS event_hour FROM tx")
def hours_for_training(spark, sf):
    return transactions(spark, sf).select("transaction_id", F.date_trunc("hour", F.col("event_time").cast("timestamp")).cast(NTZ).alias("event_hour"))


# Audit


def _entries(spark, sf):
    """Log entries made from the events."""
    t = transactions(spark, sf)
    return t.select(
        F.col("event_time").alias("timestamp"),
        F.format_string("%016x", "transaction_id").alias("event_id"),
        F.when(F.col("transaction_id") % 2 == 0, "PIT_QUERY").otherwise("INSERT").alias("operation"),
        F.concat(F.lit("user_"), F.col("account_id") % 10).alias("user_id"),
        F.concat(F.lit("acc_"), "account_id").alias("account_id"),
        F.lit("features").alias("resource"),
        F.col("category").alias("action"),
        F.when(F.col("transaction_id") % 97 == 0, "FAILED").otherwise("OK").alias("status"),
        F.round(F.col("amount") / 100, 4).alias("latency_ms"),
        F.to_json(F.struct("merchant_id")).alias("metadata"),
        F.date_format("event_time", "yyyyMMdd").alias("day"),
    )


ENTRIES = f"""{TX}, log AS (SELECT event_time AS timestamp, printf('%016x', transaction_id) AS event_id, CASE WHEN transaction_id % 2 = 0 THEN 'PIT_QUERY' ELSE 'INSERT' END AS operation,
 'user_' || account_id % 10 AS user_id, 'acc_' || account_id AS account_id, category AS action, CASE WHEN transaction_id % 97 = 0 THEN 'FAILED' ELSE 'OK' END AS status, round(amount / 100, 4) AS latency_ms,
 strftime(event_time, '%Y%m%d') AS day FROM tx)"""
ORDER = ["timestamp", "event_id"]


#: What the chain of the queries covers: texts alone, which both sides write alike. A day's log is of ten writers.
CHAINED = ("account_id", "action", "event_id", "operation", "status", "user_id")
SEGMENT = ["day", "user_id"]
CHAIN = f"""{ENTRIES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY timestamp, event_id) AS i,
 '{{{{' || concat_ws(',', {", ".join(f"'\"{c}\":\"' || {c} || '\"'" for c in CHAINED)}) || '}}}}' AS content FROM log),
chain AS (SELECT day, user_id, event_id, i, 'genesis' AS prev_checksum, sha256(content || 'genesis') AS checksum FROM numbered WHERE i = 1
 UNION ALL SELECT n.day, n.user_id, n.event_id, n.i, c.checksum, sha256(n.content || c.checksum) FROM chain c JOIN numbered n ON n.day = c.day AND n.user_id = c.user_id AND n.i = c.i + 1)""".replace("{{", "{").replace("}}", "}")


def _chain(spark, sf):
    return audit.chain(_entries(spark, sf), SEGMENT, ORDER, CHAINED)


@query(f"WITH RECURSIVE {CHAIN} SELECT event_id, prev_checksum, checksum FROM chain")
def audit_checksums(spark, sf):
    """Every entry's checksum and its predecessor's."""
    return _chain(spark, sf).select("event_id", "prev_checksum", "checksum")


@query(f"WITH RECURSIVE {CHAIN} SELECT day, user_id, arg_max(checksum, i) AS head, count(*) AS n, count(*) FILTER (prev_checksum IS NULL) AS broken FROM chain GROUP BY ALL")
def audit_chain_intact(spark, sf):
    """Each segment's last checksum, and how many of its rows don't verify."""
    log = _chain(spark, sf)
    bad = audit.broken_links(log, SEGMENT, ORDER, CHAINED).groupBy(*SEGMENT).agg(F.count("*").alias("broken"))
    return audit.heads(log, SEGMENT, ORDER).join(bad, SEGMENT, "left").select(*SEGMENT, "head", "n", F.coalesce("broken", F.lit(0)).alias("broken"))


@query(f"WITH {ENTRIES} SELECT event_id FROM log WHERE event_id = printf('%016x', 77)")
def audit_chain_tampered(spark, sf):
    """One entry's content is changed afterwards: it is found, and it alone."""
    log = audit.chain(_entries(spark, sf), SEGMENT, ORDER)
    bad = log.withColumn("status", F.when(F.col("event_id") == f"{77:016x}", "CHANGED").otherwise(F.col("status")))
    return audit.broken_links(bad, SEGMENT, ORDER).select("event_id")


@query(f"WITH {ENTRIES} SELECT day, user_id, count(*) AS n, arg_max(event_id, (timestamp, event_id)) AS last_event FROM log GROUP BY ALL")
def audit_segments(spark, sf):
    log = audit.chain(_entries(spark, sf), SEGMENT, ORDER)
    heads = audit.heads(log, SEGMENT, ORDER)
    last = log.groupBy(*SEGMENT).agg(F.max_by("event_id", F.struct(*ORDER)).alias("last_event"), F.max_by("checksum", F.struct(*ORDER)).alias("sum"))
    return heads.join(last, SEGMENT).filter("head = sum").select("day", "user_id", "n", "last_event")


@query(f"WITH {ENTRIES} SELECT event_id, operation, account_id FROM log WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND account_id = 'acc_7' AND operation = 'PIT_QUERY'")
def audit_entries(spark, sf):
    log = _entries(spark, sf)
    return audit.entries(log, F.lit("2024-01-05").cast(NTZ), F.lit("2024-01-20").cast(NTZ), "acc_7", "PIT_QUERY").select("event_id", "operation", "account_id")


_BUNDLE = "timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"


@query(f"WITH RECURSIVE {CHAIN} SELECT day, user_id, count(*) AS entry_count, arg_max(checksum, i) AS last_checksum, day <> '20240107' OR user_id <> 'user_3' AS integrity_verified FROM chain JOIN log USING (day, user_id, event_id) WHERE {_BUNDLE} GROUP BY ALL")
def compliance_export(spark, sf):
    """One segment's first row is changed after the chain was made; the others verify."""
    log = _chain(spark, sf)
    altered = (F.col("day") == "20240107") & (F.col("user_id") == "user_3") & (F.col("prev_checksum") == audit.GENESIS)
    log = log.withColumn("status", F.when(altered, "CHANGED").otherwise(F.col("status")))
    return audit.compliance_bundle(log, F.lit("2024-01-05").cast(NTZ), F.lit("2024-01-20").cast(NTZ), SEGMENT, ORDER, CHAINED)


@query(f"WITH {TX} SELECT transaction_id, substr(sha256(strftime(event_time, '%Y-%m-%d %H:%M:%S') || ':' || transaction_id || ':genesis'), 1, 16) AS event_id FROM tx")
def audit_event_ids(spark, sf):
    t = transactions(spark, sf)
    return t.select("transaction_id", audit.event_id(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.col("transaction_id"), F.lit("genesis")).alias("event_id"))


# Metrics


@query(f"WITH {TX} SELECT CASE WHEN s < 10 THEN '0-10s' WHEN s < 60 THEN '10-60s' ELSE '60s+' END AS bucket, count(*) AS n FROM (SELECT date_diff('second', event_time, processing_time) AS s FROM tx) GROUP BY ALL")
def lateness_histogram(spark, sf):
    t = transactions(spark, sf).select((F.unix_timestamp(F.col("processing_time").cast("timestamp")) - F.unix_timestamp(F.col("event_time").cast("timestamp"))).alias("s"))
    return t.groupBy(quality.lateness_bucket(F.col("s")).alias("bucket")).agg(F.count("*").alias("n"))


_BUCKETS = " UNION ALL ".join(f"SELECT operation, '{b}' AS le, count(*) FILTER (latency_ms <= {b}) AS n FROM log GROUP BY ALL" for b in quality.LATENCY_BUCKETS)


@query(f"WITH {ENTRIES} {_BUCKETS} UNION ALL SELECT operation, '+Inf', count(latency_ms) FROM log GROUP BY ALL")
def latency_histogram(spark, sf):
    return quality.histogram(_entries(spark, sf), "latency_ms", quality.LATENCY_BUCKETS, ["operation"])


@query(f"WITH {ENTRIES} SELECT operation, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM log GROUP BY ALL")
def latency_percentiles(spark, sf):
    p = quality.percentiles(_entries(spark, sf), "latency_ms", ["operation"], exact=True)
    return p.select("operation", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query(f"WITH {ENTRIES} SELECT operation, action, status, count(*) AS n FROM log GROUP BY ALL")
def labelled_counters(spark, sf):
    return _entries(spark, sf).groupBy("operation", "action", "status").agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT category AS source, max(date_diff('second', event_time, processing_time))::DOUBLE AS lag_seconds, round(count(*) / date_diff('second', min(event_time), max(event_time)), 9) AS events_per_second FROM tx GROUP BY ALL")
def ingest_gauges(spark, sf):
    s = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    g = transactions(spark, sf).groupBy(F.col("category").alias("source")).agg(F.max(s("processing_time") - s("event_time")).cast("double").alias("lag_seconds"), F.count("*").alias("n"), (F.max(s("event_time")) - F.min(s("event_time"))).alias("span"))
    return g.select("source", "lag_seconds", F.round(F.col("n") / F.col("span"), 9).alias("events_per_second"))


@query(f"WITH {ENTRIES}, m AS (SELECT 'late_events' AS metric, count(*)::DOUBLE AS value FROM tx WHERE processing_time > event_time + INTERVAL 10 MINUTE UNION ALL SELECT 'pit_query_p99', quantile_cont(latency_ms, 0.99) FROM log WHERE operation = 'PIT_QUERY' UNION ALL SELECT 'pii_masking_failures', 0), r AS (SELECT * FROM (VALUES ('HighLateRate', 'late_events', 100, 'warning'), ('SlowQueries', 'pit_query_p99', 0.2, 'critical'), ('MaskingFailure', 'pii_masking_failures', 0, 'critical')) t(alert, metric, above, severity)) SELECT alert, metric, round(value, 6) AS value, severity FROM m JOIN r USING (metric) WHERE value > above")
def firing_alerts(spark, sf):
    late = transactions(spark, sf).filter("processing_time > event_time + INTERVAL 10 MINUTES").agg(F.lit("late_events").alias("metric"), F.count("*").cast("double").alias("value"))
    p99 = quality.percentiles(_entries(spark, sf).filter("operation = 'PIT_QUERY'"), "latency_ms", [], exact=True).select(F.lit("pit_query_p99").alias("metric"), F.col("p99").alias("value"))
    none = spark.range(1).select(F.lit("pii_masking_failures").alias("metric"), F.lit(0.0).alias("value"))
    rules = [("HighLateRate", "late_events", 100.0, "warning"), ("SlowQueries", "pit_query_p99", 0.2, "critical"), ("MaskingFailure", "pii_masking_failures", 0.0, "critical")]
    return quality.alerts(late.unionByName(p99).unionByName(none), rules).withColumn("value", F.round("value", 6))


_BOUNDS = [50.0, 100.0, 150.0, 200.0, 300.0]


@query(
    f"WITH {TX}, b AS (SELECT {' + '.join(f'(amount > {b})::INT' for b in _BOUNDS)} AS bucket, event_time >= TIMESTAMP '2024-01-15' AS is_new FROM tx), c AS (SELECT bucket, count(*) FILTER (NOT is_new) AS o, count(*) FILTER (is_new) AS n FROM b GROUP BY ALL), s AS (SELECT bucket, greatest(o, 1) / (sum(o) OVER ()) AS os, greatest(n, 1) / (sum(n) OVER ()) AS ns FROM c) SELECT bucket, round(os, 9) AS old_share, round(ns, 9) AS new_share, round((ns - os) * ln(ns / os), 9) AS psi FROM s"
)
def amount_drift(spark, sf):
    d = quality.population_stability(transactions(spark, sf), "amount", F.col("event_time") >= F.lit("2024-01-15").cast(NTZ), _BOUNDS)
    return d.select("bucket", *[F.round(c, 9).alias(c) for c in ("old_share", "new_share", "psi")])


@query(f"WITH {TX} SELECT transaction_id, 'trc_' || substr(sha256(transaction_id::VARCHAR), 1, 12) AS trace_id, 'source>ingest>features' AS path, 1::BIGINT AS source_version, processing_time AS ingested FROM tx")
def lineage(spark, sf):
    t = quality.begin_lineage(transactions(spark, sf), F.col("transaction_id"))
    t = quality.add_stage(t, "source", "database", "transactions", F.lit(1), F.col("event_time"))
    t = quality.add_stage(t, "ingest", "feed", "transactions.raw", F.lit(1), F.col("processing_time"))
    t = quality.add_stage(t, "features", "spark", "rolling", F.lit(1), F.col("processing_time"))
    return t.select("transaction_id", "trace_id", F.array_join(F.col("stages.stage"), ">").alias("path"), F.get("stages", F.lit(0))["version"].alias("source_version"), F.get("stages", F.lit(1))["at"].alias("ingested"))


@query("SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN left(c_name, 1) || '***' || right(c_name, 2) ELSE '***' END AS c_name, c_mktsegment FROM customer")
def analyst_view(spark, sf):
    return quality.view_for(spark.read.parquet(f"{sf}/customer.parquet"), "customer", "analyst")


@query(f"WITH {TX} SELECT CASE WHEN event_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'hot' WHEN event_time >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'cold' ELSE 'expired' END AS tier, count(*) AS n FROM tx GROUP BY ALL")
def retention_tiers(spark, sf):
    return transactions(spark, sf).groupBy(quality.tier(F.col("event_time"), F.lit(NOW).cast(NTZ)).alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT transaction_id, event_time FROM tx WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def retained_events(spark, sf):
    return quality.keep_days(transactions(spark, sf), "event_time", F.lit(NOW).cast(NTZ), 14).select("transaction_id", "event_time")


@query(f"WITH {TX} SELECT transaction_id FROM tx WHERE account_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def erased_subjects(spark, sf):
    gone = spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("account_id"))
    return H.erase(transactions(spark, sf), gone, "account_id").select("transaction_id")


@query(f"WITH {TX} SELECT transaction_id AS token_id FROM tx WHERE transaction_id % 3 = 0 OR event_time + INTERVAL 10 DAY > TIMESTAMP '{NOW}'")
def unexpired_tokens(spark, sf):
    t = transactions(spark, sf).select(F.col("transaction_id").alias("token_id"), F.when(F.col("transaction_id") % 3 != 0, F.col("event_time") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return H.unexpired(t, F.lit(NOW).cast(NTZ)).select("token_id")


def master_key_fingerprint(password: str) -> str:
    """For logs: what a key is told by without being shown."""
    return hashlib.sha256(derive_key(password, DEMO_SALT)).hexdigest()[:8]
