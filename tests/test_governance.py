"""Personal data, the audit chain and the schema registry."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pii
from tidemark.functions.scalars import derive_key, hmac_sha256
from tidemark.governance import audit, quality, registry
from tidemark.sources import sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "category", "want"),
    [
        ("123-45-6789", "ssn", "***-**-6789"),
        ("12", "ssn", "***-**-****"),
        ("john.doe@example.com", "email", "j***@example.com"),
        ("@example.com", "email", "***@example.com"),
        ("nobody", "email", "***@***"),
        ("ACC_001234567", "account_number", "****4567"),
        ("1", "account_number", "****"),
        ("555-123-4567", "phone", "***-***-4567"),
        ("abcdef", "custom", "a***ef"),
        ("abc", "custom", "***"),
        ("12345", "zip", "123**"),
        (None, "ssn", None),
    ],
)
def test_masks(spark, value, category, want):
    assert one(spark, value, pii.mask(F.col("v"), category)) == want


def test_tokens(spark):
    key = derive_key("password", b"salt", 1000)
    token = lambda c: pii.tokenize(F.col("v"), c, F.lit(key), key)
    a, b = one(spark, "test-account-123", token("custom")), one(spark, "test-account-123", token("custom"))
    assert a == b != one(spark, "test-account-123", token("ssn")) and "test" not in a and not set("+/") & set(a)
    assert one(spark, a, pii.decrypt(F.col("v"), F.lit(key))) == "test-account-123"
    assert one(spark, "garbage!", pii.decrypt(F.col("v"), F.lit(key))) is None
    assert one(spark, "", token("custom")) == "" and one(spark, None, token("custom")) is None
    for text in ("'; DROP TABLE users; --", "<script>alert(1)</script>", "../../etc/passwd"):
        assert one(spark, one(spark, text, token("custom")), pii.decrypt(F.col("v"), F.lit(key))) == text


def test_keyed_hash(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, "message é", hmac_sha256(F.col("v"), key)) == hmac.new(key, "message é".encode(), hashlib.sha256).hexdigest()


def test_shifted_digits_keep_their_form(spark):
    got = one(spark, "ACC_001234567", pii.shift_digits(F.col("v"), "00ff"))
    digest = hashlib.sha256(b"00ff:001234567").hexdigest()
    want = "ACC_" + "".join(str((int(d) + int(digest[i % 64], 16) % 10) % 10) for i, d in enumerate("001234567"))
    assert got == want != "ACC_001234567"


def test_leak_scan(spark):
    rec = spark.createDataFrame([("ACC_001234", "123-45-6789", "fine", "4111111111111111", "***-**-6789")], "account string, ssn string, safe string, card string, masked string")
    found = rec.select(pii.scan(rec.columns).alias("x")).first()["x"]
    assert found == ["account may contain account_number", "ssn may contain ssn", "card may contain credit_card"]
    assert rec.select(pii.scan(["card"], legacy=True).alias("x")).first()["x"] == []


ENTRIES = [(f"2024-01-{d:02d} 00:00:{i:02d}", f"e{i}", "INSERT", None, f"acc_{i}", "r", "a", "OK", 1.5, "{}", f"{d}") for d in (1, 2) for i in range(20)]
SCHEMA = "timestamp string, event_id string, operation string, user_id string, account_id string, resource string, action string, status string, latency_ms double, metadata string, day string"
ORDER = ["timestamp", "event_id"]


def test_audit_chain(spark):
    log = audit.chain(spark.createDataFrame(ENTRIES, SCHEMA), ["day"], ORDER).cache()
    assert audit.verify(log, ["day"], ORDER).first()["intact"]
    assert audit.verify(log.limit(0), ["day"], ORDER).first()["intact"]
    changed = log.withColumn("amount", F.lit(1)).withColumn("status", F.when((F.col("event_id") == "e3") & (F.col("day") == "1"), "BAD").otherwise(F.col("status")))
    assert [r["event_id"] for r in audit.broken_links(changed, ["day"], ORDER).collect()] == ["e3"]
    removed = log.filter("not (event_id = 'e3' and day = '1')")
    assert [r["event_id"] for r in audit.broken_links(removed, ["day"], ORDER).collect()] == ["e4"]
    first = log.filter("day = '1'").orderBy(*ORDER).first()
    assert first["prev_checksum"] == "genesis"
    bundle = audit.compliance_bundle(changed, "2024-01-01", "2024-01-03", ["day"], ORDER).collect()
    assert {r["day"]: (r["entry_count"], r["integrity_verified"]) for r in bundle} == {"1": (20, False), "2": (20, True)}


def test_registry():
    r = registry.Registry()
    assert r.register("t", registry.TRANSACTION) == 1
    wider = {**registry.TRANSACTION, "fields": [*registry.TRANSACTION["fields"], {"name": "note", "type": "string", "nullable": True}]}
    assert r.register("t", wider, "FULL") == 2 and r.version("t") == 2 and r.schema("t", 1) is registry.TRANSACTION
    with pytest.raises(ValueError):
        r.register("t", {"type": "record", "fields": []})
    with pytest.raises(KeyError):
        r.schema("t", 3)
    with pytest.raises(KeyError):
        r.schema("unknown")
    assert registry.promotable("int", "double") and not registry.promotable("double", "int") and registry.promotable(["null", "int"], "long")
    kind = registry.spark_type(registry.TRANSACTION)
    assert kind["data"].dataType["amount"].dataType.simpleString() == "double" and kind["processing_time"].nullable


def test_validation_of_json(spark):
    good = '{"transaction_id": "t", "account_id": "a", "event_time": "x", "event_type": "T", "processing_time": null, "data": {"amount": 1, "currency": "USD"}}'
    cases = {good: [], "nope": ["not JSON"], good.replace('"amount": 1', '"amount": "1"'): ["type of data.amount"], good.replace('"account_id": "a", ', ""): ["missing account_id"]}
    rows = registry.validate_json(spark.createDataFrame([(k,) for k in cases], "value string"), "value", registry.TRANSACTION).collect()
    for r in rows:
        want = cases[r["value"]]
        assert r["errors"] == want or (r["value"] == "nope" and "not JSON" in r["errors"])


def test_roles(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    assert "c_acctbal" not in quality.view_for(customers, "customer", "analyst").columns
    with pytest.raises(PermissionError):
        quality.view_for(customers, "customer", "guest")


def test_entries_of_an_operation(spark):
    rows = audit.entry(spark.createDataFrame([(7, 3)], "account_id long, n long"), "PIT_QUERY", "features", F.lit("u"), F.lit(2), ["n"], F.lit("2024-01-01 00:00:00"))
    r = rows.first()
    assert (r["account_id"], r["metadata"], r["action"], len(r["event_id"])) == ("7", '{"n":3}', "pit_query", 16)
    assert set(audit.COVERED) <= set(rows.columns)


def test_tokens_by_switches(spark):
    key = bytes(range(32))
    rows = spark.createDataFrame([("ACC_001234567",), ("ACC_001234567",), ("",), (None,)], "account string")
    token = lambda **how: [r["t"] for r in rows.select(pii.tokenize(F.col("account"), "account_number", F.lit(key), key, **how).alias("t")).collect()]
    a, b, empty, none = token()
    assert a == b != "ACC_001234567" and empty == "" and none is None
    a, b, *_ = token(deterministic=False)
    assert a != b
    a, b, *_ = token(preserve_format=True)
    assert a == b != "ACC_001234567" and a.startswith("ACC_") and len(a) == 13
    # A category without a form of its own isn't shifted.
    assert rows.select(pii.tokenize(F.col("account"), "ssn", F.lit(key), key, preserve_format=True).alias("t")).first()["t"] != a


def test_payloads_are_judged_by_what_they_are(spark):
    """The label isn't looked at, and what isn't handled as it should be is told."""
    rows = [("?", '{"path": "a/../b"}', "blocked"), ("?", '{"path": "a/b"}', "blocked"), ("?", '{"field": "f", "value": "x\\\\u0027y"}', "tokenised"), ("?", '{"data": "AAAA"}', "truncated")]
    rows += [("sql_injection", '{"account_id": "a", "event_time": "2024-01-01T00:00:00Z", "amount": 3}', "rejected"), ("?", '{"account_id": "a", "event_time": "2030-01-01T00:00:00Z"}', "watermarked"), ("?", '{"account_id": "a", "event_time": "x"}', "rejected")]
    judged = quality.verdict_on_payload(spark.createDataFrame(rows, "type string, payload string, expected string"), F.lit("2024-01-15").cast("timestamp"), bytes(32)).collect()
    assert [r["handled"] for r in judged] == ["blocked", "rejected", "tokenised", "truncated", "accepted", "watermarked", "rejected"]
    assert [r["passed"] for r in judged] == [True, False, True, True, False, True, True]


def test_sketched_percentiles(spark):
    rows = spark.range(100_000).select((F.col("id") * 7919 % 100_000 / 100).alias("x"), (F.col("id") % 3).alias("k"))
    exact, sketch = ({r["k"]: r for r in quality.percentiles(rows, "x", ["k"], exact=e).collect()} for e in (True, False))
    assert all(abs(exact[k][p] - sketch[k][p]) <= 0.5 for k in exact for p in ("p50", "p95", "p99"))


def test_an_export_has_a_line_for_each_entry(spark, tmp_path):
    log = audit.chain(spark.createDataFrame(ENTRIES, SCHEMA), ["day"], ORDER)
    bounds = ("2024-01-01 00:00:05", "2024-01-03")
    sinks.write_bundle(audit.compliance_bundle(log, *bounds, ["day"], ORDER), audit.compliance_lines(log, *bounds), ["day"], str(tmp_path))
    assert {(r["day"], r["entry_count"], r["integrity_verified"]) for r in spark.read.json(f"{tmp_path}/summary").collect()} == {("1", 15, True), ("2", 20, True)}
    assert spark.read.json(f"{tmp_path}/entries").groupBy("day").count().orderBy("day").collect() == [(1, 15), (2, 20)]
