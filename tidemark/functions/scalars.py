"""Scalar functions: times, risk, keys and checksums. Columns in, columns out; nothing leaves the JVM."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_event_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp; null where it can't be read, never the present time."""
    return F.try_to_timestamp(text)


def iso_format(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def day_key(time: Column) -> Column:
    """yyyyMMdd, the partition key of daily tables."""
    return F.date_format(time, "yyyyMMdd")


def month_key(time: Column) -> Column:
    return F.date_format(time, "yyyyMM")


def second_difference(a: Column, b: Column) -> Column:
    """Whole-second boundaries between two times, as the storage engine counts them."""
    second = lambda t: F.unix_timestamp(F.date_trunc("second", t.cast("timestamp")))
    return second(b) - second(a)


def risk_score(count: Column, total: Column) -> Column:
    """From the number and the unrounded sum of a window: at most 1, and 0 without transactions."""
    average = F.when(count > 0, total / count).otherwise(0.0)
    step = lambda value, high, above, low, over: F.when(value > high, above).when(value > low, over).otherwise(0.0)
    parts = step(count, 10, 0.3, 5, 0.1) + step(total, 1000, 0.4, 500, 0.2) + step(average, 500, 0.3, 200, 0.1)
    return F.when(count > 0, F.least(parts, F.lit(1.0))).otherwise(0.0)


RISK_SQL = """CASE WHEN {n} > 0 THEN least(
 (CASE WHEN {n} > 10 THEN 0.3::DOUBLE WHEN {n} > 5 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)
 + (CASE WHEN {t} > 1000 THEN 0.4::DOUBLE WHEN {t} > 500 THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
 + (CASE WHEN {t} / {n} > 500 THEN 0.3::DOUBLE WHEN {t} / {n} > 200 THEN 0.1::DOUBLE ELSE 0::DOUBLE END), 1::DOUBLE) ELSE 0::DOUBLE END"""


def dedup_key(transaction_id: Column, account: Column, time: Column, kind: Column, amount: Column) -> Column:
    """The business key: the transaction's id, or else 32 hex digits of a hash over what identifies it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws("|", text(account), text(time), text(kind), text(amount)), 256), 1, 32)
    return F.coalesce(F.nullif(transaction_id.cast("string"), F.lit("")), digest)


def change_key(source: Column, table: Column, key: Column, time: Column, sequence: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws(":", *map(text, (source, table, key, time, sequence)))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed one-way hash, from the built-in SHA-256. The pads are literals of the plan: whoever may read the plan
    may read the key."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    once = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, once), 256)


def new_id() -> Column:
    """A random id of version 4 for each row; another one whenever it is computed."""
    return F.uuid()


@lru_cache(maxsize=64)
def derive_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """PBKDF2-SHA256, 32 bytes; once, on the driver."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def with_default(mapping: Column, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(default))


#: Registry types and the Spark types that a text value must be castable to.
TYPES = {"int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "string": "string"}


def is_of_type(value: Column, kind: str) -> Column:
    """Whether a text can be read as a value of a registry type; a null can't."""
    return value.try_cast(TYPES[kind]).isNotNull()
