"""A tamper-evident audit log: rows hashed with their predecessor's checksum, in segments."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "genesis"
#: The stored columns that a checksum covers, in the order of their names.
COVERED = ("account_id", "action", "event_id", "latency_ms", "metadata", "operation", "resource", "status", "timestamp", "user_id")


def content(columns=COVERED) -> Column:
    """What is hashed of a row: its stored columns as JSON, nulls included."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def event_id(time: Column, number: Column, last: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", time.cast("string"), number.cast("string"), last), 256), 1, 16)


def entry(df: DataFrame, operation: str, resource: str, user: Column, latency_ms: Column, details: list[str], at: Column) -> DataFrame:
    """Log rows of an operation on the rows of `df` (account_id), with some columns as JSON metadata."""
    metadata = F.to_json(F.struct(*details)) if details else F.lit("{}")
    rows = df.select(
        at.alias("timestamp"), F.lit(operation).alias("operation"), user.cast("string").alias("user_id"), F.col("account_id").cast("string").alias("account_id"), F.lit(resource).alias("resource"),
        F.lit(operation.lower()).alias("action"), F.lit("OK").alias("status"), latency_ms.cast("double").alias("latency_ms"), metadata.alias("metadata"),
    )
    return rows.withColumn("event_id", event_id(F.col("timestamp"), F.xxhash64("account_id", "metadata"), F.lit(GENESIS)))


def _folding(batches):
    """Rows in the order of their segments: (columns..., segment, content) with prev_checksum and checksum in the
    place of the last two."""
    segment = last = None
    for batch in batches:
        n = batch.num_columns
        before, after = [], []
        for of, text in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
            if of != segment:
                segment, last = of, GENESIS
            before.append(last)
            last = hashlib.sha256((text + last).encode()).hexdigest()
            after.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(before), pa.array(after)], names=[*batch.schema.names[: n - 2], "prev_checksum", "checksum"])


def chain(entries: DataFrame, segment: list[str], order: list[str], columns=COVERED) -> DataFrame:
    """Adds prev_checksum and checksum = SHA-256(content + prev_checksum). A chain is sequential, so there is one for
    each segment (a day and a writer, say): segments are folded in parallel, each row by row in its order, without
    being held as a whole."""
    marked = entries.withColumn("segment_", F.to_json(F.struct(*segment))).withColumn("content_", content(columns))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    rows = marked.repartition("segment_").sortWithinPartitions("segment_", *order)
    return rows.mapInArrow(_folding, f"{kinds}, prev_checksum string, checksum string")


def broken_links(log: DataFrame, segment: list[str], order: list[str], columns=COVERED) -> DataFrame:
    """Rows whose checksum isn't that of their content, or which don't follow the row before. All are checked at once:
    a row needs its predecessor's checksum only."""
    previous = F.coalesce(F.lag("checksum").over(W.partitionBy(*segment).orderBy(*order)), F.lit(GENESIS))
    seen = log.withColumn("expected_prev", previous).withColumn("expected_sum", F.sha2(F.concat(content(columns), "prev_checksum"), 256))
    return seen.filter(~(F.col("prev_checksum").eqNullSafe(F.col("expected_prev")) & F.col("checksum").eqNullSafe(F.col("expected_sum")))).drop("expected_prev", "expected_sum")


def verify(log: DataFrame, segment: list[str], order: list[str], columns=COVERED) -> DataFrame:
    """One row: broken (rows) and intact. An empty log is intact."""
    return broken_links(log, segment, order, columns).agg(F.count("*").alias("broken")).withColumn("intact", F.col("broken") == 0)


def heads(log: DataFrame, segment: list[str], order: list[str]) -> DataFrame:
    """Each segment's last checksum: what a root hash is made of, and what shows that a segment was cut short."""
    return log.groupBy(*segment).agg(F.max_by("checksum", F.struct(*order)).alias("head"), F.count("*").alias("n"))


def entries(log: DataFrame, start, stop, account_id=None, operation=None) -> DataFrame:
    """Rows of an inclusive time range, of one account and operation if they are given."""
    found = F.col("timestamp").between(start, stop)
    for c, value in (("account_id", account_id), ("operation", operation)):
        found = found & (F.col(c) == value) if value is not None else found
    return log.filter(found)


def compliance_bundle(log: DataFrame, start, stop, segment: list[str], order: list[str], columns=COVERED) -> DataFrame:
    """One row a segment: the number of its rows of the range, its last checksum, and whether the segment is intact. The
    rows themselves are compliance_lines()."""
    rows = entries(log, start, stop).groupBy(*segment).agg(F.count("*").alias("entry_count"), F.max_by("checksum", F.struct(*order)).alias("last_checksum"))
    bad = broken_links(log, segment, order, columns).groupBy(*segment).agg(F.count("*").alias("broken"))
    return rows.join(bad, segment, "left").withColumn("integrity_verified", F.coalesce("broken", F.lit(0)) == 0).drop("broken")


def compliance_lines(log: DataFrame, start, stop) -> DataFrame:
    """The rows of the range as they are exported: a line each, whatever a segment has."""
    return entries(log, start, stop)
