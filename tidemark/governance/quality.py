"""Validation at the boundary, metrics, alerts, drift, lineage and access by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_event_time

EARLIEST = "2020-01-01"
# Upper bounds of the histograms' buckets, in seconds.
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
CHECKPOINT_BUCKETS = (1, 5, 10, 30, 60, 120, 300)
MAX_TEXT = 10_000


def errors(required: list[str], amount: str | None = None, time: str | None = None, limit: Column | None = None) -> Column:
    """Messages of what is wrong with a flat event: fields that are null or empty, an amount that isn't a finite
    number, a time that can't be read, is before EARLIEST or beyond `limit`."""
    found = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in required]
    if amount:
        number = F.col(amount).cast("string").try_cast("double")
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
        found.append(F.when(F.col(amount).isNotNull() & ~finite, F.lit(f"{amount} is not a number")))
    if time:
        at = parse_event_time(F.col(time).cast("string"))
        found.append(F.when(F.col(time).isNotNull() & (F.col(time).cast("string") != "") & at.isNull(), F.lit(f"{time} can't be read")))
        found.append(F.when(at < F.lit(EARLIEST).cast("timestamp"), F.lit(f"{time} too old")))
        if limit is not None:
            found.append(F.when(at > limit, F.lit(f"{time} in the future")))
    return F.array_compact(F.array(*found))


def quarantine(df: DataFrame, checks: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their errors."""
    checked = df.withColumn("errors", checks)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def lateness_bucket(seconds: Column) -> Column:
    return F.when(seconds < 10, "0-10s").when(seconds < 60, "10-60s").otherwise("60s+")


def histogram(df: DataFrame, value: str, buckets, by: list[str]) -> DataFrame:
    """Cumulative counts of values up to each bound, the last bound being everything."""
    counts = [F.struct(F.lit(str(b)).alias("le"), F.count(F.when(F.col(value) <= b, 1)).alias("n")) for b in buckets]
    counts.append(F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n")))
    out = df.groupBy(*by).agg(F.array(*counts).alias("h"))
    return out.select(*by, F.inline("h"))


def percentiles(df: DataFrame, value: str, by: list[str], exact: bool = False) -> DataFrame:
    """p50, p95, p99, by a sketch of bounded size. The exact form holds the distinct values of a group."""
    of = (lambda p: F.percentile(value, F.lit(p))) if exact else (lambda p: F.percentile_approx(value, F.lit(p), F.lit(10_000)))
    return df.groupBy(*by).agg(*[of(p / 100).alias(f"p{p}") for p in (50, 95, 99)])


def alerts(metrics: DataFrame, rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """metrics (metric, value) against rules (alert, metric, above, severity): the alerts that fire."""
    spark = metrics.sparkSession
    known = F.broadcast(spark.createDataFrame(rules, "alert string, metric string, above double, severity string"))  # one row a rule
    return metrics.join(known, "metric").filter("value > above").select("alert", "metric", "value", "severity")


def population_stability(df: DataFrame, value: str, is_new: Column, bounds: list[float]) -> DataFrame:
    """Drift of a value between old and new rows: by bucket the shares and their part of the stability index."""
    bucket = sum((F.when(F.col(value) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.when(~is_new, 1)).alias("old"), F.count(F.when(is_new, 1)).alias("new"))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row a bucket
    share = lambda c: F.greatest(c, F.lit(1)) / F.sum(c).over(everything)
    shares = counts.select("bucket", share("old").alias("old_share"), share("new").alias("new_share"))
    return shares.withColumn("psi", (F.col("new_share") - F.col("old_share")) * F.log(F.col("new_share") / F.col("old_share")))


STAGE = "struct<stage:string,system:string,entity:string,version:bigint,at:timestamp_ntz>"


def begin_lineage(df: DataFrame, key: Column) -> DataFrame:
    """A trace id, from the row's key, and an empty list of stages."""
    return df.withColumn("trace_id", F.concat(F.lit("trc_"), F.substring(F.sha2(key.cast("string"), 256), 1, 12))).withColumn("stages", F.array().cast(f"array<{STAGE}>"))


def add_stage(df: DataFrame, stage: str, system: str, entity: str, version: Column, at: Column) -> DataFrame:
    entry = F.struct(F.lit(stage).alias("stage"), F.lit(system).alias("system"), F.lit(entity).alias("entity"), version.cast("bigint").alias("version"), at.cast("timestamp_ntz").alias("at"))
    return df.withColumn("stages", F.array_append("stages", entry))


#: What each role may see of an asset: its columns, and the masks that are put on some.
ROLES = {
    "data_scientist": {"customer": (["c_custkey", "c_nationkey", "c_mktsegment"], {})},
    "analyst": {"customer": (["c_custkey", "c_name", "c_mktsegment"], {"c_name": "custom"})},
    "compliance": {"customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], {})},
}


def view_for(df: DataFrame, asset: str, role: str) -> DataFrame:
    """The projection of an asset that a role may read; a role without one gets an error."""
    from tidemark.functions.pii import mask

    if asset not in ROLES.get(role, {}):
        raise PermissionError(f"{role} may not read {asset}")
    columns, masked = ROLES[role][asset]
    return df.select(*[mask(F.col(c), masked[c]).alias(c) if c in masked else F.col(c) for c in columns])


def keep_days(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Retention: rows of the last so many days."""
    return df.filter(F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS"))


def tier(time: Column, now: Column) -> Column:
    """Where a row is kept: hot for 7 days, cold up to 90, then gone."""
    return F.when(time >= now - F.expr("INTERVAL 7 DAYS"), "hot").when(time >= now - F.expr("INTERVAL 90 DAYS"), "cold").otherwise("expired")


def verdict_on_payload(df: DataFrame, now: Column, key: bytes) -> DataFrame:
    """Payloads (payload as JSON, expected): how the engine's own rules handle each, and whether that is what is expected.
    What a payload is follows from its fields alone.

    A path that leads upwards is blocked. A text field becomes a token, and counts as tokenised if that gives the text back and doesn't show it. Bulk
    data is cut at MAX_TEXT characters. Anything else is an event: rejected if the boundary's rules find errors, held
    back by the watermark if it is from the future."""
    from tidemark.functions.pii import decrypt, tokenize

    get = lambda k: F.get_json_object("payload", f"$.{k}")
    flat = df.withColumns({"path_": get("path"), "value_": get("value"), "data_": get("data"), "account_id_": get("account_id"), "event_time_": get("event_time"), "amount_": F.coalesce(get("data.amount"), get("amount"))})
    found = errors(["account_id_", "event_time_"], "amount_", "event_time_")
    token = tokenize(F.col("value_"), "CUSTOM", F.lit(key), key)
    held_back = parse_event_time(F.col("event_time_")) > now
    is_event = F.col("account_id_").isNotNull() | F.col("event_time_").isNotNull()
    handled = (
        F.when(F.col("path_").rlike(r"(^|/)\.\.(/|$)"), "blocked")
        .when(F.col("value_").isNotNull() & get("field").isNotNull(), F.when((decrypt(token, F.lit(key)) == F.col("value_")) & ~F.contains(token, F.col("value_")), "tokenised").otherwise("exposed"))
        .when(F.col("data_").isNotNull() & ~is_event, F.when(F.length(F.left("data_", F.lit(MAX_TEXT))) <= MAX_TEXT, "truncated").otherwise("accepted"))
        .when(F.size(found) > 0, "rejected")
        .when(held_back, "watermarked")
        .otherwise("accepted")
    )
    return flat.withColumn("handled", handled).withColumn("passed", F.col("handled") == F.col("expected")).select(*df.columns, "handled", "passed")
