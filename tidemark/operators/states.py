"""Mergeable aggregation states: hourly partials that later reads add up, with exact and sketched distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hourly_states(tx: DataFrame) -> DataFrame:
    """One row per account and hour: count, sum, extremes and a sketch of the merchants."""
    hour = F.date_trunc("hour", F.col("event_time").cast("timestamp")).cast("timestamp_ntz")
    return tx.groupBy("account_id", hour.alias("hour")).agg(
        F.count("*").alias("count_state"),
        F.sum("amount").alias("sum_state"),
        F.max("amount").alias("max_state"),
        F.min("amount").alias("min_state"),
        F.hll_sketch_agg("merchant_id").alias("merchants_state"),
    )


def merge(states: DataFrame, by: list) -> DataFrame:
    """The states of coarser keys, and what they come to."""
    out = states.groupBy(*by).agg(
        F.sum("count_state").alias("count_state"),
        F.sum("sum_state").alias("sum_state"),
        F.max("max_state").alias("max_state"),
        F.min("min_state").alias("min_state"),
        F.hll_union_agg("merchants_state").alias("merchants_state"),
    )
    return out.withColumn("mean", F.col("sum_state") / F.col("count_state")).withColumn("merchants", F.hll_sketch_estimate("merchants_state"))


def rolling_day(states: DataFrame) -> DataFrame:
    """24 hours from hourly states: each account's state hours with the sums of the 23 hours before them added."""
    w = "OVER (PARTITION BY account_id ORDER BY hour RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW)"
    return states.selectExpr(
        "account_id", "hour", f"sum(count_state) {w} AS transaction_count_24h", f"round(sum(sum_state) {w}, 2) AS total_amount_24h", f"max(max_state) {w} AS max_amount_24h", f"min(min_state) {w} AS min_amount_24h"
    )


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """Simple aggregate states of a pre-aggregated table with those of newly arrived rows added."""
    both = old.unionByName(new)
    return both.groupBy("account_id", "hour").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def widen(states: DataFrame) -> DataFrame:
    """States of the first version (total, count) in the second's form: extremes begin at the mean."""
    mean = F.when(F.col("count") > 0, F.col("total") / F.col("count")).otherwise(0.0)
    return states.withColumn("min", mean).withColumn("max", mean)


def last_versions(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """All versions with their rank, latest first."""
    return df.withColumn("version_rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(version))))
