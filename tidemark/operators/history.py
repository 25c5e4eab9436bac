"""Reading history: as-of reads and joins, replacing, collapsing, upserts. No read sees rows later than its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replacing(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row per key: the one of the highest version; further columns of `version` break ties. The maximum is
    combined before the shuffle, so a hot key sends one row from each task."""
    rest = [c for c in df.columns if c not in key and c not in version]
    best = F.max(F.struct(*version, *[F.col(c) for c in rest])).alias("best_")
    return df.groupBy(*key).agg(best).select(*[F.col(c) if c in key else F.col(f"best_.{c}").alias(c) for c in df.columns])


def collapsing(df: DataFrame, key: list[str], sign: str, sums: list[str]) -> DataFrame:
    """Rows of sign +1 and -1 cancel: net sums of the keys that are left with more inserts than deletes."""
    net = df.groupBy(*key).agg(F.sum(sign).cast("bigint").alias("net_rows"), *[F.sum(F.col(sign) * F.col(c)).alias(c) for c in sums])
    return net.filter("net_rows > 0")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Old rows with the new ones written over them where their version is higher."""
    return replacing(old.unionByName(new), key, [version])


def unexpired(df: DataFrame, at: Column, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires).isNull() | (F.col(expires) > at))


def erase(df: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """The rows of all but the given subjects: a rewrite by anti-join."""
    return df.join(subjects.select(key).distinct(), key, "left_anti")


def as_of(df: DataFrame, entity: str, time: str, at, ties: list[str] | None = None) -> DataFrame:
    """Of each entity its latest row with time <= at."""
    order = F.struct(time, *(ties or []))
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.filter(F.col(time) <= at).groupBy(entity).agg(F.max_by(row, order).alias("r_")).select("r_.*")


def latest(df: DataFrame, entity: str, time: str, columns: list[str], ties: list[str] | None = None) -> DataFrame:
    """Online retrieval: the named columns of each entity's latest row; names that don't exist are ignored."""
    columns = [c for c in columns if c in df.columns]
    best = F.max_by(F.struct(*columns), F.struct(time, *(ties or [])))
    return df.groupBy(entity).agg(best.alias("r_")).select(entity, "r_.*")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    columns: list[str],
    how: str = "left",
    tolerance: str | None = None,
    forward: bool = False,
    ties: list[str] | None = None,
    chunk_seconds: int | None = None,
) -> DataFrame:
    """To each left row the latest right row with the same key and right time <= left time (forward: the earliest
    with right time >= left time), if not further off than `tolerance` (an interval).

    Both sides are united and each left row takes the last right row before it: one shuffle by key and one sort,
    linear in the rows however many there are of an entity. A right row is carried as a struct, so a null in it isn't
    passed over. Right rows at the same time stand in the order of `ties`; the last counts. A null key matches none.

    A key is one task's work. Where a few keys have a large part of the rows, `chunk_seconds` cuts their time into
    stretches that run apart; what a stretch begins with is the last right row of the stretches before it, from a
    table of one row for each key and stretch.
    """
    # Either side's struct is null, as a whole, in the other's rows; without ties there is no column for them. So a row that
    # is sorted is no wider than its own side.
    side = 0 if not forward else 1
    keyed = lambda df: [F.col(c).alias(f"k{i}_") for i, c in enumerate(on)]
    right_kind = T.StructType([T.StructField("t_", right.schema[right_time].dataType), *[right.schema[c] for c in columns]])
    r = right.select(*keyed(right), F.col(right_time).alias("t_"), F.lit(side).cast("byte").alias("side_"), *([F.struct(*ties).alias("tie_")] if ties else []), F.struct(F.col(right_time).alias("t_"), *columns).alias("r_"), F.lit(None).cast(left.schema).alias("l_"))
    rows = left.select(*keyed(left), F.col(left_time).alias("t_"), F.lit(1 - side).cast("byte").alias("side_"), *([F.lit(None).cast(r.schema["tie_"].dataType).alias("tie_")] if ties else []), F.lit(None).cast(right_kind).alias("r_"), F.struct(*left.columns).alias("l_"))
    keys = [f"k{i}_" for i in range(len(on))]
    order = [F.col("t_"), F.col("side_"), *([F.col("tie_")] if ties else [])]
    order = [c.desc() for c in order] if forward else order
    both = r.unionByName(rows)
    if chunk_seconds:
        keys.append("c_")
        sign = -1 if forward else 1
        both = both.withColumn("c_", sign * F.floor(F.unix_seconds(F.col("t_").cast("timestamp")) / chunk_seconds))
    last = F.last("r_", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = both.withColumn("m_", last).filter("l_ is not null")
    if chunk_seconds:
        pick = F.min_by if forward else F.max_by
        final = both.filter("r_ is not null").groupBy(*keys).agg(pick("r_", F.struct("t_", *(["tie_"] if ties else []))).alias("final_"))
        marks = final.unionByName(out.select(*keys).distinct().withColumn("final_", F.lit(None).cast(final.schema["final_"].dataType)))
        earlier = W.partitionBy(*keys[:-1]).orderBy("c_").rangeBetween(W.unboundedPreceding, -1)
        carried = marks.withColumn("carry_", F.last("final_", ignorenulls=True).over(earlier)).filter("final_ is null").select(*[F.col(k).alias(f"{k}o") for k in keys], "carry_")
        on_keys = F.lit(True)
        for k in keys:
            on_keys = on_keys & F.col(k).eqNullSafe(F.col(f"{k}o"))
        out = out.join(carried, on_keys, "left").withColumn("m_", F.coalesce("m_", "carry_"))
        keys.pop()
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    if tolerance:
        off = F.expr(f"m_.t_ - INTERVAL {tolerance} <= t_" if forward else f"t_ - INTERVAL {tolerance} <= m_.t_")
        known = known & off
    out = out.withColumn("m_", F.when(known, F.col("m_")))
    if how == "inner":
        out = out.filter("m_ is not null")
    return out.select("l_.*", *[F.col(f"m_.{c}").alias(c if c not in left.columns else f"right_{c}") for c in columns])


def asof_join_by_range(left: DataFrame, right: DataFrame, on: str, left_id: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The same as a range join and a maximum; for few right rows of a key, since it meets them all."""
    r = right.select(F.col(on).alias("k_"), F.col(right_time).alias("t_"), F.col(value).alias("v_"))
    met = left.join(r, (F.col(on) == F.col("k_")) & (F.col("t_") <= F.col(left_time)))
    return met.groupBy(left_id, on, left_time).agg(F.max_by("v_", "t_").alias(value))


def historical(spine: DataFrame, features: DataFrame, entity: str, spine_time: str, feature_time: str, names: list[str]) -> DataFrame:
    """A training set: the features of each (entity, time) of the spine as they were then."""
    return asof_join(spine, features, [entity], spine_time, feature_time, [n for n in names if n in features.columns])


def known_by(df: DataFrame, event_time: str, processing_time: str, start, stop, allowed: str = "15 MINUTES") -> DataFrame:
    """Events of [start, stop) that had arrived `allowed` after its end."""
    return df.filter((F.col(event_time) >= start) & (F.col(event_time) < stop) & (F.col(processing_time) <= stop + F.expr(f"INTERVAL {allowed}")))


def leakage(df: DataFrame, snapshot_time: str, created_at: str, at) -> DataFrame:
    """Snapshots of after `at` that had been made before it, and whether there are none."""
    n = F.count(F.when((F.col(snapshot_time) > at) & (F.col(created_at) < at), 1))
    return df.agg(n.cast("bigint").alias("leaks")).withColumn("passed", F.col("leaks") == 0)


def changelog(before: DataFrame, after: DataFrame) -> DataFrame:
    """Retractions: rows that no longer hold with op -1, rows that hold now with op +1, repetitions counted. One
    shuffle: equal rows of both sides meet and cancel."""
    columns = before.columns
    both = before.withColumn("op", F.lit(-1)).unionByName(after.withColumn("op", F.lit(1)))
    net = both.groupBy(*columns).agg(F.sum("op").cast("int").alias("net_")).filter("net_ <> 0")
    return net.select(*columns, F.explode(F.array_repeat(F.signum("net_").cast("int"), F.abs("net_"))).alias("op"))
