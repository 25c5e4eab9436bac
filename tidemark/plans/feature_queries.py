"""Queries over features: vectors, as-of reads and joins, windows, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import risk_score
from tidemark.model import transactions, with_duplicates
from tidemark.operators import history as H
from tidemark.operators import states as S
from tidemark.operators import windows as W
from tidemark.plans.base import DUP, RISK_SQL, TX, query, rolling_sql
from tidemark.sources.sinks import snapshots

AT = "2024-01-20 12:00:00"
NTZ = "timestamp_ntz"


def _t(text: str):
    return F.lit(text).cast(NTZ)


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(NTZ) for c in columns})


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.replacing(with_duplicates(transactions(spark, sf)), ["transaction_id"], ["version"])
    return rows.drop("version")


DEDUPED = f"{DUP}, one AS (SELECT * FROM dup QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY version DESC) = 1)"


@query(f"WITH {TX}, {DEDUPED}, {rolling_sql('one')} SELECT * FROM v WHERE feature_timestamp <= TIMESTAMP '{AT}' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY feature_timestamp DESC, transaction_id DESC) = 1")
def flagship_features_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated events, rolling vectors, and each account's vector as of a time."""
    return H.as_of(W.rolling_features(_deduped(spark, sf), by_account=True), "account_id", "feature_timestamp", _t(AT), ["transaction_id"])


@query(f"WITH {TX}, {rolling_sql()} SELECT * FROM v")
def rolling_feature_vectors(spark, sf):
    return W.rolling_features(transactions(spark, sf))


@query(f"WITH {TX}, {rolling_sql('tx', '7 DAYS', '30 DAYS')} SELECT transaction_id, transaction_count_24h AS n, total_amount_24h AS total, risk_score FROM v")
def risk_over_long_windows(spark, sf):
    v = W.rolling_features(transactions(spark, sf), "7 DAYS", "30 DAYS")
    return v.select("transaction_id", F.col("transaction_count_24h").alias("n"), F.col("total_amount_24h").alias("total"), "risk_score")


@query(f"SELECT user_id AS account_id, count(*) AS n, {RISK_SQL.format(n='count(*)', t='sum(value)')} AS risk_score FROM events GROUP BY ALL")
def risk_by_account(spark, sf):
    t = transactions(spark, sf).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("t"))
    return t.select("account_id", "n", risk_score(F.col("n"), F.col("t")).alias("risk_score"))


# As-of reads


def _sides(spark, sf):
    t = transactions(spark, sf)
    left = t.filter("category = 'purchase'").select("transaction_id", "account_id", "event_time")
    right = t.filter("category in ('click', 'view')").select("account_id", "event_time", F.col("amount").alias("value"), "merchant_id")
    return left, right


SIDES = f"""{TX}, l AS (SELECT transaction_id, account_id, event_time FROM tx WHERE category = 'purchase'),
r AS (SELECT account_id, event_time, amount AS value, merchant_id FROM tx WHERE category IN ('click', 'view'))"""


@query(f"WITH {SIDES} SELECT l.*, r.value, r.merchant_id FROM l ASOF LEFT JOIN r ON l.account_id = r.account_id AND l.event_time >= r.event_time")
def asof_join_left(spark, sf):
    left, right = _sides(spark, sf)
    return H.asof_join(left, right, ["account_id"], "event_time", "event_time", ["value", "merchant_id"])


@query(f"WITH {SIDES} SELECT l.*, r.value, r.merchant_id FROM l ASOF LEFT JOIN r ON l.account_id = r.account_id AND l.event_time >= r.event_time")
def asof_join_in_chunks(spark, sf):
    """As asof_join_left, with each account's time cut into days that run apart."""
    left, right = _sides(spark, sf)
    return H.asof_join(left, right, ["account_id"], "event_time", "event_time", ["value", "merchant_id"], chunk_seconds=86400)


@query(f"WITH {SIDES} SELECT l.*, r.value FROM l ASOF LEFT JOIN r ON l.account_id = r.account_id AND l.event_time <= r.event_time")
def asof_join_forward_in_chunks(spark, sf):
    left, right = _sides(spark, sf)
    return H.asof_join(left, right, ["account_id"], "event_time", "event_time", ["value"], forward=True, chunk_seconds=86400)


@query(f"WITH {TX}, one AS (SELECT * REPLACE (0::BIGINT AS account_id) FROM tx), {rolling_sql('one')} SELECT * FROM v")
def rolling_vectors_of_one_account(spark, sf):
    """All events as one account's: the frames hold many rows, and its days run apart."""
    return W.rolling_features(transactions(spark, sf).withColumn("account_id", F.lit(0).cast("bigint")))


@query(f"WITH {SIDES} SELECT l.*, r.value FROM l ASOF JOIN r ON l.account_id = r.account_id AND l.event_time >= r.event_time")
def asof_join_inner(spark, sf):
    left, right = _sides(spark, sf)
    return H.asof_join(left, right, ["account_id"], "event_time", "event_time", ["value"], how="inner")


@query(f"WITH {SIDES} SELECT l.transaction_id, l.account_id, l.event_time, arg_max(r.value, r.event_time) AS value FROM l JOIN r ON l.account_id = r.account_id AND r.event_time <= l.event_time GROUP BY ALL")
def asof_join_by_range(spark, sf):
    left, right = _sides(spark, sf)
    return H.asof_join_by_range(left, right, "account_id", "transaction_id", "event_time", "event_time", "value")


@query(
    f"WITH {SIDES}, j AS (SELECT l.*, r.value, r.event_time AS rt FROM l ASOF LEFT JOIN r ON l.account_id = r.account_id AND l.event_time >= r.event_time) SELECT transaction_id, account_id, event_time, CASE WHEN rt >= event_time - INTERVAL 6 HOURS THEN value END AS value FROM j"
)
def asof_join_tolerance(spark, sf):
    left, right = _sides(spark, sf)
    return H.asof_join(left, right, ["account_id"], "event_time", "event_time", ["value"], tolerance="6 HOURS")


@query(f"WITH {SIDES} SELECT l.*, r.value FROM l ASOF LEFT JOIN r ON l.account_id = r.account_id AND l.event_time <= r.event_time")
def asof_join_forward(spark, sf):
    left, right = _sides(spark, sf)
    return H.asof_join(left, right, ["account_id"], "event_time", "event_time", ["value"], forward=True)


SPINE = "SELECT o_orderkey, o_custkey % 150 AS account_id, TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 1009) % 2592000) AS label_time, o_totalprice FROM orders"


@query(f"WITH {TX}, {rolling_sql()}, s AS ({SPINE}) SELECT s.*, v.transaction_count_24h::DOUBLE AS transaction_count_24h, v.total_amount_24h, v.risk_score FROM s ASOF LEFT JOIN v ON s.account_id = v.account_id AND s.label_time >= v.feature_timestamp")
def historical_features(spark, sf):
    """A training set: labels from orders, features as they were at each label's time."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    seconds = F.make_dt_interval(secs=F.pmod(F.col("o_orderkey") * 1009, F.lit(2592000)))
    spine = o.select("o_orderkey", F.pmod("o_custkey", F.lit(150)).alias("account_id"), (_t("2024-01-01") + seconds).alias("label_time"), "o_totalprice")
    names = ["transaction_count_24h", "total_amount_24h", "risk_score", "no_such_feature"]
    found = H.historical(spine, W.rolling_features(transactions(spark, sf)), "account_id", "label_time", "feature_timestamp", names)
    return found.withColumn("transaction_count_24h", F.col("transaction_count_24h").cast("double"))


@query(f"WITH {TX}, {rolling_sql()} SELECT account_id, transaction_count_24h, risk_score FROM v QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY feature_timestamp DESC, transaction_id DESC) = 1")
def online_features(spark, sf):
    return H.latest(W.rolling_features(transactions(spark, sf)), "account_id", "feature_timestamp", ["transaction_count_24h", "risk_score"], ["transaction_id"])


@query("SELECT user_id AS account_id, arg_max(value, ts) AS latest_amount, max(ts) AS latest_time FROM events GROUP BY ALL")
def latest_value(spark, sf):
    return transactions(spark, sf).groupBy("account_id").agg(F.max_by("amount", "event_time").alias("latest_amount"), F.max("event_time").alias("latest_time"))


@query(f"WITH {TX} SELECT account_id, category, amount, merchant_id FROM tx WHERE event_time <= TIMESTAMP '{AT}' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY event_time DESC, transaction_id DESC) = 1")
def latest_tuple(spark, sf):
    best = F.max_by(F.struct("category", "amount", "merchant_id"), F.struct("event_time", "transaction_id"))
    return transactions(spark, sf).filter(F.col("event_time") <= _t(AT)).groupBy("account_id").agg(best.alias("x")).select("account_id", "x.*")


def _eav(spark, sf):
    """Features as rows of entity, name, value, version, with the retries as a second version that may delete."""
    d = with_duplicates(transactions(spark, sf))
    return d.select(F.col("account_id").alias("entity_id"), F.col("category").alias("feature_name"), "event_time", F.col("amount").alias("value"), "transaction_id", "version", F.when((F.col("version") == 2) & (F.col("transaction_id") % 20 == 0), 1).otherwise(0).alias("is_deleted"))


EAV = f"{TX}, {DUP}, eav AS (SELECT account_id AS entity_id, category AS feature_name, event_time, amount AS value, transaction_id, version, CASE WHEN version = 2 AND transaction_id % 20 = 0 THEN 1 ELSE 0 END AS is_deleted FROM dup)"


@query(f"WITH {EAV} SELECT entity_id, feature_name, arg_max(value, (version, transaction_id)) AS value, max(version) AS version FROM eav GROUP BY ALL")
def feature_by_version(spark, sf):
    return _eav(spark, sf).groupBy("entity_id", "feature_name").agg(F.max_by("value", F.struct("version", "transaction_id")).alias("value"), F.max("version").alias("version"))


@query(f"WITH {EAV}, l AS (SELECT * FROM eav QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY version DESC) = 1) SELECT entity_id, feature_name, count(*) AS n, round(sum(value), 2) AS total FROM l WHERE is_deleted = 0 GROUP BY ALL")
def without_deleted(spark, sf):
    live = H.replacing(_eav(spark, sf), ["transaction_id"], ["version"]).filter("is_deleted = 0")
    return live.groupBy("entity_id", "feature_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {EAV} SELECT entity_id, round(max(value) FILTER (feature_name = 'purchase'), 2) AS purchase, round(max(value) FILTER (feature_name = 'click'), 2) AS click FROM eav GROUP BY ALL")
def features_wide(spark, sf):
    return _eav(spark, sf).groupBy("entity_id").pivot("feature_name", ["purchase", "click"]).agg(F.round(F.max("value"), 2))


@query(f"WITH {EAV} SELECT feature_name, event_time, value, version FROM eav WHERE entity_id = 7 AND feature_name = 'purchase' ORDER BY version, event_time")
def feature_audit_trail(spark, sf):
    return _eav(spark, sf).filter("entity_id = 7 and feature_name = 'purchase'").select("feature_name", "event_time", "value", "version").orderBy("version", "event_time")


@query(f"WITH {TX}, {rolling_sql()} SELECT account_id, feature_timestamp, transaction_count_24h FROM v WHERE account_id = 7 AND feature_timestamp <= TIMESTAMP '{AT}' ORDER BY feature_timestamp DESC LIMIT 1")
def as_of_one_account(spark, sf):
    v = W.rolling_features(transactions(spark, sf).filter("account_id = 7"))
    return v.filter(F.col("feature_timestamp") <= _t(AT)).select("account_id", "feature_timestamp", "transaction_count_24h").orderBy(F.desc("feature_timestamp")).limit(1)


@query("SELECT event_id, user_id, ts FROM events WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' ORDER BY ts")
def between_times(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.filter(F.col("ts").between(_t("2024-01-05"), _t("2024-01-12")) & (F.col("user_id") == 7)).select("event_id", "user_id", "ts").orderBy("ts")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (1, 7, 42) GROUP BY ALL")
def in_list(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").filter(F.col("user_id").isin(1, 7, 42)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def half_open_range(spark, sf):
    from tidemark.sources.readers import fetch

    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("tidemark_events")
    return fetch(spark, "SELECT count(*) AS n, round(sum(value), 2) AS total FROM tidemark_events WHERE ts >= cast(:a AS timestamp_ntz) AND ts < cast(:b AS timestamp_ntz)", a="2024-01-05", b="2024-01-06")


@query(f"WITH {TX} SELECT transaction_id, account_id FROM tx WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-10 06:00:00' AND processing_time <= TIMESTAMP '2024-01-10 06:00:00' + INTERVAL 5 MINUTES")
def known_by_window_end(spark, sf):
    return H.known_by(transactions(spark, sf), "event_time", "processing_time", _t("2024-01-10"), _t("2024-01-10 06:00:00"), "5 MINUTES").select("transaction_id", "account_id")


@query(f"WITH {TX} SELECT count(*) FILTER (event_time > TIMESTAMP '{AT}' AND processing_time < TIMESTAMP '{AT}') AS leaks, leaks = 0 AS passed FROM tx")
def leakage_check(spark, sf):
    return H.leakage(transactions(spark, sf), "event_time", "processing_time", _t(AT))


@query(f"WITH {TX}, {DEDUPED} SELECT transaction_id, account_id, event_time, processing_time, version FROM one WHERE event_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09' ORDER BY account_id, event_time")
def backtest_scan(spark, sf):
    found = with_duplicates(transactions(spark, sf)).filter(F.col("event_time").between(_t("2024-01-03"), _t("2024-01-09")))
    return H.replacing(found, ["transaction_id"], ["version"]).select("transaction_id", "account_id", "event_time", "processing_time", "version").orderBy("account_id", "event_time")


# Replacing, collapsing, totals


@query(f"WITH {TX}, {DEDUPED} SELECT * FROM one")
def replacing_dedup(spark, sf):
    return H.replacing(with_duplicates(transactions(spark, sf)), ["transaction_id"], ["version"])


@query(f"WITH {TX}, {DUP} SELECT transaction_id, version, row_number() OVER (PARTITION BY transaction_id ORDER BY version DESC) AS version_rank FROM dup")
def version_ranks(spark, sf):
    return S.last_versions(with_duplicates(transactions(spark, sf)), ["transaction_id"], "version").select("transaction_id", "version", F.col("version_rank").cast("bigint").alias("version_rank"))


SIGNED = f"""{TX}, signed AS (SELECT account_id, transaction_id, amount, 1 AS sign FROM tx UNION ALL SELECT account_id, transaction_id, amount, -1 FROM tx WHERE transaction_id % 7 = 0)"""


@query(f"WITH {SIGNED} SELECT account_id, transaction_id, sum(sign)::BIGINT AS net_rows, sum(sign * amount) AS amount FROM signed GROUP BY ALL HAVING sum(sign) > 0")
def collapsing_rows(spark, sf):
    t = transactions(spark, sf).select("account_id", "transaction_id", "amount", F.lit(1).alias("sign"))
    both = t.unionByName(t.filter("transaction_id % 7 = 0").withColumn("sign", F.lit(-1)))
    return H.collapsing(both, ["account_id", "transaction_id"], "sign", ["amount"])


@query(f"WITH {TX}, new AS (SELECT transaction_id, account_id, amount + 1 AS amount, 2::BIGINT AS version FROM tx WHERE transaction_id % 3 = 0 UNION ALL SELECT transaction_id, account_id, amount - 1, 0 FROM tx WHERE transaction_id % 3 = 1), a AS (SELECT transaction_id, account_id, amount, 1::BIGINT AS version FROM tx UNION ALL SELECT * FROM new) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY version DESC) = 1")
def upsert_newer_wins(spark, sf):
    t = transactions(spark, sf).select("transaction_id", "account_id", "amount", F.lit(1).cast("bigint").alias("version"))
    newer = t.filter("transaction_id % 3 = 0").select("transaction_id", "account_id", (F.col("amount") + 1).alias("amount"), F.lit(2).cast("bigint").alias("version"))
    older = t.filter("transaction_id % 3 = 1").select("transaction_id", "account_id", (F.col("amount") - 1).alias("amount"), F.lit(0).cast("bigint").alias("version"))
    return H.upsert(t, newer.unionByName(older), ["transaction_id"], "version")


@query(f"WITH {TX} SELECT account_id, count(*) AS n, round(sum(amount), 2) AS total FROM tx GROUP BY ALL")
def idempotent_totals(spark, sf):
    """Totals over events that partly come twice: the same as over events that come once."""
    return with_duplicates(transactions(spark, sf)).dropDuplicates(["transaction_id"]).groupBy("account_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


# States


@query(f"WITH {TX} SELECT account_id, date_trunc('hour', event_time) AS hour, count(*) AS count_state, round(sum(amount), 2) AS sum_state, max(amount) AS max_state, min(amount) AS min_state FROM tx GROUP BY ALL")
def hourly_states(spark, sf):
    return S.hourly_states(transactions(spark, sf)).drop("merchants_state").withColumn("sum_state", F.round("sum_state", 2))


@query(f"WITH {TX} SELECT account_id, date_trunc('day', event_time) AS day, count(*)::BIGINT AS count_state, round(avg(amount), 6) AS mean, max(amount) AS max_state, min(amount) AS min_state FROM tx GROUP BY ALL")
def states_merged_by_day(spark, sf):
    day = F.date_trunc("day", F.col("hour").cast("timestamp")).cast(NTZ).alias("day")
    return S.merge(S.hourly_states(transactions(spark, sf)), ["account_id", day]).select("account_id", "day", "count_state", F.round("mean", 6).alias("mean"), "max_state", "min_state")


HOURS = f"{TX}, h AS (SELECT account_id, date_trunc('hour', event_time) AS hour, count(*) AS c, sum(amount) AS s, max(amount) AS a, min(amount) AS b FROM tx GROUP BY ALL)"


@query(f"WITH {HOURS} SELECT account_id, hour, (sum(c) OVER w)::BIGINT AS transaction_count_24h, round(sum(s) OVER w, 2) AS total_amount_24h, max(a) OVER w AS max_amount_24h, min(b) OVER w AS min_amount_24h FROM h WINDOW w AS (PARTITION BY account_id ORDER BY hour RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW)")
def rolling_day_from_states(spark, sf):
    return S.rolling_day(S.hourly_states(transactions(spark, sf)))


@query()
def merchants_by_sketch(spark, sf):
    """Approximate distinct merchants by day from merged sketches; estimates differ between engines."""
    day = F.date_trunc("day", F.col("hour").cast("timestamp")).cast(NTZ).alias("day")
    return S.merge(S.hourly_states(transactions(spark, sf)), [day]).select("day", "merchants")


@query(f"WITH {TX} SELECT date_trunc('day', event_time) AS day, count(DISTINCT merchant_id) AS merchants FROM tx GROUP BY ALL")
def merchants_exact(spark, sf):
    day = F.date_trunc("day", F.col("event_time").cast("timestamp")).cast(NTZ).alias("day")
    return transactions(spark, sf).groupBy(day).agg(F.countDistinct("merchant_id").alias("merchants"))


@query(f"WITH {TX} SELECT account_id, date_trunc('hour', event_time) AS hour, count(*)::BIGINT AS n, round(sum(amount), 2) AS total FROM tx GROUP BY ALL")
def refreshed_preaggregation(spark, sf):
    """A pre-aggregated table with later rows added: the same as aggregating all."""
    t = transactions(spark, sf)
    hour = F.date_trunc("hour", F.col("event_time").cast("timestamp")).cast(NTZ).alias("hour")
    part = lambda df: df.groupBy("account_id", hour).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    cut = F.col("event_time") < _t("2024-01-15 10:30:00")
    return S.refresh(part(t.filter(cut)), part(t.filter(~cut))).withColumn("total", F.round("total", 2))


@query(f"WITH {TX} SELECT account_id, count(*) AS count, round(sum(amount), 2) AS total, round(sum(amount) / count(*), 4) AS min, round(sum(amount) / count(*), 4) AS max FROM tx GROUP BY ALL")
def state_schema_migration(spark, sf):
    first = transactions(spark, sf).groupBy("account_id").agg(F.sum("amount").alias("total"), F.count("*").alias("count"))
    return S.widen(first).select("account_id", "count", F.round("total", 2).alias("total"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


# Windows


def _tumbling_sql(size: str) -> str:
    return f"WITH {TX} SELECT account_id, time_bucket(INTERVAL {size}, event_time, TIMESTAMP '1970-01-01') AS window_start, window_start + INTERVAL {size} AS window_end, count(*) AS n, round(sum(amount), 2) AS total FROM tx GROUP BY ALL"


def _window(df):
    return _ntz(df, "window_start", "window_end").withColumn("total", F.round("total", 2))


@query(_tumbling_sql("1 MINUTE"))
def tumbling_1m(spark, sf):
    return _window(W.tumbling(transactions(spark, sf), "account_id", "event_time", "amount", "1 minute"))


@query(_tumbling_sql("5 MINUTES"))
def tumbling_5m(spark, sf):
    return _window(W.tumbling(transactions(spark, sf), "account_id", "event_time", "amount", "5 minutes"))


@query(_tumbling_sql("1 HOUR"))
def tumbling_1h(spark, sf):
    return _window(W.tumbling(transactions(spark, sf), "account_id", "event_time", "amount", "1 hour"))


@query(f"WITH {TX}, x AS (SELECT *, time_bucket(INTERVAL 15 MINUTES, event_time, TIMESTAMP '1970-01-01') AS b FROM tx), s AS (SELECT *, unnest([b, b - INTERVAL 15 MINUTES, b - INTERVAL 30 MINUTES, b - INTERVAL 45 MINUTES]) AS window_start FROM x) SELECT account_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(amount), 2) AS total FROM s GROUP BY ALL")
def sliding_1h_15m(spark, sf):
    return _window(W.sliding(transactions(spark, sf), "account_id", "event_time", "amount", "1 hour", "15 minutes"))


SESSION = f"""{TX}, g AS (SELECT *, lag(event_time) OVER (PARTITION BY account_id ORDER BY event_time) AS p FROM tx),
o AS (SELECT *, CASE WHEN p IS NULL OR date_diff('second', p, event_time) > 1800 THEN 1 ELSE 0 END AS opens FROM g),
s AS (SELECT *, (sum(opens) OVER (PARTITION BY account_id ORDER BY event_time))::BIGINT AS session_id FROM o)"""


@query(f"WITH {SESSION} SELECT account_id, session_id, min(event_time) AS session_start, max(event_time) AS session_end, count(*) AS n_events FROM s GROUP BY ALL")
def sessions_by_lag(spark, sf):
    return W.sessions(transactions(spark, sf), "account_id", "event_time")


@query(f"WITH {SESSION} SELECT account_id, min(event_time) AS session_start, max(event_time) AS session_end, count(*) AS n_events FROM s GROUP BY account_id, session_id")
def session_windows(spark, sf):
    return _ntz(W.session_windows(transactions(spark, sf), "account_id", "event_time"), "session_start")


@query(f"WITH {TX} SELECT transaction_id, round(sum(amount) OVER w, 2) AS rolling_sum, count(*) OVER w AS rolling_count FROM tx WINDOW w AS (PARTITION BY account_id ORDER BY event_time ROWS BETWEEN 60 PRECEDING AND CURRENT ROW)")
def rolling_61_rows(spark, sf):
    return W.rolling_rows(transactions(spark, sf), "account_id", "event_time", "amount").select("transaction_id", F.round("rolling_sum", 2).alias("rolling_sum"), "rolling_count")


@query(f"WITH {TX}, c AS (SELECT account_id, date_trunc('hour', event_time) AS window_start, category, count(*) AS n FROM tx GROUP BY ALL) SELECT account_id, window_start, string_agg(category || ':' || n, ',' ORDER BY category) AS categories, sum(n)::BIGINT AS n FROM c GROUP BY ALL")
def category_distribution(spark, sf):
    c = transactions(spark, sf).groupBy("account_id", F.window(F.col("event_time").cast("timestamp"), "1 hour").alias("w"), "category").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("category", "n")))
    out = c.groupBy("account_id", F.col("w.start").cast(NTZ).alias("window_start")).agg(F.map_from_entries(pairs).alias("distribution"), F.sum("n").alias("n"))
    text = F.array_join(F.transform(F.map_entries("distribution"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return out.select("account_id", "window_start", text.alias("categories"), "n")


# Lateness and retractions


@query(f"WITH {TX}, m AS (SELECT *, max(event_time) OVER (PARTITION BY account_id ORDER BY processing_time, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 SECOND AS wm FROM tx) SELECT transaction_id, CASE WHEN wm IS NULL OR event_time >= wm THEN 'on_time' WHEN event_time >= wm - INTERVAL 300 SECOND THEN 'late' ELSE 'too_late' END AS route FROM m")
def lateness_monotone(spark, sf):
    m = W.arrival_watermark(transactions(spark, sf), "account_id", "event_time", ["processing_time", "transaction_id"], "5 SECONDS")
    route = F.when(F.col("watermark").isNull(), "on_time").otherwise(W.lateness(m, "event_time", F.col("watermark"), "300 SECONDS"))
    return m.select("transaction_id", route.alias("route"))


@query(f"WITH {TX} SELECT CASE WHEN event_time >= TIMESTAMP '{AT}' THEN 'on_time' WHEN event_time >= TIMESTAMP '{AT}' - INTERVAL 60 SECOND THEN 'late' ELSE 'too_late' END AS route, count(*) AS n FROM tx GROUP BY ALL")
def lateness_supplied(spark, sf):
    t = transactions(spark, sf)
    return t.groupBy(W.lateness(t, "event_time", _t(AT), "60 SECONDS").alias("route")).agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT category, max(event_time) - INTERVAL 5 SECOND AS watermark, count(*) AS n FROM tx GROUP BY ALL")
def watermark_by_partition(spark, sf):
    t = transactions(spark, sf).groupBy("category").agg(F.max("event_time").alias("m"), F.count("*").alias("n"))
    return t.select("category", (F.col("m") - F.expr("INTERVAL 5 SECONDS")).alias("watermark"), "n")


LATE = "transaction_id % 50 = 3"
ROLL = "SELECT transaction_id, account_id, event_time AS feature_timestamp, count(*) OVER l AS n, round(sum(amount) OVER l, 2) AS total FROM {} WINDOW l AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)"


@query(f"WITH {TX}, early AS (SELECT * FROM tx WHERE NOT {LATE}), b AS ({ROLL.format('early')}), a AS ({ROLL.format('tx')}) SELECT *, -1 AS op FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 1 AS op FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def retractions(spark, sf):
    """What late events change: vectors taken back and vectors put in their place."""
    t = transactions(spark, sf)
    roll = lambda df: W.rolling_features(df).select("transaction_id", "account_id", "feature_timestamp", F.col("transaction_count_24h").alias("n"), F.col("total_amount_24h").alias("total"))
    return H.changelog(roll(t.filter(f"not ({LATE})")), roll(t))


@query(
    f"""WITH {TX}, {rolling_sql()}, again AS (WITH twice AS (SELECT DISTINCT * FROM (SELECT * FROM tx UNION ALL SELECT * FROM tx)), {rolling_sql('twice')} SELECT * FROM v)
SELECT count(*) = 0 AS same FROM ((SELECT * FROM v EXCEPT ALL SELECT * FROM again) UNION ALL (SELECT * FROM again EXCEPT ALL SELECT * FROM v))"""
)
def reproduced_state(spark, sf):
    """Vectors of permuted and doubled input against those of the input: nothing differs."""
    t = transactions(spark, sf)
    twice = t.unionByName(t.repartition("merchant_id")).dropDuplicates(["transaction_id"])
    a, b = W.rolling_features(t).drop("last_transaction_time"), W.rolling_features(twice).drop("last_transaction_time")
    return H.changelog(a, b).agg((F.count("*") == 0).alias("same"))


@query(f"WITH {TX}, {rolling_sql()} SELECT account_id, feature_timestamp AS snapshot_time, transaction_count_1h, transaction_count_24h, total_amount_1h, total_amount_24h, avg_amount_1h, avg_amount_24h, unique_merchants_24h, max_amount_24h, min_amount_24h, risk_score, transaction_count_24h AS source_event_count, '1.0' AS computation_version, strftime(feature_timestamp, '%Y%m%d') AS day FROM v")
def snapshot_rows(spark, sf):
    return snapshots(W.rolling_features(transactions(spark, sf)))


@query("SELECT * FROM (SELECT event_id, user_id, value FROM events) ORDER BY value DESC, event_id LIMIT 25")
def top_amounts(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("SELECT event_id, user_id FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 4))::BIGINT % 10 = 0")
def hash_sample(spark, sf):
    """A tenth of the rows by a hash of their id: a sampling operator, the same rows each time."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    part = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("bigint")
    return e.filter(F.pmod(part, F.lit(10)) == 0).select("event_id", "user_id")
