"""How queries are registered, and the SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.scalars import RISK_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name, with the same in DuckDB's SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TX = """tx AS (SELECT event_id AS transaction_id, user_id AS account_id, ts AS event_time, event_type AS category, value AS amount,
 json_extract_string(props, '$.k') AS merchant_id, ts + to_seconds((event_id * 7919) % 900) AS processing_time FROM events)"""
DUP = """dup AS (SELECT *, 1::BIGINT AS version FROM tx UNION ALL
 SELECT * REPLACE (processing_time + INTERVAL 60 SECOND AS processing_time), 2::BIGINT FROM tx WHERE transaction_id % 10 = 0)"""


def rolling_sql(source: str = "tx", short: str = "1 HOUR", long: str = "24 HOURS") -> str:
    """CTE `v`: the rolling vectors of `source`."""
    return f"""w AS (SELECT transaction_id, account_id, event_time,
 count(*) OVER s AS n1, sum(amount) OVER s AS t1, count(*) OVER l AS n24, sum(amount) OVER l AS t24,
 count(DISTINCT nullif(merchant_id, '')) OVER l AS m, max(amount) OVER l AS most, min(amount) OVER l AS least, max(event_time) OVER l AS last
 FROM {source} WINDOW s AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL {short} PRECEDING AND CURRENT ROW),
 l AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL {long} PRECEDING AND CURRENT ROW)),
v AS (SELECT transaction_id, account_id, event_time AS feature_timestamp, n1 AS transaction_count_1h, n24 AS transaction_count_24h,
 round((t1)::DECIMAL(38, 6), 2)::DOUBLE AS total_amount_1h, round((t24)::DECIMAL(38, 6), 2)::DOUBLE AS total_amount_24h, round((t1 / n1)::DECIMAL(38, 6), 2)::DOUBLE AS avg_amount_1h, round((t24 / n24)::DECIMAL(38, 6), 2)::DOUBLE AS avg_amount_24h,
 m::BIGINT AS unique_merchants_24h, most AS max_amount_24h, least AS min_amount_24h, last AS last_transaction_time, {RISK_SQL.format(n="n24", t="t24")} AS risk_score FROM w)"""
