"""Every query of the engine against its SQL in DuckDB, and the driver's entry points."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame):
    def value(x):
        return None if x is None or pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x

    return sorted((tuple(map(value, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_in_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["rolling_feature_vectors", "snapshot_rows", "online_features"])
def test_totals_at_a_threshold_as_in_sql(spark, tmp_path, name):
    """Accounts whose day comes to 500 in cents and, added up as doubles from first to last, to a little more."""
    amounts = [7.36, 9.2, 110.29, 132.31, 111.78, 118.11, 10.95]
    rows = [(u * 10 + i, dt.datetime(2024, 1, 26) + dt.timedelta(hours=u + i), u, "view", a, '{"k": 1}') for u in range(24) for i, a in enumerate(amounts)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.execute(SQL[name]).fetchdf())


#: Whole last days of accounts of drawn tables of 6,000,000 events and 90,000 accounts: 500.00 in cents.
LAST_DAYS = [
    [("2024-01-29 11:04:13.429379", 22.71), ("2024-01-30 03:17:47.245537", 96.93), ("2024-01-30 03:51:28.424956", 348.54), ("2024-01-30 09:46:44.030819", 31.82)],
    [("2024-01-28 22:09:40.556037", 232.5), ("2024-01-29 15:35:12.101972", 79.97), ("2024-01-29 18:10:34.136636", 77.73), ("2024-01-29 18:50:11.346998", 83.74), ("2024-01-29 21:17:02.988338", 26.06)],
    [("2024-01-29 23:04:10.608386", 84.8), ("2024-01-29 23:32:31.826911", 82.48), ("2024-01-30 01:40:28.656883", 279.69), ("2024-01-30 04:22:07.629989", 34.61), ("2024-01-30 08:42:09.703430", 3.6), ("2024-01-30 11:46:25.159587", 14.3), ("2024-01-30 19:17:37.778413", 0.52)],
]


def test_last_days_at_a_threshold_as_in_sql(spark, tmp_path):
    """The accounts that online_features scored otherwise than its SQL when it added up a day by blocks."""
    rows = [(u * 10 + i, dt.datetime.fromisoformat(t), u, "view", a, '{"k": 1}') for u, day in enumerate(LAST_DAYS) for i, (t, a) in enumerate(day)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = plain(QUERIES["online_features"](spark, str(tmp_path)).toPandas())
    assert got == plain(con.execute(SQL["online_features"]).fetchdf())
    assert [row[1] for row in got] == [0.2, 0.2, 0.3]  # account_id, risk_score, transaction_count_24h


@pytest.mark.parametrize("name", ["rolling_feature_vectors", "snapshot_rows", "online_features"])
def test_frames_without_amounts_as_in_sql(spark, tmp_path, name):
    """One account without any amount, one with amounts in some of its frames."""
    rows = [(u * 10 + i, dt.datetime(2024, 1, 26) + dt.timedelta(hours=20 * i), u, "view", 600.0 if u and i % 4 == 3 else None, '{"k": 1}') for u in range(2) for i in range(9)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_text_operators(tmp_path):
    """The folders of the text operators can be deleted; what is left imports."""
    left = tmp_path / "repo"
    shutil.copytree(REPO, left, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=left, check=True, env=os.environ | {"PYTHONPATH": str(left)})


def test_flagship_plan(spark, sf):
    """One exchange by transaction for the deduplication and one by account for windows and as-of; filters and columns
    reach the scan."""
    plan = QUERIES["between_times"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(ts," in plan and "EqualTo(user_id," in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
    plan = QUERIES["flagship_features_as_of"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan
    assert "NestedLoop" not in QUERIES["asof_join_left"](spark, sf)._jdf.queryExecution().executedPlan().toString()
