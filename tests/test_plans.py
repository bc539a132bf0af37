"""Every plan against an independent engine, and the hand-made window cases."""

import os

import duckdb
import pytest

import __spark_entry__
from tidewater.plans import dialect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(float(x))
    return str(x).removesuffix(" 00:00:00")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(__spark_entry__.PLANS))
def test_plan(spark, duck, name):
    plan = __spark_entry__.PLANS[name]
    got = dialect.run(plan, spark, SF)
    want = duck.execute(dialect.oracle(plan))
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_trailing_count_is_positional_above_and_by_value_below(spark, tmp_path):
    text = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    at = ["2017-01-01 00:00:00", "2017-01-01 23:00:00", "2017-01-02 23:00:00", "2017-01-05 12:00:00", "2017-01-05 12:00:00"]
    import datetime as dt

    data = [(i, dt.datetime.fromisoformat(t), 1, "click", 1.0, "{}") for i, t in enumerate(at)]
    spark.createDataFrame(data, text).write.parquet(f"{tmp_path}/events.parquet")
    got = dialect.run(__spark_entry__.PLANS["w12_trailing_count"], spark, str(tmp_path)).collect()
    assert {r["event_id"]: r["velocity"] for r in got} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
