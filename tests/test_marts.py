"""Trailing windows against brute force, with the cases of ties, edges, nulls and hot keys; marts against their oracles."""

import datetime as dt
import os
import random

import duckdb
import pytest

from tests.test_plans import SF, rows
from tidewater.functions import trailing
from tidewater.operators import marts

DAY = 86_400


@pytest.mark.parametrize("name", sorted(marts.QUERIES))
def test_mart(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = marts.QUERIES[name](spark, SF), con.execute(marts.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def run(spark, data, window, **more):
    frame = spark.createDataFrame(data, "k string, t long, o string, v long")
    return {r["o"]: (r["n"], r["sum_v"]) for r in trailing(frame, "k", "t", "o", window, ["v"], **more).collect()}


def seconds(*stamps):
    return [int((dt.datetime.fromisoformat(s) - dt.datetime(1970, 1, 1)).total_seconds()) for s in stamps]


def test_velocity(spark):
    a = seconds("2017-01-01 00:00:00", "2017-01-01 23:00:00", "2017-01-03 12:00:00")
    assert [run(spark, [("c", t, str(i), 0) for i, t in enumerate(a)], DAY)[str(i)][0] for i in range(3)] == [0, 1, 0]
    b = seconds("2017-01-01 00:00:00", "2017-01-02 00:00:00")  # exactly 24 hours apart
    assert [run(spark, [("c", t, str(i), 0) for i, t in enumerate(b)], DAY)[str(i)][0] for i in range(2)] == [0, 1]


def test_benchmark(spark):
    at = seconds("2017-01-01 00:00:00", "2017-02-01 00:00:00", "2017-06-01 00:00:00")
    got = run(spark, [("c", t, str(i), v) for i, (t, v) in enumerate(zip(at, (10, 30, 500)))], 90 * DAY)
    assert [s / n if n else v for (n, s), v in zip((got[str(i)] for i in range(3)), (10, 30, 500))] == [10, 10, 500]
    tie = run(spark, [("c", 5, "b", 20), ("c", 5, "a", 10)], DAY)  # in one second, a is first
    assert tie == {"a": (0, 0), "b": (1, 10)}


@pytest.mark.parametrize("own", [False, True])
def test_trailing_against_brute_force(spark, own):
    rng = random.Random(own)
    data = [(rng.choice(["hot"] * 5 + ["x", None]), rng.randint(-50, 200), f"{i:04d}", rng.choice([None, 1, 2, 3])) for i in range(400)]
    for window, cell in ((30, None), (30, 7), (1, 1), (500, 3)):
        want = {}
        for k, t, o, _ in data:
            found = [v for j, s, p, v in data if j == k and s >= t - window and ((s, p) < (t, o) or own and p == o)]
            want[o] = (len(found), sum(v or 0 for v in found))
        assert run(spark, data, window, cell=cell, own=own) == want
    assert run(spark, data[:0], 5) == {}


def test_trailing_days_against_brute_force(spark):
    from tidewater.functions import trailing_days

    rng = random.Random(4)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), rng.choice([None, 1, 5])) for i in range(300)]
    rows = spark.createDataFrame(data, "o int, k string, day int, v int")
    got = {r["o"]: (r["n"], r["sum_v"]) for r in trailing_days(rows, "k", "day", "o", 3, ["v"]).collect()}
    for o, k, day, _ in data:
        before = [] if k is None or day is None else [v for p, q, e, v in data if q == k and e is not None and day - 3 <= e and (e, p) < (day, o)]
        assert got[o] == (len(before), sum(v or 0 for v in before))


def test_features_of_orders_read_the_lines_once(spark):
    plan = marts.dialect.run(marts._orders, spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation [l_orderkey" in line for line in plan.splitlines()) == 1
    made = marts.order_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in made and "Union" not in made
