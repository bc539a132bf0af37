"""Splits, fits and importance on small rows; the backtest has its own SQL."""

import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_plans import SF, duck, rows  # noqa: F401
from tidewater.operators import marts, models
from tidewater.plans import dialect


@pytest.mark.parametrize("name", sorted(models.ORACLE))
def test_model_query(spark, duck, name):  # noqa: F811
    got, want = models.QUERIES[name](spark, SF), duck.execute(models.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_time_split_takes_the_latest_rows(spark):
    data = [(i, None if i == 0 else i // 4) for i in range(40)]
    got = models.time_split(spark.createDataFrame(data, "k int, day int"), "day", "k", 0.25).collect()
    assert sorted(r["k"] for r in got if r["held_out"]) == list(range(30, 40)) and len(got) == 40
    assert models.time_split(spark.createDataFrame([], "k int, day int"), "day", "k").count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    """One feature of three decides the label, which is rare."""
    rng = random.Random(1)
    data = [(i, rng.random(), rng.random(), None if i % 7 == 0 else rng.random()) for i in range(1200)]
    frame = spark.createDataFrame(data, "k int, a double, b double, c double").withColumn("y", (F.col("a") > 0.9).cast("int"))
    frame = models.written(models.canonical(frame, "k"), "test-model")
    return frame, models.fit_binary(frame.where("k < 900"), ["a", "b", "c"], "y")


def test_balanced_fit(fitted):
    frame, model = fitted
    got = models.score_binary(model, frame.where("k >= 900"), ["a", "b", "c"]).collect()
    assert len(got) == 300 and all(max(r["score"], 1 - r["score"]) == r["confidence"] for r in got)
    assert sum((r["score"] >= 0.5) == (r["y"] == 1) for r in got) >= 294


def test_importance_finds_the_feature(fitted):
    frame, model = fitted
    got = {r["feature"]: r["importance"] for r in models.importance(model, frame.where("k >= 900"), ["a", "b", "c"], "y", "k", parts=4).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] > 0.5 > 10 * max(abs(got["b"]), abs(got["c"]))


def test_churn_and_forecast_fits(spark):
    churn = models.m08_churn_fit(spark, SF)
    held = models.m01_training_order(spark, SF).where("held_out")
    assert churn.select("customer").exceptAll(held.select("customer")).isEmpty() and churn.count() == held.count()
    assert churn.where("NOT score BETWEEN 0 AND 1").isEmpty()
    assert models.m08_forecast_fit(spark, SF).where("score < 0 OR NOT entity RLIKE '^[A-Z]+@[0-9-]{10}$'").isEmpty()


@pytest.mark.parametrize("name", ["f05_churn_training", "f06_churn_current", "a14_customer_history", "m20_churn_scores"])
def test_history_of_odd_orders(spark, tmp_path, name):
    """Days with several orders, orders without lines, lines without a product or a date, and nulls as keys."""
    rng = random.Random(4)
    day = lambda: datetime(2000, 1 + rng.randrange(12), 1 + rng.randrange(3) * 9)
    some = lambda value, n=12: None if rng.randrange(n) == 0 else value
    orders = [(i, some(rng.randrange(25), 20), rng.choice("OFP"), some(float(rng.randrange(1, 900)) / 4), day()) for i in range(240)]
    lines = [(some(rng.randrange(210), 30), some(rng.randrange(40)), 1, rng.randrange(1, 3), some(float(rng.randrange(1, 50))), 10.0, 0.0, 0.05, "A", "O", some(day())) for _ in range(700)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "B", some(rng.choice(["unknown", "a", "b", "c"]), 6)) for i in range(35)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 3, datetime(2000, 1, 1), "signup", 1.0)], "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = dialect.run(marts.PLANS[name], spark, str(tmp_path))
    with duckdb.connect() as con:
        for table in ("orders", "lineitem", "part", "events"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.execute(dialect.oracle(marts.PLANS[name]))
        columns = [c[0] for c in want.description]
        assert rows(columns, got.select(*columns).collect()) == rows(columns, want.fetchall())


def test_rows_from_written_orders(spark):
    """Training rows and current ones of one table of orders are those of the queries."""
    orders = marts.customer_orders(spark, SF)
    for made, name in ((marts.churn_training, "f05_churn_training"), (marts.churn_current, "f06_churn_current")):
        given, own = made(spark, SF, orders), dialect.run(marts.PLANS[name], spark, SF)
        assert given.exceptAll(own).isEmpty() and own.exceptAll(given).isEmpty() and not own.isEmpty()
        assert "l_orderkey" not in given._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["f05_churn_training", "f06_churn_current"])
def test_lines_are_read_once(spark, name):
    plan = dialect.run(marts.PLANS[name], spark, SF)._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("l_orderkey" in plan.apply(i).toString() for i in range(plan.size())) == 1
