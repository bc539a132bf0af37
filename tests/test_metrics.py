"""Metric functions against the SQL texts, and their arguments and edges."""

import re

import pytest

import __spark_entry__
from tests.test_plans import SF, duck, rows  # noqa: F401
from tidewater.operators import metrics
from tidewater.plans import dialect


@pytest.mark.parametrize("name", sorted(metrics.QUERIES))
def test_metric(spark, duck, name):  # noqa: F811
    got, want = metrics.QUERIES[name](spark, SF), duck.execute(metrics.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.fixture
def tables(spark):
    text = "order_id int, customer int, d string, pay decimal(12,2), is_delivered boolean, is_lost boolean"
    data = [(1, 1, "2020-01-01", 10, True, False), (2, 1, "2020-01-02", 20, False, False), (3, 2, "2020-01-03", 40, False, True), (4, None, None, 5, None, False), (5, 3, "2020-01-03", None, True, False)]
    orders = spark.createDataFrame([(*r[:3], None if r[3] is None else __import__("decimal").Decimal(r[3]), *r[4:]) for r in data], text).withColumn("d", metrics.F.col("d").cast("date"))
    lines = spark.createDataFrame([(1, "b"), (1, "b"), (1, "a"), (2, "a"), (3, "a"), (4, "c"), (9, "z")], "order_id int, category string")
    return orders, lines


def test_dates_are_included(tables):
    orders, _ = tables
    days = lambda *a: [str(r["d"]) for r in metrics.series(orders, *a).collect()]
    assert days("2020-01-01", "2020-01-02") == ["2020-01-01", "2020-01-02"]
    assert days("2020-01-02") == ["2020-01-02"] and days(None, "2020-01-01") == ["2020-01-01"] and days("2021-01-01") == []


def test_top_categories_ranks_and_ties(tables):
    orders, lines = tables
    top = lambda *a: [r["category"] for r in metrics.top_categories(lines, orders, *a).collect()]
    assert top("revenue", 3) == ["a", "b", "c"] and top("orders", 2) == ["a", "b"] and top("orders", 1) == ["a"]
    for bad in (("price", 3), ("revenue", 0), ("revenue", 51)):
        with pytest.raises(ValueError):
            top(*bad)


def test_summary_of_a_range_without_orders(tables):
    orders, lines = tables
    got = metrics.summary(orders, lines, "2030-01-01", "2030-12-31").first()
    assert (got["revenue"], got["orders"], got["aov"], got["customers"], got["top_category"]) == (None, 0, 0.0, 2, "a")
    empty = metrics.summary(orders.limit(0), lines).first()
    assert (empty["orders"], empty["aov"], empty["top_category"]) == (0, 0.0, None)


@pytest.mark.parametrize("name", ["a08_top_categories", "a16_weekly_category", "f03_forecast", "f04_forecast_next", "w05_ranks", "w06_lags", "w07_rolling", "w08_series_length"])
def test_orders_of_a_category_are_counted_without_a_distinct_aggregate(spark, name):
    """A distinct count keeps every pair of order and category in the memory of a task."""
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "count(distinct" not in plan.split("== Optimized Logical Plan ==")[1].lower()


def test_orders_are_counted_once_per_category(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (1, None), (1, None), (2, "a"), (3, "b"), (3, "b")], "order_id long, category string")
    orders = spark.createDataFrame([(1, "x", "1997-01-01", 10, True, False), (1, "x", "1997-02-01", 5, True, False), (2, "y", "1997-01-01", 7, True, True), (3, "y", "1997-01-01", 2, True, False)], "order_id long, customer string, d string, pay int, is_delivered boolean, is_lost boolean")
    got = {tuple(r) for r in metrics.category_totals(lines, orders).collect()}
    assert got == {("a", 30.0, 1), ("b", 19.0, 2), (None, 30.0, 1)}


@pytest.mark.parametrize("name", ["a08_top_categories", "a16_weekly_category", "f04_forecast_next", "w05_ranks", "w06_lags", "l01_top_by_rank"])
@pytest.mark.parametrize("products", [1, 10**9])
def test_tasks_that_meet_orders_grow_with_the_lines(spark, monkeypatch, name, products):
    """More lines make more tasks, not larger ones, whatever the session's number of shuffle partitions; rows are the same."""
    found = __spark_entry__.queries()[name]
    want = sorted(map(str, found(spark, SF).collect()))
    monkeypatch.setattr(dialect, "MANY_PRODUCTS", products)
    monkeypatch.setattr(dialect, "TASK_LINES", 1000)
    got = found(spark, SF)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    by_order = re.findall(r"Exchange hashpartitioning\((?:order_id|l_orderkey|o_orderkey)#\d+L?, (\d+)\)", plan)
    assert n > 4 and by_order and set(by_order) == {str(n)}
    assert bool(re.search(rf"hashpartitioning\((?:product_id|l_partkey)#\d+L?, {n}\)", plan)) == (products == 1)
    assert sorted(map(str, got.collect())) == want


@pytest.mark.parametrize("name", ["a08_top_categories", "a16_weekly_category", "f03_forecast", "f04_forecast_next", "w06_lags"])
def test_many_shuffle_partitions_are_not_joined_to_large_tasks(spark, monkeypatch, name):
    """With more shuffle partitions than the lines need, adaptive execution must not make one task a core of them."""
    found, before = __spark_entry__.queries()[name], spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(str, found(spark, SF).collect()))
    monkeypatch.setattr(dialect, "TASK_LINES", 1000)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    spark.conf.set("spark.sql.shuffle.partitions", 2 * n)
    try:
        got = found(spark, SF)
        assert sorted(map(str, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = got._jdf.queryExecution().executedPlan().toString()
    by_order = re.findall(r"Exchange hashpartitioning\((?:order_id|l_orderkey|o_orderkey)#\d+L?, (\d+)\), (\w+)", plan)
    assert n > 4 and by_order and set(by_order) == {(str(n), "REPARTITION_BY_NUM")}


@pytest.mark.parametrize("lines, want", [(10**9, None), (5000, 4), (1000, 6)])
def test_tasks_are_one_a_core_at_least(spark, monkeypatch, lines, want):
    monkeypatch.setattr(dialect, "TASK_LINES", lines)
    assert spark.read.parquet(f"{SF}/lineitem.parquet").count() == 6000 and spark.sparkContext.defaultParallelism == 4
    assert dialect.tasks(spark, SF) == want
