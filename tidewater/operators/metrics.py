"""Metrics as DataFrame functions with their dates, limits and ranks as arguments.

``orders`` has order_id, customer, d, pay, is_delivered and is_lost; ``lines`` has order_id and
category. Dates are included at both ends, None leaves an end open. Their checks are
the SQL texts of ``facts``, written apart from these.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators import facts
from tidewater.plans import dialect

Day = str | dt.date | None
MOST = 50


def between(rows: DataFrame, low: Day = None, high: Day = None, day: str = "d") -> DataFrame:
    if low is not None:
        rows = rows.where(F.col(day) >= F.lit(low).cast("date"))
    return rows if high is None else rows.where(F.col(day) <= F.lit(high).cast("date"))


def is_valid() -> F.Column:
    return ~F.col("is_lost") & (F.col("pay") > 0)


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def daily_revenue(orders: DataFrame, low: Day = None, high: Day = None) -> DataFrame:
    return between(orders, low, high).where(is_valid()).groupBy("d").agg(F.countDistinct("order_id").alias("orders"), F.sum("pay").cast("double").alias("revenue"))


def daily_orders(orders: DataFrame, low: Day = None, high: Day = None) -> DataFrame:
    n = lambda c: F.countDistinct(F.when(F.col(c), F.col("order_id")))
    return between(orders, low, high).groupBy("d").agg(F.countDistinct("order_id").alias("total"), n("is_delivered").alias("delivered"), n("is_lost").alias("lost"))


def daily_aov(orders: DataFrame, low: Day = None, high: Day = None) -> DataFrame:
    return daily_revenue(orders, low, high).select("d", _ratio(F.col("revenue"), F.col("orders")).alias("aov"))


def series(orders: DataFrame, low: Day = None, high: Day = None) -> DataFrame:
    return daily_revenue(orders, low, high).select("d", "revenue").orderBy("d")


def category_totals(lines: DataFrame, orders: DataFrame, low: Day = None, high: Day = None, tasks: int | None = None) -> DataFrame:
    """Revenue and distinct orders per category: an order's payment counts once per line of it. An order is counted at its first line of
    a category and its first header row, both marked in the order that the join needs anyway. Orders meet in ``tasks``, if given."""
    per = W.partitionBy("order_id")
    lines, orders = lines.select("order_id", "category"), between(orders, low, high).where(is_valid()).select("order_id", "pay")
    if tasks:
        lines, orders = (rows.repartition(tasks, "order_id") for rows in (lines, orders))
    once = orders.select("order_id", "pay", (F.row_number().over(per.orderBy("pay")) == 1).alias("_one"))
    first = ~F.lag(F.struct("category")).over(per.orderBy("category")).eqNullSafe(F.struct("category"))
    marked = lines.select("order_id", "category", first.alias("_first"))
    return marked.join(once, "order_id").groupBy("category").agg(F.sum("pay").cast("double").alias("revenue"), F.count_if(F.col("_first") & F.col("_one")).alias("orders"))


def top_categories(lines: DataFrame, orders: DataFrame, by: str = "revenue", limit: int = 10, low: Day = None, high: Day = None, tasks: int | None = None) -> DataFrame:
    """The first ``limit`` (1 to 50) categories by revenue or orders, ties by name."""
    if by not in ("revenue", "orders") or not 1 <= limit <= MOST:
        raise ValueError(f"by is revenue or orders, limit 1 to {MOST}")
    return category_totals(lines, orders, low, high, tasks).orderBy(F.desc(by), "category").limit(limit)


def summary(orders: DataFrame, lines: DataFrame, low: Day = None, high: Day = None, tasks: int | None = None) -> DataFrame:
    """Revenue, orders and their ratio between two dates, beside customers, first and last day and top category of the whole history."""
    inside = is_valid()
    if low is not None:
        inside = inside & (F.col("d") >= F.lit(low).cast("date"))
    if high is not None:
        inside = inside & (F.col("d") <= F.lit(high).cast("date"))
    kept = ~F.col("is_lost")
    one = orders.agg(
        F.sum(F.when(inside, F.col("pay"))).cast("double").alias("revenue"),
        F.countDistinct(F.when(inside, F.col("order_id"))).alias("orders"),
        F.countDistinct(F.when(kept, F.col("customer"))).alias("customers"),
        F.min(F.when(kept, F.col("d"))).alias("first_day"),
        F.max(F.when(kept, F.col("d"))).alias("last_day"),
    )
    best = category_totals(lines, orders, tasks=tasks).agg(F.min_by("category", F.struct(-F.col("revenue"), "category")).alias("top_category"))
    return one.crossJoin(F.broadcast(best)).select("revenue", "orders", _ratio(F.col("revenue"), F.col("orders")).alias("aov"), "customers", "first_day", "last_day", "top_category")  # one row each


def weekly(orders: DataFrame, weeks: int | None = None) -> DataFrame:
    """Orders and revenue per week; of the last ``weeks`` weeks before the newest day, or of all."""
    if weeks is not None:
        newest = orders.agg((F.max("d") - F.expr(f"INTERVAL '{7 * weeks}' DAY")).alias("_from"))
        orders = orders.crossJoin(F.broadcast(newest)).where(F.col("d") >= F.col("_from"))  # one row
    return orders.groupBy(F.date_trunc("week", "d").cast("date").alias("week")).agg(F.count("*").alias("orders"), F.sum("pay").cast("double").alias("revenue"))


def at_risk_share(predictions: DataFrame, threshold: float) -> DataFrame:
    hot = F.count_if(F.col("score") >= threshold)
    return predictions.groupBy("model").agg(F.count("*").alias("scored"), hot.alias("at_risk"), (hot.cast("double") / F.count("*")).alias("share"))


def newest(predictions: DataFrame, limit: int, model: str | None = None, entity: str | None = None) -> DataFrame:
    """The newest predictions, of one model or entity if named; ties by falling id."""
    for c, v in (("model", model), ("entity", entity)):
        if v is not None:
            predictions = predictions.where(F.col(c) == v)
    return predictions.orderBy(F.desc("predicted_at"), F.desc("id")).limit(limit)


def _table(name: str):
    return lambda spark, sf_dir: dialect.run(lambda d: f"SELECT * FROM {name}", spark, sf_dir)


_orders, _preds = _table("header"), _table("preds")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(lambda d: f"SELECT {d.by('order_id')} order_id, category FROM lines", spark, sf_dir)


QUERIES = {
    "a05_daily_revenue": lambda s, d: daily_revenue(_orders(s, d)),
    "a06_daily_orders": lambda s, d: daily_orders(_orders(s, d)),
    "a07_daily_aov": lambda s, d: daily_aov(_orders(s, d)),
    "a08_top_categories": lambda s, d: category_totals(_lines(s, d), _orders(s, d), tasks=dialect.tasks(s, d)),
    "a09_summary": lambda s, d: summary(_orders(s, d), _lines(s, d), "1997-01-01", "1998-12-31", dialect.tasks(s, d)),
    "a12_weekly": lambda s, d: weekly(_orders(s, d), 12),
    "a17_weekly_orders": lambda s, d: weekly(_orders(s, d)),
    "a18_at_risk_share": lambda s, d: at_risk_share(_preds(s, d), 0.9),
    "l01_top_by_rank": lambda s, d: top_categories(_lines(s, d), _orders(s, d), "revenue", 5, tasks=dialect.tasks(s, d)).select("category", "revenue"),
    "l04_predictions": lambda s, d: newest(_preds(s, d), 50, "purchase").select("id", "entity", "score"),
    "l08_recent_scores": lambda s, d: newest(_preds(s, d), 20, "click").select("id", "score"),
    "l10_series": lambda s, d: series(_orders(s, d), "1997-01-01", "1997-12-31"),
}
ORACLE = {name: dialect.oracle(facts.PLANS[name]) for name in QUERIES}
PLANS: dict = {}
