"""Data-quality checks that return what breaks them, listings with arguments, and records for the replay.

The queries plant violations into the fixture, which has none, so that a check that finds nothing fails its comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from ..sources.landing import land_csv, shared_path
from ..streaming import detect
from . import marts, monitoring


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is in no row of the parent; a null key refers to nothing and is none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def outside(rows: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows whose value is below ``low`` or above ``high``; nulls are for ``not_null`` to find."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < F.lit(low))
    if high is not None:
        bad = bad | (F.col(column) > F.lit(high))
    return rows.where(F.coalesce(bad, F.lit(False)))


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are in both populations, once."""
    return a.select(key).intersect(b.select(key))


def disagreement(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """(key, a, b) where two paths to one metric differ by more than the tolerance, or one of them has no value."""
    both = a.select(F.col(key).alias("_ka"), F.col(value).alias("a")).join(b.select(F.col(key).alias("_kb"), F.col(value).alias("b")), F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer")
    same = F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)) | (F.col("a").isNull() & F.col("b").isNull())
    return both.where(~same).select(F.coalesce("_ka", "_kb").alias(key), "a", "b")


def open_anomalies(rows: DataFrame, detector: str | None = None, most: int = 50) -> DataFrame:
    """Open and surfaced anomalies, newest first, of one detector or of all."""
    found = rows.where("status = 'open' AND surfaced")
    found = found if detector is None else found.where(F.col("detector") == detector)
    return found.orderBy(F.desc("bucket_start"), "metric").limit(most)


def drift_rows(rows: DataFrame, model: str | None = None, most: int = 50) -> DataFrame:
    """Drift rows of one model or of all, newest run first."""
    found = rows if model is None else rows.where(F.col("model") == model)
    return found.orderBy(F.desc("computed_at"), "model", "feature").limit(most)


def replay_orders(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders (order_id, ...) with ``items`` in line order and ``payments`` by value, installments (both falling) and type. An
    order's lines are one list in a task."""
    lines = items.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "product_id", "seller_id", "price", "freight"))).alias("_l"))
    paid = payments.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("_v"), (-F.col("installments")).alias("_i"), "pay_type"))).alias("_p"))
    rows = orders.join(lines, "order_id", "left").join(paid, "order_id", "left")
    made = rows.withColumn("items", F.transform(F.coalesce("_l", F.array().cast("array<struct<item_id:int,product_id:bigint,seller_id:bigint,price:decimal(12,2),freight:decimal(12,2)>>")), lambda x: F.struct(x.product_id.alias("product_id"), x.seller_id.alias("seller_id"), x.price.alias("price"), x.freight.alias("freight"))))
    return made.withColumn("payments", F.transform("_p", lambda x: F.struct(x.pay_type.alias("payment_type"), (-x["_i"]).alias("installments"), (-x["_v"]).cast("decimal(12,2)").alias("value")))).drop("_l", "_p")


def surges(forecast: DataFrame, factor: float = 1.2, least: float = 5.0) -> DataFrame:
    """Forecasts (category, week, point_estimate, recent_avg) above ``factor`` times the recent mean and at least ``least`` more, with the
    quantity to draft: what exceeds the mean, rounded up."""
    more = F.col("point_estimate") - F.col("recent_avg")
    return forecast.where((F.col("point_estimate") > F.col("recent_avg") * factor) & (more >= least)).withColumn("quantity", F.ceil(more).cast("int"))


def label_mix(features: DataFrame) -> DataFrame:
    """Orders that each pattern of the injected labels matches."""
    high = (F.col("installments_max") >= marts.INSTALLMENTS) & (F.col("order_value") > marts.VALUE)
    return features.agg(F.count_if(F.col("velocity_24h") >= marts.VELOCITY).alias("velocity"), F.count_if(F.col("price_vs_benchmark") >= marts.RATIO).alias("price"), F.count_if(high).alias("installments"), F.count("*").alias("orders"))


# --- queries ------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return dialect.run(lambda d: text, spark, sf_dir)


def d04_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without an order, where the order of some lines was lost."""
    lines = _table(spark, sf_dir, "SELECT CASE WHEN l_orderkey % 500 = 0 THEN -1 - l_orderkey ELSE l_orderkey END AS order_id, l_linenumber FROM lineitem")
    return orphans(lines, "order_id", _table(spark, sf_dir, "SELECT o_orderkey FROM orders"), "o_orderkey")


def d05_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores outside 1 to 5, negative prices, and dates after the present, each planted in some lines."""
    rows = _table(spark, sf_dir, "SELECT order_id, item_id, CASE WHEN order_id % 700 = 0 THEN -price ELSE price END AS price, CASE WHEN order_id % 900 = 0 THEN 6 WHEN order_id % 900 = 1 THEN 0 ELSE score END AS score, CASE WHEN order_id % 800 = 0 THEN DATE '2999-01-01' ELSE shipped END AS shipped FROM items")
    checks = {"price": outside(rows, "price", low=0), "score": outside(rows, "score", 1, 5), "shipped": rows.where(F.col("shipped") > F.current_date())}
    parts = [found.select(F.lit(name).alias("check"), "order_id", "item_id") for name, found in checks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def u03_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that were both trained on and scored, where every 97th was put into both."""
    p = _table(spark, sf_dir, "SELECT * FROM preds")
    old = F.col("predicted_at") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    leaked = F.col("id") % 97 == 0
    return shared(p.where(old | leaked), p.where(~old | leaked), "id")


def d08_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue from orders, and from one row per order with its lines, where a join doubled some orders."""
    one = _table(spark, sf_dir, "SELECT d, sum(pay) AS revenue FROM valid GROUP BY d")
    other = _table(spark, sf_dir, "SELECT d, sum(pay) AS revenue FROM (SELECT d, pay FROM valid UNION ALL SELECT d, pay FROM valid WHERE order_id % 1000 = 0) t GROUP BY d")
    return disagreement(one, other, "d", "revenue").select("d", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))


def s02_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two files landed in two batches, with their stamps."""
    parts = []
    for batch in ("b0", "b1"):
        path = shared_path(spark, "lineage")
        _table(spark, sf_dir, "SELECT c_custkey, c_name FROM customer").where(F.col("c_custkey") % 2 == int(batch[1])).coalesce(1).write.option("header", True).csv(path)
        parts.append(land_csv(spark, path, batch))
    rows = parts[0].unionByName(parts[1])
    recent = F.unix_timestamp("_loaded_at") > F.unix_timestamp() - 3600
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "_batch_id", recent.alias("stamped"), F.col("_source_file").rlike(r"^part-.*\.csv$").alias("has_file"))


def s10_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the replay sends them, their lists written out."""
    orders = _table(spark, sf_dir, "SELECT order_id, customer, status, pay, is_lost FROM header")
    items = _table(spark, sf_dir, "SELECT order_id, item_id, product_id, seller_id, price, freight FROM items")
    pays = _table(spark, sf_dir, "SELECT order_id, pay_type, installments, price AS value FROM items")
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")
    out = replay_orders(orders, items, pays)
    return out.select("order_id", "customer", "status", F.col("pay").cast("double").alias("pay"), "is_lost", text("items", "product_id", "seller_id", "price", "freight").alias("items"), F.coalesce(text("payments", "payment_type", "installments", "value"), F.lit("")).alias("payments"))


def l03_open_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 anomalies of each detector."""
    level = detect.s08_anomalies(spark, sf_dir).select("metric", "detector", "bucket_start", "severity", "status", "surfaced")
    rate = detect.t12_surfaced(spark, sf_dir).select(F.concat("model", F.lit("_rate")).alias("metric"), F.lit("model").alias("detector"), F.timestamp_micros(F.col("b") * 21_600_000_000).alias("bucket_start"), "severity", F.lit("open").alias("status"), "surfaced")
    rows = level.unionByName(rate)
    return open_anomalies(rows, "statistical", 20).unionByName(open_anomalies(rows, "model", 20)).select("metric", "detector", "bucket_start", "severity")


def l06_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five drift rows of one model."""
    base = monitoring.baseline(monitoring._training(spark, sf_dir), monitoring.KEYS)
    runs = [monitoring.drift(base, monitoring._samples(spark, sf_dir, n), monitoring.KEYS, least=10).withColumn("computed_at", F.lit(n)) for n in (500, 60)]
    return drift_rows(runs[0].unionByName(runs[1]), "purchase", 5).select("model", "computed_at", "feature", "psi", "status")


def g16_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    coming = dialect.run(marts.PLANS["f04_forecast_next"], spark, sf_dir)
    rows = coming.select("category", "week", F.col("orders_lag1").cast("double").alias("point_estimate"), F.col("orders_roll4_mean").alias("recent_avg"))
    return surges(rows, 1.05, 1.0).select("category", "week", "quantity")


def a25_label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_mix(marts.order_features(spark, sf_dir))


QUERIES = {f.__name__: f for f in (d04_relationships, d05_range, u03_disjoint, d08_agreement, s02_lineage, s10_nested, l03_open_anomalies, l06_drift, g16_surge, a25_label_mix)}

_ITEMS = f"items AS ({dialect.LOGICAL['items']})"
_RATE = detect.ORACLE["t12_surfaced"]
ORACLE = {
    "d04_relationships": "SELECT -1 - l_orderkey AS order_id, l_linenumber FROM lineitem WHERE l_orderkey % 500 = 0",
    "d05_range": f"WITH {_ITEMS} SELECT 'price' AS check, order_id, item_id FROM items WHERE order_id % 700 = 0 AND price > 0 UNION ALL SELECT 'score', order_id, item_id FROM items WHERE order_id % 900 IN (0, 1) UNION ALL SELECT 'shipped', order_id, item_id FROM items WHERE order_id % 800 = 0",
    "u03_disjoint": "SELECT event_id AS id FROM events WHERE event_id % 97 = 0",
    "d08_agreement": """WITH v AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(12,2)) AS pay, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 0)
        SELECT d, CAST(sum(pay) AS DOUBLE) AS a, CAST(sum(pay) + sum(pay) FILTER (WHERE k % 1000 = 0) AS DOUBLE) AS b FROM v GROUP BY d HAVING count(*) FILTER (WHERE k % 1000 = 0) > 0""",
    "s02_lineage": "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'b0' ELSE 'b1' END AS _batch_id, true AS stamped, true AS has_file FROM customer",
    "s10_nested": f"""WITH {_ITEMS} SELECT o.o_orderkey AS order_id, o.o_custkey AS customer, o.o_orderstatus AS status, CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS pay, o.o_orderstatus = 'P' AS is_lost,
        coalesce((SELECT string_agg(concat_ws(':', product_id, seller_id, price, freight), ',' ORDER BY item_id) FROM items i WHERE i.order_id = o.o_orderkey), '') AS items,
        coalesce((SELECT string_agg(concat_ws(':', pay_type, installments, price), ',' ORDER BY price DESC, installments DESC, pay_type) FROM items i WHERE i.order_id = o.o_orderkey), '') AS payments FROM orders o""",
    "l03_open_anomalies": f"""SELECT * FROM (SELECT metric, detector, bucket_start, severity FROM ({detect.ORACLE['s08_anomalies']}) ORDER BY bucket_start DESC, metric LIMIT 20)
        UNION ALL SELECT * FROM (SELECT model || '_rate', 'model', make_timestamp(b * 21600000000), severity FROM ({_RATE}) WHERE surfaced ORDER BY b DESC, model LIMIT 20)""",
    "l06_drift": f"""WITH {monitoring._HEAD}, {monitoring._drift_sql('d', 500)}, {monitoring._drift_sql('e', 60)} SELECT model, computed_at, feature, psi, {monitoring._BAND} AS status
        FROM (SELECT 500 AS computed_at, * FROM d WHERE n >= 10 UNION ALL SELECT 60, * FROM e WHERE n >= 10) WHERE model = 'purchase' ORDER BY computed_at DESC, feature LIMIT 5""",
    "g16_surge": dialect.oracle(lambda d: f"WITH n AS ({marts._forecast(d, 1)}) SELECT category, week, CAST(ceil(orders_lag1 - orders_roll4_mean) AS INT) AS quantity FROM n WHERE orders_lag1 - orders_roll4_mean > 0.05 * orders_roll4_mean AND orders_lag1 >= orders_roll4_mean + 1"),
    "a25_label_mix": dialect.oracle(
        lambda d: f"WITH {marts._features_oracle(d)} SELECT count(*) FILTER (WHERE velocity_24h >= {marts.VELOCITY}) AS velocity, count(*) FILTER (WHERE price_vs_benchmark >= {marts.RATIO}) AS price, count(*) FILTER (WHERE installments_max >= {marts.INSTALLMENTS} AND order_value > {marts.VALUE}) AS installments, count(*) AS orders FROM features"
    ),
}
