"""Training, rolling backtest, scoring and importance, on Spark SQL and Spark ML.

Rows are keyed and put in a canonical order (M01), so a model depends on its data only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators import marts
from tidewater.plans import dialect
from tidewater.sources.landing import shared_path

#: Parameters of the final fits.
TREES, DEPTH, STEP_SIZE, SEED = 20, 4, 0.1, 42
HELD_OUT = 0.2
#: Bounds of a forecast's confidence.
LOW, HIGH = 0.05, 0.999


def canonical(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of their unique key, range-partitioned by it; nulls first."""
    return rows.orderBy(*keys)


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: fits read them many times, and lost executors cost no more than a read."""
    path = shared_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def time_split(rows: DataFrame, day: str, key: str, share: float = HELD_OUT) -> DataFrame:
    """``held_out``: the latest ``share`` of rows by (day, key); positions are counted by day, so no task sorts all rows."""
    days = rows.groupBy(F.col(day).alias("_day")).agg(F.count("*").alias("_m"))
    upto = W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"), F.sum("_m").over(W.partitionBy()).alias("_n"))
    rank = F.row_number().over(W.partitionBy(day).orderBy(key)) + F.col("_before")
    return rows.join(days, F.col(day).eqNullSafe(F.col("_day"))).withColumn("held_out", rank > F.floor(F.col("_n") * (1 - share))).drop("_day", "_m", "_before", "_n")


def _ready(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in rows.columns])


def fit_binary(rows: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Balanced boosted trees: positive rows weigh negatives / positives, at least 1. Null features are 0."""
    n = rows.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    heavy = max(1.0, n["neg"] / max(n["pos"], 1))
    data = _ready(rows, features).withColumn("_w", F.when(F.col(label) == 1, heavy).otherwise(1.0)).withColumn("_y", F.col(label).cast("double"))
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP_SIZE, seed=SEED)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    return PipelineModel([assembler, trees.fit(assembler.transform(data))])


def fit_regression(rows: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    data = _ready(rows, features).withColumn("_y", F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    trees = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP_SIZE, seed=SEED)
    return PipelineModel([assembler, trees.fit(assembler.transform(data))])


def score_binary(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``score`` and ``confidence`` = max(p, 1 - p)."""
    p = vector_to_array("probability")[1]
    found = model.transform(_ready(rows, features)).withColumn("score", p).withColumn("confidence", F.greatest(p, 1 - p))
    return found.select(*rows.columns, "score", "confidence")


def score_regression(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(_ready(rows, features)).select(*rows.columns, F.greatest(F.col("prediction"), F.lit(0.0)).alias("score"))


def importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], label: str, key: str, parts: int | None = None) -> DataFrame:
    """Permutation importance: the log loss with one feature taken from another row, less the log loss as it is.

    One job scores all features: rows are exploded by feature, dealt by a hash of
    (feature, key) to ``parts`` groups, and inside a group each takes the value of the next row in
    hash order, the last one that of the first. So no task orders a whole column.
    """
    ready = _ready(rows, features)
    parts = parts or 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = ready.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in ["", *features]])))
    each = each.withColumn("_h", F.xxhash64("feature", key)).withColumn("_g", F.pmod("_h", F.lit(parts)))
    own = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features])
    group = W.partitionBy("feature", "_g")
    ring = group.orderBy("_h", key)
    each = each.withColumn("_own", own).withColumn("_new", F.coalesce(F.lead("_own").over(ring), F.first("_own").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    mixed = each.select(label, "feature", *[F.when(F.col("feature") == f, F.col("_new")).otherwise(F.col(f)).alias(f) for f in features])
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = model.transform(mixed).groupBy("feature").agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
    plain = loss.where("feature = ''").select(F.col("loss").alias("plain"))
    return loss.where("feature <> ''").crossJoin(F.broadcast(plain)).select("feature", (F.col("loss") - F.col("plain")).alias("importance"))  # one row


# --- rolling-origin backtest ------------------------------------------------------------

_SIX = "floor({} * 1000 + 0.5) / 1000"


def _backtest(d):
    """Each series, each origin: a line of revenue on the week before it, fitted by least squares to all weeks
    before the origin, predicts the next HORIZON weeks. A fit needs only sums, so a running sum per
    series serves every origin, and no training rows are repeated."""
    h, least = marts.HORIZON, marts.MIN_TRAIN
    rows = f"f AS ({marts._forecast(d)}), r AS (SELECT category, week, CAST(floor(revenue * 100 + 0.5) AS BIGINT) AS y, CAST(floor(revenue_lag1 * 100 + 0.5) AS BIGINT) AS x, row_number() OVER (PARTITION BY category ORDER BY week) AS rn FROM f WHERE revenue_lag1 IS NOT NULL)"
    if d.name == "spark":
        big = lambda c: f"CAST({c} AS DECIMAL(19,0))"
        run = lambda c: f"sum({c}) OVER (PARTITION BY category ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        sums = f"""s AS (SELECT category, rn AS k, {run(big('x'))} AS sx, {run(big('y'))} AS sy, {run(f"{big('x')} * {big('x')}")} AS sxx, {run(f"{big('x')} * {big('y')}")} AS sxy, count(*) OVER (PARTITION BY category) AS n FROM r),
            o AS (SELECT * FROM s WHERE k >= {least} AND k + {h} <= n AND (k - {least}) % {h} = 0)"""
        joined = f"SELECT o.*, p.rn, p.week, p.x, p.y FROM (SELECT *, {least} + {h} * CAST(floor((rn - 1 - {least}) / {h}) AS INT) AS origin FROM r WHERE rn > {least}) p JOIN o ON p.category = o.category AND p.origin = o.k"
    else:
        sums = f"""o AS (SELECT a.category, a.rn AS k, sum(CAST(b.x AS HUGEINT)) AS sx, sum(CAST(b.y AS HUGEINT)) AS sy, sum(CAST(b.x AS HUGEINT) * b.x) AS sxx, sum(CAST(b.x AS HUGEINT) * b.y) AS sxy FROM r a JOIN r b ON a.category = b.category AND b.rn <= a.rn
            WHERE a.rn >= {least} AND a.rn + {h} <= (SELECT max(z.rn) FROM r z WHERE z.category = a.category) AND (a.rn - {least}) % {h} = 0 GROUP BY a.category, a.rn)"""
        joined = f"SELECT o.*, p.rn, p.week, p.x, p.y FROM o JOIN r p ON p.category = o.category AND p.rn BETWEEN o.k + 1 AND o.k + {h}"
    exact = "DECIMAL(38,0)" if d.name == "spark" else "HUGEINT"
    minor = lambda c, a, b: f"CAST(CAST(k AS {exact}) * CAST({c} AS {exact}) - CAST({a} AS {exact}) * CAST({b} AS {exact}) AS DOUBLE)"
    det = minor("sxx", "sx", "sx")
    slope = f"CASE WHEN {det} > 0 THEN {minor('sxy', 'sx', 'sy')} / {det} ELSE 0.0E0 END"
    return f"""{rows}, {sums}, j AS ({joined}), m AS (SELECT category, week, CAST((k - {least}) / {h} AS INT) AS fold, x, y, k, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy, {slope} AS slope FROM j),
        bt AS (SELECT category, week, fold, CAST(y AS DOUBLE) / 100 AS actual, {_SIX.format('greatest((sy - slope * sx) / k + slope * x, 0.0E0) / 100')} AS prediction, CAST(x AS DOUBLE) / 100 AS lag1, {_SIX.format('slope * (x - sx / k) / 100')} AS effect FROM m)"""


PLANS = {
    "m07_backtest": lambda d: f"WITH {_backtest(d)} SELECT category, week, fold, actual, prediction FROM bt",
    "m10_forecast_confidence": lambda d: f"""WITH {_backtest(d)}, w AS (SELECT category, CAST(sum(CAST(floor(actual * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS a, CAST(sum(abs(CAST(floor(prediction * 100 + 0.5) AS BIGINT) - CAST(floor(actual * 100 + 0.5) AS BIGINT))) AS DOUBLE) AS e FROM bt GROUP BY category)
        SELECT category, least(greatest(1 - e / a, {LOW}E0), {HIGH}E0) AS confidence FROM w WHERE a > 0""",
}


# --- final fits --------------------------------------------------------------------------

CHURN = marts.CHURN_FEATURES
FORECAST = ["week_of_year", "aov_lag1", *(f"{c}_lag{k}" for c in ("revenue", "orders") for k in (1, 2, 4, 8)), "revenue_roll4_mean", "revenue_roll4_std", "orders_roll4_mean", "series_weeks"]


def churn_rows(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Training rows with their side of the split, written twice: the split and the order read the first table three times, the fit the second."""
    rows = written(marts.churn_training(spark, sf_dir, orders), "churn-history")
    return written(canonical(time_split(rows, "as_of", "customer"), "customer"), "churn-rows")


def m01_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The churn rows in canonical order with their side of the time split."""
    return canonical(time_split(dialect.run(marts.PLANS["f05_churn_training"], spark, sf_dir).select("customer", "as_of", "churned"), "as_of", "customer"), "customer")


def m08_churn_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows scored by a fit on the earlier ones."""
    rows = churn_rows(spark, sf_dir)
    model = fit_binary(rows.where(~F.col("held_out")), CHURN, "churned")
    return score_binary(model, rows.where("held_out"), CHURN).select("customer", "as_of", "churned", "score", "confidence")


def m08_forecast_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next week's orders of every trained category, by a fit on all its weeks; trained are those with 16 non-zero weeks."""
    weeks = written(dialect.run(marts.PLANS["f03_forecast"], spark, sf_dir), "forecast-rows")
    trained = weeks.where("orders > 0").groupBy("category").agg(F.count("*").alias("_n")).where(f"_n >= {marts.MIN_TRAIN}").select("category")
    model = fit_regression(canonical(weeks.join(trained, "category", "left_semi"), "category", "week"), FORECAST, "orders")
    coming = dialect.run(marts.PLANS["f04_forecast_next"], spark, sf_dir).join(trained, "category", "left_semi")
    return score_regression(model, coming, FORECAST).select(F.concat("category", F.lit("@"), F.date_format("week", "yyyy-MM-dd")).alias("entity"), "score")


def m11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = churn_rows(spark, sf_dir)
    model = fit_binary(rows.where(~F.col("held_out")), CHURN, "churned")
    return importance(model, rows.where("held_out"), CHURN, "churned", "customer")


QUERIES = {f.__name__: f for f in (m01_training_order, m08_churn_fit, m08_forecast_fit, m11_importance)}
ORACLE = {
    "m01_training_order": dialect.oracle(
        lambda d: f"WITH t AS ({marts._churn_training(d)}), n AS (SELECT count(*) AS n FROM t) SELECT t.customer, t.as_of, t.churned, (SELECT count(*) FROM t x WHERE x.as_of < t.as_of OR x.as_of = t.as_of AND x.customer <= t.customer) > floor(n * {1 - HELD_OUT}) AS held_out FROM t CROSS JOIN n"
    ),
}
