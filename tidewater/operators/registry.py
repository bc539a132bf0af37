"""Model registry, prediction table and the scoring jobs that read both.

The registry is a log of entries, folded per model: an ``active`` registration supersedes the version before it, a
``candidate`` never does, and a ``promote`` entry takes effect only while the active version is the one it expects
(compare and set). An entry is a folder that is written once, under the next free number; of two writers of one
number the second fails and reads again. Entries of a model are few; a task folds them as one list.

Predictions are partitioned by model, version and batch. A batch that is written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from ..sources.landing import shared_path
from . import marts, models

ENTRY = "entry long, kind string, model string, version string, status string, expected string, task string, grain string, artifact string, metrics map<string,double>, features array<string>, at timestamp"
PREDICTION = "model_name string, model_version string, batch string, grain string, entity_id string, prediction double, confidence double, lower_bound double, upper_bound double, explanation map<string,double>, features map<string,double>, source string, predicted_at timestamp"
#: Least base rate, factor above which a reproduction warns, and its least rows.
LEAST_RATE, WARNS, LEAST_ROWS = 0.01, 1.25, 20


def fold(log: DataFrame) -> DataFrame:
    """Per model ``active`` (a version or null), the versions that were active, and the entries that were refused."""
    step = F.array_sort(F.collect_list(F.struct("entry", "kind", "version", "status", "expected")))

    def take(s: Column, x: Column) -> Column:
        ok = (x.kind == "register") | (s.active.eqNullSafe(x.expected) & F.array_contains(s.known, x.version))
        on = ok & ((x.kind == "promote") | (x.status == "active"))
        off = ok & ~on  # registered again as a candidate
        active = F.when(on, x.version).when(off & (s.active == x.version), F.lit(None)).otherwise(s.active)
        was = F.when(on, F.array_union(s.was, F.array(x.version))).when(off, F.array_except(s.was, F.array(x.version))).otherwise(s.was)
        return F.struct(active.cast("string").alias("active"), F.when(x.kind == "register", F.array_union(s.known, F.array(x.version))).otherwise(s.known).alias("known"), was.alias("was"), F.when(ok, s.refused).otherwise(F.array_append(s.refused, x.entry)).alias("refused"))

    none = F.expr("named_struct('active', cast(null as string), 'known', cast(array() as array<string>), 'was', cast(array() as array<string>), 'refused', cast(array() as array<bigint>))")
    return log.groupBy("model").agg(F.aggregate(step, none, take).alias("s")).select("model", "s.active", "s.was", "s.refused")


def versions(log: DataFrame) -> DataFrame:
    """The newest registration of every version with its status: active, superseded or candidate."""
    newest = log.where("kind = 'register'").groupBy("model", "version").agg(F.max_by(F.struct("task", "grain", "artifact", "metrics", "features", "at"), "entry").alias("r"))
    rows = newest.join(fold(log), "model")
    status = F.when(F.col("version") == F.col("active"), "active").when(F.array_contains("was", F.col("version")), "superseded").otherwise("candidate")
    return rows.select("model", "version", status.alias("status"), "r.*")


def active(log: DataFrame) -> DataFrame:
    """The active version of every model. A threshold that is not positive is none, and then there is no base rate either,
    so whatever compares with them does not hold; a base rate is at least LEAST_RATE."""
    t = F.col("metrics")["recommended_threshold"]
    rows = versions(log).where("status = 'active'").withColumn("threshold", F.when(t > 0, t))
    rate = F.when(F.col("threshold").isNotNull(), F.greatest(F.coalesce(F.col("metrics")["positive_rate"], F.lit(LEAST_RATE)), F.lit(LEAST_RATE)))
    return rows.select("model", "version", "threshold", rate.alias("base_rate"), "artifact", "metrics", "features")


def at_risk(predictions: DataFrame, log: DataFrame) -> DataFrame:
    """Predictions (model, score, ...) against the threshold of their model's active version; null without one."""
    now = active(log).select(F.col("model").alias("_m"), "threshold", "base_rate")
    return predictions.join(F.broadcast(now), F.col("model") == F.col("_m"), "left").withColumn("at_risk", F.col("score") >= F.col("threshold")).drop("_m")  # one row per model


class Registry:
    """The log in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at) or not files.listStatus(at):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/*")

    def _append(self, row: dict, tries: int = 20) -> int:
        names = [f.split()[0] for f in ENTRY.split(", ")]
        for _ in range(tries):
            n = (self.log().agg(F.max("entry")).first()[0] or 0) + 1
            try:
                rows = self.spark.createDataFrame([tuple({**row, "entry": n}.get(c) for c in names)], ENTRY).withColumn("at", F.current_timestamp())
                rows.coalesce(1).write.mode("error").parquet(f"{self.path}/{n:012d}")
                return n
            except PySparkException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
        raise RuntimeError("the registry was written by others all the time")

    def register(self, model: str, version: str, status: str = "active", **more) -> int:
        if status not in ("active", "candidate"):
            raise ValueError(f"status {status}")
        return self._append({"kind": "register", "model": model, "version": version, "status": status, **more})

    def promote(self, model: str, version: str, expected: str | None) -> bool:
        """Make a registered version active if ``expected`` is the active one; whether it took effect."""
        n = self._append({"kind": "promote", "model": model, "version": version, "expected": expected})
        refused = fold(self.log()).where(F.col("model") == model).select(F.array_contains("refused", F.lit(n).cast("long"))).first()
        return not refused[0]

    def active(self, model: str):
        """The row of the active version; LookupError without one."""
        found = active(self.log()).where(F.col("model") == model).first()
        if found is None:
            raise LookupError(f"no active version of {model}")
        return found


# --- predictions --------------------------------------------------------------------


def write_predictions(rows: DataFrame, path: str, model: str, version: str, grain: str, batch: str, source: str = "batch") -> None:
    """Write rows (entity_id, prediction, and those of the other columns that there are) as one batch of a version."""
    fixed = {"model_name": model, "model_version": version, "batch": batch, "grain": grain, "source": source}
    columns = []
    for field in PREDICTION.split(", "):
        name, kind = field.split(" ", 1)
        given = F.lit(fixed[name]) if name in fixed else F.current_timestamp() if name == "predicted_at" else F.col(name) if name in rows.columns else F.lit(None)
        columns.append(given.cast(kind).alias(name))
    rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name", "model_version", "batch").parquet(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], PREDICTION)
    return spark.read.schema(PREDICTION).parquet(path)


def bounds(backtest: DataFrame, series: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(series, low, high): quantiles of what was, less what was predicted, over the folds of each series."""
    off = F.col("actual") - F.col("prediction")
    return backtest.groupBy(series).agg(F.percentile(off, F.lit(low)).alias("low"), F.percentile(off, F.lit(high)).alias("high"))


def explained(model: PipelineModel, rows: DataFrame, features: Sequence[str], key: str, usual: dict[str, float], score: Column) -> DataFrame:
    """(key, explanation): for each feature, by how much the score falls when it takes its usual value. One job scores every row once
    more per feature; a row's list is as long as the features."""
    ready = models._ready(rows.select(key, *features), features)
    each = ready.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in ["", *features]])))
    changed = each.select(key, "_f", *[F.when(F.col("_f") == f, F.lit(float(usual.get(f) or 0.0))).otherwise(F.col(f)).alias(f) for f in features])
    found = model.transform(changed).withColumn("_s", score).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_s"))).alias("_all"))
    return found.select(key, F.map_filter(F.transform_values("_all", lambda k, v: F.col("_all")[""] - v), lambda k, v: k != "").alias("explanation"))


def probability() -> Column:
    return vector_to_array("probability")[1]


def not_negative() -> Column:
    return F.greatest(F.col("prediction"), F.lit(0.0))


def usual(rows: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return models._ready(rows, features).agg(*[F.avg(c).alias(c) for c in features]).first().asDict()


def train_churn(spark: SparkSession, sf_dir: str, registry: Registry, root: str, version: str, status: str = "active", orders: DataFrame | None = None) -> None:
    """Fit on the earlier rows, register with threshold, base rate and the features' usual values measured there."""
    rows = models.churn_rows(spark, sf_dir, orders)
    train, held = rows.where(~F.col("held_out")), rows.where("held_out")
    model = models.fit_binary(train, models.CHURN, "churned")
    artifact = f"{root}/churn-{version}"
    model.write().overwrite().save(artifact)
    scored = models.score_binary(model, held, models.CHURN).select(F.floor(F.col("score") * 200).alias("b"), "churned")
    bins = {r["b"]: (r["n"], r["y"]) for r in scored.groupBy("b").agg(F.count("*").alias("n"), F.sum("churned").alias("y")).collect()}  # at most 201
    n, y, best = 0, 0, (0.0, 0.5)
    for b in range(199, 99, -1):
        n, y = n + bins.get(b, (0, 0))[0] + (bins.get(200, (0, 0))[0] if b == 199 else 0), y + bins.get(b, (0, 0))[1] + (bins.get(200, (0, 0))[1] if b == 199 else 0)
        if n and y / n >= best[0]:
            best = (min(y / n, 0.85), b / 200)
    rate = train.agg(F.avg("churned")).first()[0]
    registry.register("churn_risk", version, status, task="binary", grain="customer", artifact=artifact, metrics={"recommended_threshold": best[1], "positive_rate": rate, **{f"usual.{k}": v or 0.0 for k, v in usual(train, models.CHURN).items()}}, features=list(models.CHURN))


def score_churn(spark: SparkSession, sf_dir: str, registry: Registry, path: str, batch: str, orders: DataFrame | None = None) -> DataFrame:
    """Score the current customers that the active version has not scored yet; returns all that it has scored in this and earlier passes, with
    their rank among them and the version's threshold and base rate, as an event of the pass carries them."""
    now = registry.active("churn_risk")
    model, seen = PipelineModel.load(now["artifact"]), predictions(spark, path).where((F.col("model_name") == "churn_risk") & (F.col("model_version") == now["version"]) & (F.col("source") == "churn_score"))
    current = marts.churn_current(spark, sf_dir, orders).withColumn("entity_id", F.col("customer").cast("string"))
    todo = models.written(current.join(seen.select("entity_id"), "entity_id", "left_anti"), "churn-current")
    scored = models.score_binary(model, todo, now["features"]).withColumnRenamed("score", "prediction")
    why = explained(model, todo, now["features"], "entity_id", {k.removeprefix("usual."): v for k, v in now["metrics"].items()}, probability())
    vector = F.create_map(*[x for f in now["features"] for x in (F.lit(f), F.coalesce(F.col(f).cast("double"), F.lit(0.0)))])
    if not todo.isEmpty():
        write_predictions(scored.withColumn("features", vector).select("entity_id", "prediction", "confidence", "features").join(why, "entity_id"), path, "churn_risk", now["version"], "customer", batch, "churn_score")
    rows = predictions(spark, path).where((F.col("model_name") == "churn_risk") & (F.col("model_version") == now["version"]) & (F.col("source") == "churn_score"))
    return ranked(rows).withColumn("threshold", F.lit(now["threshold"]).cast("double")).withColumn("base_rate", F.lit(now["base_rate"]).cast("double"))


def ranked(rows: DataFrame) -> DataFrame:
    """Predictions with ``risk_rank``: highest first, ties by entity (numbers as such, before other names)."""
    placed = rows.withColumn("_id", F.col("entity_id").try_cast("long"))
    return rows.sparkSession.sql(marts._ranked(dialect.Spark(), "{rows}", "prediction", "_id NULLS LAST, s.entity_id", "risk_rank"), rows=placed).drop("_id", "bin")


def train_forecast(spark: SparkSession, sf_dir: str, registry: Registry, root: str, version: str, status: str = "active") -> None:
    """Fit on the weeks of series that are long enough, register with the mean absolute error per category on its last weeks."""
    weeks = models.written(dialect.run(marts.PLANS["f03_forecast"], spark, sf_dir), "forecast-rows")
    trained = weeks.where("orders > 0").groupBy("category").agg(F.count("*").alias("_n")).where(f"_n >= {marts.MIN_TRAIN}").select("category")
    rows = models.time_split(weeks.join(trained, "category", "left_semi"), "week", "category")
    model = models.fit_regression(models.canonical(rows.where(~F.col("held_out")), "category", "week"), models.FORECAST, "orders")
    artifact = f"{root}/forecast-{version}"
    model.write().overwrite().save(artifact)
    held = models.score_regression(model, rows.where("held_out"), models.FORECAST).select("category", F.col("orders").cast("double").alias("actual"), F.col("score").alias("prediction"))
    held.write.mode("overwrite").parquet(f"{artifact}-residuals")
    error = held.agg((F.sum(F.abs(F.col("actual") - F.col("prediction"))) / F.sum("actual")).alias("wmape"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae")).first()
    registry.register("category_forecast", version, status, task="regression", grain="category", artifact=artifact, metrics={**error.asDict(), **{f"usual.{k}": v or 0.0 for k, v in usual(rows, models.FORECAST).items()}}, features=list(models.FORECAST))


def score_forecast(spark: SparkSession, sf_dir: str, registry: Registry, path: str, batch: str) -> DataFrame:
    """Next week's orders of the categories the active version was trained on: entity category@week, bounds from its residuals,
    confidence from the category's WMAPE. Entities that are there already are not written again."""
    now = registry.active("category_forecast")
    model = PipelineModel.load(now["artifact"])
    residuals = spark.read.parquet(f"{now['artifact']}-residuals")
    wmape = residuals.groupBy("category").agg((F.sum(F.abs(F.col("actual") - F.col("prediction"))) / F.sum("actual")).alias("wmape"))
    coming = dialect.run(marts.PLANS["f04_forecast_next"], spark, sf_dir).withColumn("entity_id", F.concat("category", F.lit("@"), F.date_format("week", "yyyy-MM-dd")))
    seen = predictions(spark, path).where((F.col("model_name") == "category_forecast") & (F.col("model_version") == now["version"])).select("entity_id")
    todo = models.written(coming.join(wmape.select("category"), "category", "left_semi").join(seen, "entity_id", "left_anti"), "forecast-next")
    scored = models.score_regression(model, todo, now["features"]).withColumnRenamed("score", "prediction").join(bounds(residuals, "category"), "category").join(wmape, "category")
    why = explained(model, todo, now["features"], "entity_id", {k.removeprefix("usual."): v for k, v in now["metrics"].items()}, not_negative())
    vector = F.create_map(*[x for f in now["features"] for x in (F.lit(f), F.coalesce(F.col(f).cast("double"), F.lit(0.0)))])
    rows = scored.select("entity_id", "prediction", F.least(F.greatest(1 - F.col("wmape"), F.lit(models.LOW)), F.lit(models.HIGH)).alias("confidence"), F.greatest(F.col("prediction") + F.col("low"), F.lit(0.0)).alias("lower_bound"), (F.col("prediction") + F.col("high")).alias("upper_bound"), vector.alias("features"))
    if not todo.isEmpty():
        write_predictions(rows.join(why, "entity_id"), path, "category_forecast", now["version"], "category", batch, "forecast")
    return predictions(spark, path).where((F.col("model_name") == "category_forecast") & (F.col("model_version") == now["version"]))


def score_stream(stream: DataFrame, model: PipelineModel, features: Sequence[str], entity: str, path: str, name: str, version: str, grain: str, checkpoint: str) -> None:
    """Score a stream of feature rows with a fitted model and persist every micro-batch; a repeated one replaces itself. Rows without
    an entity, or with a feature that is null or NaN, break the contract and are left out."""
    good = F.col(entity).isNotNull()
    for f in features:
        good = good & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))

    def write(batch: DataFrame, n: int) -> None:
        scored = models.score_binary(model, batch.where(good), features).withColumnRenamed("score", "prediction")
        vector = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
        write_predictions(scored.select(F.col(entity).cast("string").alias("entity_id"), "prediction", "confidence", vector.alias("features")), path, name, version, grain, f"stream-{n}", "stream")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


# --- queries ------------------------------------------------------------------------


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(lambda d: "SELECT * FROM preds", spark, sf_dir)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the fixture: every model registers a version a day, as a candidate if its best score is low; on some days the version of
    the day before is promoted, if that of two days before is active."""
    d = F.to_date("predicted_at")
    a, f = F.col("value").cast("decimal(12,2)"), (F.col("id") % 100).cast("decimal(12,2)")
    days = _preds(spark, sf_dir).groupBy("model", d.alias("d")).agg(F.count("*").alias("n"), F.max("score").alias("q"), F.sum("label").alias("y"), F.sum(F.abs(a - f)).cast("double").alias("e"), F.sum(F.abs(a)).cast("double").alias("v"))
    number, text = F.datediff("d", F.lit("2024-01-01")).cast("long"), lambda back: F.date_format(F.date_sub("d", back), "yyyy-MM-dd")
    metrics = F.create_map(F.lit("recommended_threshold"), F.when(F.col("n") % 7 == 0, 0.0).otherwise(F.lit(0.85) + (F.col("n") % 10) / F.lit(100.0)), F.lit("positive_rate"), F.col("y") / F.col("n"), F.lit("mae"), F.col("e") / F.col("n"), F.lit("wmape"), F.col("e") / F.col("v"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = lambda days, kind, place, version, status, expected: days.select((number * 2 + place).alias("entry"), F.lit(kind).alias("kind"), "model", version.alias("version"), status.alias("status"), expected.alias("expected"), null("string").alias("task"), null("string").alias("grain"), null("string").alias("artifact"), metrics.alias("metrics"), null("array<string>").alias("features"), F.col("d").cast("timestamp").alias("at"))
    made = rows(days, "register", 0, text(0), F.when(F.col("q") < 0.98, "candidate").otherwise("active"), null("string"))
    return made.unionByName(rows(days.where("n % 3 <> 1"), "promote", 1, text(1), null("string"), text(2)))


def m13_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(_log(spark, sf_dir)).select("model", "version", "status")


def m22_active_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active(_log(spark, sf_dir)).select("model", "version", "threshold", "base_rate")


def l05_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(_log(spark, sf_dir)).select("model", "version", "status", F.col("metrics")["mae"].alias("mae")).orderBy("model", F.desc("version"))


def a22_active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active(_log(spark, sf_dir)).agg(F.count("*").alias("active"))


def j14_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_risk(_preds(spark, sf_dir), _log(spark, sf_dir)).select("id", "at_risk", "base_rate")


def a24_forecast_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest prediction of every model that is active, less and plus the mean absolute error of its version, not below 0."""
    last = _preds(spark, sf_dir).groupBy(F.col("model").alias("_m")).agg(F.max_by("value", F.struct("predicted_at", "id")).alias("prediction"))
    mae = F.col("metrics")["mae"]
    return last.join(active(_log(spark, sf_dir)), F.col("_m") == F.col("model")).select("model", "prediction", F.greatest(F.col("prediction") - mae, F.lit(0.0)).alias("low"), (F.col("prediction") + mae).alias("high"))


def m19_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAPE of all stored rows against that of the active version when it was registered: a warning above 1.25 times, with few rows none."""
    a, f = F.col("value").cast("decimal(12,2)"), (F.col("id") % 100).cast("decimal(12,2)")
    now = _preds(spark, sf_dir).groupBy(F.col("model").alias("_m")).agg((F.sum(F.abs(a - f)).cast("double") / F.sum(F.abs(a)).cast("double")).alias("wape"), F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    base = F.col("metrics")["wmape"]
    return now.join(active(_log(spark, sf_dir)), F.col("_m") == F.col("model")).select("model", "version", "wape", base.alias("baseline"), F.when(F.col("wape") > WARNS * base, "warning").otherwise("ok").alias("status"))


def s11_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling backtest's predictions, written and read back with bounds from each series' residuals, the feature, and what it adds to
    the prediction against its mean so far."""
    rows = dialect.run(lambda d: f"WITH {models._backtest(d)} SELECT * FROM bt", spark, sf_dir)
    near = rows.join(bounds(rows, "category").withColumnRenamed("category", "_c"), F.col("category") == F.col("_c"))
    path = shared_path(spark, "predictions")
    vector = F.create_map(F.lit("revenue_lag1"), F.col("lag1"))
    out = near.select(F.concat("category", F.lit("@"), F.date_format("week", "yyyy-MM-dd")).alias("entity_id"), "prediction", F.greatest(F.col("prediction") + F.col("low"), F.lit(0.0)).alias("lower_bound"), (F.col("prediction") + F.col("high")).alias("upper_bound"), vector.alias("features"), F.create_map(F.lit("revenue_lag1"), F.col("effect")).alias("explanation"))
    for _ in range(2):  # the same batch again
        write_predictions(out, path, "category_forecast", "v1", "category", "backtest")
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    return predictions(spark, path).select("model_name", "model_version", "grain", "entity_id", "prediction", cents("lower_bound").alias("lower_bound"), cents("upper_bound").alias("upper_bound"), F.col("features")["revenue_lag1"].alias("lag1"), F.col("explanation")["revenue_lag1"].alias("effect"))


def _jobs(spark: SparkSession) -> tuple[Registry, str, str]:
    root = shared_path(spark, "models")
    return Registry(spark, f"{root}/registry"), root, f"{root}/predictions"


def m20_churn_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, register, score every current customer once, and rank: highest score first, ties by customer."""
    registry, root, path = _jobs(spark)
    orders = marts.customer_orders(spark, sf_dir)
    train_churn(spark, sf_dir, registry, root, "v1", orders=orders)
    rows = score_churn(spark, sf_dir, registry, path, "pass-1", orders)
    return rows.select(F.col("entity_id").cast("long").alias("customer"), F.col("prediction").alias("score"), "confidence", "risk_rank", "threshold", "base_rate", "explanation", "features")


def m21_forecast_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, root, path = _jobs(spark)
    train_forecast(spark, sf_dir, registry, root, "v1")
    return score_forecast(spark, sf_dir, registry, path, "pass-1").select("entity_id", "prediction", "confidence", "lower_bound", "upper_bound", "explanation")


def t15_model_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows as a stream, scored by the active version."""
    registry, root, path = _jobs(spark)
    orders = marts.customer_orders(spark, sf_dir)
    train_churn(spark, sf_dir, registry, root, "v1", orders=orders)
    now, rows = registry.active("churn_risk"), models.written(marts.churn_current(spark, sf_dir, orders), "feature-stream")
    rows.write.mode("overwrite").parquet(f"{root}/stream")
    score_stream(spark.readStream.schema(rows.schema).parquet(f"{root}/stream"), PipelineModel.load(now["artifact"]), now["features"], "customer", path, "churn_risk", now["version"], "customer", f"{root}/checkpoint")
    return predictions(spark, path).select("entity_id", "prediction", "confidence", "source")


QUERIES = {f.__name__: f for f in (m13_registry, m22_active_model, l05_registry, a22_active_models, j14_registry, a24_forecast_band, m19_reproduction, s11_predictions, m20_churn_job, m21_forecast_job, t15_model_stream)}

_PREDS = dialect.LOGICAL["preds"]
_LOG = f"""RECURSIVE preds AS ({_PREDS}), days AS (SELECT model, CAST(predicted_at AS DATE) AS d, count(*) AS n, max(score) AS q, sum(label) AS y, CAST(sum(abs(CAST(value AS DECIMAL(12,2)) - CAST(id % 100 AS DECIMAL(12,2)))) AS DOUBLE) AS e, CAST(sum(abs(CAST(value AS DECIMAL(12,2)))) AS DOUBLE) AS v FROM preds GROUP BY 1, 2),
    log AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY d, kind DESC) AS k FROM (SELECT model, d, 'register' AS kind, d AS version, CASE WHEN q < 0.98 THEN 'candidate' ELSE 'active' END AS status, NULL AS expected FROM days UNION ALL SELECT model, d, 'promote', CAST(d - INTERVAL 1 DAY AS DATE), NULL, CAST(d - INTERVAL 2 DAY AS DATE) FROM days WHERE n % 3 <> 1)),
    run AS (SELECT model, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS act, CAST([] AS DATE[]) AS was FROM (SELECT DISTINCT model FROM log) m
        UNION ALL SELECT r.model, l.k, CASE WHEN x.on_ THEN l.version ELSE r.act END, CASE WHEN x.on_ THEN list_append(r.was, l.version) ELSE r.was END FROM run r JOIN log l ON l.model = r.model AND l.k = r.k + 1
        CROSS JOIN LATERAL (SELECT CASE l.kind WHEN 'register' THEN l.status = 'active' ELSE r.act IS NOT DISTINCT FROM l.expected AND EXISTS (SELECT 1 FROM days z WHERE z.model = l.model AND z.d = l.version) END AS on_) x),
    fin AS (SELECT model, arg_max(act, k) AS act, arg_max(was, k) AS was FROM run GROUP BY model),
    act AS (SELECT f.model, CAST(f.act AS VARCHAR) AS version, CASE WHEN y.n % 7 <> 0 THEN 0.85E0 + (y.n % 10) / 100.0E0 END AS threshold, CASE WHEN y.n % 7 <> 0 THEN greatest(CAST(y.y AS DOUBLE) / y.n, 0.01) END AS base_rate, y.e / y.n AS mae, y.e / y.v AS wmape FROM fin f JOIN days y ON y.model = f.model AND y.d = f.act)"""
ORACLE = {
    "m13_registry": f"WITH {_LOG} SELECT y.model, CAST(y.d AS VARCHAR) AS version, CASE WHEN y.d = f.act THEN 'active' WHEN list_contains(f.was, y.d) THEN 'superseded' ELSE 'candidate' END AS status FROM days y JOIN fin f ON f.model = y.model",
    "m22_active_model": f"WITH {_LOG} SELECT model, version, threshold, base_rate FROM act",
    "l05_registry": f"WITH {_LOG} SELECT y.model, CAST(y.d AS VARCHAR) AS version, CASE WHEN y.d = f.act THEN 'active' WHEN list_contains(f.was, y.d) THEN 'superseded' ELSE 'candidate' END AS status, y.e / y.n AS mae FROM days y JOIN fin f ON f.model = y.model ORDER BY 1, 2 DESC",
    "a22_active_models": f"WITH {_LOG} SELECT count(*) AS active FROM act",
    "j14_registry": f"WITH {_LOG} SELECT p.id, p.score >= a.threshold AS at_risk, a.base_rate FROM preds p LEFT JOIN act a ON a.model = p.model",
    "a24_forecast_band": f"WITH {_LOG} SELECT a.model, p.value AS prediction, greatest(p.value - a.mae, 0) AS low, p.value + a.mae AS high FROM act a JOIN (SELECT *, row_number() OVER (PARTITION BY model ORDER BY predicted_at DESC, id DESC) AS rn FROM preds) p ON p.model = a.model AND p.rn = 1",
    "m19_reproduction": f"""WITH {_LOG}, w AS (SELECT model, CAST(sum(abs(CAST(value AS DECIMAL(12,2)) - CAST(id % 100 AS DECIMAL(12,2)))) AS DOUBLE) / CAST(sum(abs(CAST(value AS DECIMAL(12,2)))) AS DOUBLE) AS wape FROM preds GROUP BY model HAVING count(*) >= 20)
        SELECT a.model, a.version, w.wape, a.wmape AS baseline, CASE WHEN w.wape > 1.25 * a.wmape THEN 'warning' ELSE 'ok' END AS status FROM w JOIN act a ON a.model = w.model""",
    "s11_predictions": dialect.oracle(
        lambda d: f"""WITH {models._backtest(d)}, q AS (SELECT category, quantile_cont(actual - prediction, 0.05) AS low, quantile_cont(actual - prediction, 0.95) AS high FROM bt GROUP BY category)
        SELECT 'category_forecast' AS model_name, 'v1' AS model_version, 'category' AS grain, bt.category || '@' || strftime(week, '%Y-%m-%d') AS entity_id, prediction, floor(greatest(prediction + low, 0.0E0) * 100 + 0.5) / 100 AS lower_bound, floor((prediction + high) * 100 + 0.5) / 100 AS upper_bound, lag1, effect FROM bt JOIN q ON q.category = bt.category"""
    ),
}
