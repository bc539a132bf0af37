"""Registry, prediction table and scoring jobs."""

import re

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tests.test_plans import SF, duck, rows  # noqa: F401
from tidewater.operators import marts, models, registry
from tidewater.plans import dialect


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_registry_query(spark, duck, name):  # noqa: F811
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, got.collect())
    assert found and found == rows(columns, want.fetchall())


def test_compare_and_set(spark, tmp_path):
    r = registry.Registry(spark, f"{tmp_path}/registry")
    status = lambda: {(x["model"], x["version"]): x["status"] for x in registry.versions(r.log()).collect()}
    assert r.log().collect() == []
    with pytest.raises(LookupError):
        r.active("m")
    r.register("m", "1", metrics={"recommended_threshold": 0.7, "positive_rate": 0.001})
    r.register("m", "2", "candidate")
    r.register("other", "1", metrics={"recommended_threshold": 0.0, "positive_rate": 0.2})
    assert status() == {("m", "1"): "active", ("m", "2"): "candidate", ("other", "1"): "active"}
    assert (r.active("m")["threshold"], r.active("m")["base_rate"]) == (0.7, 0.01)
    assert (r.active("other")["threshold"], r.active("other")["base_rate"]) == (None, None)
    assert not r.promote("m", "2", expected="9") and not r.promote("m", "unknown", expected="1")
    assert r.promote("m", "2", expected="1") and not r.promote("m", "1", expected="1")
    assert status() == {("m", "1"): "superseded", ("m", "2"): "active", ("other", "1"): "active"}
    r.register("m", "3")
    r.register("m", "3", "candidate")
    assert status()[("m", "3")] == "candidate" and status()[("m", "2")] == "superseded"
    with pytest.raises(ValueError):
        r.register("m", "4", "live")
    writer = registry.Registry(spark, f"{tmp_path}/registry")
    writer._append = lambda row, tries=20: registry.Registry._append(writer, row, tries)
    before = r.log().count()
    stale = registry.Registry(spark, f"{tmp_path}/registry")
    first, seen = r.log(), []
    stale.log = lambda: seen.append(1) or (spark.createDataFrame(first.where("entry < 5").collect(), registry.ENTRY) if len(seen) == 1 else r.log())
    stale.register("m", "5")  # its first number is taken
    assert r.log().count() == before + 1 and len(seen) == 2


def test_scoring_jobs(spark, tmp_path):
    """Everybody once per version; the scores are the model's, and what explains them adds up for what is usual."""
    r, path = registry.Registry(spark, f"{tmp_path}/registry"), f"{tmp_path}/predictions"
    registry.train_churn(spark, SF, r, str(tmp_path), "v1")
    now = r.active("churn_risk")
    assert 0.5 <= now["threshold"] < 1 and now["base_rate"] >= 0.01
    first = registry.score_churn(spark, SF, r, path, "a").collect()
    again = registry.score_churn(spark, SF, r, path, "b").collect()
    assert first and len(again) == len(first) == len({x["entity_id"] for x in first})
    current = dialect.run(marts.PLANS["f06_churn_current"], spark, SF)
    want = {str(x["customer"]): x["score"] for x in models.score_binary(PipelineModel.load(now["artifact"]), current, models.CHURN).collect()}
    assert {x["entity_id"]: x["prediction"] for x in first} == want
    assert all(set(x["explanation"]) == set(models.CHURN) == set(x["features"]) for x in first)
    for x in first:  # a feature at its usual value explains nothing
        for f in models.CHURN:
            if x["features"][f] == now["metrics"][f"usual.{f}"]:
                assert x["explanation"][f] == 0
    stream = f"{tmp_path}/stream"
    odd = current.limit(1).withColumn("customer", F.lit(-1).cast(current.schema["customer"].dataType)).withColumn(models.CHURN[0], F.lit(None).cast("double"))
    whole = current.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in models.CHURN else F.col(c) for c in current.columns])
    whole.unionByName(odd.select(*[F.col(c).cast("double").alias(c) if c in models.CHURN else F.col(c) for c in current.columns])).write.parquet(stream)
    kinds = spark.read.parquet(stream).schema
    for _ in range(2):
        registry.score_stream(spark.readStream.schema(kinds).parquet(stream), PipelineModel.load(now["artifact"]), models.CHURN, "customer", path, "churn_risk", "v2", "customer", f"{tmp_path}/check")
    got = registry.predictions(spark, path).where("model_version = 'v2'").collect()
    assert {x["entity_id"]: x["prediction"] for x in got} == want and len(got) == len(want)


def test_churn_rank(spark, tmp_path, monkeypatch):
    """A pass scores who is new; the rank is among all that the version scored, ties by customer, and rows of other sources have none."""
    r, path = registry.Registry(spark, f"{tmp_path}/registry"), f"{tmp_path}/predictions"
    registry.train_churn(spark, SF, r, str(tmp_path), "v1")
    whole = marts.churn_current
    monkeypatch.setattr(marts, "churn_current", lambda *a: whole(*a).where("customer % 3 = 0"))
    first = registry.score_churn(spark, SF, r, path, "a").collect()
    monkeypatch.setattr(marts, "churn_current", whole)
    other = spark.createDataFrame([("-1", 0.999)], "entity_id string, prediction double")
    registry.write_predictions(other, path, "churn_risk", "v1", "customer", "stream-0", "stream")
    both = registry.score_churn(spark, SF, r, path, "b").collect()
    assert 0 < len(first) < len(both) == whole(spark, SF).count() and {x["batch"] for x in both} == {"a", "b"}
    for rows_ in (first, both):
        order = sorted(rows_, key=lambda x: (-x["prediction"], int(x["entity_id"])))
        assert [x["risk_rank"] for x in order] == list(range(1, len(rows_) + 1))
    assert len({x["prediction"] for x in both}) < len(both)  # there are ties
    now = r.active("churn_risk")
    assert {(x["threshold"], x["base_rate"]) for x in both} == {(now["threshold"], now["base_rate"])}


def test_forecast_job(spark, tmp_path):
    r, path = registry.Registry(spark, f"{tmp_path}/registry"), f"{tmp_path}/predictions"
    registry.train_forecast(spark, SF, r, str(tmp_path), "v1")
    rows_ = registry.score_forecast(spark, SF, r, path, "a").collect()
    assert rows_ and registry.score_forecast(spark, SF, r, path, "b").count() == len(rows_)
    for x in rows_:
        assert 0 <= x["lower_bound"] <= x["upper_bound"] and models.LOW <= x["confidence"] <= models.HIGH and set(x["explanation"]) == set(models.FORECAST)


def test_forecast_job_meets_orders_in_small_tasks(spark, monkeypatch):
    """Training and coming weeks are made in tasks of TASK_LINES lines, not in one task a core joined from many shuffle partitions."""
    plans, write, before = {}, models.written, spark.conf.get("spark.sql.shuffle.partitions")

    def written(table, label):
        plans[label] = table._jdf.queryExecution().executedPlan().toString()
        return write(table, label)

    monkeypatch.setattr(models, "written", written)
    monkeypatch.setattr(dialect, "TASK_LINES", 1000)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    spark.conf.set("spark.sql.shuffle.partitions", 2 * n)
    try:
        assert not registry.m21_forecast_job(spark, SF).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n > 4 and set(plans) == {"forecast-rows", "forecast-next"}
    for plan in plans.values():
        dealt = re.findall(r"Exchange hashpartitioning\((?:order_id|l_orderkey|o_orderkey)#\d+L?, (\d+)\), (\w+)", plan)
        assert dealt and all(int(parts) >= n and origin == "REPARTITION_BY_NUM" for parts, origin in dealt)
