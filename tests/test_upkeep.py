"""Drift, retention and repair."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_plans import SF, duck, rows  # noqa: F401
from tidewater.operators import monitoring, quality, retention

CASES = monitoring.ORACLE | retention.ORACLE | quality.ORACLE
#: These find nothing on the smallest fixture; the cases below plant what they find.
SPARSE = {"g16_surge", "l03_open_anomalies"}


@pytest.mark.parametrize("name", sorted(CASES))
def test_upkeep_query(spark, duck, name):  # noqa: F811
    got = (monitoring.QUERIES | retention.QUERIES | quality.QUERIES)[name](spark, SF)
    want = duck.execute(CASES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, got.collect())
    assert (found or name in SPARSE) and found == rows(columns, want.fetchall())


def test_quantiles_are_exact(spark):
    """Heavy tails, one value for a third of all rows, few and single values, nulls and NaN."""
    rng = np.random.default_rng(4)
    groups = {"tails": np.exp(rng.normal(0, 20, 900)), "hot": np.where(rng.random(900) < 0.4, 7.0, rng.normal(0, 1, 900)), "two": np.array([1.0, 2.0]), "one": np.array([5.0]), None: rng.normal(0, 1e-9, 50), "wide": np.array([-1.7e308, 0.0, 1.7e308])}
    data = [(k, float(x)) for k, v in groups.items() for x in v] + [("two", None), ("two", float("nan")), ("none", None)]
    got = {(r["g"], r["point"]): r["quantile"] for r in monitoring.quantiles(spark.createDataFrame(data, "g string, value double").repartition(5), ["g"], "value", (0.0, 0.01, 0.5, 0.99)).collect()}
    assert len(got) == 4 * len(groups)
    for (g, p), q in got.items():
        v = np.sort(groups[g])
        at = (len(v) - 1) * p
        low, high = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
        assert q == low + (high - low) * (at - int(at))


def test_bands(spark):
    values = [0.0, 0.09, 0.15, 0.20, 0.21, float("nan"), float("inf"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, psi double").withColumn("b", monitoring.band(F.col("psi"))).orderBy("i").collect()
    assert [r["b"] for r in got] == ["ok", "ok", "warning", "warning", "critical", "ok", "critical", "ok"]


def test_constant_and_small_features(spark):
    data = [("c", 4.0)] * 30 + [("few", float(i)) for i in range(19)] + [("x", float(i)) for i in range(1000)]
    base = monitoring.baseline(spark.createDataFrame(data, "feature string, value double"), ["feature"])
    found = {}
    for r in base.collect():
        found.setdefault(r["feature"], {})[r["bin"]] = r["share"]
    assert set(found) == {"c", "x"} and found["c"] == {0: 1.0, **{i: 0.0 for i in range(1, 10)}} and all(0.09 < s < 0.11 for s in found["x"].values())
    same = monitoring.drift(base, spark.createDataFrame(data, "feature string, value double"), ["feature"]).collect()
    assert [(r["feature"], r["status"]) for r in same] == [("x", "ok")]  # 30 samples of c are too few


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = retention.Predictions(spark, f"{tmp_path}/store", retention.HOT)
    at = lambda day: dt.datetime(2024, 1, day)
    store.load(spark.createDataFrame([(i, "s" if i % 2 else "other", at(1 + i % 5), 0.5) for i in range(1, 41)], retention.HOT))
    everything, none = store.hot().count(), spark.createDataFrame([], "id long")
    ids = lambda rows: sorted(r["id"] for r in rows.collect())
    now, write = F.lit(at(13)), store._write
    monkeypatch.setattr(store, "_write", lambda rows, name, run: (_ for _ in ()).throw(OSError("lost")) if name == "hot" else write(rows, name, run))
    with pytest.raises(OSError):
        store.move(1, now, {"s": 10}, 30, none)
    assert store.hot().count() == everything and ids(store.archive()) == []
    monkeypatch.undo()
    store.move(1, now, {"s": 10}, 30, spark.createDataFrame([(5,)], "id long"))
    want = [i for i in range(1, 31) if i % 2 and 1 + i % 5 < 3 and i != 5]
    assert ids(store.archive()) == want and sorted(ids(store.hot()) + want) == list(range(1, 41))
    store.move(2, now, {"s": 10}, 30, spark.createDataFrame([(5,)], "id long"))
    assert [tuple(r) for r in store.log().groupBy("run").agg(F.sum("moved")).orderBy("run").collect()] == [(1, len(want)), (2, 0)]
    store.move(3, now, {"s": 10}, 40, none)
    assert sorted(ids(store.hot()) + ids(store.archive())) == list(range(1, 41)) and 5 in ids(store.archive())


def test_checks(spark):
    """Null keys are no orphans, nulls are in no range, one-sided keys disagree, and limits and filters of the listings."""
    rows_ = spark.createDataFrame([(1, 5), (2, None), (None, 9), (4, -1)], "k long, v int")
    parent = spark.createDataFrame([(1,), (2,), (None,)], "p long")
    assert [r["k"] for r in quality.orphans(rows_, "k", parent, "p").collect()] == [4]
    assert sorted(r["v"] for r in quality.outside(rows_, "v", 0, 8).collect()) == [-1, 9]
    other = spark.createDataFrame([(1, 5), (2, 3), (7, None)], "k long, v int")
    assert sorted((str(r["k"]), r["a"], r["b"]) for r in quality.disagreement(rows_, other, "k", "v").collect()) == [("2", None, 3), ("4", -1, None), ("None", 9, None)]
    assert quality.disagreement(rows_, rows_, "k", "v").collect() == []
    at = lambda h: dt.datetime(2024, 1, 1, h)
    found = spark.createDataFrame([("a", "statistical", at(1), "open", True), ("b", "model", at(2), "open", True), ("c", "model", at(3), "open", False), ("d", "model", at(4), "dismissed", True), ("e", "model", at(5), "open", True)], "metric string, detector string, bucket_start timestamp, status string, surfaced boolean")
    assert [r["metric"] for r in quality.open_anomalies(found).collect()] == ["e", "b", "a"]
    assert [r["metric"] for r in quality.open_anomalies(found, "model", 1).collect()] == ["e"]
    coming = spark.createDataFrame([("a", 12.0, 10.0), ("b", 16.2, 10.0), ("c", 14.9, 10.0), ("d", None, 1.0)], "category string, point_estimate double, recent_avg double")
    assert [(r["category"], r["quantity"]) for r in quality.surges(coming).collect()] == [("b", 7)]
