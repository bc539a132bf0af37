"""Streams and landing against an independent engine, restarts and malformed records."""

import datetime as dt

import pytest

from tests.test_plans import SF, duck, rows  # noqa: F401
from tidewater.sources import events, landing
from tidewater.streaming import detect, folds, jobs, ordered

CASES = landing.ORACLE | events.ORACLE | jobs.ORACLE | ordered.ORACLE | detect.ORACLE


@pytest.mark.parametrize("name", sorted(CASES))
def test_stream(spark, duck, name):  # noqa: F811
    got = (landing.QUERIES | events.QUERIES | jobs.QUERIES | ordered.QUERIES | detect.QUERIES)[name](spark, SF)
    want = duck.execute(CASES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_ended_sessions(spark, duck):  # noqa: F811
    """A session is out once when the newest event is more than the gap and the delay behind its last one."""
    found = [(r["user_id"], r["began"], r["clicks"]) for r in jobs.t13_sessions(spark, SF).collect()]
    want = duck.execute("""WITH g AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts), count(*) FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 370 MINUTE < (SELECT max(ts) FROM events)""").fetchall()
    assert want and sorted(found) == sorted(want)


@pytest.mark.parametrize("name", ["t01_revenue", "t02_sessions", "s06_landing", "s07_upsert", "t13_sessions", "t14_once", "t08_detector", "s08_anomalies", "t10_state", "t12_rates", "t12_surfaced"])
def test_many_files_out_of_order(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(40, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got, want = ((jobs.QUERIES | detect.QUERIES)[name](spark, d) for d in (str(tmp_path), SF))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())


def test_restart_adds_only_new_files(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    source = f"{tmp_path}/in"

    def deliver(ids):
        data = [(i, dt.datetime(2024, 1, 1, 0, i % 60), 1, "purchase", 10.0, "{}") for i in ids]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return jobs.newest(jobs.run_to_table(jobs.revenue_buckets(stream, "1 hour"), "r", "update", f"{tmp_path}/out", f"{tmp_path}/check"), "bucket").collect()

    deliver(range(5))
    assert [(r["revenue"], r["orders"]) for r in run()] == [(50.0, 5)]
    deliver(range(3, 8))  # two of them again
    assert [(r["revenue"], r["orders"]) for r in run()] == [(80.0, 8)]
    assert [(r["revenue"], r["orders"]) for r in run()] == [(80.0, 8)]


def test_malformed_records_are_set_apart(spark):
    good = '{"event_id":"1","event_type":"page.view","occurred_at":"2024-01-01T00:00:00Z","payload":"{\\"session_id\\":\\"s\\",\\"page_type\\":\\"home\\"}"}'
    lines = spark.createDataFrame([(good,), ("{broken",), ('{"event_id":"2"}',), (None,), ("",)], "value string")
    found, rejects = events.decode(lines)
    assert found.count() == 1 and rejects.count() == 4
    assert events.payload(found, "page.view").select("session_id", "page_type").collect()[0].asDict() == {"session_id": "s", "page_type": "home"}


def test_csv_landing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id , name\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    got = landing.land_csv(spark, f"file://{tmp_path}/a.csv", "b1")
    assert got.columns == ["id", "name", "_loaded_at", "_source_file", "_batch_id"]
    assert sorted((r["id"], r["name"], r["_source_file"]) for r in got.collect()) == [("1", 'two\nlines, "quoted"', "a.csv"), ("2", None, "a.csv")]
    assert [r.asDict() for r in landing.load_audit(got).collect()] == [{"_source_file": "a.csv", "_batch_id": "b1", "n_rows": 2}]
    with pytest.raises(Exception):
        landing.land_csv(spark, f"file://{tmp_path}/missing.csv", "b1")


def test_rows_that_arrive_much_later_are_folded(spark, tmp_path):
    """Each delivery is a run of its own; a late row, a repeated one and a null time change what they should."""
    schema, source = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", f"{tmp_path}/in"

    def deliver(*found):
        spark.createDataFrame([(i, t, 1, "purchase", v) for i, t, v in found], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        landed, hours = folds.land_once(stream, ["event_id"], "ts", "late", f"{tmp_path}/out", f"{tmp_path}/check", fold=lambda r: jobs.revenue(r, "1 hour"))
        return landed.count(), {r["bucket"].hour: (r["revenue"], r["orders"]) for r in jobs.newest(hours, "bucket").collect()}

    at = lambda day, hour: dt.datetime(2024, 1, day, hour, 5)
    assert deliver((1, at(1, 3), 5.0)) == (1, {3: (5.0, 1)})
    assert deliver((2, at(9, 4), 7.0), (3, None, 1.0)) == (3, {3: (5.0, 1), 4: (7.0, 1)})
    assert deliver((4, at(1, 3), 2.0), (1, at(1, 3), 5.0), (3, None, 1.0)) == (4, {3: (7.0, 2), 4: (7.0, 1)})


def test_closed_buckets(spark):
    """A timeline that starts again in the past has its own clock; an idle one closes its newest bucket."""
    at = lambda *m: dt.datetime(2024, 1, 1, *m)
    data = [("a", at(10, 0, 5)), ("a", at(10, 5, 1)), ("b", at(1, 0, 1)), ("b", at(1, 4, 0)), (None, at(10, 5, 2)), ("c", None)]
    got = folds.closed(spark.createDataFrame(data, "line string, at timestamp"), "line", "at", "1 minute").collect()
    assert {(r["timeline"], r["bucket"].hour, r["bucket"].minute): r["is_closed"] for r in got} == {("a", 10, 0): True, ("a", 10, 5): False, ("b", 1, 0): True, ("b", 1, 4): True, (None, 10, 5): False}


def test_ordered_features_do_not_depend_on_arrival(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    data = [(3, at(24), "k", 30), (1, at(0), "k", 10), (2, at(0), "k", None), (4, at(24.5), "k", 40), (5, at(0), None, 7), (6, at(30), "end", 0), (7, None, "k", 1)]
    spark.createDataFrame(data, "id long, ts timestamp, key string, v long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp, key string, v long").parquet(f"{tmp_path}/in")
    got = {r["id"]: (r["n"], r["total"], r["days"]) for r in ordered.ordered(stream, "key", ordered.DAY, "test").collect()}
    assert got == {1: (0, 0, 0), 2: (1, 10, 0), 3: (2, 10, 1), 4: (1, 30, 1), 5: (0, 0, 0)}


MINUTE = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _minutes(spark, path, minutes, orders, begin=0):
    """Per minute orders of 100.0, two of no value and twenty views."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m, seconds=5)
    data = [(m * 1000 + i, at(m), i, "purchase", 100.0) for m in minutes for i in range(orders)]
    data += [(m * 1000 + 500 + i, at(m), i, "purchase", 0.0) for m in minutes for i in range(2)] + [(m * 1000 + 600 + i, at(m), i % 4, "view", None) for m in minutes for i in range(20)]
    spark.createDataFrame(data, MINUTE).repartition(3).write.mode("append").parquet(path)


def test_a_spike_is_severe_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    source = f"{tmp_path}/in"
    _minutes(spark, source, range(24), 8)
    _minutes(spark, source, [24], 60)
    stream = detect.with_clock(spark.readStream.schema(MINUTE).parquet(source))
    sink = detect.sink_anomalies(detect.bucket_metrics(stream, "1 minute"), "spike", f"{tmp_path}/out")
    found = {r["metric"]: r for r in sink.records(spark).collect()}
    assert set(found) == {"events", "orders", "revenue"} and {r["bucket_start"] for r in found.values()} == {dt.datetime(2024, 1, 1, 0, 24)}
    assert all(r["severity"] == "severe" and r["z_score"] >= 5 for r in found.values()) and found["revenue"]["observed"] == 6000.0 and found["revenue"]["expected"] == 800.0
    us = lambda m: m * 60_000_000 + 1_704_067_200_000_000
    again = spark.createDataFrame([("orders", us(24), 60, 8.0, 130.0), ("orders", us(25), 8, 8.0, 0.5)], detect.DETECTED)
    before = len(sink.events(spark).collect())
    sink(again, 99)
    sink(again, 99)
    assert sink.events(spark).count() == before + 1 == sink.records(spark).count()
    assert sink.records(spark).select("anomaly_id").distinct().count() == before  # the same bucket has the same id


def test_a_detector_goes_on_from_exported_state(spark, tmp_path):
    """Two runs with another checkpoint, and rows that are delivered again, give what one run gives."""
    first, second, both = (f"{tmp_path}/{n}" for n in ("first", "second", "both"))
    for path, minutes in ((first, range(15)), (second, range(10, 30)), (both, range(30))):
        _minutes(spark, path, [m for m in minutes if m % 4], 8)
        _minutes(spark, path, [m for m in minutes if not m % 4], 11)

    def run(path, state=None):
        metrics = detect.bucket_metrics(detect.with_clock(spark.readStream.schema(MINUTE).parquet(path)), "1 minute")
        found, checkpoint = detect.detections(metrics, "export", state)
        return found.collect(), detect.export_state(spark, checkpoint)

    early, state = run(first)
    held = spark.createDataFrame(state.collect(), detect.STATE)
    assert {(r["metric"], r["n"]) for r in held.collect()} == {("events", 15), ("orders", 15), ("revenue", 15)}
    late, end = run(second, held)
    whole, want = run(both)
    assert sorted(map(tuple, early + late), key=str) == sorted(map(tuple, whole), key=str)
    assert sorted(map(tuple, end.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rate_tracker(spark, tmp_path):
    """25 scores per window: high, high, low, low, high. The low ones after high ones still fire; a window of low ones ends the streak."""
    data = [(b * 100 + i, "m", dt.datetime(1970, 1, 1) + dt.timedelta(seconds=300 * (b + 1) + 10 * i), s) for b, s in enumerate([0.9, 0.9, 0.1, 0.1, 0.9]) for i in range(25)]
    data += [(9999, "late", dt.datetime(1970, 1, 2), 0.0), (None, "m", None, 0.9)]
    spark.createDataFrame(data, "id long, model string, ts timestamp, score double").repartition(7).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, model string, ts timestamp, score double").parquet(f"{tmp_path}/in")
    got = sorted((r["b"], r["streak"], r["surfaced"], r["severity"]) for r in detect.rate_anomalies(stream(), 0.5, 300, 20, 0.01, "tracker").collect())
    assert got == [(1, 1, False, "severe"), (2, 2, True, "severe"), (3, 3, True, "severe"), (5, 1, False, "elevated")]  # the first high score makes 1 of 25
    assert detect.rate_anomalies(stream(), 0.0, 300, 20, 0.01, "tracker").collect() == []


def test_current_table_has_one_file_per_day_and_batches_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folds, "MERGE", 3)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for turn in range(8):
        data = [(turn * 10 + i, dt.datetime(2024, 1, 1 + i % 2, turn), 1, "purchase", 1.0) for i in range(4)] + [(0, dt.datetime(2024, 1, 5), 1, "purchase", 1.0)]
        spark.createDataFrame(data, MINUTE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MINUTE).parquet(source)
        landed, hours = folds.land_once(stream, ["event_id"], "ts", "merge", out, f"{tmp_path}/check", fold=lambda r: jobs.revenue(r, "1 hour"))
    assert landed.count() == 32 == landed.select("event_id").distinct().count()  # id 0 came again with another day
    assert sum(r["orders"] for r in hours.collect()) == 32 and hours.count() == 16
    kept = folds.Batches(spark, out, landed.schema, "_day").folders()
    assert len(kept["_batch"]) <= 4 and len(kept["_upto"]) == 1
    assert len(list((tmp_path / "out-current").glob("_day=*/*.parquet"))) == 2


def test_empty_sources(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = lambda: spark.readStream.schema(MINUTE).parquet(f"{tmp_path}/none")
    landed, hours = folds.land_once(stream(), ["event_id"], "ts", "none", fold=lambda r: jobs.revenue(r, "1 hour"))
    assert landed.collect() == [] and hours.collect() == []
    lines = spark.readStream.schema("value string").text(f"{tmp_path}/none")
    assert events.land_envelopes(lines, f"{tmp_path}/out").collect() == []


def test_no_task_holds_the_rows_of_a_key(spark, tmp_path, monkeypatch):
    """Rows that wait and their features stay in Spark: no Python state, and equal and repeated rows count each."""
    monkeypatch.setattr("pyspark.sql.GroupedData.transformWithStateInPandas", None)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    data = [(i, at(i), "m", float(i % 2)) for i in range(40)] + [(7, at(7), "m", 1.0), (7, at(7.0004), "m", 1.0), (99, at(90_000), "end", 0.0)]
    spark.createDataFrame(data, "id long, ts timestamp, model string, score double").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, ts timestamp, model string, score double").parquet(f"{tmp_path}/in")
    got = sorted(tuple(r) for r in ordered.ordered(stream().withColumn("v", jobs.F.lit(1)), "model", 10_000_000, "flat").where("id < 12").collect())
    assert got == sorted([(i, n, n, 0) for i, n in [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (7, 8), (7, 9), (8, 10), (9, 11), (10, 12), (11, 12)]])
    assert {(r["model"], r["b"] % 10, r["n"]) for r in detect.rate_anomalies(stream(), 0.5, 300, 20, 0.01, "flat").collect()} == {("m", 1_704_067_200 // 300 % 10, 20)}
