"""Detectors directly on the event stream, their state as a table, and the anomaly sink.

Buckets are closed by the watermark, in a windowed aggregation before the state; windows that one micro-batch
closes come before those of the next, so a detector sees buckets in order of time whatever the order of
files. At the end of a bounded input a clock row, the present time, lets the watermark pass the last
buckets, as an idle stream is closed by the wall clock. An event that comes behind the watermark
is dropped, so disorder of more than the delay needs the files of one run in one batch.

State is one row of moments per metric with the bucket it is folded up to. ``export_state`` reads it from
a checkpoint with the state source; ``detections`` starts from such a table, and buckets up to its
cursor are not folded again. Moments are sums of integers, so no order of adding changes them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions import trailing

from ..sources.events import file_stream
from ..sources.landing import shared_path
from .jobs import LATE, ROCKS, run_to_table
from .ordered import passed

#: Buckets before a verdict, bounds of the z-score, floors of sigma, and of the rate tracker
#: least samples of a window, multiples of the base rate, and windows in a row until it surfaces.
WARMUP, WARNING, SEVERE, FLOOR, FLOOR_SHARE = 20, 3.0, 5.0, 0.01, 0.05
FIRES, SEVERE_RATE, SURFACES = 3.0, 5.0, 2

MOMENTS = "k long, s decimal(38,0), ss decimal(38,0), cursor long"
STATE = "metric string, n long, total decimal(38,0), squares decimal(38,0), cursor long"
DETECTED = "metric string, us long, observed long, expected double, z double"


def with_clock(stream: DataFrame) -> DataFrame:
    """The stream and one row of nulls at the present time."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "clock")
    spark.range(1).select(F.current_timestamp().alias("ts")).write.parquet(path)
    return stream.unionByName(spark.readStream.schema("ts timestamp").parquet(path), allowMissingColumns=True)


class Detector(StatefulProcessor):
    """Compares each bucket of a metric with the ones before it, then adds it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", MOMENTS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.moments.update((int(r["n"]), Decimal(int(r["total"])), Decimal(int(r["squares"])), int(r["cursor"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        k, s, ss, cursor = map(int, self.moments.get()) if self.moments.exists() else (0, 0, 0, -(1 << 62))
        out = []
        for us, v in sorted((int(u), int(v)) for part in rows for u, v in zip(part["us"], part["v"])):
            if us <= cursor:
                continue
            mean, z = s / k if k else None, None
            if k >= WARMUP:
                sd = math.sqrt(max((float(ss) - float(s) * float(s) / k) / (k - 1), 0.0))
                z = (v - mean) / max(sd, FLOOR, FLOOR_SHARE * abs(mean))
            out.append((key[0], us, v, mean, z))
            k, s, ss, cursor = k + 1, s + v, ss + v * v, us
        self.moments.update((k, Decimal(s), Decimal(ss), cursor))
        yield pd.DataFrame(out, columns=["metric", "us", "observed", "expected", "z"])

    def close(self) -> None:
        pass


def bucket_metrics(events: DataFrame, width: str, delay: str = LATE) -> DataFrame:
    """(metric, us, v) of closed buckets: orders, and revenue in hundredths, of valid purchases; events that are
    delivered again count once."""
    seen = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    valid = (F.col("event_type") == "purchase") & (F.col("value") > 0)
    cents = F.when(valid, F.col("value").cast("decimal(12,2)") * 100).cast("long")
    per = seen.groupBy(F.window("ts", width)).agg(F.count("event_id").alias("events"), F.count_if(valid).alias("orders"), F.coalesce(F.sum(cents), F.lit(0)).alias("revenue"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("events", "orders", "revenue")])
    return per.where("events > 0").select(F.unix_micros("window.start").alias("us"), F.explode(pairs).alias("p")).select("p.metric", "us", "p.v")


def detections(metrics: DataFrame, label: str, state: DataFrame | None = None, path: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, str]:
    """(rows of DETECTED for every closed bucket, checkpoint), run to the end of the input. ``state``: from ``export_state``."""
    spark = metrics.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = path or shared_path(spark, label)
    checkpoint = checkpoint or f"{path}-checkpoint"
    first = {} if state is None else {"initialState": state.groupBy("metric")}
    found = metrics.groupBy("metric").transformWithStateInPandas(Detector(), DETECTED, "append", "none", **first)
    return run_to_table(found, label, path=path, checkpoint=checkpoint).drop("_batch"), checkpoint


def export_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Moments and cursor of every metric, from the state of the last batch of a checkpoint."""
    held = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "moments").load(checkpoint)
    return held.select("key.metric", F.col("value.k").alias("n"), F.col("value.s").alias("total"), F.col("value.ss").alias("squares"), "value.cursor")


def severity(z: F.Column) -> F.Column:
    return F.when(F.abs(z) >= SEVERE, "severe").when(F.abs(z) >= WARNING, "warning")


def two_places(x: F.Column) -> F.Column:
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def anomalies(detected: DataFrame, detector: str = "statistical") -> DataFrame:
    """Records of the buckets that deviate, each with the event that tells of it. The id is a function of metric, detector and
    bucket, so a record that is written twice is the same record."""
    unit = F.when(F.col("metric") == "revenue", 100.0).otherwise(1.0)
    found = detected.where(severity(F.col("z")).isNotNull()).select(
        F.sha2(F.concat_ws("|", "metric", F.lit(detector), F.col("us").cast("string")), 256).alias("anomaly_id"), "metric", F.lit(detector).alias("detector"), F.timestamp_micros("us").alias("bucket_start"),
        two_places(F.col("observed") / unit).alias("observed"), two_places(F.col("expected") / unit).alias("expected"), two_places(F.col("z")).alias("z_score"), severity(F.col("z")).alias("severity"), F.lit("open").alias("status"), F.lit(True).alias("surfaced"))
    payload = F.to_json(F.struct("anomaly_id", "metric", "detector", "bucket_start", "observed", "expected", "z_score", "severity"))
    envelope = F.struct(F.lit(1).alias("schema_version"), F.col("anomaly_id").alias("event_id"), F.lit("anomaly.detected").alias("event_type"), F.col("bucket_start").alias("occurred_at"), F.col("metric").alias("key"), payload.alias("payload"))
    return found.withColumn("envelope", F.to_json(envelope))


class AnomalySink:
    """Appends records once and tells of them once.

    The batch n of a stream is one folder of records with their events (an outbox): both are committed by one
    write. The events then go to ``topic`` from what was written, as a folder per batch. A batch that
    breaks off anywhere is repeated by the stream and replaces both folders, so a record and its event are both
    out or neither, and nothing is there twice."""

    def __init__(self, path: str, topic: str):
        self.path, self.topic = path, topic

    def __call__(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = anomalies(batch)
        rows.write.mode("overwrite").parquet(f"{self.path}/_batch={n}")
        spark.read.schema(rows.schema).parquet(f"{self.path}/_batch={n}").select(F.col("envelope").alias("value")).write.mode("overwrite").text(f"{self.topic}/_batch={n}")

    def records(self, spark: SparkSession) -> DataFrame:
        schema = anomalies(spark.createDataFrame([], DETECTED)).schema
        return spark.read.schema(schema).option("basePath", self.path).parquet(f"{self.path}/_batch=*").select(*schema.names)

    def events(self, spark: SparkSession) -> DataFrame:
        """Lines of the topic (column value)."""
        return spark.read.schema("value string").text(f"{self.topic}/_batch=*").select("value")


def sink_anomalies(metrics: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> AnomalySink:
    """Detect and write to the end of the input."""
    spark = metrics.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = path or shared_path(spark, label)
    sink = AnomalySink(path, f"{path}-topic")
    found = metrics.groupBy("metric").transformWithStateInPandas(Detector(), DETECTED, "append", "none")
    found.writeStream.outputMode("append").option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return sink


def rate_anomalies(scores: DataFrame, threshold: float, window_s: int, least: int, base: float, label: str) -> DataFrame:
    """Findings of every model over a stream (model, id, ts, score), from the scores that the watermark has passed: at-risk share in the trailing
    window by (time, id), one finding per bucket of the window's width, with the number of buckets in a row. Windows are counted over
    cells of time and buckets with a row each are what meets per model. A threshold that is not positive finds nothing."""
    hot = F.coalesce(F.col("score") >= threshold, F.lit(False)).cast("long")
    rows = scores.where(F.lit(threshold > 0)).select(F.col("model").alias("key"), "ts", F.coalesce("id", F.lit(-1)).cast("long").alias("id"), hot.alias("v"))
    whole = lambda c, n: F.expr(f"({c} - pmod({c}, {n}L)) div {n}")
    seen = passed(rows, label).withColumn("sec", whole("us", 1_000_000)).withColumn("place", F.struct("us", "id", "nth", "key"))
    rates = trailing(seen, "key", "sec", "place", window_s, ["v"], own=True).where(F.col("n") >= least).withColumn("share", F.col("sum_v") / F.col("n"))
    fires = F.col("share") > FIRES * base
    per = rates.groupBy("key", whole("sec", window_s).alias("b")).agg(F.min_by(fires, "place").alias("at_once"), F.min_by(F.struct("n", "sum_v", "share"), F.when(fires, F.col("place"))).alias("first")).where("first IS NOT NULL")
    model = W.partitionBy("key").orderBy("b")
    goes_on = F.col("at_once") & F.coalesce(F.lag("b").over(model) == F.col("b") - 1, F.lit(False))
    islands = per.withColumn("goes_on", goes_on).withColumn("island", F.sum((~F.col("goes_on")).cast("int")).over(model))
    streak = F.row_number().over(W.partitionBy("key", "island").orderBy("b")).cast("long")
    severity = F.when(F.col("first.share") > SEVERE_RATE * base, "severe").otherwise("elevated")
    return islands.select(F.col("key").alias("model"), "b", "first.n", F.col("first.sum_v").alias("at_risk"), severity.alias("severity"), streak.alias("streak"), (streak >= SURFACES).alias("surfaced"))


class Streaks(StatefulProcessor):
    """Consecutive firing buckets of one model; the second and later ones surface."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "b long, streak long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        b, streak = map(int, self.last.get()) if self.last.exists() else (-2, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("b").itertuples(index=False):
            fires = r.n >= 10 and r.at_risk / r.n > 0.15
            streak = (streak + 1 if r.b == b + 1 else 1) if fires else 0
            b = int(r.b)
            out.append((key[0], b, bool(fires), streak, streak >= 2))
        self.last.update((b, streak))
        yield pd.DataFrame(out, columns=["model", "b", "fires", "streak", "surfaced"])

    def close(self) -> None:
        pass


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_clock(file_stream(spark, sf_dir, "events", None))


def t08_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every hour's number of events after the warm-up."""
    found, _ = detections(bucket_metrics(_events(spark, sf_dir), "1 hour"), "t08")
    z = F.abs("z")
    return found.where("metric = 'events' AND z IS NOT NULL").select(F.timestamp_micros("us").alias("bucket"), F.col("observed").alias("n"), F.col("expected").alias("mean"), (F.floor(z * 1000000 + 0.5) / 1000000).alias("z"), severity(z).alias("severity"))


def s08_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of hourly events, orders and revenue as written, with the key of the event that was published for each."""
    sink = sink_anomalies(bucket_metrics(_events(spark, sf_dir), "1 hour"), "s08")
    told = sink.events(spark).select(F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.key").alias("event_key"))
    rows = sink.records(spark).join(told, F.col("anomaly_id") == F.col("event_id"), "full_outer")
    return rows.select("metric", "detector", "bucket_start", "observed", "expected", "z_score", "severity", "status", "surfaced", "event_key")


def t10_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's moments and cursor, read from its checkpoint."""
    _, checkpoint = detections(bucket_metrics(_events(spark, sf_dir), "1 hour"), "t10")
    s, ss = F.col("total").cast("double"), F.col("squares").cast("double")
    return export_state(spark, checkpoint).select("metric", "n", (s / F.col("n")).alias("mean"), (ss - s * s / F.col("n")).alias("m2"), F.timestamp_micros("cursor").alias("analyzed_through"))


def t12_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed buckets of six hours per model: whether the rate fires, and for how many in a row."""
    seen = _events(spark, sf_dir).withWatermark("ts", LATE)
    hot = (F.pmod(F.col("event_id") * 7919, F.lit(1000)) >= 900).cast("long")
    per = seen.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("event_id").alias("n"), F.sum(hot).alias("at_risk")).where("n > 0")
    rates = per.select(F.col("event_type").alias("model"), (F.unix_micros("window.start") / 21_600_000_000).cast("long").alias("b"), "n", "at_risk")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "model string, b long, fires boolean, streak long, surfaced boolean"
    return run_to_table(rates.groupBy("model").transformWithStateInPandas(Streaks(), schema, "append", "none"), "t12").drop("_batch")


def t12_surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rate tracker over six hours of scores per model."""
    scores = with_clock(file_stream(spark, sf_dir, "events", None)).where("event_id IS NOT NULL OR event_type IS NULL")
    scored = scores.select(F.coalesce("event_type", F.lit("clock")).alias("model"), F.col("event_id").alias("id"), "ts", (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)).alias("score"))
    return rate_anomalies(scored, 0.9, 6 * 3600, 10, 0.05, "t12s")


QUERIES = {f.__name__: f for f in (t08_detector, s08_anomalies, t10_state, t12_rates, t12_surfaced)}

_METRICS = """h AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase' AND value > 0) AS orders,
        CAST(coalesce(sum(CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT)) FILTER (WHERE event_type = 'purchase' AND value > 0), 0) AS BIGINT) AS revenue FROM events GROUP BY 1),
    m AS (SELECT * FROM (SELECT bucket, 'events' AS metric, events AS v FROM h UNION ALL SELECT bucket, 'orders', orders FROM h UNION ALL SELECT bucket, 'revenue', revenue FROM h))"""
_TWO = "sign({0}) * floor(abs({0}) * 100 + 0.5) / 100"
ORACLE = {
    "t08_detector": """WITH h AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY date_trunc('hour', ts)), m AS (SELECT bucket, n, count(*) OVER w AS k, CAST(sum(n) OVER w AS DOUBLE) AS s, CAST(sum(n * n) OVER w AS DOUBLE) AS ss FROM h WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT bucket, n, s / k AS mean, sqrt(greatest((ss - s * s / k) / (k - 1), 0.0E0)) AS sd FROM m WHERE k >= 20), z AS (SELECT bucket, n, mean, abs(n - mean) / greatest(sd, 0.01, 0.05 * abs(mean)) AS z FROM b)
        SELECT bucket, n, mean, floor(z * 1000000 + 0.5) / 1000000 AS z, CASE WHEN z >= 5 THEN 'severe' WHEN z >= 3 THEN 'warning' END AS severity FROM z""",
    "s08_anomalies": f"""WITH {_METRICS}, k AS (SELECT metric, bucket, v, count(*) OVER w AS k, CAST(sum(v) OVER w AS DOUBLE) AS s, CAST(sum(v * v) OVER w AS DOUBLE) AS ss FROM m WINDOW w AS (PARTITION BY metric ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        z AS (SELECT metric, bucket, CASE metric WHEN 'revenue' THEN 100.0E0 ELSE 1.0E0 END AS unit, v, s / k AS mean, (v - s / k) / greatest(sqrt(greatest((ss - s * s / k) / (k - 1), 0.0E0)), 0.01, 0.05 * abs(s / k)) AS z FROM k WHERE k >= 20)
        SELECT metric, 'statistical' AS detector, bucket AS bucket_start, {_TWO.format("(v / unit)")} AS observed, {_TWO.format("(mean / unit)")} AS expected, {_TWO.format("z")} AS z_score, CASE WHEN abs(z) >= 5 THEN 'severe' ELSE 'warning' END AS severity, 'open' AS status, true AS surfaced, metric AS event_key FROM z WHERE abs(z) >= 3""",
    "t10_state": f"""WITH {_METRICS} SELECT metric, count(*) AS n, CAST(sum(v) AS DOUBLE) / count(*) AS mean, CAST(sum(v * v) AS DOUBLE) - CAST(sum(v) AS DOUBLE) * CAST(sum(v) AS DOUBLE) / count(*) AS m2, max(bucket) AS analyzed_through FROM m GROUP BY metric""",
    "t12_rates": """WITH r AS (SELECT event_type AS model, CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) AS b, count(*) AS n, count(*) FILTER (WHERE (event_id * 7919) % 1000 >= 900) AS at_risk FROM events GROUP BY 1, 2),
        f AS (SELECT *, n >= 10 AND CAST(at_risk AS DOUBLE) / n > 0.15 AS fires FROM r), g AS (SELECT *, b - row_number() OVER (PARTITION BY model, fires ORDER BY b) AS island FROM f)
        SELECT model, b, fires, CASE WHEN fires THEN row_number() OVER (PARTITION BY model, fires, island ORDER BY b) ELSE 0 END AS streak, fires AND row_number() OVER (PARTITION BY model, fires, island ORDER BY b) >= 2 AS surfaced FROM g""",
    "t12_surfaced": """WITH o AS (SELECT event_type AS model, event_id AS id, ts, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, CASE WHEN CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 >= 0.9 THEN 1 ELSE 0 END AS hot FROM events),
        w AS (SELECT a.model, a.ts, a.id, any_value(a.sec) AS sec, count(*) AS n, CAST(sum(b.hot) AS BIGINT) AS at_risk FROM o a JOIN o b ON a.model = b.model AND b.sec >= a.sec - 21600 AND (b.ts < a.ts OR b.ts = a.ts AND b.id <= a.id) GROUP BY a.model, a.ts, a.id HAVING count(*) >= 10),
        f AS (SELECT *, sec // 21600 AS b, CAST(at_risk AS DOUBLE) / n > 3.0E0 * 0.05E0 AS fires, row_number() OVER (PARTITION BY model, sec // 21600 ORDER BY ts, id) AS place FROM w),
        t AS (SELECT *, place = 1 AS at_once, row_number() OVER (PARTITION BY model, b ORDER BY ts, id) AS nth FROM f WHERE fires), x AS (SELECT * FROM t WHERE nth = 1),
        y AS (SELECT *, CASE WHEN at_once AND lag(b) OVER (PARTITION BY model ORDER BY b) = b - 1 THEN 0 ELSE 1 END AS starts FROM x), g AS (SELECT *, sum(starts) OVER (PARTITION BY model ORDER BY b) AS island FROM y)
        SELECT model, b, n, at_risk, CASE WHEN CAST(at_risk AS DOUBLE) / n > 5.0E0 * 0.05E0 THEN 'severe' ELSE 'elevated' END AS severity, row_number() OVER (PARTITION BY model, island ORDER BY b) AS streak, row_number() OVER (PARTITION BY model, island ORDER BY b) >= 2 AS surfaced FROM g""",
}
