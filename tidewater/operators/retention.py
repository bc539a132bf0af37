"""Retention by the time of ingestion, the archive of aged predictions, and repair of buckets.

The prediction store keeps rows by day of creation and generation. A run writes the rows that leave a day to the archive and the rest of the
day as a new generation, and then one manifest of what it did: (run, day, rows moved, least and greatest id). Readers take what
manifests name, so a run that breaks off has changed nothing, its move is one commit for all its days, and the manifest is its log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from ..sources.landing import shared_path
from . import actions

MANIFEST = "run long, day date, moved long, least long, greatest long"


class Predictions:
    """Hot rows (id, source, created_at and others) and their archive in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _write(self, rows: DataFrame, name: str, run: int) -> None:
        rows.withColumn("_day", F.to_date("created_at")).withColumn("_run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run", "_day").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        schema = f"{self.schema}, _run long, _day date"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def load(self, rows: DataFrame) -> None:
        """The rows that there are before the first run."""
        self._write(rows, "hot", 0)

    def log(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/log/*") if self._exists("log") else self.spark.createDataFrame([], MANIFEST)

    def hot(self) -> DataFrame:
        now = self.log().where("day IS NOT NULL").groupBy("day").agg(F.max("run").alias("_now"))
        rows = self._read("hot").join(F.broadcast(now), F.col("_day") == F.col("day"), "left")  # a row per day
        return rows.where(F.col("_run") == F.coalesce("_now", F.lit(0))).select(*[f.split()[0] for f in self.schema.split(", ")])

    def archive(self) -> DataFrame:
        done = self.log().where("day IS NOT NULL").select(F.col("run").alias("_r"), F.col("day").alias("_d"))
        return self._read("archive").join(F.broadcast(done), (F.col("_run") == F.col("_r")) & (F.col("_day") == F.col("_d"))).select(*[f.split()[0] for f in self.schema.split(", ")])

    def move(self, run: int, now: F.Column, keep_days: dict[str, int], cursor: int, cited: DataFrame) -> None:
        """Archive rows of the sources in ``keep_days`` that are older than that, at or below the cursor, and not cited (id). Runs are numbered
        upwards; a run that broke off is repeated with its number. One that moves nothing has a log row too."""
        age = F.lit(False)
        for source, days in keep_days.items():
            age = age | ((F.col("source") == source) & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")))
        gone = self.hot().where(age & (F.col("id") <= cursor)).join(cited.select("id"), "id", "left_anti")
        self._write(gone, "archive", run)
        moved = self._read("archive").where(F.col("_run") == run)
        days = moved.groupBy("_day").agg(F.count("*").alias("moved"), F.min("id").alias("least"), F.max("id").alias("greatest"))
        found = [r.asDict() for r in days.collect()]  # a row per day
        if found:
            old = self.hot().withColumn("_d", F.to_date("created_at")).where(F.col("_d").isin([r["_day"] for r in found])).drop("_d")
            stay = old.join(moved.select("id"), "id", "left_anti")
            self._write(stay, "hot", run)
        rows = [(run, r["_day"], r["moved"], r["least"], r["greatest"]) for r in found] or [(run, None, 0, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/log/{run:09d}")


def retained(rows: DataFrame, at: str, now: F.Column, keep: str) -> DataFrame:
    """Rows that were ingested at most ``keep`` (an interval) before now; rows without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= now - F.expr(f"INTERVAL {keep}")))


def purge(spark: SparkSession, path: str, schema: str, at: str, hour: str, now: F.Column, keep: str, unit: str = "hour") -> None:
    """Retain in a table that is partitioned by the hour (or ``unit``) of ingestion: whole hours that are too old are deleted, the hour
    on the edge is written anew, others are not read."""
    edge = spark.range(1).select(F.date_trunc(unit, now - F.expr(f"INTERVAL {keep}")).alias("e")).first()["e"]
    rows = spark.read.schema(schema).parquet(path)
    kept = retained(rows.where(F.col(hour) == F.lit(edge)), at, now, keep)
    staged = f"{path}-edge"
    kept.write.mode("overwrite").parquet(staged)
    spark.read.schema(kept.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(hour).parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(root):  # a folder per unit
        name, _, value = status.getPath().getName().partition("=")
        if name == hour and value[:13] < f"{edge:%Y-%m-%d %H}":
            files.delete(status.getPath(), True)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def reconcile(events: DataFrame, current: DataFrame, fold, at: str, loaded: str, since: F.Column) -> DataFrame:
    """The current table (bucket, ..., anomaly) where every bucket that events ingested since then touch is computed anew from all its events. The
    anomaly flag of a bucket stays."""
    bucket = F.date_trunc("hour", F.col(at))
    touched = events.where(F.col(loaded) >= since).select(bucket.alias("bucket")).distinct()
    whole = fold(events.withColumn("bucket", bucket).join(touched, "bucket", "left_semi"))
    flags = current.select("bucket", "anomaly")
    new = whole.join(flags, "bucket", "left").withColumn("anomaly", F.coalesce("anomaly", F.lit(False)))
    return current.join(touched, "bucket", "left_anti").unionByName(new.select(*current.columns))


# --- queries ------------------------------------------------------------------------

HOT = "id long, source string, created_at timestamp, score double"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time they were ingested: up to six hours after they happened."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("loaded", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 7 * 3_600_000_000))


def _store(spark: SparkSession, sf_dir: str) -> Predictions:
    """Predictions of the fixture after two runs of retention, five days apart."""
    store = Predictions(spark, shared_path(spark, "retention"), HOT)
    source = F.when(F.col("event_type").isin("click", "view"), "stream_score").when(F.col("event_type") == "purchase", "live_score").otherwise("batch")
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), source.alias("source"), F.col("loaded").alias("created_at"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)).alias("score"))
    store.load(rows)
    queue, audit = actions._log(spark, sf_dir)
    cited = actions.current(queue, audit).where("status IN ('pending', 'failed')").select("id")
    cursor = rows.agg(F.max("id")).first()[0] * 4 // 5
    for run, day in ((1, "2024-01-21"), (2, "2024-01-26")):
        store.move(run, F.lit(f"{day} 00:00:00").cast("timestamp"), {"stream_score": 10, "live_score": 20}, cursor, cited)
    return store


def t17_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every prediction is."""
    store = _store(spark, sf_dir)
    return store.hot().select("id", F.lit("hot").alias("place")).unionByName(store.archive().select("id", F.lit("archive").alias("place")))


def t17_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).log().groupBy("run").agg(F.sum("moved").alias("moved"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def t16_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of events (12 hours), buckets (3 hours) and anomalies (10 days), by the time of ingestion."""
    e = _events(spark, sf_dir)
    now = F.lit(e.agg(F.max("loaded")).first()[0])
    hours = e.groupBy(F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"), F.max("loaded").alias("loaded"))
    path = shared_path(spark, "raw-events")
    raw = e.select("event_id", "loaded", F.date_trunc("day", "loaded").alias("_from"))
    raw.repartition("_from").write.partitionBy("_from").parquet(path)
    purge(spark, path, "event_id long, loaded timestamp, _from timestamp", "loaded", "_from", now, "12 HOURS", "day")
    left = spark.read.schema("event_id long, loaded timestamp, _from timestamp").parquet(path).select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("key"))
    text = F.unix_micros("bucket").cast("string")
    out = left.unionByName(retained(hours, "loaded", now, "3 HOURS").select(F.lit("bucket").alias("kind"), text.alias("key")))
    return out.unionByName(retained(hours.where("n > 20"), "loaded", now, "10 DAYS").select(F.lit("anomaly").alias("kind"), text.alias("key")))


def t09_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours as they were without the events that came late, with their flags, repaired for events ingested in the last five days."""
    e = _events(spark, sf_dir)
    fold = lambda rows: rows.groupBy("bucket").agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(12,2)")).otherwise(0)).cast("double").alias("revenue"), F.countDistinct("user_id").alias("sessions"), F.count("*").alias("n"))
    known = fold(e.where("event_id % 7 < 5").withColumn("bucket", F.date_trunc("hour", "ts"))).withColumn("anomaly", F.col("n") > 15)
    return reconcile(e, known, fold, "ts", "loaded", F.lit("2024-01-25 00:00:00").cast("timestamp"))


QUERIES = {f.__name__: f for f in (t17_archive, t17_log, t16_retention, t09_reconcile)}
_PLACES = """pr AS (SELECT event_id AS id, ts + to_hours(CAST(event_id % 7 AS INT)) AS at_, CASE WHEN event_type IN ('click', 'view') THEN 10 WHEN event_type = 'purchase' THEN 20 END AS keep FROM events),
    ar AS (SELECT id, CASE WHEN at_ < TIMESTAMP '2024-01-21 00:00:00' - to_days(keep) THEN 1 WHEN at_ < TIMESTAMP '2024-01-26 00:00:00' - to_days(keep) THEN 2 END AS run FROM pr WHERE id <= (SELECT max(event_id) * 4 // 5 FROM events) AND id NOT IN (SELECT action_id FROM fin WHERE state IN ('pending', 'failed')))"""
ORACLE = {
    "t17_archive": f"WITH {actions._RUN}, {_PLACES} SELECT pr.id, CASE WHEN ar.run IS NULL THEN 'hot' ELSE 'archive' END AS place FROM pr LEFT JOIN ar ON ar.id = pr.id",
    "t17_log": f"WITH {actions._RUN}, {_PLACES} SELECT CAST(r.run AS BIGINT) AS run, count(ar.id) AS moved, min(ar.id) AS least, max(ar.id) AS greatest FROM (VALUES (1), (2)) r(run) LEFT JOIN ar ON ar.run = r.run GROUP BY r.run",
    "t16_retention": """WITH e AS (SELECT *, ts + to_hours(CAST(event_id % 7 AS INT)) AS loaded FROM events), n AS (SELECT max(loaded) AS now_ FROM e), h AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, max(loaded) AS loaded FROM e GROUP BY 1)
        SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS key FROM e, n WHERE loaded >= now_ - INTERVAL 12 HOUR UNION ALL SELECT 'bucket', CAST(epoch_us(bucket) AS VARCHAR) FROM h, n WHERE loaded >= now_ - INTERVAL 3 HOUR
        UNION ALL SELECT 'anomaly', CAST(epoch_us(bucket) AS VARCHAR) FROM h, n WHERE h.n > 20 AND loaded >= now_ - INTERVAL 10 DAY""",
    "t09_reconcile": """WITH e AS (SELECT *, ts + to_hours(CAST(event_id % 7 AS INT)) AS loaded, date_trunc('hour', ts) AS bucket FROM events), t AS (SELECT DISTINCT bucket FROM e WHERE loaded >= TIMESTAMP '2024-01-25 00:00:00'),
        k AS (SELECT bucket, count(*) > 15 AS anomaly FROM e WHERE event_id % 7 < 5 GROUP BY bucket), u AS (SELECT * FROM e WHERE event_id % 7 < 5 OR bucket IN (SELECT bucket FROM t))
        SELECT u.bucket, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS revenue, count(DISTINCT user_id) AS sessions, count(*) AS n, coalesce(any_value(k.anomaly), false) AS anomaly FROM u LEFT JOIN k ON k.bucket = u.bucket GROUP BY u.bucket""",
}
