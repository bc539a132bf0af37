"""Structured Streaming jobs over click and prediction events, run to the end of
their input into Parquet tables; each has a batch twin that checks it.

Sinks write one folder per micro-batch id, so a repeated batch replaces itself and
a restart loses and repeats nothing. ``newest`` folds them to a keyed upsert.
Landing and buckets use ``folds``, where no row is too late; ``t13`` and ``t11`` need
time to pass, so they take the files that are there as one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.events import file_stream
from ..sources.landing import shared_path
from .folds import closed, land_once

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "10 minutes"


def run_to_table(stream: DataFrame, label: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return the written table with ``_batch``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = path or shared_path(spark, label)
    checkpoint = checkpoint or f"{path}-checkpoint"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", path).parquet(f"{path}/_batch=*").select(*stream.columns, F.regexp_extract(F.input_file_name(), r"_batch=(\d+)", 1).cast("long").alias("_batch"))


def newest(table: DataFrame, *keys: str) -> DataFrame:
    """The row of the newest micro-batch per key: an upsert on read."""
    rest = [c for c in table.columns if c not in (*keys, "_batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def revenue(events: DataFrame, width: str) -> DataFrame:
    """Valid revenue and orders per tumbling bucket of events that are there once."""
    valid = (F.col("event_type") == "purchase") & (F.col("value") > 0)
    pay = F.when(valid, F.col("value").cast("decimal(12,2)")).otherwise(0)
    return events.groupBy(F.window("ts", width)).agg(F.sum(pay).cast("double").alias("revenue"), F.sum(valid.cast("long")).alias("orders")).select(F.col("window.start").alias("bucket"), "revenue", "orders")


def revenue_buckets(clicks: DataFrame, width: str) -> DataFrame:
    """The same in a stream with a watermark: redelivered events count once, later ones than ``LATE`` are dropped."""
    return revenue(clicks.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]), width)


def active_sessions(events: DataFrame, width: str) -> DataFrame:
    """Distinct sessions per bucket from views and clicks: one row per session and bucket, then a count."""
    seen = events.select(F.window("ts", width).start.alias("bucket"), F.when(F.col("event_type").isin("view", "click"), F.col("user_id")).alias("user_id")).distinct()
    return seen.groupBy("bucket").agg(F.count("user_id").alias("sessions"))


def ended_sessions(clicks: DataFrame, gap: str) -> DataFrame:
    """Features of sessions that ended: a session is closed when the watermark passes its gap."""
    s = F.session_window("ts", gap)
    out = clicks.withWatermark("ts", LATE).groupBy("user_id", s).agg(F.count("*").alias("clicks"), F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("has_cart"), F.max("value").alias("cart_value"), F.min("ts").alias("began"))
    return out.select("user_id", "began", "clicks", "has_cart", "cart_value")


def _hours(spark: SparkSession, sf_dir: str, fold: Callable[[DataFrame, str], DataFrame], label: str) -> DataFrame:
    """Hours touched by each micro-batch, recomputed from all their landed events."""
    _, found = land_once(file_stream(spark, sf_dir, "events"), ["event_id"], "ts", label, fold=lambda rows: fold(rows, "1 hour"))
    return newest(found, "bucket")


def t01_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir, revenue, "t01")


def t02_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir, active_sessions, "t02").where("sessions > 0")


def _live(events: DataFrame, width: str) -> DataFrame:
    """Revenue, orders and sessions of every bucket: one row per session and bucket, then a sum."""
    valid = (F.col("event_type") == "purchase") & (F.col("value") > 0)
    per = events.groupBy(F.window("ts", width).start.alias("bucket"), "user_id").agg(F.sum(F.when(valid, F.col("value").cast("decimal(12,2)")).otherwise(0)).alias("r"), F.count_if(valid).alias("o"), F.max(F.col("event_type").isin("view", "click")).alias("active"))
    return per.groupBy("bucket").agg(F.sum("r").cast("double").alias("revenue"), F.sum("o").alias("orders"), F.count_if(F.col("active") & F.col("user_id").isNotNull()).alias("sessions"))


def s07_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table of hours after two runs over files in any order, the second from where the first ended."""
    source, path = shared_path(spark, "deliveries"), shared_path(spark, "s07")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for turn in (0, 1):
        events.where((F.col("event_id") % 3 != 0) == F.lit(turn == 0)).repartition(6, F.xxhash64("event_id")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(source)
        _, hours = land_once(stream, ["event_id"], "ts", "s07", path, f"{path}-checkpoint", fold=lambda rows: _live(rows, "1 hour"))
    return hours.drop("_batch")


def s06_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent: the same events delivered twice land once."""
    twice = file_stream(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return land_once(twice, ["event_id"], "ts", "s06")[0].select("event_id", "user_id")


def t05_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour buckets of every event type, a timeline of its own, with whether they are closed."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return closed(rows, "event_type", "ts", "1 hour")


def t13_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that ended before the watermark of the last events."""
    return run_to_table(ended_sessions(file_stream(spark, sf_dir, "events", None), "6 hours"), "t13").drop("_batch")


def t14_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per (loop, entity): the loop is the day."""
    rows = file_stream(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("loop_id"), F.col("user_id").alias("entity"))
    return land_once(rows, ["loop_id", "entity"], "loop_id", "t14")[0]


def t15_scoring(spark: SparkSession, sf_dir: str, score: Callable[[], F.Column] | None = None) -> DataFrame:
    """Contract check, scoring expression and confidence on a stream, appended to the prediction table."""
    rows = file_stream(spark, sf_dir, "events").where("value IS NOT NULL AND NOT isnan(value)")
    p = score() if score else F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)
    scored = rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), F.col("user_id").alias("entity"), p.alias("score"))
    return run_to_table(scored.withColumn("confidence", F.greatest("score", 1 - F.col("score"))), "t15").drop("_batch")


QUERIES = {f.__name__: f for f in (t01_revenue, t02_sessions, s06_landing, s07_upsert, t05_closed, t13_sessions, t14_once, t15_scoring)}

_HOUR = "date_trunc('hour', ts)"
ORACLE = {
    "t01_revenue": f"SELECT {_HOUR} AS bucket, CAST(sum(CASE WHEN event_type = 'purchase' AND value > 0 THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS revenue, count(*) FILTER (WHERE event_type = 'purchase' AND value > 0) AS orders FROM events GROUP BY {_HOUR}",
    "t02_sessions": f"SELECT {_HOUR} AS bucket, count(DISTINCT user_id) AS sessions FROM events WHERE event_type IN ('view', 'click') GROUP BY {_HOUR}",
    "s06_landing": "SELECT event_id, user_id FROM events",
    "s07_upsert": f"""SELECT {_HOUR} AS bucket, CAST(sum(CASE WHEN event_type = 'purchase' AND value > 0 THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS revenue, count(*) FILTER (WHERE event_type = 'purchase' AND value > 0) AS orders,
        count(DISTINCT user_id) FILTER (WHERE event_type IN ('view', 'click')) AS sessions FROM events GROUP BY {_HOUR}""",
    "t05_closed": """WITH b AS (SELECT event_type AS timeline, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2) SELECT timeline, bucket, n, bucket + INTERVAL '1' MINUTE < (SELECT max(date_trunc('hour', e.ts)) FROM events e WHERE e.event_type = b.timeline)
        OR (SELECT max(e.ts) FROM events e WHERE e.event_type = b.timeline) + INTERVAL '10' SECOND <= (SELECT max(ts) FROM events) AND bucket + INTERVAL '1' MINUTE < (SELECT max(ts) FROM events) AS is_closed FROM b""",
    "t13_sessions": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6' HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS clicks, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS has_cart, max(value) AS cart_value
        FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '370' MINUTE < (SELECT max(ts) FROM events)""",
    "t14_once": "SELECT DISTINCT CAST(ts AS DATE) AS loop_id, user_id AS entity FROM events",
    "t15_scoring": "SELECT event_id AS id, event_type AS model, user_id AS entity, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score, greatest(CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000, 1 - CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000) AS confidence FROM events WHERE value IS NOT NULL AND NOT isnan(value)",
}
