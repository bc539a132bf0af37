"""Features of a key's earlier rows in a stream, computed in order of event time.

Rows wait in state until the watermark has passed them, as aggregates of one key and millisecond, which Spark deals over all
tasks; a row that comes behind the watermark is dropped, as is usual in a stream, and rows that the watermark has not passed
when the input ends are not out yet. What has passed is a table. No row comes before one of it any more, so features are
``functions.trailing`` over it: by (time, id), a row's features without the row itself, whatever the order of arrival.
No task holds a key's rows: a key that has a fifth of all rows is spread over its cells of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import trailing

from ..sources.events import file_stream
from .jobs import LATE, ROCKS, run_to_table

DAY = 86_400_000_000


def passed(rows: DataFrame, label: str) -> DataFrame:
    """Run a stream of (key, ts, id, v) to its end: (key, us, id, v, nth) of the rows that the watermark has passed, ``nth`` to tell equal ones apart."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    waiting = rows.where("ts IS NOT NULL").withWatermark("ts", LATE).groupBy("key", F.window("ts", "1 millisecond")).agg(F.sort_array(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), "id", "v"))).alias("r"))
    return run_to_table(waiting.select("key", F.posexplode("r").alias("nth", "r")).select("key", "r.*", "nth"), label).drop("_batch")


def ordered(stream: DataFrame, key: str, window: int, label: str, cell: int | None = None) -> DataFrame:
    """Run a stream with ``ts``, ``id`` and a long ``v`` to its end: per row n and total of its key's earlier rows within ``window``, whole days
    since the first of all. A null ``v`` counts in n and adds 0; rows without time are dropped."""
    seen = passed(stream.select(F.col(key).alias("key"), "ts", F.col("id").cast("long").alias("id"), F.coalesce(F.col("v").cast("long"), F.lit(0)).alias("v")), label)
    found = trailing(seen.withColumn("place", F.struct("id", "nth", "us", "key")), "key", "us", "place", window, ["v"], cell)
    first = seen.groupBy(F.col("key").alias("_key")).agg(F.min("us").alias("_first"))
    met = found.join(first, F.col("key").eqNullSafe(F.col("_key")))
    return met.select("id", "n", F.col("sum_v").alias("total"), F.expr(f"(us - _first) div {DAY}").alias("days"))


def t11_ordered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: events of its user in 24 hours and days since the first; count and value of its type in 90 days."""

    def rows() -> DataFrame:
        cents = (F.col("value").cast("decimal(12,2)") * 100).cast("long")
        return file_stream(spark, sf_dir, "events", None).select(F.col("event_id").alias("id"), "ts", "user_id", "event_type", cents.alias("v"))

    person = ordered(rows(), "user_id", DAY, "t11-person").select("id", F.col("n").alias("velocity"), F.col("days").alias("age_days"))
    kind = ordered(rows(), "event_type", 90 * DAY, "t11-kind", DAY // 4).select("id", F.col("n").alias("bench_n"), (F.col("total") / 100).alias("bench_sum"))
    return person.join(kind, "id").withColumnRenamed("id", "event_id")


def f12_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stream's features against the batch ones: compared, and differing by more than 1e-6."""
    cents = (F.col("value").cast("decimal(12,2)") * 100).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), cents.alias("v"))
    person = trailing(rows, "user_id", "us", "event_id", DAY).select("event_id", F.col("n").alias("b_velocity"))
    kind = trailing(rows, "event_type", "us", "event_id", 90 * DAY, ["v"], cell=DAY // 4).select("event_id", F.col("n").alias("b_bench_n"), (F.col("sum_v") / 100).alias("b_bench_sum"))
    both = t11_ordered_features(spark, sf_dir).join(person, "event_id", "left").join(kind, "event_id", "left")
    names = ["velocity", "bench_n", "bench_sum"]
    pairs = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("s"), F.col(f"b_{c}").cast("double").alias("b")) for c in names])).alias("p")).select("p.*")
    off = F.col("b").isNull() | (F.abs(F.col("s") - F.col("b")) > 1e-6)
    return pairs.groupBy("feature").agg(F.count("*").alias("compared"), F.count_if(off).alias("mismatches"))


QUERIES = {f.__name__: f for f in (t11_ordered_features, f12_parity)}
_OUT = "epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 600000"
_EARLIER = "(b.ts < a.ts OR b.ts = a.ts AND b.event_id < a.event_id)"
ORACLE = {
    "t11_ordered_features": f"""WITH p AS (SELECT a.event_id, count(b.event_id) FILTER (WHERE b.ts >= a.ts - INTERVAL '24' HOUR) AS velocity, CAST(floor((epoch_us(any_value(a.ts)) - coalesce(min(epoch_us(b.ts)), epoch_us(any_value(a.ts)))) / {DAY}) AS BIGINT) AS age_days
        FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND {_EARLIER} GROUP BY a.event_id),
        k AS (SELECT a.event_id, count(b.event_id) AS bench_n, CAST(coalesce(sum(CAST(b.value AS DECIMAL(12,2))), 0) AS DOUBLE) AS bench_sum FROM events a LEFT JOIN events b ON a.event_type = b.event_type AND b.ts >= a.ts - INTERVAL '90' DAY AND {_EARLIER} GROUP BY a.event_id)
        SELECT p.*, k.bench_n, k.bench_sum FROM p JOIN k ON p.event_id = k.event_id JOIN events e ON e.event_id = p.event_id WHERE {_OUT}""",
    "f12_parity": f"SELECT f.feature, count(*) AS compared, 0 AS mismatches FROM events CROSS JOIN (VALUES ('velocity'), ('bench_n'), ('bench_sum')) f(feature) WHERE {_OUT} GROUP BY f.feature",
}
PLANS: dict = {}
