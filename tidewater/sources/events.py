"""Event source: JSON envelopes from a topic or files, with malformed records set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .landing import shared_path

ENVELOPE = "schema_version int, event_id string, event_type string, occurred_at timestamp, produced_at timestamp, key string, loop_id string, payload string"
#: Payload schema of each event type.
PAYLOADS = {
    "order.placed": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, payment_value_total double, is_lost boolean, items array<struct<product_id:string,seller_id:string,price:double,freight_value:double,quantity:int>>, payments array<struct<payment_type:string,payment_installments:int,payment_value:double>>",
    "page.view": "session_id string, customer_id string, page_type string, product_id string",
    "cart.abandoned": "session_id string, customer_id string, items_count int, cart_value double",
    "price.changed": "product_id string, old_price double, new_price double, changed_at timestamp",
    "training.session_label": "session_id string, is_synthetic_bot boolean, loop_id string, is_converting boolean",
}


def topic(spark: SparkSession, servers: str, name: str) -> DataFrame:
    """Streaming lines of a Kafka topic (needs the connector): column ``value``."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": name}).load().select(F.col("value").cast("string").alias("value"))


def decode(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of ``value`` lines, batch or stream. A line that is not an
    envelope, has no id, type or time, is a reject; nothing is dropped."""
    parsed = lines.withColumn("e", F.from_json("value", ENVELOPE))
    good = F.coalesce(F.col("e.event_id").isNotNull() & F.col("e.event_type").isNotNull() & F.col("e.occurred_at").isNotNull(), F.lit(False))
    return parsed.where(good).select("e.*"), parsed.where(~good).select("value")


def payload(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type with their payload's fields beside the envelope's."""
    rows = events.where(F.col("event_type") == event_type).withColumn("p", F.from_json("payload", PAYLOADS[event_type]))
    return rows.select("event_id", "occurred_at", "produced_at", "key", F.col("loop_id").alias("_loop"), "p.*")


def judged(lines: DataFrame) -> DataFrame:
    """Every line with its envelope's fields and ``reason``: null where it is an event, ``envelope`` where it is none, ``payload``
    where its type has a schema that the payload cannot be read with. Types without a schema pass as they are."""
    parsed = lines.withColumn("e", F.from_json("value", ENVELOPE))
    good = F.coalesce(F.col("e.event_id").isNotNull() & F.col("e.event_type").isNotNull() & F.col("e.occurred_at").isNotNull(), F.lit(False))
    broken = F.lit(False)
    for kind, schema in PAYLOADS.items():
        read = F.from_json("e.payload", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
        broken = F.when(F.col("e.event_type") == kind, F.col("e.payload").isNull() | read.getField("_corrupt_record").isNotNull()).otherwise(broken)
    reason = F.when(~good, "envelope").when(F.coalesce(broken, F.lit(True)), "payload")
    return parsed.select("value", "e.*", reason.alias("reason"))


def land_envelopes(lines: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of lines to its end into one table of events and rejects, a folder per batch; nothing
    is dropped, and a batch that is repeated replaces itself."""
    spark, kinds = lines.sparkSession, judged(lines).schema

    def write(batch: DataFrame, n: int) -> None:
        judged(batch).write.mode("overwrite").parquet(f"{path}/_batch={n}")

    lines.writeStream.option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not written.getFileSystem(spark._jsc.hadoopConfiguration()).exists(written):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("basePath", path).parquet(f"{path}/_batch=*").select(*kinds.names)


def observed(landed: DataFrame) -> DataFrame:
    """What the live buckets take: (event_id, occurred_at, order_id, amount) of valid orders, (…, session_id) of views
    and carts with a session id that is not blank."""
    events = landed.where("reason IS NULL")
    orders = payload(events, "order.placed").where("NOT coalesce(is_lost, false) AND payment_value_total > 0")
    out = orders.select("event_id", "occurred_at", "order_id", F.col("payment_value_total").alias("amount"), F.lit(None).cast("string").alias("session_id"))
    for kind in ("page.view", "cart.abandoned"):
        seen = payload(events, kind).where("trim(session_id) <> ''")
        out = out.unionByName(seen.select("event_id", "occurred_at", F.lit(None).cast("string").alias("order_id"), F.lit(None).cast("double").alias("amount"), "session_id"))
    return out


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = 8) -> DataFrame:
    """A Parquet table of the folder as a stream of its files, ``ts`` as timestamp.
    None takes all files that are there in one batch, so that no row of them is late.
    The glob lets the path be one file or a folder of part files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    limit = {} if files_per_batch is None else {"maxFilesPerTrigger": files_per_batch}
    rows = spark.readStream.schema(schema).options(**limit).parquet(f"{sf_dir}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as lines of a topic: purchases are orders, some of them lost; views and clicks are sessions, some blank;
    every fiftieth line each is cut short, lacks its id, or has a payload that is cut short."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    names = {"purchase": "order.placed", "view": "page.view", "click": "cart.abandoned", "signup": "price.changed"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("other"))
    session = F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("user_id").cast("string"))
    order = F.struct(F.col("event_id").cast("string").alias("order_id"), F.col("value").alias("payment_value_total"), (F.col("user_id") % 10 == 0).alias("is_lost"))
    body = F.when(F.col("event_type") == "purchase", F.to_json(order)).otherwise(F.to_json(F.struct(session.alias("session_id"))))
    rest = F.col("event_id") % 50
    body = F.when(rest == 11, F.substring(body, 1, 9)).otherwise(body)
    line = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.when(rest != 9, F.col("event_id").cast("string")).alias("event_id"), kind.alias("event_type"), F.col("ts").alias("occurred_at"), F.col("ts").alias("produced_at"), F.col("user_id").cast("string").alias("key"), body.alias("payload")))
    return e.select(F.when(rest == 7, F.substring(line, 1, 45)).otherwise(line).alias("value"))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "topic")
    _envelopes(spark, sf_dir).write.text(path)
    return land_envelopes(spark.readStream.schema("value string").option("maxFilesPerTrigger", 4).text(path), f"{path}-landed")


def s05_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of envelope lines: events by type, and what was refused for which reason."""
    return _landed(spark, sf_dir).groupBy("event_type", "reason").agg(F.count("*").alias("n"), F.count("event_id").alias("n_ids"), F.max("occurred_at").alias("newest"))


def p13_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the payloads of that stream give to the live buckets."""
    return observed(_landed(spark, sf_dir)).drop("occurred_at")


QUERIES = {"s05_events": s05_events, "p13_payload": p13_payload}
_KIND = "CASE event_type WHEN 'purchase' THEN 'order.placed' WHEN 'view' THEN 'page.view' WHEN 'click' THEN 'cart.abandoned' WHEN 'signup' THEN 'price.changed' ELSE 'other' END"
ORACLE = {
    "s05_events": f"""WITH l AS (SELECT event_id % 50 AS k, {_KIND} AS kind, event_id, ts FROM events),
        j AS (SELECT CASE WHEN k <> 7 THEN kind END AS event_type, CASE WHEN k IN (7, 9) THEN 'envelope' WHEN k = 11 AND kind <> 'other' THEN 'payload' END AS reason, CASE WHEN k NOT IN (7, 9) THEN event_id END AS event_id, CASE WHEN k <> 7 THEN date_trunc('millisecond', ts) END AS ts FROM l)
        SELECT event_type, reason, count(*) AS n, count(event_id) AS n_ids, max(ts) AS newest FROM j GROUP BY event_type, reason""",
    "p13_payload": """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS order_id, CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type <> 'purchase' THEN CAST(user_id AS VARCHAR) END AS session_id
        FROM events WHERE event_id % 50 NOT IN (7, 9, 11) AND (event_type = 'purchase' AND user_id % 10 <> 0 AND value > 0 OR event_type IN ('view', 'click') AND event_id % 7 <> 0)""",
}
