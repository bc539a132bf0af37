"""Streams that lose no late row: insert-if-absent landing, and a current table of the buckets that it touched.

No watermark is used. A micro-batch lands the events whose keys have not landed yet (keys are kept
apart, by a hash of the key, so a key that comes again with another time is found). Then all buckets
of the days that it touched are computed anew from all their landed events and replace these days
of the current table (dynamic partition overwrite). A repeated batch replaces its own
folders and computes the same days, so a restart adds and loses nothing. The current table has one
file per day, a batch has one per day and part unless a day is large, and landed batches are merged every ``MERGE`` batches, so the number of files does not grow
with the number of batches. The lists taken to the driver are days and parts of the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import shared_path

PARTS, MERGE = 16, 32


class Batches:
    """A table of one folder per micro-batch, ``_batch=n``; ``_upto=n`` has all batches up to n in one."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None, by: str):
        self.spark, self.path, self.schema, self.by = spark, path, schema, by
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root, name)

    def folders(self) -> dict[str, list[int]]:
        """Finished merges and batches. A folder whose writing was broken off has no _SUCCESS."""
        found: dict[str, list[int]] = {"_upto": [], "_batch": []}
        for status in self.files.listStatus(self.root) if self.files.exists(self.root) else []:
            kind, _, n = status.getPath().getName().partition("=")
            if kind in found and self.files.exists(self._at(f"{kind}={n}/_SUCCESS")):
                found[kind].append(int(n))
        return {kind: sorted(n) for kind, n in found.items()}

    def write(self, rows: DataFrame, n: int) -> None:
        rows.hint("rebalance", self.by).write.mode("overwrite").partitionBy(self.by).parquet(f"{self.path}/_batch={n}")

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of the batches before ``before``, or of all."""
        found = self.folders()
        whole = [n for n in found["_upto"] if before is None or n < before][-1:]
        names = [f"_upto={n}" for n in whole] + [f"_batch={n}" for n in found["_batch"] if (not whole or n > whole[0]) and (before is None or n < before)]
        empty = self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}") for name in names]
        out = empty
        for part in parts:
            out = out.unionByName(part.select(*out.columns))
        return out

    def merge(self, n: int) -> None:
        """Merge the batches up to ``n`` when there are many, then delete them. Batch n can still be repeated:
        it is merged only when a later one comes."""
        found = self.folders()
        own = [b for b in found["_batch"] if b < n]
        if len(own) >= MERGE:
            last = own[-1]
            self.read(n).hint("rebalance", self.by).write.mode("overwrite").partitionBy(self.by).parquet(f"{self.path}/_upto={last}")
            for name in [f"_batch={b}" for b in own] + [f"_upto={u}" for u in found["_upto"] if u < last]:
                self.files.delete(self._at(name), True)


def land_once(stream: DataFrame, keys: list[str], at: str, label: str, path: str | None = None, checkpoint: str | None = None, fold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(landed, current): the rows of a stream once per key, and ``fold`` of every bucket.

    ``at`` is the event time (or day). A folded row's first column is the start of its bucket, which lies
    in the day of ``at``. Null keys are equal to each other; of repeated rows any one stays. ``current`` has
    ``_batch``, the batch that wrote a day. A source without files gives empty tables.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark, label)
    checkpoint = checkpoint or f"{path}-checkpoint"
    names = stream.columns
    part = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(PARTS)).cast("int")
    dated = spark.createDataFrame([], stream.schema).withColumn("_day", F.to_date(at)).withColumn("_part", part)
    landed = Batches(spark, path, dated.drop("_part").schema, "_day")
    known = Batches(spark, f"{path}-keys", dated.select(*keys, "_part").schema, "_part")
    now = f"{path}-current"
    folded = fold(dated.select(*names)).withColumn("_batch", F.lit(0).cast("long")).withColumn("_day", F.to_date(F.lit(None))).schema if fold else None

    def days_of(rows: DataFrame) -> F.Column:
        days = [r[0] for r in rows.select("_day").distinct().collect()]
        return F.coalesce(F.col("_day").isin([d for d in days if d is not None]), F.lit(False)) | (F.col("_day").isNull() if None in days else F.lit(False))

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        new = batch.dropDuplicates(keys).withColumn("_day", F.to_date(at)).withColumn("_part", part)
        parts = [r[0] for r in new.select("_part").distinct().collect()]
        old = known.read(n).where(F.col("_part").isin(parts)).select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.col("_part").alias("_old_part"))
        same = F.col("_part") == F.col("_old_part")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_old_{k}"))
        landed.write(new.join(old, same, "left_anti").drop("_part"), n)
        batch.unpersist()
        mine = spark.read.schema(landed.schema).option("basePath", f"{path}/_batch={n}").parquet(f"{path}/_batch={n}")
        known.write(mine.withColumn("_part", part).select(*keys, "_part"), n)
        if fold is not None:
            touched = days_of(mine)
            whole = landed.read(n + 1).where(touched)
            found = fold(whole.select(*names)).withColumn("_batch", F.lit(n)).withColumn("_day", F.to_date(F.col(folded.names[0])))
            found.repartition("_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(now)
        landed.merge(n)
        known.merge(n)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    everything = landed.read().select(*names)
    if fold is None:
        return everything, None
    written = Batches(spark, now, folded, "_day")
    current = spark.read.schema(folded).parquet(now) if written.files.exists(written.root) else spark.createDataFrame([], folded)
    return everything, current.drop("_day")


def closed(rows: DataFrame, timeline: str, at: str, width: str, idle: str = "10 seconds") -> DataFrame:
    """Buckets of every timeline with their rows, and whether each may be analysed.

    A timeline (a replay, a loop) has its own clock, so one that starts again far in the
    past is not late. A bucket is closed when it begins more than a minute before the newest bucket of its
    timeline, or when the timeline has been idle and the newest event of all is more
    than a minute past the bucket's beginning. Rows without time are left out.
    """
    per = rows.where(F.col(at).isNotNull()).groupBy(F.col(timeline).alias("timeline"), F.window(at, width).start.alias("bucket")).agg(F.count("*").alias("n"), F.max(at).alias("_last"))
    clocks = per.groupBy(F.col("timeline").alias("_line")).agg(F.max("bucket").alias("_mark"), F.max("_last").alias("_seen"))
    now = clocks.agg(F.max("_seen").alias("_now"))
    known = per.join(clocks, F.col("timeline").eqNullSafe(F.col("_line"))).crossJoin(F.broadcast(now))  # one row
    minute = F.expr("INTERVAL 1 MINUTE")
    moved_on = F.col("bucket") < F.col("_mark") - minute
    is_idle = (F.col("_now") - F.expr(f"INTERVAL {idle}") >= F.col("_seen")) & (F.col("bucket") < F.col("_now") - minute)
    return known.select("timeline", "bucket", "n", (moved_on | is_idle).alias("is_closed"))
