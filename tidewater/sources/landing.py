"""Landing of CSV files as text tables with lineage, and the folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tidewater/{label}-{uuid.uuid4().hex}"


def land_csv(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """Every column as text, names trimmed and freed of a byte order mark, with
    ``_loaded_at``, ``_source_file`` and ``_batch_id``. A missing file is an error;
    an empty field is null, as CSV does not tell the two apart."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    clean = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return clean.select("*", F.current_timestamp().alias("_loaded_at"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_source_file"), F.lit(batch_id).alias("_batch_id"))


def load_audit(landed: DataFrame) -> DataFrame:
    """Rows per source file and batch."""
    return landed.groupBy("_source_file", "_batch_id").agg(F.count("*").alias("n_rows"))


def s01_land_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "customers-csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    landed = land_csv(spark, path, "batch")
    return landed.select("c_custkey", "c_name", "c_mktsegment", "_batch_id")


def s03_load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "orders-csv")
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    return load_audit(land_csv(spark, path, "batch")).groupBy("_batch_id").agg(F.sum("n_rows").alias("n_rows"))


QUERIES = {"s01_land_customers": s01_land_customers, "s03_load_audit": s03_load_audit}
ORACLE = {
    "s01_land_customers": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, 'batch' AS _batch_id FROM customer",
    "s03_load_audit": "SELECT 'batch' AS _batch_id, count(*) AS n_rows FROM orders",
}
