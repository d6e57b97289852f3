"""Sources and sinks: what a table reads like after a round trip through each format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteql.plans.registry import Registry
from graniteql.session import table
from graniteql.shared import fresh_path
from graniteql.sources import arrow_files, formats

query = Registry()

query.sql("io1_parquet", "part", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size > 10")


def _round_trip(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "supplier")
        path = fresh_path(spark, kind)
        formats.write(rows, kind, path)
        return formats.read(spark, kind, path, rows.schema)

    return run


for _kind in ("csv", "json", "orc", "xml", "parquet"):
    query(f"io2_{_kind}", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(_round_trip(_kind))


@query("io2_text", "SELECT n_name AS value FROM nation")
def text(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "text")
    table(spark, d, "nation").select(F.col("n_name").alias("value")).write.text(path)
    return spark.read.text(path)


@query("io2_partitioned", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Written by status; the filter on it reads one folder."""
    path = fresh_path(spark, "partitioned")
    table(spark, d, "orders").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@query("io6_python_source", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def python_source(spark: SparkSession, d: str) -> DataFrame:
    """Written and read by a format in Python, batch by batch."""
    arrow_files.register(spark)
    path = fresh_path(spark, "arrow")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").write.format("arrowfiles").mode("append").save(path)
    return spark.read.format("arrowfiles").load(path).where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_orderpriority", "o_totalprice")
