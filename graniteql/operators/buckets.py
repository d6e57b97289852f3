"""Joins of tables that are kept bucketed and sorted by their key, without a shuffle at query time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteql.shared import fresh_path


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """df written as a table of so many buckets, by a hash of the key, each of them one sorted file. Tables with the same number
    of buckets join bucket by bucket on that key, as often as wanted, for one shuffle when they are written. A key with very
    many rows makes its bucket large: such a bucket is one task in each join, so keys of that kind belong to a salted join
    (`joins.salted`), or the salt to the bucketing key. Rows with a null key have a bucket; an empty table is a table."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # by the same hash, so that a bucket is one file
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", fresh_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def largest_bucket(df: DataFrame, key: str, buckets: int) -> float:
    """The share of all rows in the largest bucket that a key would make: what to look at before bucketing by it."""
    sizes = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return sizes["most"] / sizes["all"] if sizes["all"] else 0.0
