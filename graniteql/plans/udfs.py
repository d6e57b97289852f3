"""User functions, each vectorised where Spark allows it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteql.plans.registry import Registry
from graniteql.session import table, text_batches

query = Registry()


@query("u1_vectorised_scalar", "SELECT doc_id, length(text) AS n FROM documents")
def u1(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def length(s: pd.Series) -> pd.Series:
        return s.str.len()

    text_batches(spark)
    return table(spark, d, "documents").select("doc_id", length("text").alias("n"))


@query("u2_vectorised_aggregate", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY o_orderpriority")
def u2(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def median(s: pd.Series) -> float:
        return float(s.median())

    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(median("o_totalprice"), 4).alias("median"))


@query("u3_grouped_map", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS nth FROM events")
def u3(spark: SparkSession, d: str) -> DataFrame:
    def number(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ts", "event_id"])
        return f.assign(nth=range(1, len(f) + 1))[["user_id", "event_id", "nth"]]

    return table(spark, d, "events").select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(number, "user_id long, event_id long, nth long")


@query("u3_map_arrow", "SELECT p_partkey, p_size * 2 AS twice FROM part")
def u3a(spark: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.multiply(b.column(1), 2).cast(pa.int32())], names=["p_partkey", "twice"])

    return table(spark, d, "part").select("p_partkey", "p_size").mapInArrow(run, "p_partkey long, twice int")


@query("u4_table_function", "SELECT n_nationkey, i AS nth, substr(n_name, i, 1) AS letter FROM (SELECT n_nationkey, n_name, CAST(unnest(generate_series(1, length(n_name))) AS INT) AS i FROM nation)")
def u4(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="nth int, letter string")
    class Letters:
        def eval(self, word: str):
            yield from enumerate(word, 1)

    spark.udtf.register("letters_of", Letters)
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, nth, letter FROM nation, LATERAL letters_of(n_name)")


@query("u5_row_function", "SELECT r_regionkey, reverse(r_name) AS turned FROM region")
def u5(spark: SparkSession, d: str) -> DataFrame:
    turned = F.udf(lambda s: None if s is None else s[::-1], "string", useArrow=True)
    return table(spark, d, "region").select("r_regionkey", turned("r_name").alias("turned"))
