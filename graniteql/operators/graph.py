"""Connected components of a graph whose edges are a table, by alternating large and small stars.

Each round hangs a node's neighbours on the smallest one: first the larger neighbours (large star), then the smaller
ones (small star). After a number of rounds that grows with the logarithm of the nodes every node hangs on the smallest
of its component. A round is two aggregations and two joins, which Spark splits where a node has many neighbours, and is written to
the shared folder, so that neither the driver nor any one task ever holds the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteql.shared import forget, written


def by_other_key(rows: DataFrame, key: str, aggregate) -> DataFrame:
    """aggregate(rows grouped by a long column), dealt by that column's bits inverted: a join on the column then deals
    both sides anew, and Spark can split a value that very many rows of the other side have. Without that the aggregate
    would stay where it is, and all those rows would have to come to it."""
    other = f"__{key}"
    made = aggregate(rows.withColumn(other, F.bitwise_not(key)).groupBy(other))
    return made.withColumn(key, F.bitwise_not(other)).drop(other)


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of the edges a, b (long); a component is named by its smallest node."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, before = written(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.hash("u", "v"), F.lit(1 << 20)))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = by_other_key(both, "u", lambda x: x.agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # few neighbours are smaller
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m"))).distinct()
        after = written(small, "edges")
        forget(now)
        now = after
