"""Top rows of groups, and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row for each distinct key, the one with the smallest `order`, by a map-side aggregate instead of a sort."""
    return df.groupBy(key.alias("key")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
