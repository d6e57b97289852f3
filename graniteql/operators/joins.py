"""Joins that SQL has no operator for."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], prefix: str = "right_", part: Column | None = None) -> DataFrame:
    """Backward as-of join: each left row gets the right row of the same key with the latest time not after its own
    (among right rows of equal time the greatest values; nulls if there is none, or if key or time is null). One shuffle on
    the key and one sorted pass: both sides are united and the last right row is carried forward; no pair of rows is made.

    part, if given, is a column that never falls as time rises (a day, say). A key's rows are then dealt by it, for keys
    that have very many, and the last right row before each part comes from one row for each key and part."""
    held = F.struct(F.col(time), *values)
    a = left.select(*left.columns, F.lit(None).cast(right.select(held.alias("r")).schema["r"].dataType).alias("__r"), F.lit(1).alias("__side"))
    known = reduce(and_, (F.col(c).isNotNull() for c in [*by, time]))
    b = right.where(known).select(*by, time, held.alias("__r"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__part", F.lit(0) if part is None else part)
    seen = Window.partitionBy(*by, *["__part"] * (part is not None)).orderBy(time, "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__r", ignorenulls=True).over(seen)).where("__side = 1")
    if part is not None:
        earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        ends = both.groupBy(*by, "__part").agg(F.max("__r").alias("__end")).withColumn("__before", F.last("__end", ignorenulls=True).over(earlier))
        ends = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col("__part").alias("__p"), "__before")
        same = F.col("__part") == F.col("__p")
        for i, k in enumerate(by):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        out = out.join(ends, same, "left").withColumn("__last", F.coalesce("__last", "__before"))
    return out.select(*left.columns, F.col(f"__last.{time}").alias(prefix + time), *(F.col(f"__last.{v}").alias(prefix + v) for v in values))


def in_range(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: int, by: list[str] | None = None) -> DataFrame:
    """Pairs of points and ranges with low <= point <= high (numbers), by buckets of a width: a range is sent to each
    bucket that it touches, a point to its own; the join is on the bucket. `width` is of the order of a range."""
    by = by or []
    p = points.withColumn("__bucket", F.floor(point / width).cast("long"))
    r = ranges.withColumn("__low", low).withColumn("__high", high)
    r = r.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__low") / width).cast("long"), F.floor(F.col("__high") / width).cast("long"))))
    return p.join(r, [*by, "__bucket"]).where((point >= F.col("__low")) & (point <= F.col("__high"))).drop("__bucket", "__low", "__high")


def salted(big: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """Inner join whose hot keys are spread: big rows get one of `salts` numbers by a hash of the row, small rows all."""
    a = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "__salt"]).drop("__salt")
