"""Exact distinct counts of whole numbers by bitmaps that merge.

`count(DISTINCT a), count(DISTINCT b)` multiplies the rows by the number of columns and shuffles every distinct value. Here a
column's values set bits in bitmaps of 32,768 numbers each, built before the shuffle, so that what leaves a task is a bitmap
for each group and stretch of numbers, however many rows it has. Bitmaps of finer groups merge into those of coarser ones,
which plain counts don't: one set serves all levels of a rollup. A bitmap takes 4 KB, so this is for keys that are
numbered densely; a hot group is spread over its bitmaps.

Defined cases: nulls are not counted, a group of nulls alone has the count 0; a null key is a group; negative numbers are
numbers; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """by columns, bucket, bitmap, n: bits of a column's values, and the number of rows, for each group and stretch."""
    value = F.col(column).cast("long")
    at = rows.select(*by, F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).alias("bit"))
    return at.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"), F.count("*").alias("n"))


def merged(maps: DataFrame, by: list[str]) -> DataFrame:
    """The bitmaps of coarser groups."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("n").alias("n"))


def counted(maps: DataFrame, by: list[str], name: str, n: str = "n") -> DataFrame:
    """by columns, the number of distinct values, the number of rows."""
    return maps.select(*by, F.bitmap_count("bitmap").alias("bits"), "n").groupBy(*by).agg(F.sum("bits").alias(name), F.sum("n").alias(n))


def distinct_counts(rows: DataFrame, by: list[str], columns: dict[str, str], n: str = "n") -> DataFrame:
    """by columns, for each of the columns its number of distinct values under the given name, and the number of rows."""
    out = None
    for column, name in columns.items():
        one = counted(bitmaps(rows, by, column), by, name, n)
        if out is None:
            out = one
        else:
            others = one.select(*(F.col(c).alias(f"of_{c}") for c in by), name)
            same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by), F.lit(True))
            out = out.join(others, same).drop(*(f"of_{c}" for c in by))
    return out.select(*by, *columns.values(), n)


def rollup_counts(rows: DataFrame, by: list[str], column: str, name: str, n: str = "n") -> DataFrame:
    """The same for all levels of a rollup, from one pass over the rows; `level` is the number of keys that hold."""
    maps, out = bitmaps(rows, by, column), None
    for level in range(len(by), -1, -1):
        if level < len(by):
            maps = merged(maps, by[:level])
        some = counted(maps, by[:level], name, n)
        some = some.select(*(F.col(c) if i < level else F.lit(None).cast(rows.schema[c].dataType).alias(c) for i, c in enumerate(by)), F.lit(level).alias("level"), name, n)
        out = some if out is None else out.unionByName(some)
    return out.where((F.col("level") > 0) | F.col(n).isNotNull())
