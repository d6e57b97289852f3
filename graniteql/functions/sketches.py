"""Sketches that SQL makes but has no function to read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteql.shared import written

#: Bytes before the hash factors: version, total, depth, width; and the modulus of the hashes, as Spark writes them.
_HEAD, _MODULUS = 20, (1 << 31) - 1


def _slot(factor: Column, key: Column, width: Column) -> Column:
    """Where a row of the sketch counts a key: factor times key modulo 2^64, folded to 31 bits, modulo the width. The product
    is taken in two halves of the key, neither of which overflows."""
    low = factor * key.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(low, 32) + factor * F.shiftright(key, 32)
    return (low.bitwiseAND(F.lit(_MODULUS)) + high.bitwiseAND(F.lit(_MODULUS))).bitwiseAND(F.lit(_MODULUS)) % width


def _laid_out(sketch: DataFrame) -> DataFrame:
    """A count_min_sketch (a row, a column) as rows: at (the number's place in it), row (of the sketch; null for the hash factors,
    which come first), slot, n, width. The bytes are cut in one pass, as each access to a long value of a row copies it."""
    column = F.col(sketch.columns[0])
    head = lambda at: F.conv(F.hex(F.substr(column, F.lit(at + 1), F.lit(4))), 16, 10).cast("long")
    numbers = F.regexp_extract_all(F.substr(F.hex(column), F.lit(2 * _HEAD + 1)), F.lit(".{16}"), F.lit(0))
    rows = sketch.select(head(12).alias("depth"), head(16).alias("width"), numbers.alias("numbers")).select("depth", "width", F.posexplode("numbers").alias("at", "n"))
    place = F.col("at") - F.col("depth")
    return rows.select("at", F.when(place >= 0, F.floor(place / F.col("width"))).alias("row"), F.pmod(place, F.col("width")).alias("slot"), F.conv("n", 16, 10).cast("long").alias("n"), "width")


def count_min(rows: DataFrame, column: str, keys: DataFrame, error: float, confidence: float, seed: int, name: str = "estimate") -> DataFrame:
    """keys, a table with that column, and how often each of them is in rows: too high by `error` of all rows at most, with the
    given confidence, never too low. The sketch, whose size depends on these two alone, is made by an aggregate and written
    once as a table of its numbers; each of its rows is one lookup of the keys. These may be any number: none of them
    carries the sketch, and the driver doesn't see it."""
    made = rows.select(F.col(column).cast("long").alias("of")).agg(F.count_min_sketch("of", F.lit(error), F.lit(confidence), F.lit(seed)).alias("sketch"))
    table = written(_laid_out(made), "sketch")
    factors = F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"])
    head = table.where("row IS NULL").agg(factors.alias("__factors"), F.max("width").alias("__width"))
    key, depth = F.col(column).cast("long"), math.ceil(-math.log(1 - confidence) / math.log(2))  # as Spark has it
    out, held = keys.crossJoin(F.broadcast(head)), [f"__{row}" for row in range(depth)]  # one row
    for row, c in enumerate(held):
        cells = table.where(F.col("row") == row).select(F.col("slot").alias("__slot"), F.col("n").alias(c))
        out = out.join(F.broadcast(cells), _slot(F.col("__factors")[row], key, F.col("__width")) == F.col("__slot"), "left").drop("__slot")
    return out.withColumn(name, F.array_min(F.array(*held))).drop(*held, "__factors", "__width")
