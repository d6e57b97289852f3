"""Exact quantiles of groups of any size by distributed selection.

`percentile` holds a group's distinct values in one buffer. Here a mergeable KLL sketch brackets the wanted ranks, the rows
below the bracket are counted, and only the rows inside are kept; what is left is collapsed to values with their counts,
and the bracket is narrowed again until no group has more than MOST values in it. Only then are a group's values looked at
in order, MOST of them at most. A sketch that is off costs a round, never the result: each bracket is made from exact
counts. The driver sees one number a round, the largest count of values.

Defined cases: a null key is a group; null values do not count, a group without others has the quantile null; NaN is larger
than any number, as in Spark's order; ties weigh by their number; an empty table gives an empty result; other columns
take no part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteql.shared import forget, written

#: Most distinct values of a group that are put in order in one task.
MOST = 10_000
#: How far from the wanted share the first bracket lies; ten times a sketch's usual error. Later brackets: CUTS cuts.
MARGIN, CUTS = 0.02, 15


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float, name: str = "quantile", most: int = MOST, rounds: list[int] | None = None) -> DataFrame:
    """by columns, name: each group's quantile q, between the two nearest values in proportion (SQL's quantile_cont).
    rounds: gets the largest number of a group's values in the bracket, after each round."""
    most = max(most, 64)  # two neighbours are wanted, and cuts must part what is left
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("value"))
    target = F.lit(q) * (F.col("n") - 1)
    state = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below"))
    state = written(state.withColumns({"first": F.floor(target), "last": F.ceil(target), "share": target - F.floor(target)}), "groups")
    left = rows.where("value is not null").withColumn("w", F.lit(1).cast("long"))
    largest = state.agg(F.max("n")).first()[0] or 0
    near = [max(0.0, q - MARGIN), min(1.0, q + MARGIN)]
    if largest > most:
        state, left = _narrowed(left, state, keys, near)
    left = _collapsed(left, keys)
    while (largest := left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > most:
        if rounds is not None:
            rounds.append(largest)
        before = left
        state, left = _narrowed(left, state, keys, [(i + 1) / (CUTS + 1) for i in range(CUTS)])
        left = _collapsed(left, keys)
        forget(before)
    if rounds is not None:
        rounds.append(largest)
    order = Window.partitionBy(*keys).orderBy("value")  # `most` rows of a group at most
    upto = _met(left, state, keys).withColumn("upto", F.col("below") + F.sum("w").over(order))
    at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("value")))
    found = upto.groupBy(*keys).agg(at("first").alias("a"), at("last").alias("b"), F.first("share").alias("share"))
    found = found.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("found"))
    out = _met(state, found, keys, "left")
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), F.col("found").alias(name))


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a and b joined on the keys, null being a key; each column comes once."""
    if not keys:
        return a.crossJoin(F.broadcast(b)) if how == "inner" else a.join(b, F.lit(True), how)  # b has one row
    b = b.select(*(F.col(k).alias(f"of_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys))
    return a.join(b, same, how).drop(*(f"of_{k}" for k in keys))


def _collapsed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return written(rows.groupBy(*keys, "value").agg(F.sum("w").alias("w")), "values")


def _inside(value: Column, low: Column, high: Column) -> Column:
    """Above low, which is outside the bracket, and up to high; null is no bound."""
    return (low.isNull() | (value > low)) & (high.isNull() | (value <= high))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], shares: list[float]) -> tuple[DataFrame, DataFrame]:
    """The state with narrower brackets, and the rows in them: cuts at these shares of the rows by a sketch, the rows up
    to each cut counted."""
    cuts = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("value").alias("sketch")).select(*keys, *(F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"c{i}") for i, s in enumerate(shares)))
    many = range(len(shares))
    counts = _met(rows, cuts, keys).groupBy(*keys).agg(*(F.sum(F.when(F.col("value") <= F.col(f"c{i}"), F.col("w")).otherwise(0)).alias(f"n{i}") for i in many), *(F.first(f"c{i}").alias(f"c{i}") for i in many))
    after = _met(state, counts, keys, "left")
    upto = lambda i: F.col("below") + F.col(f"n{i}")
    # the largest cut that lies before the first wanted row, and the smallest that the last one does not pass
    low = F.array_max(F.array(*(F.when(upto(i) <= F.col("first"), F.struct(F.col(f"c{i}").alias("cut"), upto(i).alias("upto"))) for i in many)))
    high = F.array_min(F.array(*(F.when(upto(i) > F.col("last"), F.col(f"c{i}")) for i in many)))
    after = after.withColumns({"low_now": low, "high_now": high})
    after = after.select(*keys, "n", F.coalesce("low_now.cut", "low").alias("low"), F.coalesce("high_now", "high").alias("high"), F.coalesce("low_now.upto", "below").alias("below"), "first", "last", "share")
    after = written(after, "groups")
    kept = _met(rows, after.select(*keys, "low", "high"), keys).where(_inside(F.col("value"), F.col("low"), F.col("high")))
    return after, kept.select(*keys, "value", "w")
