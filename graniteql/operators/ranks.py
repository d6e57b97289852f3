"""Row numbers, ranks and their shares over partitions of any size: no task holds a partition's rows.

Rows are range-partitioned by key and order, so that a key with a third of all rows is cut into as many ranges as it
needs; within a range a row's place is known from the order of the rows alone. What comes before a range is the sum of
the counts of the key's earlier ranges, a table with one row for each key and range. Rows that tie are told apart by a
hash of the row and its place in the input, so that a value that very many rows share is cut as well.

Defined cases: a null key is a key; a null sorts first, or last where the order is descending; rows that tie in all of
the order are numbered by a hash of their columns (maps take no part in it), rows that are alike in everything in any
order; an empty table gives an empty result; columns may have any names, those of the results are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteql.shared import written

_INDEX_BITS = 33  # of monotonically_increasing_id: the lower bits count rows, the upper ones are the partition


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(c: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def placed(df: DataFrame, by: list[str], order: list[str], desc: tuple[str, ...] = (), place: str = "place", piece: str = "piece", parts: int | None = None) -> DataFrame:
    """df in the order of key and order, written, with each row's place (growing in that order) and its range, the piece.
    parts: number of ranges; else as many as the session's shuffle partitions, fewer if the data are small."""
    tie, at = unused(df, "tie", "at")
    plain = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = df.withColumns({tie: F.xxhash64(*plain) if plain else F.lit(0), at: F.monotonically_increasing_id()})
    keys = [*map(quoted, by), *(quoted(c).desc() if c in desc else quoted(c).asc() for c in order), F.col(tie), F.col(at)]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    numbers = dealt.sortWithinPartitions(*keys).drop(tie, at).withColumn(place, F.monotonically_increasing_id())
    return written(numbers.withColumn(piece, F.shiftright(place, _INDEX_BITS)), "placed")


def numbered(df: DataFrame, by: list[str], order: list[str], desc: tuple[str, ...] = (), name: str = "row_number", size: str | None = None, parts: int | None = None) -> DataFrame:
    """df with each row's number (from 1) in its key's order, and the number of the key's rows as `size`, if named."""
    df = df.drop(name, *([size] if size else []))
    place, piece, start, n, before, total = unused(df, "place", "piece", "start", "n", "before", "total")
    rows = placed(df, by, order, desc, place, piece, parts)
    others = unused(rows, *(f"of_{c}" for c in by))
    runs = rows.groupBy(*map(quoted, by), piece).agg(F.min(place).alias(start), F.count("*").alias(n))
    runs = runs.select(*(quoted(c).alias(o) for c, o in zip(by, others, strict=True)), F.col(piece).alias("in_piece"), start, n)
    key = Window.partitionBy(*map(quoted, others))  # a row for each range that has the key
    runs = runs.withColumns({before: F.coalesce(F.sum(n).over(key.orderBy("in_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), total: F.sum(n).over(key)})
    same = reduce(and_, (quoted(c).eqNullSafe(quoted(o)) for c, o in zip(by, others, strict=True)), F.col(piece) == F.col("in_piece"))
    out = rows.join(runs, same).withColumn(name, F.col(place) - F.col(start) + 1 + F.col(before))
    return out.select(*map(quoted, df.columns), name, *([F.col(total).alias(size)] if size else []))


def ranked(df: DataFrame, by: list[str], order: list[str], desc: tuple[str, ...] = (), name: str = "row_number", rank: str = "rank", last: str = "last", size: str = "size", parts: int | None = None) -> DataFrame:
    """df with row number, rank, the last row number of those that tie with the row, and the key's number of rows."""
    df = df.drop(name, rank, last, size)
    rows = written(numbered(df, by, order, desc, name, size, parts), "numbered")
    others = unused(rows, rank, last, *(f"tied_{c}" for c in (*by, *order)))[2:]
    ties = rows.groupBy(*(quoted(c).alias(o) for c, o in zip((*by, *order), others, strict=True))).agg(F.min(name).alias(rank), F.max(name).alias(last))
    same = reduce(and_, (quoted(c).eqNullSafe(quoted(o)) for c, o in zip((*by, *order), others, strict=True)))
    return rows.join(ties, same).select(*map(quoted, df.columns), name, rank, last, size)


def tile(number: Column, size: Column, k: int) -> Column:
    """SQL's ntile(k) of a row number and the number of rows: the first tiles have one row more than the others."""
    least, more = F.floor(size / k), size % k
    head = more * (least + 1)
    return F.when(number <= head, F.floor((number - 1) / (least + 1)) + 1).otherwise(more + F.floor((number - head - 1) / F.greatest(least, F.lit(1))) + 1)


def percent_rank(rank: Column, size: Column) -> Column:
    """SQL's percent_rank; 0 in a partition of one row."""
    return F.when(size > 1, (rank - 1) / (size - 1)).otherwise(F.lit(0.0))


def cume_dist(last: Column, size: Column) -> Column:
    """SQL's cume_dist."""
    return last / size
