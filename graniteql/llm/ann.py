"""Operator 5: nearest neighbours by randomly rotated one-bit codes.

`index` gives every distinct vector a code: its difference from a centroid, made a unit vector, is turned at random, and
the sign of each dimension is one bit, packed into 64-bit words. Two correction scalars belong to a code: the length of
the difference, and the inner product of the unit vector with its own code. A query is turned the same way and rounded
to four bits a dimension; its inner product with a code is then four ANDs and counts of bits a word. From that and the
scalars the inner product with the vector follows without bias, with an error of a known size.

`search` takes two passes over codes alone. Queries and codes meet in tiles of a bounded size. The first pass gives each
query the vectors of the largest estimates; their exact scores give a bound that the k nearest reach. The second pass
keeps, as a list for each query and tile, the candidates whose estimate plus SURE times its error reaches that bound. A
join then brings the vectors that are in any of a tile's lists, and exact scores decide: a tile gives k rows for each
query, never its pairs. How rows are dealt over tiles has no part in the result.

Copies are one distinct vector: it is coded, searched for and compared once, and of its identifiers the k + 1 smallest
are kept, as no more can be among anyone's k nearest. The centroid is the mean of at most SAMPLE vectors; all vectors
are indexed. The search is exhaustive over codes, so its work grows with queries times distinct vectors; a tile reads 24
bytes and the code of each candidate, a sixteenth of its vector at 64 dimensions.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length is not the most frequent one (the smaller of two such). A row is a candidate of every query but itself, so rows
that repeat an identifier are candidates each, and queries each; rows without identifier are candidates, last in ties.
Ties go to the smaller identifier; very long vectors have longer codes; an empty table gives no rows. Other columns take
no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteql.llm.common import forget, ship, some, written

SURE, SAMPLE, PLANES, FIRST = 1.6, 4096, 4, 3
#: Most queries and candidates in a tile; tiles of one block of candidates whose vectors come together; pairs that are
#: compared at once.
QUERIES, CANDIDATES, TOGETHER, AT_ONCE = 1024, 16_384, 4, 1 << 18


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vector: the rows that take part."""
    v = F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where("vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["d"] if sizes else 0))


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random map with orthonormal columns from d dimensions to the next multiple of 64."""
    wide = -(-d // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, d)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones as rows of 64-bit words."""
    return np.packbits(bits, axis=1).view(np.uint64)


def encoded(x: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits as words, lengths and corrections."""
    r = x - center
    length = np.sqrt((r * r).sum(1))
    o = (r / np.where(length > 0, length, 1)[:, None]) @ turn.T
    own = np.abs(o).sum(1) / math.sqrt(turn.shape[0])
    return _words(o >= 0), length, np.where(length > 0, own, 1.0)


class Asked:
    """Queries, turned and rounded to PLANES bits a dimension."""

    def __init__(self, q: np.ndarray, center: np.ndarray, turn: np.ndarray):
        turned = q @ turn.T
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_words(level >> i & 1) for i in range(PLANES)]
        self.sum = self.step * level.sum(1) + turned.shape[1] * self.low
        self.offset, self.square, self.wide = q @ center, (q * q).sum(1), turned.shape[1]

    def estimates(self, at: slice, codes: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some of the queries (rows) with all codes (columns): inner products, and the size of their errors."""
        both = np.zeros((len(self.low[at]), len(codes)), np.int32)
        for w in range(codes.shape[1]):
            for i, plane in enumerate(self.planes):
                both += np.left_shift(np.bitwise_count(plane[at, w, None] & codes[None, :, w]), i, dtype=np.int32)
        small = lambda x: x.astype(np.float32)  # noqa: E731  estimates need no more
        ones, scale = np.bitwise_count(codes).sum(1, dtype=np.int32), small(length / own)
        per_row, per_column = (2 * small(self.step[at, None]), small(self.sum[at, None])), small(length / own / math.sqrt(self.wide))
        guess = both * per_row[0] + (2 * small(self.low[at, None]) * small(ones) - per_row[1])
        guess *= per_column
        guess += small(self.offset[at, None])
        error = small((1 - np.minimum(own, 1) ** 2) / max(1, self.wide - 1)) * small(self.square[at, None])
        error += small(self.step[at, None] ** 2 / 12)
        return guess, np.sqrt(error, out=error) * scale


def index(vectors: DataFrame, k: int = 20, seed: int = 11) -> tuple[DataFrame, np.ndarray]:
    """number, vector, ids (the k + 1 smallest), code, length, correction of each distinct usable vector, written; and
    the centroid."""
    spark = vectors.sparkSession
    ship(spark)
    place = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last()))
    few = usable(vectors).withColumn("place", place).where(F.col("place") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"])
    rows = written(few.groupBy("vector").agg(ids.alias("ids")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    drawn = some(rows, "vector", SAMPLE).select("vector").collect()
    center = np.mean([r[0] for r in drawn], 0) if drawn else np.zeros(0)
    shared = spark.sparkContext.broadcast((center, rotation(len(center), seed) if drawn else None))

    def code(batches):
        middle, turn = shared.value
        for batch in batches:
            if batch.num_rows:
                bits, length, own = encoded(_matrix(batch.column(1)), middle, turn)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(own)], names=["number", "vector", "ids", "code", "length", "correction"])

    made = rows.select("number", "vector", "ids").mapInArrow(code, "number long, vector array<double>, ids array<long>, code binary, length double, correction double")
    out = written(made, "codes")
    forget(rows)
    return out, center


def _block(number: str | Column, salt: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(number, F.lit(salt)), F.lit(blocks)).cast("int")


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


class Tiles:
    """Queries (number, vector) and codes in tiles qb, cb."""

    def __init__(self, asked: DataFrame, made: DataFrame, center: np.ndarray, seed: int):
        self.asked, self.made = asked, made
        self.q_blocks, self.c_blocks = (max(1, math.ceil(x.count() / size)) for x, size in ((asked, QUERIES), (made, CANDIDATES)))
        spark = made.sparkSession
        self.shared = spark.sparkContext.broadcast((center, rotation(len(center), seed) if len(center) else None))

    def _queries(self, columns: list[str]) -> DataFrame:
        return self.asked.select(_block("number", 1, self.q_blocks).alias("qb"), _each(self.c_blocks).alias("cb"), "number", "vector", *[c for c in columns if c != "qb"])

    def met(self, choose, columns: list[str], schema: str) -> DataFrame:
        """What choose gives of each tile, from the queries' and codes' numbers, the queries' other columns, how many
        queries to take at once, and a function that gives estimates and errors of some queries."""
        codes = self.made.select(_each(self.q_blocks).alias("qb"), _block("number", 2, self.c_blocks).alias("cb"), "number", "code", "length", "correction")
        shared = self.shared

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):
                return choose(None, None, None, None)
            asked = Asked(_matrix(left.column("vector")), *shared.value)
            bits = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint64).reshape(right.num_rows, -1)
            length, own = right.column("length").to_numpy(), right.column("correction").to_numpy()
            numbers = [t.column("number").to_numpy() for t in (left, right)]
            return choose(numbers, [left.column(c).to_numpy() for c in columns], max(1, AT_ONCE // right.num_rows), lambda at: asked.estimates(at, bits, length, own))

        return self._queries(columns).groupBy("qb", "cb").cogroup(codes.groupBy("qb", "cb")).applyInArrow(meet, schema)

    def top(self, m: int) -> DataFrame:
        """query, number: the m codes of the largest estimates of each query; ties go to the smaller number."""

        def choose(numbers, _, step, estimates) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for low in range(0, len(numbers[0]) if numbers else 0, step):
                guess = estimates(slice(low, low + step))[0]
                for q, row in zip(numbers[0][low : low + step], guess, strict=True):
                    best = np.flatnonzero(row >= np.partition(row, -m)[-m]) if len(row) > m else np.arange(len(row))
                    best = best[np.lexsort((numbers[1][best], -row[best]))[:m]]
                    out.append((np.full(len(best), q), numbers[1][best], row[best]))
            return pa.table(dict(zip(("query", "number", "guess"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        found = self.met(choose, [], "query long, number long, guess double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("guess"), "number"))
        return found.withColumn("place", place).where(F.col("place") <= m).select("query", "number")

    def near(self, bounds: DataFrame, sure: float) -> DataFrame:
        """query, numbers: of each query and tile the candidates whose estimate plus `sure` times its error reaches the
        query's bound; and a row without query with all that are in any of the tile's lists."""

        def choose(numbers, columns, step, estimates) -> pa.Table:
            out = []
            for low in range(0, len(numbers[0]) if numbers else 0, step):
                at = slice(low, low + step)
                guess, error = estimates(at)
                near = guess + sure * error + 1e-5 * (1 + np.abs(guess)) >= columns[0][at, None].astype(np.float32)
                out += [(q, numbers[1][row]) for q, row in zip(numbers[0][at].tolist(), near, strict=True) if row.any()]
            if out:
                out.append((None, np.unique(np.concatenate([x[1] for x in out]))))
            ends = np.cumsum([0, *(len(x[1]) for x in out)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in out)])))
            qb = columns[1][:1].tolist() if numbers else [0]
            return pa.table({"qb": pa.array(qb * len(out), pa.int32()), "query": pa.array([x[0] for x in out], pa.int64()), "numbers": lists.cast(pa.list_(pa.int64()))})

        asked = self.asked
        self.asked = asked.join(bounds, asked["number"] == bounds["query"]).drop("query")
        found = self.met(choose, ["bound", "qb"], "qb int, query long, numbers array<long>")
        self.asked = asked
        tq = F.floor(F.col("qb") / TOGETHER).cast("int").alias("tq")
        return found.select(tq, _block(F.get("numbers", F.lit(0)), 2, self.c_blocks).alias("cb"), "query", "numbers")

    def exact(self, lists: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
        """query, number, score: the exact scores of lists (cb, query, numbers), of each query and block of candidates
        the k best. wanted: cb, tq and number of the vectors that any list names."""
        lists = lists.select(self.together("query"), "cb", "query", "numbers")
        theirs = wanted.select("tq", "cb", "number").distinct().join(self.made.select("number", "vector"), "number").select("tq", "cb", F.lit(0).alias("side"), "number", "vector")
        asked = lists.select("tq", "cb", F.col("query").alias("number")).distinct().join(self.asked.select("number", "vector"), "number").select("tq", "cb", F.lit(1).alias("side"), "number", "vector")

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if left.num_rows and right.num_rows:
                side, numbers, x = right.column("side").to_numpy(), right.column("number").to_numpy(), _matrix(right.column("vector"))
                sides = []
                for s in (1, 0):
                    own = np.flatnonzero(side == s)
                    sides.append(own[np.argsort(numbers[own])])
                for q, names in zip(left.column("query").to_pylist(), left.column("numbers"), strict=True):
                    names = names.values.to_numpy()
                    a = sides[0][np.searchsorted(numbers[sides[0]], q)]
                    rows = sides[1][np.searchsorted(numbers[sides[1]], names)]
                    got = x[rows] @ x[a]
                    if len(got) > 4 * k:  # exact order only among the best
                        keep = got >= np.partition(got, -k)[-k] - 1e-9 * np.abs(got).max()
                        rows, names = rows[keep], names[keep]
                    exact = np.einsum("ij,j->i", x[rows], x[a])
                    best = np.lexsort((names, -exact))[:k]
                    out.append((np.full(len(best), q), names[best], exact[best]))
            return pa.table(dict(zip(("query", "number", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        both = theirs.unionByName(asked).toDF("their_tq", "their_cb", "side", "number", "vector")
        found = lists.groupBy("tq", "cb").cogroup(both.groupBy("their_tq", "their_cb")).applyInArrow(score, "query long, number long, score double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "number"))
        return found.withColumn("place", place).where(F.col("place") <= k).drop("place")

    def together(self, query: str) -> Column:
        return F.floor(_block(query, 1, self.q_blocks) / TOGETHER).cast("int").alias("tq")


def search(vectors: DataFrame, k: int = 20, every: int = 20, seed: int = 11, sure: float = SURE, figures: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose identifier `every` divides, among all others, by
    inner product. figures, if given, gets the numbers of queries, codes and reranked pairs."""
    made, center = index(vectors, k, seed)
    rows = usable(vectors).where(F.col("vec_id") % every == 0).join(made.select("vector", "number"), "vector").select("vec_id", "number")
    rows = written(rows, "queries")
    asked = written(rows.select("number").distinct().join(made.select("number", "vector"), "number"), "asked")
    tiles = Tiles(asked, made, center, seed)
    first = written(tiles.top(FIRST * (k + 1)).select("query", "number", tiles.together("query"), _block("number", 2, tiles.c_blocks).alias("cb")), "first")
    few = first.groupBy("query", "cb").agg(F.collect_list("number").alias("numbers"))  # FIRST * (k + 1) of a query
    n = made.select("number", F.size("ids").alias("n"))
    best = written(tiles.exact(few, first, FIRST * (k + 1)), "best")
    # the bound: the score up to which k + 1 identifiers are counted; without so many, all pairs are kept
    so_far = Window.partitionBy("query").orderBy(F.desc("score"), "number").rowsBetween(Window.unboundedPreceding, 0)
    counted = best.join(n, "number").withColumn("so_far", F.sum("n").over(so_far))
    bounds = counted.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("so_far") >= k + 1, F.col("score"))), F.lit(float("-inf"))).alias("bound"))
    pairs = written(tiles.near(bounds, sure), "pairs")
    if figures is not None:
        figures |= {"queries": asked.count(), "codes": made.count(), "pairs": pairs.where("query is not null").agg(F.sum(F.size("numbers"))).first()[0]}
    wanted = pairs.where("query is null").select("tq", "cb", F.explode("numbers").alias("number"))
    found = tiles.exact(pairs.where("query is not null"), wanted, k + 1).unionByName(best.select("query", "number", "score")).groupBy("query", "number").agg(F.max("score").alias("score"))
    item = F.struct((-F.col("score")).alias("less"), F.coalesce("vec_id", F.lit(2**63 - 1)).alias("at"), "vec_id", "number")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "number"))
    listed = found.join(made.select("number", "ids"), "number").select("query", "number", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("found"))  # k + 1 of a query
    own = rows.withColumnRenamed("vec_id", "query_id").join(listed, rows["number"] == listed["query"]).drop("query")
    itself = F.array_min(F.transform("found", lambda x, i: F.when((x["number"] == F.col("number")) & x["vec_id"].eqNullSafe(F.col("query_id")), i)))
    others = F.slice(F.filter("found", lambda x, i: i != F.coalesce(F.col("itself"), F.lit(-1))), 1, k)
    out = own.withColumn("itself", itself).select("query_id", F.posexplode(others).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
