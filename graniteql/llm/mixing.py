"""Operator 7: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents, in the order of a hash, form one stream of words; the stream is cut into blocks of equally many
words. A source whose target is e whole passes and a rest has a quota of e times its blocks and, for the rest, so many
more. The tree starts with all sources' quotas and splits them again and again between two halves of the output shards,
each time by a draw without replacement (multivariate hypergeometric), until a leaf holds one shard's quota of every
source. A shard draws the blocks of a range of each source's pseudo-random permutation, and the leaves' ranges follow
one another; so no block is drawn twice in a pass, a block beyond all leaves is drawn by none, and every document finds
its own blocks' shards by arithmetic alone. The pieces then go to their shards, are shuffled there (the order of a hash)
and written. What the mix takes of a document is summed up from the written shards.

The driver holds a row for each source and a quota for each shard and source; shards have SHARD_WORDS words. Positions
in the stream are sums over two levels, hash ranges and rows within a range, with the square root of the source's rows
at either level; so a source with a third of all rows is spread over many tasks, as are rows without identifier (the
hash takes the text in). Quotas of more blocks than the sampler takes are drawn in strata, each of which is a tree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0; repeated rows are documents of their own (many rows alike in id and text lie in one range); a very long text
has as many pieces as blocks; ties of the hash go by identifier and size; an empty table gives an empty result. Extra
columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteql.llm.common import forget, plainly, ship, written

#: Words in a block; most blocks that the sampler takes at once; most times that a word may be taken.
BLOCK_WORDS, MOST_BLOCKS, MOST_TIMES = 64, 500_000_000, 3
#: Words of a shard, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 64_000_000, 64
SPACES = " \t\n\x0b\x0c\r"


def words_in(text: Column) -> Column:
    """The number of words: each word and the blanks after it become one letter, and letters are counted."""
    inner = F.ltrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.length(F.regexp_replace(inner, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words; salt: a hash of text and source."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("salt"))


def targets(totals: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, Fraction]:
    """Each source's words: by weight, at most MOST_TIMES its size, the excess dealt again by weight."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    found: dict[str | None, Fraction] = {}
    left, rest = Fraction(sum(totals.values())), list(order)
    while rest:
        scale = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * scale > MOST_TIMES * totals[s]]
        if not over:
            return found | {s: weight[s] * scale for s in rest}
        for s in over:
            found[s] = Fraction(MOST_TIMES * totals[s])
            left -= found[s]
        rest = [s for s in rest if s not in found]
    return found


def split(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """Each shard's exact share of every source's quota: rows are shards, and a column sums to its quota."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(share: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = share
            return
        mid = (low + high) // 2
        total = int(share.sum())
        sample = (total * (mid - low) + (high - low) // 2) // (high - low)
        rng = np.random.Generator(np.random.PCG64([seed, low, high, i]))
        left = rng.multivariate_hypergeometric(share, sample, method="marginals") if total else share
        down(left, low, mid)
        down(share - left, mid, high)

    quotas = np.asarray(quotas, np.int64)
    strata = max(1, -(-int(quotas.sum()) // MOST_BLOCKS))
    total = np.zeros_like(out)
    for i in range(strata):
        down(quotas // strata + (i < quotas % strata), 0, shards)
        total += out
    return total


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..n-1, for each element its own n and key: a Feistel network over the next even number
    of bits, walked until it falls inside."""
    x, n, key = (np.asarray(v, np.uint64).copy() for v in np.broadcast_arrays(x, n, key))
    if not len(x):
        return x.astype(np.int64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(v, half, mask, key):
        a, b = v >> half, v & mask
        for r in range(4):
            m = b * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(0xBF58476D1CE4E5B9 * (r + 1) & (2**64 - 1))
            m ^= m >> np.uint64(29)
            m *= np.uint64(0x94D049BB133111EB)
            m ^= m >> np.uint64(32)
            a, b = b, a ^ (m & mask)
        return a << half | b

    out = once(x, half, mask, key)
    while len(i := np.flatnonzero(out >= n)):
        out[i] = once(out[i], half[i], mask[i], key[i])
    return out.astype(np.int64)


@dataclass
class Plan:
    """What the driver knows of each source, by its number."""

    words: np.ndarray  # of the source
    passes: np.ndarray  # whole passes
    full: np.ndarray  # blocks that are whole
    cut: np.ndarray  # words of the block after the quota
    ends: np.ndarray  # by shard and source: where a shard's range of the permuted blocks of all passes ends
    seed: int

    def drawn(self, s: np.ndarray, p: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that the mix takes of blocks at these places of a pass's permutation, and the shard that draws each;
        the shard is -1 for what no leaf of the tree holds: the source's last block, which is not whole, and the one
        that is cut where the quota ends."""
        rank, quota = p * self.full[s] + place, self.ends[-1][s]
        whole = place < self.full[s]
        held = whole & (rank < quota)
        rest = np.where(whole, BLOCK_WORDS, self.words[s] - self.full[s] * BLOCK_WORDS)
        last = (p == self.passes[s]) & (rank == quota)
        length = np.where(held, BLOCK_WORDS, np.where(last, np.minimum(self.cut[s], rest), np.where(~whole & (p < self.passes[s]), rest, 0)))
        shard = np.full(len(s), -1)
        for k in np.unique(s[held]):
            own = held & (s == k)
            shard[own] = np.searchsorted(self.ends[:, k], rank[own], "right")
        return length, shard

    def pieces(self, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        """Of documents at these places in their streams: row, pass, first word, words, shard, order of each piece."""
        parts = []
        for p in range(MOST_TIMES + 1):
            rows = np.flatnonzero((size > 0) & (p <= self.passes[source]))
            if not len(rows):
                continue
            first, last = start[rows] // BLOCK_WORDS, (start[rows] + size[rows] - 1) // BLOCK_WORDS
            n = last - first + 1
            row = np.repeat(rows, n)
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            s = source[row]
            whole = block < self.full[s]
            key = (s.astype(np.uint64) * np.uint64(64) + np.uint64(p)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(self.seed)
            place = np.where(whole, permuted(np.where(whole, block, 0), np.maximum(self.full[s], 1), key), self.full[s])
            length, shard = self.drawn(s, p, place)
            low = np.maximum(start[row], block * BLOCK_WORDS)
            high = np.minimum(start[row] + size[row], block * BLOCK_WORDS + length)
            order = permuted(block, np.full(len(block), 1 << 40), key)
            shard = np.where(shard < 0, order % len(self.ends), shard)
            keep = high > low
            found = {"row": row, "pass": np.full(len(row), p), "first": low - start[row], "words": high - low, "shard": shard, "order": order}
            parts.append({k: v[keep] for k, v in found.items()})
        return {k: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in ("row", "pass", "first", "words", "shard", "order")}

    def whole(self, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        """The same for whole documents: the stream, which is in the order of a hash, is the permutation, and a document
        goes with the word in its middle. row, shard, order."""
        parts = []
        middle = start + size // 2
        for p in range(MOST_TIMES + 1):
            rows = np.flatnonzero((size > 0) & (p <= self.passes[source]))
            s, place = source[rows], middle[rows] // BLOCK_WORDS
            length, shard = self.drawn(s, p, place)
            keep = middle[rows] - place * BLOCK_WORDS < length
            key = (s.astype(np.uint64) * np.uint64(64) + np.uint64(p)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(self.seed)
            order = permuted(start[rows] % (1 << 40), np.full(len(rows), 1 << 40), key)
            parts.append({"row": rows[keep], "shard": np.where(shard < 0, order % len(self.ends), shard)[keep], "order": order[keep]})
        return {k: np.concatenate([x[k] for x in parts]) for k in ("row", "shard", "order")}


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, seed: int = 7) -> tuple[Plan, list[tuple]]:
    """The plan, and a row for each source: source, number, size, target, documents with words."""
    found = {r["source"]: (int(r["words"] or 0), r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("n")).collect()}
    order = sorted(found, key=lambda s: (s is None, s or ""))
    target = targets({s: found[s][0] for s in found}, weights)
    words = np.array([found[s][0] for s in order], np.int64)
    goal = np.array([round(target[s]) for s in order], np.int64)
    passes = np.where(words > 0, goal // np.maximum(words, 1), 0)
    need = goal - passes * words
    full = words // BLOCK_WORDS
    quota = np.minimum(need // BLOCK_WORDS, full)
    shards = shards or max(LEAST_SHARDS, -(-int(goal.sum()) // SHARD_WORDS))
    tree = split(passes * full + quota, shards, seed)
    return Plan(words, passes, full, need - quota * BLOCK_WORDS, np.cumsum(tree, 0), seed), [(s, i, int(words[i]), float(target[s]), found[s][1]) for i, s in enumerate(order)]


def placed(sized: DataFrame, sources: list[tuple], seed: int = 7) -> DataFrame:
    """Adds number, source_size, target, and start: the words of the source before the document; -1 for a document
    without words, which is nowhere."""
    spark = sized.sparkSession
    known = F.broadcast(spark.createDataFrame(sources, "source_ string, number int, source_size long, target double, n long"))  # the driver has them
    h = F.xxhash64("doc_id", "salt", F.lit(seed))
    ranges = F.ceil(F.sqrt("n"))
    rows = sized.join(known, sized["source"].eqNullSafe(known["source_"])).select("doc_id", "salt", "size", "number", "source_size", "target", h.alias("h"), F.floor(F.pmod(F.shiftrightunsigned(h, 16), F.lit(1 << 40)) * ranges / (1 << 40)).cast("long").alias("range"))
    nowhere = rows.where("size = 0").withColumn("start", F.lit(-1).cast("long")).drop("h", "range")
    rows = rows.where("size > 0")
    sums = rows.groupBy("number", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("number", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, ["number", "range"]).withColumn("start", F.col("before") + F.col("within")).drop("within", "before", "h", "range")
    return rows.unionByName(nowhere)


def _columns(batch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in ("number", "start", "size")]


def _planned(docs: DataFrame, weights: tuple[int, ...], shards: int | None, seed: int):
    """The documents at their places, written, and the plan as a broadcast."""
    ship(docs.sparkSession)
    own = written(sizes(docs), "sizes")
    made, sources = plan(own, weights, shards, seed)
    at = written(placed(own, sources, seed), "placed")
    forget(own)
    return at, docs.sparkSession.sparkContext.broadcast(made)


def pieces(at: DataFrame, shared) -> DataFrame:
    """number, start, doc_id, pass, first_word, words, shard, order: a row for each piece of a document in the mix."""

    def draw(batches):
        for batch in batches:
            x = shared.value.pieces(*_columns(batch))
            rows = pa.array(x["row"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in ("number", "start", "doc_id")), *(pa.array(x[k].astype(np.int64)) for k in ("pass", "first", "words", "shard", "order"))], names=["number", "start", "doc_id", "pass", "first_word", "words", "shard", "order"])

    return at.where("size > 0").select("number", "start", "size", "doc_id").mapInArrow(draw, "number int, start long, doc_id long, pass long, first_word long, words long, shard long, order long")


def shuffled(mix: DataFrame, *ties: str) -> DataFrame:
    """Brings each shard's rows together, in their local order."""
    return mix.repartitionByRange("shard", "order", *ties).sortWithinPartitions("shard", "order", *ties)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, seed: int = 7) -> DataFrame:
    """The mix, shard by shard: a row for each piece of a document: doc_id, pass, first_word, words, shard, order."""
    at, shared = _planned(docs, weights, shards, seed)
    return shuffled(pieces(at, shared), "number", "start", "first_word").drop("number", "start")


def taken(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many of a document's words the written shards of the mix have,
    repeats counted."""
    at, shared = _planned(docs, weights, shards, seed)
    mix = written(shuffled(pieces(at, shared), "number", "start", "first_word"), "mix")
    sums = mix.groupBy("number", "start").agg(F.sum("words").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    out = at.where("size > 0").join(sums, ["number", "start"], "left").select(columns)
    return out.unionByName(at.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def resampled(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, seed: int = 7) -> DataFrame:
    """The mix in whole documents, with their columns, shard by shard in each shard's local order: a document is drawn
    with the word in its middle, so that a source's words miss its target by one document at most. Rows alike in
    identifier, text and source come equally often; rows without words come once, in the first shard."""
    docs, names = plainly(docs, "doc_id", "text", "source")
    at, shared = _planned(docs, weights, shards, seed)

    def draw(batches):
        for batch in batches:
            x = shared.value.whole(*_columns(batch))
            order = np.argsort(x["row"], kind="stable")
            ends = np.searchsorted(x["row"][order], np.arange(batch.num_rows + 1))
            places = pa.StructArray.from_arrays([pa.array(x[k][order].astype(np.int64)) for k in ("shard", "order")], ["shard", "order"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "salt")), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places)], names=["__doc", "__salt", "__places"])

    first = at.where("size > 0").groupBy("doc_id", "salt").agg(F.min(F.struct("start", "number", "size")).alias("at")).select("doc_id", "salt", "at.*")
    drawn = first.mapInArrow(draw, "__doc long, __salt long, __places array<struct<shard:long,order:long>>")
    once = F.array(F.struct(F.lit(0).cast("long").alias("shard"), F.xxhash64("doc_id").alias("order")))
    drawn = drawn.unionByName(at.where("size = 0").select(F.col("doc_id").alias("__doc"), F.col("salt").alias("__salt"), once.alias("__places")).dropDuplicates(["__doc", "__salt"]))
    rows = docs.withColumn("__key", F.xxhash64("text", "source"))
    rows = rows.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["__doc"]) & (F.col("__key") == drawn["__salt"]))
    rows = rows.withColumn("__place", F.explode("__places")).withColumn("__shard", F.col("__place.shard")).withColumn("__order", F.col("__place.order"))
    return rows.repartitionByRange("__shard", "__order").sortWithinPartitions("__shard", "__order").select(docs.columns).toDF(*names)
