"""Operator 8: document fingerprints from closed syncmers, with DataFrame functions only.

A text's units are its words; of a word of over UNIT characters, as in scripts without blanks, each character is a unit of
its own, so that units never depend on where a word began. A k-mer is K consecutive units, its inner substrings are the S consecutive units inside it, ordered by their hashes. A k-mer is a
closed syncmer if its smallest inner substring is the first or the last one. Whether a k-mer is chosen depends on the
k-mer alone, not on what stands around it; so an edit changes the anchors that it touches and no others.

`anchors` gives all of them with their positions, and the fingerprint lists them all in the text's order. `links` match
positions: a link is two anchors that follow one another and the units between them, so that it survives a shift, and two
texts have it in common only where both anchors moved together. `likeness` is the share of common distinct links,
2 |A and B| / (|A| + |B|); `shared` is the share of common anchors with every occurrence counted; `displacement` is the
shift in units at which most common anchors agree. None of them is an estimate.

Defined cases: a null text is an empty one; an empty text has no anchor and the fingerprint '', and likeness is 1 to
another such text and 0 to any other; a text of fewer than K units has one anchor, the whole; an anchor that is alone is
its own link; positions from 2^24 - 1 on are stored as that, and links count from there on as if without gaps. Equal texts
have equal fingerprints. Rows that repeat an identifier or have none are documents of their own, in the order of a hash
of their texts, then of the texts, and those without come last; an empty table gives no rows; columns other than doc_id
and text take no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteql.llm.common import about_chars

UNIT, K, S = 24, 4, 2
#: About how many characters a range of documents has, and most ranges.
RANGE_CHARS, MOST_RANGES = 32_000_000, 50_000
_POS = 24
_TOP = (1 << _POS) - 1


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable is evaluated before its body, a column inside a
    lambda's body again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def anchors(text: Column) -> Column:
    """Closed syncmers in order: longs, the hash's upper 40 bits above 24 bits of position."""
    letter = r"[^\x20\x09-\x0D]"
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<!{letter}){letter}{{1,{UNIT}}}+(?!{letter})|{letter}"), F.lit(0))

    def packed(h: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(h, _POS), _POS).bitwiseOR(F.least(i, F.lit(_TOP)).cast("long"))

    def of_inner(inner: Column) -> Column:
        n = F.size(inner) - (K - S)  # k-mers
        edge = lambda a, i: F.least(a, F.get(inner, i + (K - S))) <= F.get(inner, i + 1)  # noqa: E731  K - S is 2: one inner substring is not at an edge
        return F.filter(F.transform(F.slice(inner, 1, n), lambda a, i: F.when(edge(a, i), packed(F.xxhash64(a, F.get(inner, i + (K - S))), i))), lambda x: x.isNotNull())

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        inner = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        whole = F.when(n > 0, F.array(packed(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= K, _bound(inner, of_inner)).otherwise(whole)

    return _bound(F.transform(units, lambda u: F.xxhash64(u)), of_hashes)


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, _POS)


def _seen(s: Column, i: Column) -> Column:
    """Whether the hash at place i of sorted anchors is that of the place before; false for the first one."""
    return (i > 0) & (_hash(F.get(s, i)) == _hash(F.get(s, F.greatest(i - 1, F.lit(0)))))


def in_order(text: Column) -> Column:
    """All anchors by hash, then by position."""
    return F.sort_array(anchors(text))


def distinct(ordered: Column) -> Column:
    """Of anchors in order, each hash at its first position."""
    return F.filter(ordered, lambda x, i: ~_seen(ordered, i))


def made(text: Column) -> Column:
    """anchors (by position) and links of a text."""
    return _bound(anchors(text), lambda z: F.struct(z.alias("anchors"), links(z).alias("links")))


def sketch(text: Column) -> Column:
    """The distinct anchors by hash, each at its first position."""
    return _bound(in_order(text), distinct)


def as_text(made: Column) -> Column:
    """Anchors as text: the hash in hexadecimal digits, a dot, the position; separated by spaces."""
    return F.array_join(F.transform(made, lambda x: F.concat(F.hex(_hash(x)), F.lit("."), x.bitwiseAND(_long(_TOP)).cast("string"))), " ")


def fingerprint(text: Column) -> Column:
    return as_text(anchors(text))


def _share(both: Column, a: Column, b: Column) -> Column:
    """both common ones of two arrays as a share; two empty arrays are alike."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2 * both.cast("double") / n)


def links(anchors: Column) -> Column:
    """Of anchors by position: a hash of each anchor, the one after it and the units between; of an anchor alone, its own."""

    def linked(z: Column) -> Column:
        at = lambda x: x.bitwiseAND(_long(_TOP))
        n = F.size(z)
        pairs = F.zip_with(F.slice(z, 1, F.greatest(n - 1, F.lit(0))), F.slice(z, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.xxhash64(_hash(x), _hash(y), at(y) - at(x)))
        return F.when(n == 1, F.transform(z, _hash)).otherwise(F.array_distinct(pairs))

    return _bound(anchors, linked)


def likeness(a: Column, b: Column) -> Column:
    """The share of common links of two texts."""
    return _share(F.size(F.array_intersect(a, b)), a, b)


def shared(a: Column, b: Column) -> Column:
    """The share of common anchors of two texts' anchors (by hash or by position), each counted as often as both texts
    have it."""
    tagged = lambda s, tag: F.transform(s, lambda x: F.shiftleft(_hash(x), 1).bitwiseOR(_long(tag)))

    def step(at: Column, x: Column) -> Column:
        h, same = F.shiftright(x, 1), F.shiftright(x, 1) == at["h"]
        first, pair = x.bitwiseAND(_long(1)) == 0, same & (at["open"] > 0)
        left = F.when(first, F.when(same, at["open"] + 1).otherwise(1)).when(pair, at["open"] - 1).otherwise(0)
        return F.struct(h.alias("h"), left.alias("open"), F.when(~first & pair, at["both"] + 1).otherwise(at["both"]).alias("both"))

    # by hash, a's before b's: each of b's closes one of a's that is open
    start = F.struct(_long(-1).alias("h"), F.lit(0).alias("open"), F.lit(0).alias("both"))
    return _share(F.aggregate(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), start, step, lambda at: at["both"]), a, b)


def displacement(a: Column, b: Column) -> Column:
    """Positional matching: b's position less a's, for common anchors of two sketches the most frequent one; null if
    none is common."""
    placed = lambda s, tag: F.transform(s, lambda x: F.struct(_hash(x).alias("h"), F.lit(tag).alias("tag"), x.bitwiseAND(_long(_TOP)).alias("at")))

    def shifts(z: Column) -> Column:  # an anchor of b comes right after a's, if a has it
        before = lambda i: F.get(z, i - 1)
        return F.filter(F.transform(z, lambda x, i: F.when((x["tag"] == 1) & (before(i)["h"] == x["h"]), x["at"] - before(i)["at"])), lambda v: v.isNotNull())

    def most(d: Column) -> Column:  # d ascends; the longest run, then the smallest shift
        starts = F.filter(F.transform(d, lambda v, i: F.when((i == 0) | (F.get(d, F.greatest(i - 1, F.lit(0))) != v), i)), lambda i: i.isNotNull())
        runs = lambda s: F.transform(s, lambda i, k: F.struct(i - F.coalesce(F.get(s, k + 1), F.size(d)), F.abs(F.get(d, i)), F.get(d, i).alias("v")))
        return F.array_min(_bound(starts, runs))["v"]

    found = _bound(F.sort_array(F.concat(placed(a, 0), placed(b, 1))), lambda z: F.sort_array(shifts(z)))
    return _bound(found, most)


def range_index(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below a value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    held, n = F.array(*map(_long, bounds)), len(bounds)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) < value), at + step).otherwise(at))
    return F.coalesce(F.when(value.isNotNull(), found), F.lit(0))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds made, next_text and next_made: the next document's by descending doc_id, after the last one the first's.

    Documents are dealt by quantiles of doc_id, and a window looks ahead inside each range. The first document of each
    range is also sent to the range before it, where it comes last. Anchors, nearly as large as the text, are taken after
    the texts are dealt. The driver holds a few numbers for each range."""
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set((docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * ranges))).first()[0] or []) if at else []))
    docs = docs.withColumn("range", range_index(F.col("doc_id"), bounds))
    tops = {r["range"]: r["top"] for r in docs.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    filled = sorted(tops, reverse=True)
    to = {r: filled[i - 1] for i, r in enumerate(filled)}  # the range that needs r's first document; for the first range the last one
    top = F.array(*(F.lit(tops.get(r)).cast("long") for r in range(len(bounds) + 1)))
    sent = F.array(*(F.lit(to.get(r, r)) for r in range(len(bounds) + 1)))
    copy = lambda r, c: F.struct(r.alias("range"), F.lit(c).alias("copy"))
    place = F.when(F.col("doc_id").eqNullSafe(F.get(top, F.col("range"))), F.array(copy(F.col("range"), 0), copy(F.get(sent, F.col("range")), 1))).otherwise(F.array(copy(F.col("range"), 0)))
    docs = docs.withColumn("place", F.explode(place)).withColumn("range", F.col("place.range")).withColumn("copy", F.col("place.copy")).drop("place")
    docs = docs.repartition(ranges, "range").withColumn("made", made(F.col("text")))
    ahead = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return docs.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_made", F.lead("made").over(ahead)).filter("copy = 0").drop("copy", "range")


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's; see the query op8."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not ranges:
        wanted = math.ceil(about_chars(docs) / RANGE_CHARS)
        ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, MOST_RANGES))
    docs = with_next(docs, ranges)
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "made", "next_made", edited.alias("edited"))
    docs = docs.select("doc_id", "n_chars", "made", "next_made", F.sha2("edited", 256).alias("edited_sha256"), made(F.col("edited")).alias("edited_made"))
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("made.anchors")).alias("fingerprint"),
        as_text(F.col("edited_made.anchors")).alias("edited_fingerprint"),
        likeness(F.col("made.links"), F.col("edited_made.links")).alias("near_edited"),
        likeness(F.col("made.links"), F.col("next_made.links")).alias("near_next"),
    )
