"""Near duplicates by one-permutation MinHash and locality-sensitive hashing, in JVM functions.

Each word shingle of a text is hashed once; the upper bits of the hash deal it to one of BANDS times ROWS bins, and a bin's
least hash is one place of the signature. A bin that a short text leaves empty borrows from the bin of that text which comes
first in an order of its own (densification): two texts that are alike borrow alike. Shingles are exploded and their minima
are aggregates that Spark compiles and combines before the shuffle, so 64 rows at most leave for each text and copies of a
text, grouped by a digest, are one.

Texts that agree in all rows of a band meet in a bucket. In a bucket each text is compared with the smallest and with the one
before it, by exact similarity, so that a bucket gives two pairs for each text however large it
is. The smallest are found by an aggregate; the one before is looked for in a bucket's part of 2^SPAN class numbers, so that no
bucket is one task. Links are joined to components. Two texts of similarity s share a bucket with probability
1 - (1 - s^ROWS)^BANDS, 0.9998 at 0.8; a link between texts that are not neighbours in any bucket is found only through
others. The similarity join of the training-data operators is exact instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteql.operators import graph
from graniteql.shared import forget, spread, written

BANDS, ROWS = 16, 4
BINS = BANDS * ROWS
#: Bits of a class number that a bucket's part spans.
SPAN = 12
WORD = r"[^\x20\x09-\x0D]+"
_BIN_BITS = BINS.bit_length() - 1


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """A text's words, split at white space, A-Z lower-cased."""
    return F.regexp_extract_all(_lower(text), F.lit(WORD), F.lit(0))


def starts(w: Column, n: int) -> Column:
    """Places of the n-word shingles of words, from 0; fewer words are one shingle, none are none."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle(w: Column, i: Column, n: int) -> Column:
    """The hash of the shingle at a place; what lies beyond the last word does not count."""
    return F.xxhash64(*(F.get(w, i + k) for k in range(n)))


def shingles(text: Column, n: int) -> Column:
    """Hashes of the distinct n-word shingles of a text."""
    return F.element_at(F.transform(F.array(words(text)), lambda w: F.array_distinct(F.transform(starts(w, n), lambda i: shingle(w, i, n)))), 1)


def signatures(rows: DataFrame, n: int) -> DataFrame:
    """name, band: a hash for each band of the signatures of words (name, w)."""
    hashed = rows.select("name", "w", F.explode(starts(F.col("w"), n)).alias("i")).select("name", shingle(F.col("w"), F.col("i"), n).alias("item"))
    least = hashed.groupBy("name", F.shiftrightunsigned("item", 64 - _BIN_BITS).cast("int").alias("bin")).agg(F.min("item").alias("item"))
    full = least.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("bin", "item"))).alias("full"))  # BINS at most

    def borrowed(b: Column) -> Column:
        order = F.transform(F.map_keys("full"), lambda other: F.struct(F.xxhash64(other, b).alias("turn"), other.alias("bin")))
        return F.element_at("full", F.array_min(order)["bin"])

    places = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("full", b), borrowed(b)))
    placed = full.select("name", places.alias("p"))
    return placed.select("name", F.explode(F.array(*(F.xxhash64(F.lit(b), *(F.get("p", F.lit(b * ROWS + r)) for r in range(ROWS))) for b in range(BANDS)))).alias("band"))


def candidates(keys: DataFrame) -> DataFrame:
    """Pairs a > b of classes that share a band (class, band): each with the bucket's smallest, and with the one before it."""
    least = graph.by_other_key(keys, "band", lambda x: x.agg(F.min("class").alias("least"), F.count("*").alias("n"))).where("n > 1").select("band", "least")
    met = keys.join(least, "band").where("class > least")
    order = Window.partitionBy("band", F.shiftright("class", SPAN)).orderBy("class")  # 2^SPAN rows at most
    met = met.withColumn("before", F.lag("class").over(order))
    return met.select(F.col("class").alias("a"), F.explode(F.array_compact(F.array("before", "least"))).alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: the smallest identifier that near duplicates lead to. Nulls and texts without words are
    near nothing; rows without identifier do not count; rows that repeat an identifier are texts of their own."""
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null"))
    # never null: joins would look for nulls, before texts are dealt
    name = F.coalesce(F.unhex(F.sha2(_lower(F.col("text")), 256)), F.lit(b""))
    ids = written(texts.select("doc_id", F.when(F.rlike("text", F.lit(WORD)), name).alias("name")), "ids")
    first = ids.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    first = written(first.withColumn("class", F.monotonically_increasing_id()), "classes")
    bands = signatures(texts.select(name.alias("name"), words(F.col("text")).alias("w")), n)
    keys = written(bands.join(first, "name").select("class", "band"), "bands")
    pairs = written(candidates(keys), "pairs")
    wanted = first.join(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "class", "left_semi")
    again = texts.join(wanted, "doc_id").where(F.coalesce(name == F.col("name"), F.lit(False)))  # a plain equality would be a key, worked out for all texts
    sets = again.dropDuplicates(["class"]).select("class", shingles(F.col("text"), n).alias("items"))
    sets = written(sets, "sets")
    left, right = (sets.select(F.col("class").alias(k), F.col("items").alias(f"{k}_items")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    links = both.where(common / (F.size("a_items") + F.size("b_items") - common) >= similarity).select("a", "b")
    parts = graph.components(links)
    classes = first.join(parts, first["class"] == parts["node"], "left").select("name", "doc_id", F.coalesce("component", "class").alias("component"))
    classes = written(classes, "components")
    smallest = graph.by_other_key(classes, "component", lambda x: x.agg(F.min("doc_id").alias("component_id")))
    linked = ids.where("name is not null").join(classes.select("name", "component").join(smallest, "component"), "name").select("doc_id", "component_id")
    for table in (keys, pairs, sets):
        forget(table)
    return linked.unionByName(ids.where("name is null").select("doc_id", F.col("doc_id").alias("component_id")))
