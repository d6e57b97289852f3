"""Search for any number of patterns in texts, by an index of their rarest word grams.

Words that a pattern holds whole, with blanks on both sides, are whole words of any text that contains it, in the same order.
So GRAM of them in a row are an anchor: texts' word grams are joined with the grams of all patterns, and of a pattern's grams
the one with the fewest hits decides; a pattern with a gram that no text has is done with. What remains is looked at as text.
A pattern with one or two whole words is anchored by one word. A pattern without any is anchored by all words of the texts
that contain its longest run: those are found in the vocabulary, by an index of character grams, not in the texts.

Nothing is collected: patterns, grams, hits and candidates are tables, and Spark broadcasts a side only where it is small.
Texts are read once for each length of gram that the patterns need, and once to look at the candidates.

Defined cases: nulls contain nothing and are in nothing; rows that repeat an identifier, and repeated rows, give pairs of
their own; identical patterns are searched once; an empty pattern is in every text that is not null, and one of blanks alone
is compared with every text, as most texts have it or lack it whatever the index; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteql.operators.near import shingle, starts
from graniteql.shared import spread, written

#: Words of an anchor; characters of the vocabulary's grams.
GRAM, LETTERS = 3, 4
_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_WHOLE = f"(?<={_BLANK}){_WORD}(?={_BLANK})"


def containing(texts: DataFrame, patterns: DataFrame, text_id: str, pattern_id: str, text: str = "text") -> DataFrame:
    """Pairs of text and pattern where the text contains the pattern."""
    docs = spread(texts.select(F.col(text_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null"))
    docs = docs.withColumn("print", F.xxhash64("text"))
    items = patterns.select(F.col(pattern_id).alias("item"), F.col(text).cast("string").alias("pattern")).where("pattern is not null")
    wanted = written(items.select("pattern").distinct().withColumn("n", F.monotonically_increasing_id()), "patterns")
    named = wanted.select("n", F.regexp_extract_all("pattern", F.lit(_WHOLE), F.lit(0)).alias("w"), F.regexp_extract_all("pattern", F.lit(_WORD), F.lit(0)).alias("all"))
    kinds = {r[0] for r in named.select(_kind()).distinct().collect()}  # four at most
    found = []
    if "gram" in kinds:
        found.append(_anchored(docs, _grams(named.where(_kind() == "gram"), GRAM), GRAM))
    one = [_grams(named.where(_kind() == "word"), 1)] if "word" in kinds else []
    if "part" in kinds:
        one.append(_expanded(docs, named.where(_kind() == "part")))
    for index in one:
        found.append(_anchored(docs, index, 1))
    pairs = None
    for candidates in found:
        # a text meets each of its candidates once, a repeated row as often as it is there
        near = candidates.join(wanted, "n").select(F.col("id").alias("of"), F.col("print").alias("of_print"), "pattern")
        here = docs.join(near, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print"))).where(F.contains("text", "pattern")).select("id", "pattern")
        pairs = here if pairs is None else pairs.unionByName(here)
    if "blank" in kinds:
        blanks = wanted.join(named.where(_kind() == "blank").select("n"), "n").select("pattern")
        everywhere = docs.select("id", "text").join(blanks, F.contains("text", "pattern")).select("id", "pattern")
        pairs = everywhere if pairs is None else pairs.unionByName(everywhere)
    if pairs is None:
        pairs = docs.limit(0).select("id", F.lit("").alias("pattern"))
    return pairs.join(items, "pattern").select(F.col("id").alias(text_id), F.col("item").alias(pattern_id))


def _kind() -> Column:
    return F.when(F.size("w") >= GRAM, "gram").when(F.size("w") > 0, "word").when(F.size("all") > 0, "part").otherwise("blank")


def _grams(named: DataFrame, k: int) -> DataFrame:
    """n, gram: each of these grams alone anchors the pattern."""
    at = named.select("n", "w", F.explode(starts(F.col("w"), k)).alias("i"))
    return at.select("n", shingle(F.col("w"), F.col("i"), k).alias("gram")).distinct().withColumn("all", F.lit(False))


def _expanded(docs: DataFrame, named: DataFrame) -> DataFrame:
    """n, gram: the words of the texts that contain a pattern's longest run; any of them may be where the pattern is."""
    runs = named.select("n", F.array_max(F.transform("all", lambda w: F.struct(F.length(w).alias("size"), w.alias("run"))))["run"].alias("run"))
    runs = written(runs.withColumn("size", F.least(F.length("run"), F.lit(LETTERS))).withColumn("letters", F.left("run", F.col("size"))), "runs")
    words = written(docs.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word")).distinct(), "words")
    sizes = runs.select("size").distinct()  # LETTERS at most
    cut = words.join(F.broadcast(sizes), F.length("word") >= F.col("size")).select("word", "size", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)).alias("i"))
    cut = cut.select("word", "size", F.substr("word", F.col("i"), F.col("size")).alias("letters")).distinct()
    met = cut.join(runs, ["size", "letters"]).where(F.contains("word", "run"))
    return met.select("n", F.xxhash64("word").alias("gram")).distinct().withColumn("all", F.lit(True))


def _anchored(docs: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """n, id, print: the texts that have a pattern's rarest gram, or, where `all`, any of its grams."""
    index = written(index, "grams")
    words = docs.select("id", "print", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("w"))
    grams = words.select("id", "print", "w", F.explode(starts(F.col("w"), k)).alias("i")).select("id", "print", shingle(F.col("w"), F.col("i"), k).alias("gram"))
    hits = written(grams.join(index.select("gram").distinct(), "gram", "left_semi"), "hits")
    counts = hits.groupBy("gram").agg(F.count("*").alias("hits"))
    held = index.join(counts, "gram", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    rarest = held.where("not all").groupBy("n").agg(F.min(F.struct("hits", "gram")).alias("r")).where("r.hits > 0").select("n", F.col("r.gram").alias("gram"))
    return hits.join(rarest.unionByName(held.where("all and hits > 0").select("n", "gram")), "gram").select("n", "id", "print").distinct()
