"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteql.llm.common import some

#: At most so many documents of either class, and characters of all, enter a fit.
PER_CLASS, CHARS = 2000, 12_000_000


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def eligible(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of what may be learned from: one row for each identifier, without those held out, those with both
    labels, and rows without identifier or label."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")


def shift(labels: DataFrame, label: str, rows: list[tuple[str, int]]) -> float:
    """What to add to a model's log-odds, as the sample has more of the rarer class than the labels have."""
    n = {r["label"]: r["count"] for r in eligible(labels, label).groupBy("label").count().collect()}
    ones = sum(y for _, y in rows)
    odds = lambda a, b: math.log((a + 1) / (b + 1))
    return odds(n.get(1, 0), n.get(0, 0)) - odds(ones, len(rows) - ones)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, chars: int = CHARS) -> list[tuple[str, int]]:
    """(text, label) of documents that are not held out, the first ones by a hash of their id. Rows without id or
    label do not count, nor do ids with both labels; the first of a repeated id's texts counts. Whole texts enter,
    until the next one would exceed the bound on characters."""
    labels, ids = eligible(labels, label), []
    for c in (0, 1):
        ids += some(labels.where(F.col("label") == c), "doc_id", per_class).select("doc_id", "label").collect()
    if not ids:
        return []
    spark, texts = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = spark.createDataFrame([(r["doc_id"], r["label"]) for r in ids], "doc_id long, label int")  # 2 * per_class rows at most
    long = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n")).collect()
    keep, total = [], 0
    for r in sorted(long, key=lambda r: (hash((r["doc_id"], 1)), r["doc_id"], r["n"])):
        if total + r["n"] <= chars:
            keep.append(r["doc_id"])
            total += r["n"]
    chosen = spark.createDataFrame([(i,) for i in sorted(set(keep))], "doc_id long")
    found = {r["doc_id"]: r["text"] for r in texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()}
    label_of = {r["doc_id"]: r["label"] for r in ids}
    return [(found[i], label_of[i]) for i in sorted(found)]
