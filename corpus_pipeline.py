"""The corpus pipeline: rejects toxic and poor documents, keeps one of each group of near copies, mixes the sources to
their target weights and turns the texts into token ids. Each stage takes what the one before it kept, written as
Parquet and read again; all but the last return the columns of documents.

Defined cases, for all stages: a null text is an empty one; empty and very long texts are scored, kept or dropped as
any other; rows that repeat an identifier or have none are documents of their own; ties are broken by identifier, then by
a hash of the text; without usable labels the filters score every text alike, by the share of label 1, 0.5 without any
label; an empty table gives an empty result; extra columns are kept, whatever their names, but for those of the last
stage's results, which are replaced.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graniteql.llm import bpe, jaccard, mixing, quality, toxicity
from graniteql.llm.common import fresh_path, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Labels of documents that are not held out train it; without
    both labels none or all go, as the share of label 1 has it."""
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.5 go; without both labels all stay if half of the labels or more are 1, or if
    there is none."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest identifier (those without come last):
    five-word shingles, a similarity of 0.8 or more. Texts without words are near copies of nothing; of rows without words
    that are alike in identifier and text one stays."""
    return jaccard.kept(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks for: not at all, once, or up to three times, shard by shard of
    the splitting tree and in each shard's local order. Documents without words come once; those without source are a
    source of their own."""
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts, and whether decoding gives the text back. An empty text has no ids."""
    return bpe.tokenized(docs, bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("toxicity", toxic), ("quality", poor), ("near copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: Trained models and a hashed draw: no SQL statement has these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
