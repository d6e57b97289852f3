"""The registered queries of the training-data operators; each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graniteql.llm import ann, bpe, conversation_repair, conversation_trie, jaccard, license_scan, mixing, oracles, quality, secret_scan, sstable, syncmer, toxicity, url_reputation
from graniteql.llm.common import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, codec).drop("text")


@query("op3_sstable")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        encoder = sstable.LibraryEncoder(f.read())
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), encoder, 2, sstable.new_folder(spark))
    return sstable.read_shards(spark, shards)


@query("op7_mixture")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op8_syncmers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.compared(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predictions(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predictions(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


@query("op5_one_bit_codes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


#: The rules of the query: verdict, host, start of the path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@query("op6_host_reputation", oracles.HOST_REPUTATION)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_reputation.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op9_ngram_join", oracles.NGRAM_JOIN)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.summary(docs, license_scan.fitted(docs))


@query("op11_conversation_repair", oracles.CONVERSATION_REPAIR)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


@query("op12_conversation_trie", oracles.CONVERSATION_TRIE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(table(spark, sf_dir, "conversations"))


@query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(table(spark, sf_dir, "documents"))
