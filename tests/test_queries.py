"""Each query with a DuckDB statement has the same columns and rows as that."""

import hashlib
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graniteql import plans
from graniteql.session import TABLES

from .conftest import SMALL


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list | tuple):
        return tuple(map(canonical, v))
    return v.item() if hasattr(v, "item") else str(v) if type(v).__name__ in ("datetime", "date", "Timestamp") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canonical(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_equals_duckdb(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL)
    cursor = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hashes_of_all_languages(spark):
    want = {r["doc_id"]: hashlib.md5(r["text"].lower().encode()).hexdigest() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: r["h"] for r in plans.QUERIES["f1_md5_all"](spark, SMALL).collect()} == want


def test_containment_decides(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {r["doc_id"] for r in docs if r["lang"] in r["text"]}
    assert 0 < len(want) < len(docs)
    assert {r["doc_id"] for r in plans.QUERIES["pf4_contains_columns"](spark, SMALL).collect()} == want


def test_whole_texts_go_to_python_in_small_batches(spark):
    """3,000 texts of 10,000 characters: no batch holds more than a few of them, for both queries that send texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        for q in ("u1_vectorised_scalar", "t6_html_text"):
            spark.conf.unset(name)
            plans.QUERIES[q](spark, SMALL)
            rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
            assert rows.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long").agg(F.max("n")).first()[0] < 100
        spark.conf.set(name, "1m")
        plans.QUERIES["u1_vectorised_scalar"](spark, SMALL)
        assert spark.conf.get(name) == "1m"  # what someone has set stays
    finally:
        spark.conf.unset(name)
