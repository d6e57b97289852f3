"""The pipeline's stages on the small tables, each against what its operator says of its own input."""

import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from graniteql.llm import bpe, quality, toxicity

from ..conftest import SMALL
from .test_copies import brute


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_registered():
    assert "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near copies", "mixture", "tokens"]


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns and df.schema.simpleString() == steps[0].schema.simpleString()


def test_filters_follow_their_scores(spark, steps):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for before, after, module, keeps in ((steps[0], steps[1], toxicity, lambda s: s < 0.7), (steps[1], steps[2], quality, lambda s: s >= 0.5)):
        scores = module.scored(before, module.fitted(before, labels)).collect()
        assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in scores if keeps(r["score"]))
        assert after.exceptAll(before).count() == 0
    assert steps[2].count() < steps[0].count()


def test_one_of_each_group_stays(steps):
    groups = brute([(r["doc_id"], r["text"]) for r in steps[2].collect()], 5, 80)
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_mixture_is_whole_documents(steps):
    before = {r["doc_id"]: r for r in steps[3].collect()}
    times = {}
    for r in steps[4].collect():
        assert r == before[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3


def test_tokens_decode_to_the_texts(steps):
    codec = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert b"".join(codec.ready().bytes_of[i] for i in r["ids"]).decode() == text[r["doc_id"]]


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in steps[5].collect())


def test_odd_input_goes_through(spark, odd, empty, odd_rows, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, an empty table; no labels, then some."""
    labels = [("none", []), ("some", [(3, 1, 0), (4, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (-3, 1, 0)])]
    for name, rows in labels:
        for kind, docs in (("odd", odd), ("empty", empty)):
            d = str(tmp_path / f"{name}-{kind}")
            docs.write.parquet(f"{d}/documents.parquet")
            spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
            got = corpus_pipeline.run(spark, d).collect()
            assert all(r["round_trip"] for r in got)
            if kind == "empty":
                assert got == []
            elif name == "none":  # all are scored 0.5: none is toxic, none is poor
                kept = {(r["doc_id"], r["source"]) for r in got}
                assert {(2, "a"), (1, "a"), (7, "b")} <= kept and (6, "b") not in kept  # 6 is a copy of 5
                assert kept <= {(r[0], r[3]) for r in odd_rows}


def test_repeated_identifiers_are_documents(spark, tmp_path):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 1), (2, texts[1] + " end", "en", "s", 1), (None, texts[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2])])
    mixed = corpus_pipeline.mixture(spark, kept, str(tmp_path))
    assert {r["text"] for r in mixed.collect()} == set(texts)


def test_extra_columns_of_any_name_go_through(spark, odd, tmp_path):
    """Columns named like those inside the operators, names with dots, a struct and a map: all are kept, with their values."""
    from pyspark.sql import functions as F

    inside = "__id __none __print __first __places __key __doc __salt __place __shard __order __toxicity __quality row class name size number start order c0 c1 a.b".split()
    docs = odd.drop("score", "size", "ids", "item", "range")
    whole = F.xxhash64("doc_id", "text", "source")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), whole.cast("string")) for c in inside} | {"some struct": F.struct(F.col("n_chars").alias("__id"), F.lit("x").alias("text")), "some map": F.create_map(F.lit("k"), F.col("n_chars"))})
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    names = [c for c in docs.columns if c not in ("text",)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        assert after.columns == docs.columns if i < 4 else after.columns == [*names, "n_tokens", "ids", "round_trip"]
        docs = after
    rows = docs.collect()
    assert len(rows) > 3
    for r in rows:
        values = {r[c].removeprefix(f"{c}:") for c in inside}
        assert len(values) == 1 and r["some struct"]["__id"] == r["n_chars"] and r["some map"] == {"k": r["n_chars"]}
