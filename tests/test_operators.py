"""Operators on small tables: nulls, ties, empty input."""

import datetime as dt
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graniteql.functions import bitmaps, sketches, text, vectors
from graniteql import plans
from graniteql.operators import buckets, graph, joins, near, ranking, search
from graniteql.sources import formats
from graniteql.streaming import events

from .conftest import MIDDLE, SMALL


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def test_asof_takes_the_last_not_after(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(1)), (3, "b", at(9)), (4, None, at(9)), (5, "a", at(7))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(5), 10), ("a", at(5), 11), ("a", at(6), None), ("b", at(10), 12)], "k string, t timestamp, v int")
    got = {r["id"]: (r["right_t"], r["right_v"]) for r in joins.asof(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {1: (at(5), 11), 2: (None, None), 3: (None, None), 4: (None, None), 5: (at(6), None)}


def test_asof_by_parts_is_asof(spark):
    rows = [(i, None if i % 7 == 0 else "abc"[i % 3], at(i * 37 % 400)) for i in range(150)]
    left = spark.createDataFrame(rows, "id int, k string, t timestamp")
    right = spark.createDataFrame([(k, t, i) for i, k, t in rows[::4]], "k string, t timestamp, v int")
    plain, parts = (sorted(map(tuple, joins.asof(left, right, ["k"], "t", ["v"], part=p).collect()), key=str) for p in (None, F.date_trunc("hour", F.col("t"))))
    assert plain == parts and any(r[-1] is not None for r in plain)
    assert joins.asof(left, right.limit(0), ["k"], "t", ["v"], part=F.date_trunc("hour", F.col("t"))).where("right_v is null").count() == 150


def test_asof_nulls_meet_nothing(spark):
    left = spark.createDataFrame([(1, "a", None), (2, None, at(5)), (3, "a", at(5)), (4, "b", at(5))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", None, 1), (None, at(1), 2), ("b", at(2), 3)], "k string, t timestamp, v int")
    for part in (None, F.date_trunc("hour", F.col("t"))):
        assert {r["id"]: r["right_v"] for r in joins.asof(left, right, ["k"], "t", ["v"], part=part).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_pandas_asof_makes_no_pairs(spark, tmp_path):
    """A user with 4,000 purchases and 4,000 views would make 8 million pairs and more."""
    spark.range(8000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS ts", "7L AS user_id", "if(id % 2 = 0, 'view', 'purchase') AS event_type", "if(id = 4, null, id / 1D) AS value").write.parquet(f"{tmp_path}/events.parquet")
    out = plans.QUERIES["j10_pandas_asof"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
    assert {r["event_id"]: r["seen"] for r in out.collect()} == {i: None if i == 5 else i - 1.0 for i in range(1, 8000, 2)}


def test_asof_with_an_empty_side(spark):
    left = spark.createDataFrame([(1, "a", at(5))], "id int, k string, t timestamp")
    right = spark.createDataFrame([], "k string, t timestamp, v int")
    assert [tuple(r) for r in joins.asof(left, right, ["k"], "t", ["v"]).collect()] == [(1, "a", at(5), None, None)]
    assert joins.asof(left.limit(0), right, ["k"], "t", ["v"]).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=20), st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 30)), max_size=10))
def test_range_join_is_the_nested_loop(spark, points, ranges):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "i int, x int")
    r = spark.createDataFrame([(j, a, a + n) for j, (a, n) in enumerate(ranges)], "j int, a int, b int")
    got = sorted((x["i"], x["j"]) for x in joins.in_range(p, r, F.col("x"), F.col("a"), F.col("b"), 10).collect())
    assert got == sorted((i, j) for i, x in enumerate(points) for j, (a, n) in enumerate(ranges) if a <= x <= a + n)


def test_salted_join_is_the_join(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1)], "k int, v int")
    small = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "k int, w string")
    assert sorted(map(tuple, joins.salted(big, small, "k", 4).select("k", "v", "w").collect())) == sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))


def test_top_k_and_first(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9), (None, 4)], "g string, v int")
    assert sorted((r["g"] or "", r["v"]) for r in ranking.top_k(df, ["g"], [F.col("v")], 2).collect()) == [("", 4), ("a", 1), ("a", 2), ("b", 9)]
    assert sorted((r["key"] or "", r["v"], r["copies"]) for r in ranking.first_of_each(df, F.col("g"), "v").collect()) == [("", 4, 1), ("a", 1, 3), ("b", 9, 1)]


def test_containing(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, None), (3, ""), (4, "xbcy"), (4, "xbcy"), (None, "abc")], "d long, text string")
    items = spark.createDataFrame([(7, "abc"), (8, "bc"), (9, "bc"), (10, None)], "i long, text string")
    want = [(1, 7), (1, 8), (1, 9), (4, 8), (4, 8), (4, 9), (4, 9), (None, 7), (None, 8), (None, 9)]
    assert sorted(map(tuple, search.containing(docs, items, "d", "i").collect()), key=str) == sorted(want, key=str)
    assert search.containing(docs, items.limit(0), "d", "i").count() == search.containing(docs.limit(0), items, "d", "i").count() == 0


WORDS = st.lists(st.sampled_from(["a", "ab", "b", "ba", "aba", " ", "  ", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6), st.lists(WORDS, min_size=1, max_size=12))
def test_containing_is_all_pairs(spark, texts, patterns):
    """With patterns of every kind: grams, single words, parts of words, blanks, nothing."""
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    items = spark.createDataFrame(list(enumerate(patterns)), "i long, text string")
    got = sorted(map(tuple, search.containing(docs, items, "d", "i").collect()))
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if p in t)


def test_a_hundred_thousand_patterns(spark):
    """Parts of the texts, cut anywhere, among very many patterns that share common words with them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    cut = [(i, r["text"][7 * i % max(1, len(r["text"])) :][: 40 + i]) for i, r in enumerate(rows)]
    many = spark.range(100_000).selectExpr("id + 1000 as item_id", "concat('of the in no. ', id, ' and the ', id * 7 % 1000, ' with it') as text")
    items = spark.createDataFrame(cut, "item_id long, text string").unionByName(many)
    got = sorted(map(tuple, search.containing(docs, items, "doc_id", "item_id").collect()))
    assert got == sorted((r["doc_id"], i) for i, t in cut for r in rows if t in r["text"])


def test_vectors_and_text(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.inner_product(a, b), vectors.norm(a), vectors.cosine(a, b), vectors.l2_distance(a, b)).collect()
    assert tuple(got[0]) == (50.0, 5.0, 1.0, 5.0) and got[1][2] is None
    t = spark.createDataFrame([("Ärger an a@b.co", "ab")], "t string, s string")
    r = t.select(text.mask_email(F.col("t")), text.char_grams(F.col("s"), 3), text.char_grams(F.col("t"), 2)).first()
    assert r[0] == "Ärger an <email>" and r[1] == [] and r[2][0] == "Är"
    assert t.select(text.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).first()[0] == pytest.approx(1 / 3)


def test_count_min_is_the_library_and_never_low(spark):
    """Each estimate is the one that Spark's own reader gives, for keys of all sizes; none is too low."""
    keys = [0, 1, -1, 7, 2**31, -(2**31), 2**32 - 1, 2**62 + 12345, -(2**63), 2**63 - 1, *range(100, 160)]
    rows = spark.createDataFrame([(k,) for i, k in enumerate(keys) for _ in range(1 + i % 5)] + [(None,)], "k long")
    ask = spark.createDataFrame([(k,) for k in [*keys, 424242, None]], "k long")
    made = rows.agg(F.count_min_sketch("k", F.lit(0.05), F.lit(0.9), F.lit(3))).first()[0]
    library = spark._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(made)
    got = {r["k"]: r["estimate"] for r in sketches.count_min(rows, "k", ask, 0.05, 0.9, 3).collect()}
    assert got == {k: library.estimateCount(spark._jvm.java.lang.Long(k)) for k in [*keys, 424242]} | {None: None}
    assert all(got[k] >= 1 + i % 5 for i, k in enumerate(keys))
    assert sketches.count_min(rows.limit(0), "k", ask, 0.05, 0.9, 3).where("estimate > 0").count() == 0


def test_count_min_error(spark):
    rows = spark.range(20000).selectExpr("id % 3000 as k")
    out = sketches.count_min(rows, "k", rows.distinct(), 0.001, 0.99, 5)
    off = out.selectExpr("count_if(estimate < 6) low", "count_if(estimate > 7 + 20) high", "count(*) n").first()
    assert off["low"] == 0 and off["high"] <= 0.01 * off["n"] and off["n"] == 3000


def test_count_min_keys_do_not_carry_the_sketch(spark):
    """Rows that meet the keys are small, however large the sketch is: 100,000 keys and a sketch of 1.1 MB; repeated keys stay."""
    rows = spark.range(50_000).selectExpr("id % 500 as k")
    keys = spark.range(100_000).selectExpr("id % 50000 as k")
    out = sketches.count_min(rows, "k", keys, 0.0001, 0.99, 1)
    assert "binary" not in {kind for _, kind in out.dtypes} and "count_min_sketch" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(out.selectExpr("count(*)", "count_if(k < 500 and estimate < 100)", "count_if(estimate > 105)").first()) == (100_000, 0, 0)


def test_bucketed_join_without_shuffle(spark):
    """Nine tenths of the rows have one key; nulls on both sides."""
    left = spark.createDataFrame([(1 if i % 10 else i, i) for i in range(2000)] + [(None, -1)], "a long, v int")
    right = spark.createDataFrame([(i, f"w{i}") for i in range(0, 2000, 3)] + [(1, "one"), (None, "none")], "b long, w string")
    assert buckets.largest_bucket(left, "a", 6) > 0.85 and buckets.largest_bucket(left.limit(0), "a", 6) == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = buckets.bucketed(left, "a", 6).join(buckets.bucketed(right, "b", 6), F.col("a") == F.col("b"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = left.join(right, F.col("a") == F.col("b"))
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1800
        whole = plan_of(spark, "j6_bucketed")
        assert "SortMergeJoin" in whole and "hashpartitioning(l_orderkey" not in whole and "hashpartitioning(o_orderkey" not in whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert buckets.bucketed(left.limit(0), "a", 6).count() == 0


def test_distinct_counts_by_bitmaps(spark):
    rows = [("a", i % 70000, -i) for i in range(3000)] + [("a", 10**12, None), ("b", None, None), (None, 5, -40000), (None, 5, 7), ("a", 40000, 40000)]
    df = spark.createDataFrame(rows, "g string, x long, y int").repartition(4)
    got = sorted(map(tuple, bitmaps.distinct_counts(df, ["g"], {"x": "xs", "y": "ys"}).collect()), key=str)
    assert got == sorted(map(tuple, df.groupBy("g").agg(F.count_distinct("x"), F.count_distinct("y"), F.count("*")).collect()), key=str)
    levels = sorted(map(tuple, bitmaps.rollup_counts(df, ["g"], "x", "xs").select("g", "xs", "n", "level").collect()), key=str)
    assert levels == sorted([*((r[0], r[1], r[3], 1) for r in got), (None, 3002, len(rows), 0)], key=str)
    assert bitmaps.distinct_counts(df.limit(0), ["g"], {"x": "xs"}).count() == 0
    assert "Expand" not in plan_of(spark, "a2_multi_distinct") and "Expand" not in plan_of(spark, "a2_distinct_rollup")


def test_exact_sums(spark):
    from graniteql.plans import relational

    rows = spark.createDataFrame([(90071992547.01,), (0.29,), (-12.35,), (None,)], "x double")
    got = rows.agg(relational.exact_sum(relational.hundredths("x"), "decimal(28,2)", 2).alias("s"), F.sum(F.col("x").cast("decimal(18,2)")).alias("d")).first()
    assert got["s"] == got["d"]


def plan_of(spark, name):
    return plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_plans_are_the_ones_meant(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(spark, "j6_sort_merge") and "ShuffledHashJoin" in plan_of(spark, "j6_shuffle_hash")
        assert "BroadcastHashJoin" in plan_of(spark, "j5_broadcast_hash")
        assert "WindowGroupLimit" in plan_of(spark, "s3_top_k_per_group") and "TakeOrderedAndProject" in plan_of(spark, "s2_top_k")
        for name in ("j7_range_without_key", "j8_interval", "j9_asof", "j9_asof_by_time"):
            plan = plan_of(spark, name)
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    assert "NestedLoop" in plan_of(spark, "j7_non_equi")  # nation has 25 rows at any scale
    scan = next(x for x in plans.QUERIES["pf2_filter"](spark, SMALL)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(l_shipdate" in scan and "In(l_returnflag" in scan
    assert "l_extendedprice" not in plan_of(spark, "pf2_filter")


def test_revenue_by_nation_filters_at_runtime(spark):
    """Where lines are shuffled, a Bloom filter of the orders that are left cuts them down before that. The thresholds, of
    gigabytes, are set down here."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = plan_of(spark, "j1_revenue_by_nation")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "might_contain" in plan and "NestedLoop" not in plan
    assert "left_semi" in plan.lower() or "LeftSemi" in plan


def test_sample_is_a_part_of_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    drawn, again = (sorted(map(tuple, plans.QUERIES["pf6_sample"](spark, SMALL).collect())) for _ in range(2))
    assert drawn == again
    left = Counter(map(tuple, rows.collect()))
    assert abs(len(drawn) - 0.1 * left.total()) < 5 * (0.09 * left.total()) ** 0.5
    assert not Counter(drawn) - left


def test_near_duplicates_on_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    near_ones = [" ".join([*base[:i], "x", *base[i:]]) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(near_ones)] + [(20, " ".join(base)), (21, " ".join(base).upper()), (22, None), (23, ""), (24, "a b"), (25, "A  b"), (26, "b a"), (None, " ".join(base)), (27, " ".join(base[::-1]))]
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys([*range(8), 20, 21], 0) | {22: 22, 23: 23, 24: 24, 25: 24, 26: 26, 27: 27}
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_recall(spark):
    """Against all pairs at sf0.01."""
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(rows).collect()}
    sets = {}
    for r in rows.collect():
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    by_size, pairs = sorted(sets, key=lambda i: len(sets[i])), []
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if 0.8 * len(sets[j]) > len(sets[i]):
                break
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
    assert len(pairs) > 50 and sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)


def test_near_duplicates_in_a_hot_bucket(spark, monkeypatch):
    """Buckets whose parts span two class numbers, short texts with mostly empty bins, rows that repeat an identifier."""
    monkeypatch.setattr(near, "SPAN", 1)
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(100, 160)] + [(7, "one two three four five six"), (7, " ".join([*base, "x7"]))]
    got = sorted((r["doc_id"], r["component_id"]) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, 7), (7, 7), *((i, 7) for i in range(100, 160))]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(31), 0) | dict.fromkeys(range(100, 140), 100)


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from graniteql import shared

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_written_leaves_settings_as_they_were(spark):
    from graniteql import shared

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    out = shared.written(spark.range(100).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert out.count() == 7 and spark.conf.get(key, None) == before
    shared.forget(out)


def test_formats(spark):
    assert formats.available(spark, "parquet") and not formats.available(spark, "avro")


def test_late_rows_are_dropped(spark):
    """Without late rows every closed window counts all its events; with them the earlier windows are missing."""
    got = {r["start"]: r["n"] for r in events.late(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    late = rows.where(F.col("event_id") > middle).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).count()
    want = {r["s"]: r["count"] for r in late.select(F.col("w.start").cast("timestamp_ntz").alias("s"), "count").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 3


def test_stream_without_rows(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    rows = events.stream(spark, str(tmp_path))
    assert events.result(rows.groupBy("user_id").count(), "complete").count() == 0
