"""Ranks and quantiles over partitions of any size, against Spark's own window functions and aggregates."""

import math

import pytest
from pyspark.sql import functions as F

from graniteql import plans
from graniteql.operators import quantiles, ranks

from .conftest import SMALL


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most rows, half of which tie; null keys and values; repeated rows; columns named like those inside."""
    many = [("hot", 1.0 if i % 2 else float(i % 211), i) for i in range(3000)]
    odd = [(None, None, 1), (None, 2.0, 2), (None, 2.0, 2), ("nulls", None, 3), ("nulls", None, 4), ("one", 5.0, 5), ("few", 1.0, 6), ("few", -1.0, 7), ("few", None, 8)]
    return spark.createDataFrame(many + odd, "g string, place double, piece int").repartition(6)


@pytest.mark.parametrize("desc", [(), ("place",)])
def test_ranks_are_the_window_functions(rows, desc):
    got = ranks.ranked(rows, ["g"], ["place", "piece"], desc, parts=7)
    made = got.select(*rows.columns, "rank", "last", "size", ranks.tile(F.col("row_number"), F.col("size"), 4).alias("t"), ranks.percent_rank(F.col("rank"), F.col("size")).alias("p"), ranks.cume_dist(F.col("last"), F.col("size")).alias("c"))
    order = f"partition by g order by place {'desc' if desc else ''}, piece"
    want = rows.selectExpr("*", f"rank() over ({order})", f"count(*) over ({order} range between unbounded preceding and current row)", "count(*) over (partition by g)", f"ntile(4) over ({order})", f"percent_rank() over ({order})", f"cume_dist() over ({order})")
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    numbers = [(r["g"], r["row_number"]) for r in got.collect()]
    assert len(set(numbers)) == len(numbers) == rows.count()


def test_a_key_is_cut_into_ranges(rows):
    """One key holds nearly all rows, one value half of them: both are spread evenly."""
    hot = ranks.placed(rows, ["g"], ["place"], place="at", piece="range", parts=8).where("g = 'hot'")
    sizes = [r["count"] for r in hot.groupBy("range").count().collect()]
    ties = [r["count"] for r in hot.where("place = 1").groupBy("range").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 3000 / 8 and len(ties) >= 4


def test_no_window_over_the_rows(spark):
    plan = plans.QUERIES["w3_distribution"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "c_acctbal" in plan


def test_without_keys_and_rows(spark, rows):
    numbers = sorted(r["row_number"] for r in ranks.numbered(rows, [], ["place"], parts=5).collect())
    assert numbers == list(range(1, rows.count() + 1))
    assert ranks.ranked(rows.limit(0), ["g"], ["place"]).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_quantiles(rows, q):
    got = {r["g"]: r["v"] for r in quantiles.exact_quantile(rows, ["g"], "place", q, "v", most=64).collect()}
    want = {r["g"]: r["v"] for r in rows.groupBy("g").agg(F.percentile("place", q).alias("v")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_a_group_of_all_rows_is_never_held(spark):
    """20,000 values in one group, nine tenths of them in two values; what is put in order has 64 values at most."""
    rows = spark.range(20000).selectExpr("case when id % 10 < 5 then 7.0D when id % 10 < 9 then 8.0D else cast(id as double) end as x")
    rounds = []
    got = quantiles.exact_quantile(rows, [], "x", 0.95, most=64, rounds=rounds)
    assert got.first()[0] == rows.agg(F.percentile("x", 0.95)).first()[0]
    assert rounds[-1] <= 64 and len(rounds) < 8
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_odd_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (-0.0,), (0.0,), (None,)], "x double")
    assert [quantiles.exact_quantile(rows, [], "x", q).first()[0] for q in (0.0, 0.5, 0.75)] == [0.0, 1.0, float("inf")]
    assert math.isnan(quantiles.exact_quantile(rows, [], "x", 1.0).first()[0])
    assert quantiles.exact_quantile(rows.limit(0), ["x"], "x", 0.5).count() == 0
