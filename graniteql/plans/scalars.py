"""String, date, number, array, map, JSON and vector expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteql.functions import text, vectors
from graniteql.plans.registry import Registry
from graniteql.session import table

query = Registry()


@query("f1_md5", "SELECT doc_id, md5(lower(text)) AS h FROM documents WHERE lang = 'en'")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.md5(F.lower("text")).alias("h"))


@query("f1_md5_all", "SELECT doc_id, md5(lower(text)) AS h FROM documents")
def f1a(spark: SparkSession, d: str) -> DataFrame:
    """Of every language: letters beyond ASCII have lower cases too."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower("text")).alias("h"))


@query("f1_sha256", "SELECT item_id, sha256(text) AS h FROM benchmark")
def f1s(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))


@query("f2_words", "SELECT item_id, len(w) AS n, w[1] AS first, w[-1] AS last FROM (SELECT item_id, CAST(regexp_extract_all(text, '\\S+') AS VARCHAR[]) AS w FROM benchmark)")
def f2(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select("item_id", text.words(F.col("text")).alias("w"))
    return w.select("item_id", F.size("w").cast("long").alias("n"), F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))


@query("f3_replace", "SELECT item_id, regexp_replace(text, '[aeiou]', '_', 'g') AS masked, replace(text, 'the', 'THE') AS shout, translate(text, 'abc', 'xyz') AS turned FROM benchmark")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[aeiou]", "_").alias("masked"), F.replace("text", F.lit("the"), F.lit("THE")).alias("shout"), F.translate("text", "abc", "xyz").alias("turned"))


@query("f4_split_explode", "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@query("f5_char_grams", "SELECT n_name, list_sort(list_distinct([substr(n_name, i, 3) FOR i IN generate_series(1, length(n_name) - 2)])) AS grams FROM nation")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", F.array_sort(text.char_grams(F.col("n_name"), 3)).alias("grams"))


query.sql("f6_levenshtein", "nation region", "SELECT n_name, r_name, CAST(levenshtein(n_name, r_name) AS INT) AS d FROM nation CROSS JOIN region")
query.sql(
    "f7_dates",
    "orders",
    "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, dayofyear(o_orderdate) AS d, last_day(o_orderdate) AS last, date_trunc('month', o_orderdate) AS start, date_format(o_orderdate, 'yyyy-MM-dd') AS iso FROM orders",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(dayofyear(o_orderdate) AS INT) AS d, last_day(o_orderdate) AS last, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS start, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
)
query.sql(
    "f8_date_difference",
    "lineitem orders",
    "SELECT l_orderkey, l_linenumber, CAST(datediff(day, o_orderdate, l_shipdate) AS BIGINT) AS days, CAST(o_orderdate AS DATE) + 30 AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, CAST(o_orderdate AS DATE) + 30 AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
query.sql(
    "f9_json_path",
    "events",
    "SELECT event_id, get_json_object(props, '$.k') AS k, variant_get(parse_json(props), '$.k', 'string') AS v FROM events",
    "SELECT event_id, props->>'$.k' AS k, props->>'$.k' AS v FROM events",
)


@query("f10_json_map", "SELECT event_id, list_sort(json_keys(props)) AS names, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def f10(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.array_sort(F.map_keys(m)).alias("names"), F.element_at(m, "k").alias("k"))


@query("f11_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@query(
    "f12_cosine_to_mean",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label)
    SELECT vec_id, round(list_inner_product(v, m) / sqrt(list_inner_product(v, v) * list_inner_product(m, m)), 6) AS cosine FROM e JOIN m USING (label)""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    """How near each vector is to the mean of its label. Means are summed by component, so that no list of vectors is
    held, and there are as many as labels."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    return e.join(means, "label").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("m")), 6).alias("cosine"))


query.sql(
    "f13_numbers",
    "customer",
    "SELECT c_custkey, CAST(ceil(c_acctbal) AS DOUBLE) AS up, CAST(floor(c_acctbal) AS DOUBLE) AS down, abs(c_acctbal) AS size, sign(c_acctbal) AS s, round(sqrt(abs(c_acctbal)), 6) AS root, c_custkey % 7 AS m, CAST(c_custkey & 12 AS BIGINT) AS bits, greatest(c_acctbal, 0D) AS g FROM customer",
    "SELECT c_custkey, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, abs(c_acctbal) AS size, CAST(sign(c_acctbal) AS DOUBLE) AS s, round(sqrt(abs(c_acctbal)), 6) AS root, c_custkey % 7 AS m, CAST(c_custkey & 12 AS BIGINT) AS bits, greatest(c_acctbal, 0.0::DOUBLE) AS g FROM customer",
)
query.sql(
    "f14_arrays",
    "embeddings",
    "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS first, array_max(embedding) AS top, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive, slice(embedding, 2, 3) AS part FROM embeddings",
    "SELECT vec_id, len(embedding) AS n, embedding[1] AS first, list_max(embedding) AS top, len(list_filter(embedding, lambda x: x > 0)) AS positive, embedding[2:4] AS part FROM embeddings",
)
query.sql(
    "f15_strings",
    "part",
    "SELECT p_partkey, upper(p_name) AS u, initcap(p_type) AS i, CAST(length(p_name) AS BIGINT) AS n, CAST(instr(p_name, 'a') AS BIGINT) AS at, lpad(p_brand, 12, '*') AS l, reverse(p_brand) AS r, split_part(p_brand, '#', 2) AS number, trim('  x ') || p_brand AS t, left(p_name, 3) AS head, repeat('ab', 2) AS ab FROM part",
    "SELECT p_partkey, upper(p_name) AS u, upper(p_type[1]) || lower(p_type[2:]) AS i, length(p_name) AS n, instr(p_name, 'a') AS at, lpad(p_brand, 12, '*') AS l, reverse(p_brand) AS r, split_part(p_brand, '#', 2) AS number, trim('  x ') || p_brand AS t, left(p_name, 3) AS head, repeat('ab', 2) AS ab FROM part",
)
