"""Operator 6: URL filters by rules and an empirical-Bayes reputation of hosts.

Rules name a host and the start of a path; the longest that fits decides. Pages that a rule decides are the labelled
outcomes from which the reputation of all hosts is learned: the share of blocked pages at the suffix, shrunk to the
share of all pages; at the registered domain, shrunk to its suffix; at the host, shrunk to its domain. Each step is a
beta-binomial posterior whose prior has the parent's mean and a strength that is estimated by moments from all nodes of
that level: the less they differ beyond chance, the stronger. A page without a rule is blocked if its host's share
exceeds one half with the confidence of SIGMAS standard deviations of the posterior, and allowed otherwise.

Rows are aggregated by host before anything is shuffled, in one pass over the pages, and that table is written; pages are
judged by a join on the host that is split where a host is frequent. The driver holds two numbers for each of the three
levels. Suffixes follow a rule (a general label under a country) or a table of any size.

Defined cases: a null url or one without `://` has an empty host and path, and the reputation of the empty host; a port
belongs to the host but not to its domain and suffix; very long urls are urls; of rules of equal length that fit, the
first by verdict, host and path counts; without labelled outcomes every page without a rule is allowed; repeated rows are
outcomes of their own; an empty table gives no rows; other columns are kept by `judged`, but for those named as its
results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteql.llm.common import written

SIGMAS = 1.6448536269514722
#: Labels that make a suffix together with a country's two letters.
GENERAL = "ac asn co com edu firm gen go gob gouv gov gv ind info ltd me mil ne net nhs nom or org plc sch web".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number become one expression, more are joined as a table.
MOST_INLINE = 100


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix, without a port. A host of digits and dots is its own domain, without suffix."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    last, two, three = (F.substring_index(bare, ".", -i) for i in (1, 2, 3))
    long, number = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(GENERAL) & (two != last), bare.rlike(r"^[0-9.]+$")
    return F.when(number, bare).when(long, three).otherwise(two), F.when(number, "").when(long, two).otherwise(last)


def _tails(host: Column) -> Column:
    """A host's ends at its dots, the whole one first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds domain and suffix to distinct hosts. suffixes: a table of public suffixes (suffix); the longest that fits
    counts, and the rule where none does."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    if suffixes is None:
        return hosts
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    tails = hosts.select("host", bare.alias("bare"), F.explode(_tails(bare)).alias("tail"))
    found = tails.join(suffixes.select(F.lower("suffix").alias("tail")).distinct(), "tail").where(~F.col("bare").rlike(r"^[0-9.]+$"))
    best = found.groupBy("host", "bare").agg(F.max(F.struct(F.length("tail").alias("n"), "tail")).alias("best"))
    labels, own = F.split("bare", r"\."), F.size(F.split("best.tail", r"\."))
    longer = F.array_join(F.slice(labels, F.greatest(F.size(labels) - own, F.lit(1)), own + 1), ".")
    best = best.select("host", F.col("best.tail").alias("own_suffix"), longer.alias("own_domain"))
    return hosts.join(best, "host", "left").withColumn("domain", F.coalesce("own_domain", "domain")).withColumn("suffix", F.coalesce("own_suffix", "suffix")).drop("own_domain", "own_suffix")


def by_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and ruled (allow, block) by the longest of (verdict, host, path) that fits, null if none does."""
    rule = ruled = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        ruled = F.when(fits, verdict) if ruled is None else ruled.when(fits, verdict)
    none = F.lit(None).cast("string")
    return pages.withColumn("rule", none if rule is None else rule).withColumn("ruled", none if ruled is None else ruled)


def by_rule_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules of any size (verdict, host, path): each distinct host and path looks up its host's
    ends."""
    places = pages.select("host", "path").distinct()
    rules = rules.select(F.col("host").alias("tail"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    met = places.select("host", "path", F.explode(_tails(F.col("host"))).alias("tail")).join(rules, "tail").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("tail", "rule_path")
    order = F.struct((-F.length(name)).alias("less"), "rule_verdict", "tail", "rule_path")
    best = met.groupBy("host", "path").agg(F.min(order).alias("best")).select("host", "path", F.concat("best.tail", "best.rule_path").alias("rule"), F.col("best.rule_verdict").alias("ruled"))
    return pages.drop("rule", "ruled").join(best, ["host", "path"], "left")


def reputations(pages: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, mean, sd: the posterior of each host's share of blocked pages. pages: host, ruled."""
    counts = pages.groupBy("host").agg(F.count("ruled").alias("n"), F.count_if(F.col("ruled") == "block").alias("k"))
    hosts = written(with_domains(counts, suffixes), "hosts")  # all that follows reads this, not the pages
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    total = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sk"), F.lit(0)).alias("k")).first()
    raw = lambda k, n: (F.col(k) + 1.0) / (F.col(n) + 2.0)
    mean = (total["k"] + 1.0) / (total["n"] + 2.0)
    domains = domains.join(suffixes, "suffix")
    hosts = hosts.join(domains, ["domain", "suffix"])

    def strength(level: DataFrame, k: str, n: str, m: Column) -> float:
        """The prior's number of pages: from the spread of the children's shares around the parent's, by moments."""
        v = m * (1 - m)
        x = level.where(F.col(n) > 0).select((F.col(n) * (F.col(k) / F.col(n) - m) ** 2).alias("s"), v.alias("v"), (v * (F.col(n) - 1)).alias("w")).agg(F.sum("s").alias("s"), F.sum("v").alias("v"), F.sum("w").alias("w")).first()
        rho = (x["s"] - x["v"]) / x["w"] if x["w"] else 0.5
        rho = min(max(rho, 0.001), 0.5)
        return 1 / rho - 1

    ks = strength(suffixes, "sk", "sn", F.lit(mean))
    kd = strength(domains, "dk", "dn", raw("sk", "sn"))
    kh = strength(hosts, "k", "n", raw("dk", "dn"))
    post = lambda k, n, m, c: (F.col(k) + c * m) / (F.col(n) + c)
    hosts = hosts.withColumn("sm", post("sk", "sn", F.lit(mean), ks))
    hosts = hosts.withColumn("dm", post("dk", "dn", F.col("sm"), kd))
    hosts = hosts.withColumn("mean", post("k", "n", F.col("dm"), kh))
    return hosts.select("host", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + kh + 1)).alias("sd"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, verdict, reputation (mean and sd of the host's posterior)."""
    ours = ["host", "path", "rule", "verdict", "reputation", "reputation_sd"]
    host, path = host_and_path(F.col(url))
    pages = pages.select("*", host.alias("__host"), path.alias("__path")).drop(*ours)
    pages = pages.withColumnsRenamed({"__host": "host", "__path": "path"})
    if len(rules) > MOST_INLINE:
        pages = by_rule_table(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"))
    else:
        pages = by_rule(pages, rules)
    known = reputations(pages.select("host", "ruled"), suffixes).withColumnRenamed("mean", "reputation").withColumnRenamed("sd", "reputation_sd")
    pages = pages.join(known, "host", "left")
    method = F.when(F.col("reputation") - SIGMAS * F.col("reputation_sd") > 0.5, "block").otherwise("allow")
    return pages.withColumn("verdict", F.coalesce("ruled", method)).drop("ruled")
