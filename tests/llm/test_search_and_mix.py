"""Operators 5, 6, 7: against brute force."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graniteql.llm import ann, mixing, queries, url_reputation

from ..conftest import MIDDLE, SMALL

LARGE = "/root/testdata/sf0.1"


def brute(ids, x, k=20, every=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def nearest(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_op5(spark):
    p = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").toPandas()
    want = brute(p.vec_id.values, np.array(p.embedding.tolist(), float))
    got = nearest(queries.QUERIES["op5_one_bit_codes"](spark, MIDDLE).collect())
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert all(abs(a - dict(want[q]).get(v, a)) < 1e-12 for q in got for v, a in got[q])


def test_recall_and_share(spark):
    """Over the 2,000 vectors of sf0.1, uniform on the sphere, the hardest case for codes of 64 bits."""
    vectors = spark.read.parquet(f"{LARGE}/embeddings.parquet")
    p, figures = vectors.toPandas(), {}
    want = brute(p.vec_id.values, np.array(p.embedding.tolist(), float))
    got = nearest(ann.search(vectors, figures=figures).collect())
    recall = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    share = figures["pairs"] / (figures["queries"] * figures["codes"])
    print(f"recall {recall:.3f}, reranked {share:.3f} of all pairs")
    assert recall >= 0.95 and share < 0.3
    assert all(abs(a - dict(want[q]).get(v, a)) < 1e-12 for q in got for v, a in got[q])


def by_rows(rows, k, every):
    """The same search row by row: every other row is a candidate."""
    out = []
    for i, (q_id, q) in enumerate(rows):
        if q_id is not None and q_id % every == 0:
            scored = sorted((-float(np.dot(q, x)), v is None, v or 0) for j, (v, x) in enumerate(rows) if j != i)[:k]
            out += [(q_id, rank + 1, None if null else v, -s) for rank, (s, null, v) in enumerate(scored)]
    return sorted(out, key=lambda r: (r[0], r[1], r[2] or 0))


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 40)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "AT_ONCE", 64)
    rng = np.random.default_rng(0)
    x = rng.integers(-9, 10, size=(120, 6)).astype(float)
    x[30:70] = x[5]  # one vector with many copies
    x[:40] *= 100
    good = [(i, v) for i, v in enumerate(x)] + [(7, x[7]), (20, x[20]), (20, x[20]), (20, x[3]), (None, x[20]), (None, x[20]), (60, x[9])]
    odd = [(200, None, ""), (201, [], ""), (202, [0.0] * 6, ""), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (204, [float("nan")] * 6, ""), (205, [float("inf")] + [0.0] * 5, ""), (206, [1.0] * 5, ""), (207, [-0.0] * 6, "")]
    df = spark.createDataFrame([(i, v.tolist(), "label") for i, v in good] + odd, "vec_id long, embedding array<double>, score string").repartition(5)
    got = sorted((tuple(r) for r in ann.search(df, k=7, sure=6).collect()), key=lambda r: (r[0], r[1], r[2] or 0))
    assert got == by_rows(good, 7, 20)
    assert ann.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.1])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    alone = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert ann.search(alone).count() == 0


def test_result_does_not_follow_the_tiles(spark, monkeypatch):
    vectors = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    want = nearest(ann.search(vectors).collect())
    monkeypatch.setattr(ann, "CANDIDATES", 33)
    monkeypatch.setattr(ann, "QUERIES", 7)
    assert nearest(ann.search(vectors.repartition(7)).collect()) == want


def test_estimates_are_unbiased_and_as_sure_as_they_say():
    rng = np.random.default_rng(1)
    for d in (6, 64, 100):
        x, q = rng.normal(size=(4000, d)) + 0.3, rng.normal(size=(50, d)) * 5
        center, turn = x.mean(0), ann.rotation(d)
        guess, error = ann.Asked(q, center, turn).estimates(slice(0, 50), *ann.encoded(x, center, turn))
        z = (guess - q @ x.T) / error
        assert abs(z.mean()) < 0.05 and 0.8 < z.std() < 1.1 and (np.abs(z) < 4).mean() > 0.999


def judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_op6_hosts_and_rules(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    got = queries.QUERIES["op6_host_reputation"](spark, MIDDLE).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = judge(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "http://a.com/en/1", "http://com/en/", "http://xcom/en/", "http://example.com/en/7x?q", "x://example.net?/de/8", "x://a.example.net/de/8#/", "http://É.org/es/", "a://b://c.com/en/", "http://1.2.3.4/x", "http://a.co.uk/y\n/z"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = url_reputation.judged(df, queries.RULES)
    assert out.columns.count("verdict") == 1
    for r in out.collect():
        host, path, rule, verdict = judge(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert verdict in (None, r["verdict"])
    assert url_reputation.judged(df.limit(0), queries.RULES).count() == 0
    table = spark.createDataFrame(queries.RULES, "verdict string, host string, path string")
    bare = out.select("page_id", "host", "path")
    by_table = {r["page_id"]: (r["rule"], r["ruled"]) for r in url_reputation.by_rule_table(bare, table).collect()}
    assert by_table == {i: judge(u)[2:] for i, u in enumerate(urls)}


def reputation(pages):
    """host -> mean, sd, by the same model written out by hand."""

    def parts(host):
        host = re.sub(":[0-9]*$", "", host)
        if re.fullmatch(r"[0-9.]+", host):
            return host, ""
        labels = host.split(".")
        n = 2 if len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in url_reputation.GENERAL else 1
        return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])

    count = lambda key: {k: (sum(1 for h, v in pages if key(h) == k and v), sum(1 for h, v in pages if key(h) == k and v == "block")) for k in {key(h) for h, _ in pages}}
    total, suffix, domain, host = count(lambda h: 0), count(lambda h: parts(h)[1]), count(parts), count(lambda h: h)
    raw = lambda n, k: (k + 1) / (n + 2)

    def strength(level, parent):
        rows = [(n, k, raw(*parent(x)) if not isinstance(parent(x), float) else parent(x)) for x, (n, k) in level.items() if n]
        w = sum(m * (1 - m) * (n - 1) for n, _, m in rows)
        rho = (sum(n * (k / n - m) ** 2 for n, k, m in rows) - sum(m * (1 - m) for _, _, m in rows)) / w if w else 0.5
        return 1 / min(max(rho, 0.001), 0.5) - 1

    mean = raw(*total[0])
    ks, kd, kh = strength(suffix, lambda s: mean), strength(domain, lambda x: suffix[x[1]]), strength(host, lambda h: domain[parts(h)])
    out = {}
    for h, (n, k) in host.items():
        d = parts(h)
        sm = (suffix[d[1]][1] + ks * mean) / (suffix[d[1]][0] + ks)
        dm = (domain[d][1] + kd * sm) / (domain[d][0] + kd)
        m = (k + kh * dm) / (n + kh)
        out[h] = m, (m * (1 - m) / (n + kh + 1)) ** 0.5
    return out


def test_reputation_by_hand(spark):
    rng = np.random.default_rng(3)
    hosts = ["a.x.com", "b.x.com:8080", "c.y.com", "d.z.org", "e.gov.au", "f.co.uk", "g.h.co.uk", "1.2.3.4:80", ""]
    pages = [(hosts[i], [None, "allow", "block"][int(v)]) for i, v in zip(rng.integers(0, 9, 200), rng.integers(0, 3, 200), strict=True)]
    got = {r["host"]: (r["mean"], r["sd"]) for r in url_reputation.reputations(spark.createDataFrame(pages, "host string, ruled string")).collect()}
    want = reputation(pages)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in want)


def test_suffixes_by_table_and_ports(spark):
    hosts = ["a.b.example.com:8080", "x.github.io", "github.io", "y.x.github.io:1", "k.city.kawasaki.jp", "gov.au", "a.gov.au", "1.2.3.4:5", "", "localhost", "Z.Co.Il".lower()]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    rule = {r["host"]: (r["domain"], r["suffix"]) for r in url_reputation.with_domains(df).collect()}
    assert rule["a.b.example.com:8080"] == ("example.com", "com") and rule["a.gov.au"] == ("a.gov.au", "gov.au") and rule["z.co.il"] == ("z.co.il", "co.il")
    assert rule["1.2.3.4:5"] == ("1.2.3.4", "") and rule["localhost"] == ("localhost", "localhost") and rule["x.github.io"] == ("github.io", "io")
    table = spark.createDataFrame([("io",), ("github.io",), ("GITHUB.io",), ("city.kawasaki.jp",), ("jp",), ("4",)], "suffix string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_reputation.with_domains(df, table).collect()}
    assert got["x.github.io"] == ("x.github.io", "github.io") and got["y.x.github.io:1"] == ("x.github.io", "github.io") and got["github.io"] == ("github.io", "github.io")
    assert got["k.city.kawasaki.jp"] == ("k.city.kawasaki.jp", "city.kawasaki.jp") and got["1.2.3.4:5"] == ("1.2.3.4", "")
    assert {h: got[h] for h in ("a.gov.au", "localhost", "")} == {h: rule[h] for h in ("a.gov.au", "localhost", "")}


def test_many_rules_are_a_table(spark, monkeypatch):
    rules = [*queries.RULES, ("block", "example.com", "/en/7"), *(("block", f"h{i}.com", f"/p{i}") for i in range(120))]
    urls = ["http://a.example.com/en/7", "http://h3.com/p33", "http://w.h33.com/p33/x", "http://x.net/de/", None, "http://com/en/"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    asked = lambda: sorted((r["page_id"], r["host"], r["rule"] or "", r["verdict"], round(r["reputation"], 12)) for r in url_reputation.judged(df, rules).collect())
    by_table = asked()
    monkeypatch.setattr(url_reputation, "MOST_INLINE", 1000)
    assert asked() == by_table and by_table[0][2:4] == ("example.com/en/7", "allow")


def test_pages_are_read_twice_only(spark):
    """Once to aggregate hosts, once to be judged."""
    plan = url_reputation.judged(spark.read.parquet(f"{MIDDLE}/pages.parquet"), queries.RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[page_id", plan)) == 1  # the plan that judges; hosts are a table


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows]


@given(st.dictionaries(st.text(max_size=3) | st.none(), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(totals):
    got = mixing.targets(totals)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    assert sum(got.values()) == sum(totals.values())
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    free = [s for s in totals if got[s] < 3 * totals[s]]
    assert all(got[s] <= 3 * totals[s] for s in totals)
    assert len({got[s] / weight[s] for s in free}) <= 1
    if free:
        assert all(Fraction(3 * totals[s], weight[s]) <= got[free[0]] / weight[free[0]] for s in totals if s not in free)


@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
@settings(deadline=None)
def test_tree_is_exact(quotas, shards, seed):
    tree = mixing.split(np.array(quotas), shards, seed)
    assert (tree >= 0).all() and tree.sum(0).tolist() == quotas
    assert tree.sum(1).max() - tree.sum(1).min() <= shards


@given(st.integers(1, 3000), st.integers(0, 2**60))
@settings(deadline=None)
def test_permutation(n, key):
    assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_op7(spark):
    got = queries.QUERIES["op7_mixture"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    docs["n"] = sizes_of(docs.text)
    both = got.merge(docs, on="doc_id")
    assert (both["size"] == both.n).all() and len(got) == len(docs) and (both.taken <= 3 * both["size"]).all()
    totals = docs.groupby("source").n.sum().to_dict()
    want = mixing.targets({k: int(v) for k, v in totals.items()})
    for s, g in both.groupby("source"):
        assert g.target.iloc[0] == float(want[s]) and abs(g.taken.sum() - g.target.iloc[0]) <= 1 and g.source_size.iloc[0] == totals[s]
    again = queries.QUERIES["op7_mixture"](spark, SMALL).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_pieces_are_disjoint_and_add_up(spark, odd, empty, odd_rows):
    pieces, drawn = mixing.mixed(odd, shards=5).toPandas(), mixing.taken(odd, shards=5).toPandas()
    assert sorted(drawn["size"]) == sorted(sizes_of([r[1] for r in odd_rows]))
    assert pieces.words.sum() == drawn.taken.sum() and pieces["shard"].between(0, 4).all()
    for _, g in pieces[pieces.doc_id == 9].groupby("pass"):
        spans = sorted(zip(g["first_word"], g["first_word"] + g["words"], strict=True))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0
    out = mixing.resampled(odd)
    assert out.columns == odd.columns
    assert mixing.resampled(empty).count() == 0


def permuted(x, n, key):
    """One value of the permutation, in plain numbers."""
    mask64 = 2**64 - 1
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(4):
            m = (b * 0x9E3779B97F4A7C15 + key + (0xBF58476D1CE4E5B9 * (r + 1) & mask64)) & mask64
            m ^= m >> 29
            m = m * 0x94D049BB133111EB & mask64
            m ^= m >> 32
            a, b = b, a ^ (m & mask)
        x = a << half | b
        if x < n:
            return x


def brute_taken(spark, docs, seed=7):
    """(doc_id, size) -> words taken, word by word: every word of a stream knows its block, every block its place."""
    sized = mixing.sizes(docs)
    rows = sized.select("*", F.xxhash64("doc_id", "salt", F.lit(seed)).alias("h")).collect()
    want = mixing.targets({s: sum(r["size"] for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    out = {}
    for number, s in enumerate(sorted(want, key=lambda s: (s is None, s or ""))):
        own = [r for r in rows if r["source"] == s and r["size"]]
        words, goal = sum(r["size"] for r in own), round(want[s])
        if not words:
            continue
        n = math.ceil(math.sqrt(len(own)))
        own.sort(key=lambda r: ((((r["h"] & 2**64 - 1) >> 16) & (1 << 40) - 1) * n // (1 << 40), r["h"], r["doc_id"] or 0, r["size"]))
        full, passes = words // 64, goal // words
        quota = min((goal - passes * words) // 64, full)
        cut = goal - passes * words - quota * 64
        at = 0
        for r in own:
            got = 0
            for p in range(passes + 1):
                key = (number * 64 + p) * 0xD6E8FEB86659FD93 + seed & 2**64 - 1
                place = {b: permuted(b, full, key) if b < full else full for b in range(at // 64, (at + r["size"] - 1) // 64 + 1)}
                got += sum(p < passes or place[w // 64] < quota or place[w // 64] == quota and w % 64 < cut for w in range(at, at + r["size"]))
            at += r["size"]
            out[r["doc_id"], r["salt"]] = out.get((r["doc_id"], r["salt"]), 0) + got
    return out


def test_taken_by_brute_force(spark, odd):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 4000"), odd):
        want = brute_taken(spark, docs)
        salts = {(r["doc_id"], r["size"], r["salt"]) for r in mixing.sizes(docs).collect()}
        got = {}
        for r in mixing.taken(docs).collect():
            got.setdefault((r["doc_id"], r["size"]), []).append(r["taken"])
        expected = {}
        for i, size, salt in salts:
            expected[i, size] = expected.get((i, size), 0) + want.get((i, salt), 0)
        assert {k: sum(v) for k, v in got.items()} == expected


def test_result_comes_through_the_tree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    kept = mixing.resampled(docs).count()
    real = mixing.split
    monkeypatch.setattr(mixing, "split", lambda quotas, shards, seed=0: real(np.asarray(quotas) // 2, shards, seed))
    half = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    assert 0.45 * sum(want.values()) < sum(half.values()) < 0.6 * sum(want.values())
    assert mixing.resampled(docs).count() < kept
    monkeypatch.setattr(mixing, "split", lambda quotas, shards, seed=0: np.zeros((shards, len(quotas)), np.int64))
    assert sum(r["taken"] for r in mixing.taken(docs).collect()) < 0.05 * sum(want.values())


def test_shards_hold_the_tree_s_quotas(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made, sources = mixing.plan(mixing.sizes(docs), shards=8)
    tree = np.diff(np.vstack([np.zeros(len(sources), np.int64), made.ends]), axis=0)
    number = {s[0]: s[1] for s in sources}
    mix = mixing.mixed(docs, shards=8).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    for (shard, source), g in mix.groupby(["shard", "source"]):
        # whole blocks by the tree; but for them a source has two blocks that are not whole in each pass at most
        assert abs(g.words.sum() - tree[shard][number[source]] * 64) <= 8 * 64
    for _, g in mix.groupby("shard", sort=False):
        assert g.order.is_monotonic_increasing and len(set(zip(g.doc_id, g["pass"], g.first_word, strict=True))) == len(g)


def test_strata_are_trees(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    tree = mixing.split(np.array([70, 3, 0, 200]), 7)
    assert (tree >= 0).all() and tree.sum(0).tolist() == [70, 3, 0, 200] and tree.sum(1).max() - tree.sum(1).min() <= 7 * 6


def test_hot_and_repeated_rows_in_the_mix(spark):
    rows = [(None if i % 3 else i, f"text {i % 50} of source " * (i % 7), "s" if i % 2 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at = mixing.placed(mixing.sizes(docs), mixing.plan(mixing.sizes(docs))[1])
    for number in (0, 1):  # places are disjoint and without gaps
        own = sorted((r["start"], r["size"]) for r in at.where(f"size > 0 and number = {number}").collect())
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
    got = mixing.taken(docs).collect()
    assert len(got) == 300 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_whole_documents_meet_their_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.resampled(docs).toPandas()
    got["n"], words = sizes_of(got.text), dict(zip((d := docs.toPandas()).doc_id, sizes_of(d.text), strict=True))
    d["n"] = d.doc_id.map(words)
    want = mixing.targets({k: int(v) for k, v in d.groupby("source").n.sum().items()})
    assert got.doc_id.value_counts().max() <= 3
    for s, g in d.groupby("source"):
        assert abs(got[got.source == s].n.sum() - float(want[s])) <= g.n.max()
    assert got.sort_values("doc_id").doc_id.tolist() == mixing.resampled(docs).toPandas().sort_values("doc_id").doc_id.tolist()
