"""Operators 8, 9: against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graniteql.llm import components, jaccard, queries, syncmer

from ..conftest import MIDDLE, SMALL

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def hash_of(values):
    """Spark's xxhash64 of longs, one after another."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed=seed)
    return signed(seed)


def anchors(text):
    units = [u for w in SPACE.findall(text or "") for u in ([w] if len(w) <= syncmer.UNIT else w)]
    h = [signed(xxhash.xxh64_intdigest(u.encode(), seed=42)) for u in units]
    if not h:
        return []
    if len(h) < syncmer.K:
        return [(hash_of(h) & (2**64 - 1)) >> 24 << 24]
    inner = [hash_of(h[i : i + 2]) for i in range(len(h) - 1)]
    return [(hash_of([inner[i], inner[i + 2]]) & (2**64 - 1)) >> 24 << 24 | i for i in range(len(h) - 3) if min(inner[i : i + 3]) in (inner[i], inner[i + 2])]


def links(text):
    """Anchors that follow one another, and the units between them."""
    z = [((a & (2**64 - 1)) >> 24, a & (2**24 - 1)) for a in anchors(text)]
    return {(a, b, j - i) for (a, i), (b, j) in zip(z, z[1:], strict=False)} if len(z) != 1 else {z[0][0]}


def likeness(a, b):
    x, y = links(a), links(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def fingerprint(text):
    return " ".join(f"{(a & (2**64 - 1)) >> 24:X}.{a & (2**24 - 1)}" for a in anchors(text))


def check_fingerprints(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        part = len(text) // 3
        edited, r = text[: len(text) - part] + after[:part], by_id[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(text), fingerprint(edited))
        assert r["near_edited"] == pytest.approx(likeness(text, edited))
        assert r["near_next"] == pytest.approx(likeness(text, after))


def test_op8(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_fingerprints(rows, queries.QUERIES["op8_syncmers"](spark, SMALL).collect())


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_odd_fingerprints(spark, odd, empty, odd_rows, ranges):
    rows = list({r[0]: r[:2] for r in odd_rows}.values())  # repeated rows are the next one of each other
    check_fingerprints(rows, syncmer.compared(odd.dropDuplicates(["doc_id"]), ranges).collect())
    assert syncmer.compared(odd, ranges).count() == len(odd_rows)
    assert syncmer.compared(empty, ranges).count() == 0
    one = syncmer.compared(odd.where("doc_id = 5").limit(1), ranges).first()
    assert one["near_next"] == 1.0


def test_texts_without_blanks(spark):
    """One character put in anywhere changes the anchors around it and no others, at the front too."""
    text = "".join(chr(0x4E00 + i * i * 7 % 6000 + i % 13) for i in range(1200))
    edits = [text[:at] + "龍" + text[at:] for at in (0, 1, 100, 601, 1200)] + [text[:50] + text[53:]]
    df = spark.createDataFrame([(text, e) for e in [*edits, "😀" * 30 + text]], "a string, b string")
    made = df.select("b", syncmer.made(F.col("a")).alias("x"), syncmer.made(F.col("b")).alias("y"))
    got = {r["b"]: r["l"] for r in made.select("b", syncmer.likeness(F.col("x.links"), F.col("y.links")).alias("l")).collect()}
    assert all(got[e] > 0.98 for e in edits) and 0.9 < got["😀" * 30 + text] < 1
    assert all(got[e] == pytest.approx(likeness(text, e)) for e in got)


def test_op8_has_no_python(spark):
    plan = queries.QUERIES["op8_syncmers"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_positions(spark):
    words = [f"w{i}" for i in range(60)]
    moved = ["a", "b", "c", *words]
    apart = [x for i in range(0, 60, 8) for x in (*words[i : i + 8], *(f"x{i}_{j}" for j in range(i % 5)))]  # same passages, other places
    texts = [" ".join(x) for x in (words, moved, apart, words[::-1])]
    df = spark.createDataFrame([(texts[0], t) for t in texts], "a string, b string")
    made = df.select("b", *(syncmer.made(F.col(c)).alias(k) for c, k in (("a", "a"), ("b", "m"))), *(syncmer.sketch(F.col(c)).alias(f"{c}_sketch") for c in "ab"))
    rows = {r["b"]: r for r in made.select("b", syncmer.displacement(F.col("a_sketch"), F.col("b_sketch")).alias("d"), syncmer.likeness(F.col("a.links"), F.col("m.links")).alias("l"), syncmer.shared(F.col("a.anchors"), F.col("m.anchors")).alias("s")).collect()}
    assert rows[texts[0]]["l"] == 1 and rows[texts[3]]["l"] == 0
    assert rows[texts[1]]["d"] == 3 and rows[texts[1]]["l"] > 0.9
    assert 0 < rows[texts[2]]["l"] < rows[texts[2]]["s"] < 1  # where anchors did not move together, likeness falls below their share
    for t in texts:
        assert rows[t]["l"] == pytest.approx(likeness(texts[0], t))


def test_ranges_follow_the_data(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    monkeypatch.setattr(syncmer, "with_next", lambda d, ranges, real=syncmer.with_next: seen.append(ranges) or real(d, ranges))
    want = sorted(map(tuple, syncmer.compared(docs).collect()))
    monkeypatch.setattr(syncmer, "RANGE_CHARS", 5_000)
    assert sorted(map(tuple, syncmer.compared(docs).collect())) == want
    assert seen[0] == 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) < seen[1]


def test_all_anchors_of_long_texts_count(spark):
    words = [f"w{i}" for i in range(20_000)]
    edited = [*words[:9_000], *(f"x{i}" for i in range(10)), *words[9_010:]]
    other = [*(f"y{i}" for i in range(10_000)), *words[5_000:5_060], *(f"z{i}" for i in range(9_940))]
    again = ("a b c d e f g " * 300).split()
    texts = {4: words, 3: edited, 2: other, 1: again, 0: again[:1_000]}
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    got = {r["doc_id"]: r for r in syncmer.compared(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    check_fingerprints(rows, got.values())
    assert 0.99 < got[4]["near_next"] < 1 and got[4]["fingerprint"] != got[3]["fingerprint"]
    assert got[3]["near_next"] > 0.001 and got[1]["near_next"] == 1 and got[0]["near_next"] == 0
    assert len(got[1]["fingerprint"]) > 2 * len(got[0]["fingerprint"])  # every occurrence is there
    pairs = spark.createDataFrame([(i, dict(rows)[i], dict(rows)[(i - 1) % 5]) for i in texts], "i long, a string, b string")
    a, b = (syncmer.sketch(F.col(c)) for c in "ab")
    found = {r["i"]: r for r in pairs.select("i", syncmer.displacement(a, b).alias("shift"), syncmer.shared(syncmer.anchors(F.col("a")), syncmer.in_order(F.col("b"))).alias("shared")).collect()}
    for i, text in rows:
        x, y = (Counter((v & (2**64 - 1)) >> 24 for v in anchors(t)) for t in (text, dict(rows)[(i - 1) % 5]))
        assert found[i]["shared"] == pytest.approx(2 * (x & y).total() / (x.total() + y.total()))
    assert (found[4]["shift"], found[3]["shift"], found[1]["shift"], found[0]["shift"]) == (0, 5_000, 0, None) and found[1]["shared"] < 0.7


def shingles(text, n):
    w = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n=4, percent=85):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, groups=12, words=200):
    """Chains and stars of edits, of all sizes, some with a passage in common."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    passage, rows = list(rng.choice(vocabulary, 60)), []
    for g in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(3, words))))
        if g % 3 == 0:
            base[1:1] = passage
        for _ in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(text)))
                text[at : at + int(rng.integers(0, 2))] = list(rng.choice(vocabulary, int(rng.integers(0, 3))))
            if g % 2:
                base = text
            rows.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, block, most", [(0, 512, 8), (1, 3, 8), (2, 3, 1), (3, 2, 0)])
def test_join_is_the_brute_force(spark, monkeypatch, seed, block, most):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MOST_BLOCKS", most)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs).collect()} == brute(rows)


def test_op9(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op9_ngram_join"](spark, MIDDLE).collect()} == brute(rows)


def by_row(rows, n=4, percent=85):
    """The same with every row a document of its own: sorted doc_id, n_shingles, component_id; and each row's group."""
    numbered = brute([(i, t) for i, (_, t) in enumerate(rows)], n, percent)
    group = [numbered[i][1] for i in range(len(rows))]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], numbered[i][0], least[group[i]]) for i, r in enumerate(rows)), key=str), group


def check_join(docs, rows, n=4, percent=85):
    want, group = by_row(rows, n, percent)
    assert sorted((tuple(r) for r in jaccard.joined(docs, n, percent).collect()), key=str) == want
    left = jaccard.kept(docs, n, percent).collect()
    assert len({(r["doc_id"], r["text"]) for r in left}) == len(left)
    groups = Counter()
    for r in left:
        groups[next(group[i] for i, x in enumerate(rows) if x[:2] == (r["doc_id"], r["text"]))] += 1
    has_words = {g for i, g in enumerate(group) if shingles(rows[i][1], n)}
    assert {g: groups[g] for g in has_words} == dict.fromkeys(has_words, 1)
    assert {(r["doc_id"], r["text"]) for r in left if not shingles(r["text"], n)} == {x[:2] for x in rows if not shingles(x[1], n)}


def test_odd_join(spark, odd, empty, odd_rows):
    check_join(odd, [r[:2] for r in odd_rows])
    assert jaccard.joined(empty).count() == 0 and jaccard.kept(empty).count() == 0
    assert jaccard.kept(odd).columns == odd.columns


@pytest.mark.parametrize("block", [2, 64])
def test_repeated_and_missing_identifiers(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    a, b, c = (" ".join(f"{k}{i}" for i in range(23)) for k in "abc")
    mixed = " ".join([*a.split()[:13], *b.split()[:10]])
    rows = [(5, a), (5, b), (5, b), (7, mixed), (9, c), (9, mixed + " end"), (None, c), (None, c), (None, "alone without identifier or company"), (11, a + " more"), (11, ""), (11, None), (None, ""), (3, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_join(docs, rows)
    check_join(docs, rows, 5, 80)


def test_large_groups_meet_their_pivot_first(spark, monkeypatch):
    """Near copies of one text, so many that pairs of blocks would be many: what links with the pivot is not dealt."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 117], f"x{i}", *words[i % 117 + 1 :]])) for i in range(200)]
    rows += [(1000 + i, " ".join([*words[:60], *(f"y{i}_{j}" for j in range(60))])) for i in range(5)]  # shares a passage only
    dealt, real = [], jaccard._dealt

    def counted(many, pivots):
        out = real(many, pivots)
        dealt.append((many.count(), pivots.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_dealt", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_join(docs, rows)
    many, linked, sent = dealt[0]
    assert many >= 200 and linked >= 190 and sent < 4 * many


def test_joins_on_a_shingle_can_be_split(spark):
    """Both sides of such a join are shuffled for it, with nothing between."""
    items = spark.range(1000).selectExpr("id as class", "id % 50 as size", "id % 7 as item")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard._shared(items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    lines = [x.strip(" +-:*()0123456789") for x in plan.splitlines()]
    at = next(i for i, x in enumerate(lines) if x.startswith("SortMergeJoin"))
    assert lines[at + 1].startswith("Sort") and lines[at + 2].startswith("Exchange hashpartitioning(item") and sum("Exchange hashpartitioning(item" in x for x in lines) == 2


def test_shingle_hashes_follow_the_words():
    texts = ["a b c d e", "A  b\tc D e ", "a b c", "c b a", "", "a b c d", "é b c d e", "ab c d e", "a bc d e", "x" * 5000]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    sets = jaccard.shingle_sets(*jaccard.word_hashes(np.concatenate(data), np.cumsum([0, *map(len, data)])), 4)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (sets[i].tolist() == sets[j].tolist()) == (shingles(a, 4) == shingles(b, 4)), (a, b)
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(a, 4) & shingles(b, 4))


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=6, deadline=None)
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in list(parent))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = pa.array([None, " ".join(f"w{i % 977}" for i in range(5000)) + "  " + "y" * 400 + " end", "short one here now"])
    whole = [s.tolist() for s in jaccard.sets_of(text, 4)]
    monkeypatch.setattr(jaccard, "AT_ONCE", 64)
    assert [s.tolist() for s in jaccard.sets_of(text, 4)] == whole
