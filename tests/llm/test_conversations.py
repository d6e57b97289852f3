"""Operators 11 and 12: against brute force and DuckDB."""

import hashlib
import zlib
from collections import defaultdict
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graniteql.llm import conversation_repair, conversation_trie, oracles, queries

from ..conftest import MIDDLE, SMALL
from ..test_queries import rows_of

SPACES = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """The cheapest edits from each row and role before it on, as whole strings: price, audit, turns."""
    follow = {"": ("s", "u", "a"), "s": ("u",), "u": ("a",), "a": ("u",)}

    @cache
    def best(i, state, inserts):
        ways = [] if i < len(rows) or state in "su" and state else [(0, "", ())]
        expected = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if inserts:
            p, a, t = best(i, expected[0], inserts - 1)
            ways.append((p + 5, "I" + a, (expected + ":", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            p, a, t = best(i + 1, state, 2)
            ways.append((p + 2, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                if role[:1] in follow[state] and role[:1] and not (state == "" and role[:1] == "a"):
                    p, a, t = best(i + 1, role[:1], 2)
                    ways.append((p + cut, "K" + a, (f"{role}:{text}", *t)))
                p, a, t = best(i + 1, expected[0], 2)
                ways.append((p + cut + 1, "R" + a, (f"{expected}:{text}", *t)))
        return min(ways) if ways else (1 << 50, "", ())

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in follow:
            best(i, state, 2)
    return best(0, "", 2)


def repaired(rows):
    """The contract row by row."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        found[conv] += []
        if k:
            text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
            found[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, turns in found.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in turns:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        known = {t for t, _, _ in turns if t is not None}
        counts = [sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        price, audit, kept = cheapest(tuple(marked)) if marked else (0, "", ())
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, *counts, illegal, price, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, rows_in, spark, **how):
    return sorted(map(tuple, conversation_repair.repaired(df, **how).collect()), key=str)


TURN = st.tuples(st.integers(0, 3), st.none() | st.integers(0, 9), st.sampled_from(["system", "user", "assistant", "tool", "", None, "u", "aide"]), st.sampled_from(["Yes.", "No?", "open", "Hm. ", " \t", "", None, "a.b", "ü!\n"]))


@settings(max_examples=4, deadline=None)
@given(st.lists(TURN, max_size=60))
def test_op11_is_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, rows, spark) == repaired(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x"]), st.sampled_from(["", "blank", "truncated"])), max_size=14), st.integers(1, 6))
def test_parts_are_the_whole(turns, size):
    """The edits of a conversation do not depend on how it is cut."""
    rows = tuple((r, "t", f) for r, f in turns)
    faults = [(r[0], {"": 0, "blank": 1, "truncated": 3}[f]) for r, f in turns]
    price, audit, _ = cheapest(rows)
    letters = lambda done: "".join(c if c in "DKR" else "I" for x in done for c in x.replace("Ru", "R").replace("Ra", "R"))
    assert letters(conversation_repair.edits(faults)) == (audit if turns else "")
    parts = [faults[i : i + size] for i in range(0, len(faults), size)]
    if parts:
        ways = conversation_repair.joined([conversation_repair.crossed(p) for p in parts])
        assert "".join(letters(conversation_repair.edits(p, a, b)) for p, (a, b) in zip(parts, ways, strict=True)) == audit


def test_one_conversation_over_many_ranges(spark):
    """A conversation with nearly all rows, cut into ranges; a turn with very many copies; extra columns."""
    roles = ["system", "user", "assistant", "user", "tool"]
    rows = [(1, i, roles[i * i % 5], ["Fine.", "open", f"No {i}!"][i % 3]) for i in range(400)] + [(1, 7, "user", "Again.")] * 300 + [(2, None, "user", "Hi."), (None, 0, "user", "Hi."), (3, 0, None, None)]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], SCHEMA + ", piece int, copies int").repartition(5)
    assert got(df, rows, spark, parts=9) == repaired(rows)


def test_op11_empty_and_long(spark):
    assert conversation_repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", "word " * 50000 + ".") for i in range(4)]
    assert got(spark.createDataFrame(rows, SCHEMA), rows, spark) == repaired(rows)


@pytest.mark.parametrize("d", [SMALL, MIDDLE])
def test_op11_is_brute_force_and_sql(spark, d):
    import duckdb

    table = spark.read.parquet(f"{d}/conversations.parquet")
    out = queries.QUERIES["op11_conversation_repair"](spark, d)
    mine = out.collect()
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, mine), key=str) == repaired(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    cursor = db.execute(oracles.CONVERSATION_REPAIR)
    names = [c[0] for c in cursor.description]
    assert rows_of(names, cursor.fetchall()) == rows_of(out.columns, mine)


# -- operator 12 ---------------------------------------------------------------------------------------------------


def trie(rows):
    """The contract node by node."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + x[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    below = defaultdict(lambda: [0, 0, 0])
    for node in sorted(members, key=len, reverse=True):
        b = below[node]
        b[1] += not b[0]
        b[2] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            up = below[node[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + b[1], up[2] + b[2]
    ends = {n: ",".join(str(c) for c in m if len(whole[c]) == len(n)) for n, m in members.items()}
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), *below[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()), key=str)


def grown(df, **how):
    return sorted(map(tuple, conversation_trie.nodes(df, **how).collect()), key=str)


@pytest.mark.parametrize("d", [SMALL, MIDDLE])
def test_op12_is_brute_force_and_sql(spark, d):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.QUERIES["op12_conversation_trie"](spark, d)
    mine = out.collect()
    assert sorted(map(tuple, mine), key=str) == trie(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    cursor = db.execute(oracles.CONVERSATION_TRIE)
    names = [c[0] for c in cursor.description]
    assert rows_of(names, cursor.fetchall()) == rows_of(out.columns, mine)


CROWD = [(c, t, "ua"[t % 2], f"text {t if c % 3 else t * 7}") for c in range(300, 420) for t in range(c % 9)] + [(c, t, "u", f"own {c}" * (c % 4)) for c in range(700, 760) for t in range(2)]
ODD_TURNS = [(5, None, None, None), (5, None, "u", "x"), (5, 1, "u", "é日"), (5, 1, "u", "é日"), (-3, 0, "a", ""), (-100, 0, "u", "first"), (-100, 1, "u", "second"), (None, 0, "u", "nobody"), (205, 3, "u", "no base"), (10**12, 0, "s", "far")]


@pytest.mark.parametrize("shard", [1, 4, 50, 10**6])
def test_op12_with_heavy_levels(spark, shard):
    """From shards of single nodes, all others being heavy, to one shard of all."""
    rows = CROWD + ODD_TURNS
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth int, k1 int").repartition(4)
    assert grown(df, shard=shard) == trie(rows)


def test_op12_long_conversations(spark, monkeypatch):
    """Blocks of three turns: digests are chained over blocks, sums run over several of them."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    rows = [(c, t, "u", f"{t}" if t < 11 else f"{t} {c % 2}") for c in range(600, 612) for t in range(17)] + CROWD
    for shard in (1, 20):
        assert grown(spark.createDataFrame(rows, SCHEMA), shard=shard, parts=5) == trie(rows)


def test_op12_empty(spark):
    assert conversation_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = [(c, 0, "u", "x") for c in range(901, 931) if zlib.crc32(str(c).encode()) % 6]
    assert grown(spark.createDataFrame(turnless, SCHEMA)) == trie(turnless) and len(trie(turnless)) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=40))
def test_louds_gives_the_tree_back(draws):
    import numpy as np

    parents = np.array([d % (i + 1) - 1 for i, d in enumerate(draws)], np.int64)
    labels, degrees, starts = conversation_trie.level_order(parents, np.arange(len(parents)))
    tree = conversation_trie.Louds(degrees)
    assert sorted(labels) == list(range(len(parents))) and (tree.degrees() == degrees).all()
    assert [([-1, *labels][p]) for p in tree.parents()] == [parents[i] for i in labels]
    depth = {-1: 0}
    for i, p in enumerate(parents):
        depth[i] = depth[p] + 1
    assert [depth[i] for i in labels] == sorted(depth[i] for i in labels)
    assert [depth[labels[s]] for s in starts if s < len(labels)] == list(range(1, max(depth.values()) + 1))
