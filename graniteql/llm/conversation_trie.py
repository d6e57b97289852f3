"""Operator 12: a prefix trie of conversations, in succinct level-order shards.

Conversations are rebuilt from a shared head and their own turns; each distinct sequence of first turns is a node. A row
(conversation, depth) finds its node by a digest of the turns so far: turns are folded in blocks of BLOCK, the blocks of a
longer conversation are chained apart, so that one of any length is spread. Rows are summed up to nodes before they are
shuffled, which makes copies one.

A node under which more than SHARD rows lie is heavy. The nodes below the heavy ones fall apart into prefix shards: subtrees
of SHARD rows at most, dealt over so many buckets that a bucket has about as many. A bucket's subtrees become one
level-order trie (LOUDS) under a root of its own: for each node in level order as many ones as it has children and a zero,
and an array of labels beside it. Parents and numbers of children are read from the bits by rank and select, and sums over
subtrees go up level by level, from the last to the first, by add.at. The heavy upper levels are merged apart: what the
shards come to is added to the nodes they hang on, and every heavy node's own share to all that lie above it on the path of
its smallest member: sums along paths, in two steps of BLOCK rows, then by node.

Each node's ending members are digested in numeric order: identifiers are gathered in lists of one range of 65,536, and the
lists stream through the digest.

Defined cases: null roles and texts are empty; a null turn comes first; turns that tie are ordered by a digest of role and
text; repeated rows are turns of their own; rows without conv_id take no part; a remainder of a negative conv_id is not
negative; an empty table has no nodes; extra columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graniteql.llm.common import ship, written
from graniteql.operators import ranks

#: Turns that are folded at once; rows under a node that is not heavy; conversations that share a head, and its turns.
BLOCK, SHARD, FAMILY, HEAD = 65_536, 4_096, 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()


class Louds:
    """A tree in level order as a bit vector, packed: node 0 is the root, and the i-th one bit (from 1) is node i's."""

    def __init__(self, degrees: np.ndarray):
        ends = np.cumsum(degrees + 1)
        bits = np.ones(int(ends[-1]), np.uint8)
        bits[ends - 1] = 0
        self.bits, self.size = np.packbits(bits), len(bits)

    def _places(self, bit: int) -> np.ndarray:
        """select: where the bits of a kind are."""
        return np.flatnonzero(np.unpackbits(self.bits, count=self.size) == bit)

    def degrees(self) -> np.ndarray:
        return np.diff(self._places(0), prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Of nodes 1 and on: the zeros before a node's one bit, its place less the ones before it."""
        ones = self._places(1)
        return ones - np.arange(len(ones))


def level_order(parents: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Nodes in level order, siblings by rank; how many children the root and each of them has; where levels begin. parents:
    -1 is the root."""
    order = np.lexsort((rank, parents))
    first, last = (np.searchsorted(parents[order], np.arange(-1, len(parents)), side) for side in ("left", "right"))
    count = last - first  # of the root, then of each node
    level, levels, degrees, starts = np.array([-1]), [], [], [0]
    while len(level):
        n = count[level + 1]
        degrees.append(n)
        ends = np.cumsum(n)
        level = order[np.repeat(first[level + 1] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        levels.append(level)
        starts.append(starts[-1] + len(level))
    return np.concatenate(levels), np.concatenate(degrees), starts[:-1]


def rolled_up(keys: np.ndarray, above: np.ndarray, conv: np.ndarray, n: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
    """For a bucket's nodes, in level order: place (in the input), parent (place, -1 outside), n_children, n_leaves,
    saved. keys, above: pairs of numbers that name a node and its parent."""
    _, ids = np.unique(np.concatenate([keys, above]), axis=0, return_inverse=True)
    ids = ids.reshape(-1)
    own, at = ids[: len(keys)], np.full(ids.max() + 1, -1)
    at[own] = np.arange(len(keys))
    labels, degrees, starts = level_order(at[ids[len(keys) :]], conv)
    trie = Louds(degrees)
    parents, children = trie.parents(), trie.degrees()
    leaves, saved = (children == 0).astype(np.int64), np.concatenate([[0], ((n - 1) * chars)[labels]])
    for low, high in zip(starts[-2::-1], starts[:0:-1], strict=True):  # levels, the last first
        for total in (leaves, saved):
            np.add.at(total, parents[low:high], total[low + 1 : high + 1])
    outside = np.concatenate([[-1], labels])
    return {"place": labels, "parent": outside[parents], "n_children": children[1:], "n_leaves": leaves[1:], "saved": saved[1:]}


# -- rows ----------------------------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows c, d, label, chars, len: the turns of the rebuilt conversations; and c, len of each of those."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), label.alias("label"), F.length(text).cast("long").alias("chars"))
    turns = written(ranks.numbered(turns, ["c"], ["turn", "label"], name="pos", size="own", parts=parts).drop("turn"), "turns")
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEAD))
    base = F.col("c") - F.pmod("c", F.lit(FAMILY))
    convs = turns.where("pos = 1").select("c", "own", h.alias("h"), base.alias("base"))
    bases = convs.where("c = base").select(F.col("c").alias("base"), F.col("own").alias("base_own"))
    head = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("c", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    convs = written(convs, "convs")
    heads = turns.where((F.col("pos") < HEAD) & (F.pmod("c", F.lit(FAMILY)) == 0)).select(F.col("c").alias("base"), F.col("pos").alias("d"), "label", "chars")
    shared = convs.where("head > 0").join(heads, "base").where("d <= head").select("c", "d", "label", "chars", "len")
    own = turns.where(F.col("pos") > h).join(convs, "c").select("c", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "label", "chars", "len")
    return shared.unionByName(own), convs.select("c", "len")


def _fold(before: bytes, label: bytes) -> bytes:
    return hashlib.sha256(before + label).digest()[:16]


def _starts(rows: DataFrame) -> DataFrame:
    """c, block, start: the digest of what lies before each block but the first, of the conversations that have several."""

    def fold(batches):
        now, digest = None, b""
        for batch in batches:
            c, out = batch.to_pydict(), []
            for key, label in zip(zip(c["c"], c["block"], strict=True), c["label"], strict=True):
                if key != now:
                    out += [(*now, digest)] if now else []
                    now, digest = key, b""
                digest = _fold(digest, label)
            yield _columns(out, ("c", "block", "digest"))
        if now:
            yield _columns([(*now, digest)], ("c", "block", "digest"))

    def chain(batches):
        now, start = None, b""
        for batch in batches:
            c, out = batch.to_pydict(), []
            for conv, block, digest in zip(c["c"], c["block"], c["digest"], strict=True):
                if conv != now:
                    now, start = conv, b""
                start = _fold(start, digest)
                out.append((conv, block + 1, start))
            yield _columns(out, ("c", "block", "start"))

    def _columns(out, names):
        x = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.binary())], names=list(names))

    many = rows.where(F.col("len") > BLOCK).select("c", "block", "d", "label").where((F.col("block") + 1) * BLOCK < F.col("len"))
    folded = many.repartition("c", "block").sortWithinPartitions("c", "block", "d").mapInArrow(fold, "c long, block long, digest binary")
    return folded.repartition("c").sortWithinPartitions("c", "block").mapInArrow(chain, "c long, block long, start binary")  # a row for each block


KEYED = "c long, d long, k1 long, k2 long, p1 long, p2 long, chars long, len long"


def keyed(rows: DataFrame, longest: int) -> DataFrame:
    """Rows with the names of their nodes and of the nodes above, two numbers each; the root's are 0, 0."""

    def name(batches):
        now, start, digest, above = None, b"", b"", (0, 0)
        for batch in batches:
            c = batch.to_pydict()
            names = np.empty((batch.num_rows, 4), np.int64)
            for i, (key, label, before) in enumerate(zip(zip(c["c"], c["block"], strict=True), c["label"], c["start"], strict=True)):
                if key != now:
                    now, start, digest = key, before or b"", b""
                    above = np.frombuffer(start, "<i8") if start else (0, 0)
                digest = _fold(digest, label)
                own = np.frombuffer(_fold(start, digest), "<i8")
                names[i, :2], names[i, 2:] = own, above
                above = own
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("d"), *(pa.array(names[:, i]) for i in range(4)), batch.column("chars"), batch.column("len")], names=[x.split()[0] for x in KEYED.split(", ")])

    rows = rows.withColumn("block", F.floor((F.col("d") - 1) / BLOCK))
    if longest > BLOCK:
        rows = rows.join(_starts(rows), ["c", "block"], "left")
    else:
        rows = rows.withColumn("start", F.lit(None).cast("binary"))
    rows = rows.select("c", "block", "d", "label", "start", "chars", "len")
    return rows.repartition("c", "block").sortWithinPartitions("c", "block", "d").mapInArrow(name, KEYED)


# -- nodes ---------------------------------------------------------------------------------------------------------

NODE = "k1 long, k2 long, p1 long, p2 long, conv long, depth long, n long, parent_conv long, n_children long, n_leaves long, saved long"


def _shards(light: DataFrame) -> DataFrame:
    """The tries of the buckets: light nodes with their sums."""
    names = ["bucket", "k1", "k2", "p1", "p2", "conv", "depth", "n", "chars"]

    def close(parts):
        x = {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)}
        r = rolled_up(np.stack([x["k1"], x["k2"]], 1), np.stack([x["p1"], x["p2"]], 1), x["conv"], x["n"], x["chars"])
        place, parent = r["place"], r["parent"]
        above = pa.array(x["conv"][parent], mask=parent < 0)
        return pa.RecordBatch.from_arrays([*(pa.array(x[n][place]) for n in ("k1", "k2", "p1", "p2", "conv", "depth", "n")), above, *(pa.array(r[n].astype(np.int64)) for n in ("n_children", "n_leaves", "saved"))], names=[x.split()[0] for x in NODE.split(", ")])

    def run(batches):
        now, parts = None, []
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in names]
            cuts = np.flatnonzero(np.diff(columns[0])) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                if parts and columns[0][low] != now:
                    yield close(parts)
                    parts = []
                now = columns[0][low]
                parts.append([x[low:high] for x in columns])
        if parts:
            yield close(parts)

    return light.select(*names).repartition("bucket").sortWithinPartitions("bucket", "depth").mapInArrow(run, NODE)


def _upper(heavy: DataFrame, paths: DataFrame, below: DataFrame) -> DataFrame:
    """Heavy nodes with their sums. paths: c, d, k1, k2 of the rows in heavy nodes; below: p1, p2, tops, leaves, saved of the
    shards that hang on a node."""
    inner = heavy.groupBy("p1", "p2").agg(F.count("*").alias("inner"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    own = heavy.join(inner.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "inner"), ["k1", "k2"], "left")
    own = own.join(below.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "tops", "leaves", "below_saved"), ["k1", "k2"], "left")
    own = own.withColumn("n_children", zero("inner") + zero("tops"))
    own = own.withColumns({"leaves": zero("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "own_saved": zero("below_saved") + (F.col("n") - 1) * F.col("chars")})
    own = written(own.select("k1", "k2", "p1", "p2", "conv", "depth", "n", "n_children", "leaves", "own_saved"), "heavy-own")
    # a node's share belongs to all nodes above it on its smallest member's path: sums from there on, in blocks and over blocks
    smallest = own.select(F.col("conv").alias("c"), F.col("depth").alias("d"), "leaves", "own_saved")
    on_path = paths.join(own.select(F.col("conv").alias("c")).distinct(), "c", "left_semi").join(smallest, ["c", "d"], "left").withColumn("block", F.floor(F.col("d") / BLOCK))
    on_path = written(on_path.select("c", "d", "block", "k1", "k2", zero("leaves").alias("leaves"), zero("own_saved").alias("own_saved")), "heavy-paths")
    after = Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = on_path.groupBy("c", "block").agg(F.sum("leaves").alias("l"), F.sum("own_saved").alias("s"))
    blocks = blocks.select("c", "block", F.coalesce(F.sum("l").over(after), F.lit(0)).alias("later_l"), F.coalesce(F.sum("s").over(after), F.lit(0)).alias("later_s"))
    within = Window.partitionBy("c", "block").orderBy(F.desc("d"))
    sums = on_path.withColumns({"l": F.sum("leaves").over(within), "s": F.sum("own_saved").over(within)}).join(blocks, ["c", "block"])
    sums = sums.groupBy("k1", "k2").agg(F.sum(F.col("l") + F.col("later_l")).alias("n_leaves"), F.sum(F.col("s") + F.col("later_s")).alias("saved"))
    return own.join(sums, ["k1", "k2"]).select("k1", "k2", "p1", "p2", "conv", "depth", "n", F.lit(None).cast("long").alias("parent_conv"), "n_children", "n_leaves", "saved")


def _ends(rows: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 from k1, k2, c."""

    def run(batches):
        now, digest = None, None
        for batch in batches:
            c, out = batch.to_pydict(), []
            for key, ids in zip(zip(c["k1"], c["k2"], strict=True), c["ids"], strict=True):
                if key != now:
                    out += [(*now, digest.hexdigest())] if now else []
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _ended(out)
        if now:
            yield _ended([(*now, digest.hexdigest())])

    def _ended(out):
        x = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.string())], names=["k1", "k2", "ends_sha256"])

    lists = rows.groupBy("k1", "k2", F.shiftright("c", 16).alias("range")).agg(F.sort_array(F.collect_list("c")).alias("ids"))  # 65,536 at most
    lists = lists.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    return lists.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range").select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def nodes(conversations: DataFrame, shard: int = SHARD, parts: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node. shard: see
    SHARD; parts: ranges into which the turns are sorted, else the session's shuffle partitions."""
    ship(conversations.sparkSession)
    turns, convs = rebuilt(conversations, parts)
    size = convs.agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("len").alias("longest"), F.sum("len").alias("rows"))
    root = size.first()
    rows = written(keyed(turns, root["longest"] or 0), "keyed")
    weight = F.sum(F.col("len") - F.col("d") + 1)
    tree = rows.groupBy("k1", "k2").agg(F.min("c").alias("conv"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("p1", "p2", "chars")), F.first("d").alias("depth"), weight.alias("weight"))
    tree = written(tree, "nodes")
    heavy = written(tree.where(F.col("weight") > shard), "heavy")
    paths = written(rows.join(heavy.select("k1", "k2"), ["k1", "k2"]).select("c", "d", "k1", "k2"), "heavy-rows")
    below = paths.groupBy("c").agg((F.max("d") + 1).alias("d"))
    tops = rows.join(below, ["c", "d"]).select("c", F.xxhash64("k1", "k2").alias("top"))
    tops = tops.unionByName(rows.where("d = 1").join(below.select("c"), "c", "left_anti").select("c", F.xxhash64("k1", "k2").alias("top")))
    buckets = max(1, -(-(root["rows"] or 0) // shard))
    light = tree.where(F.col("weight") <= shard).join(tops, F.col("conv") == F.col("c")).withColumn("bucket", F.pmod("top", F.lit(buckets)))
    low = written(_shards(light), "shards")
    hung = low.where("parent_conv is null").groupBy("p1", "p2").agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below_saved"))
    high = written(_upper(heavy, paths, hung), "upper")
    both = low.unionByName(high)
    first = both.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    zero = F.lit(0).cast("long")
    top = first.select(*(zero.alias(c) for c in ("k1", "k2", "p1", "p2")), F.lit(root["least"]).cast("long").alias("conv"), zero.alias("depth"), F.lit(root["n"]).cast("long").alias("n"), F.lit(None).cast("long").alias("parent_conv"), "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved"))
    # the smallest members of the nodes that heavy ones and shards hang on
    known = heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("above"))
    hanging = both.where("parent_conv is null and depth > 1").join(known, ["p1", "p2"]).withColumn("parent_conv", F.col("above")).drop("above")
    under_root = both.where("parent_conv is null and depth = 1").withColumn("parent_conv", F.lit(root["least"]).cast("long"))
    all_ = both.where("parent_conv is not null").unionByName(hanging).unionByName(under_root).unionByName(top.where(F.lit(root["n"] > 0)))
    ends = _ends(rows.where("d = len").select("k1", "k2", "c").unionByName(convs.where("len = 0").select(zero.alias("k1"), zero.alias("k2"), "c")))
    out = all_.join(ends, ["k1", "k2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
