"""Operator 9: exact similarity join on word n-grams by a prefix tree.

Two documents link if the Jaccard similarity of their sets of n-word shingles is at least `percent` per cent. The join
loses no link, and returns each document's component.

1. Every text becomes a sorted set of 64-bit shingle hashes; texts of one set are one class from here on, so copies cost
   nothing. Of each set only a head is kept: hashes are in a global order, and two sets that link must share so many
   hashes within their heads (the prefix principle with a margin).
2. Classes whose head has too few hashes in common with any other class can't link and leave. The sets of the rest are
   made again in full, and the same test is made with whole sets: a class all but 15 % of whose shingles no other
   class has leaves too. What stays are near-duplicates, for the most part.
3. The rest of each set, rarest shingle first, has a prefix of which a linked pair shares a shingle. Classes that are
   connected by prefix shingles form clusters. In a cluster of more than BLOCK classes each class is first compared with
   one other, the smallest that shares a prefix shingle (its pivot); those that link form groups. Then all classes but
   those of the largest group, in blocks, meet all classes of the cluster, in blocks: pairs within the largest group
   have nothing to add. Clusters with very many such classes are dealt by prefix shingle instead, and a pair then meets
   at its first common one. No task has more than two blocks.
4. In a task the ordered sets are stored in a trie with compressed paths. Each set walks down the trie; what it shares
   with a path is counted once for all sets below; a subtree is left as soon as the shingles that remain, the sizes
   below, or a group known already rule out a new link.
5. Links are joined to components by star contraction over tables.

Nothing that grows with the documents reaches the driver or a broadcast. Joins on a shingle meet a table that is dealt
anew for the join, so that Spark can split a shingle that very many documents have.

Defined cases: a null text is an empty one; a document without words has no shingle and links with nothing; fewer words
than n are one shingle, the whole sequence; every row is a document of its own, also those that repeat an identifier or
have none; a component is named by its smallest identifier (null if it has none); an empty table gives no rows. Very long
texts are hashed in parts. Extra columns take no part.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteql.llm.common import forget, plainly, ship, written
from graniteql.llm.components import by_other_key, components

#: Classes in a block, and blocks outside a cluster's largest group; clusters with more are dealt by shingle.
BLOCK, MOST_BLOCKS = 64, 64
#: The margin of a head, in per cent of the set.
MARGIN = 10
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_weights = _factors(4096)


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where each text's words start and end. data: UTF-8 bytes, edges: where texts do."""
    global _weights
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = edges[:-1][np.diff(edges) > 0]
    first[starts] = ~space[starts]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    letters = np.flatnonzero(~space)
    word_at = np.searchsorted(letters, begin)
    lengths = np.diff(np.r_[word_at, len(letters)])
    within = np.arange(len(letters)) - np.repeat(word_at, lengths)
    longest = int(lengths.max())
    if longest > len(_weights):
        _weights = _factors(2 * longest)
    words = np.add.reduceat((_LOWER[data[letters]].astype(np.uint64) + np.uint64(1)) * _weights[within], word_at)
    return _mix(words + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(begin, edges)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, of what word_hashes gives."""
    odd = np.uint64(0x9FB21C651E98DF25)
    grams = words[: max(0, len(words) - n + 1)].copy()
    for i in range(1, n):
        grams = grams * odd + words[i : i + len(grams)]
    grams = _mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = _mix(whole * odd + words[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _long_hashes(data: np.ndarray) -> np.ndarray:
    """The word hashes of one long text, a piece at a time; pieces end at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + AT_ONCE)
        while end < len(data):
            space = np.flatnonzero(_SPACE[data[end : end + AT_ONCE]])
            if len(space):
                end += int(space[0])
                break
            end = min(len(data), end + AT_ONCE)
        out.append(word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def sets_of(texts: pa.Array, n: int):
    """The sets of a column of texts, some at a time."""
    texts = texts.cast(pa.large_string()).fill_null("")
    size = len(texts)
    if not size:
        return
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, np.int64, size + 1, texts.offset * 8)
    low = 0
    while low < size:
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + AT_ONCE, "right")) - 1)
        high = min(high, size)
        part = edges[low : high + 1]
        raw = np.frombuffer(data, np.uint8, int(part[-1] - part[0]), int(part[0])) if part[-1] > part[0] else np.zeros(0, np.uint8)
        with np.errstate(over="ignore"):
            if len(raw) > 4 * AT_ONCE:  # one text alone
                words = _long_hashes(raw)
                yield from shingle_sets(words, np.array([0, len(words)]), n)
            else:
                yield from shingle_sets(*word_hashes(raw, part - part[0]), n)
        low = high


def least_common(size: int, percent: int) -> int:
    """Shingles that a set of this size shares with any set that it links to."""
    return -(-percent * size // 100)


def margin(size: int, percent: int) -> int:
    """Common shingles that the head of a set of this size has room for."""
    return min(least_common(size, percent), max(1, -(-MARGIN * size // 100)))


def head_length(size: int, percent: int) -> int:
    return size - least_common(size, percent) + margin(size, percent) if size else 0


def _list(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _heads(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each row: doc, print (a hash of the text), size, name (of the set), head."""

    def run(batches):
        for batch in batches:
            sets = list(sets_of(batch.column(2), n))
            sizes = [len(s) for s in sets]
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            heads = [s[: head_length(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), _list(heads)], names=["doc", "print", "size", "name", "head"])

    return docs.select("doc", F.xxhash64("text").alias("print"), "text").mapInArrow(run, "doc long, print long, size long, name binary, head array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Of class, text: the class's size and whole set."""

    def run(batches):
        for batch in batches:
            sets = list(sets_of(batch.column(1), n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _list(sets)], names=["class", "size", "items"])

    return docs.select("class", "text").mapInArrow(run, "class long, size long, items array<long>")


def _shared(items: DataFrame) -> DataFrame:
    """class, size, item, df for items (distinct in a class) that at least two classes have."""
    often = by_other_key(items, "item", lambda x: x.agg(F.count("*").alias("df"))).where("df > 1")
    return items.join(often, "item")


def _floor(size, percent: int):
    """The least margin of any set that a set of this size links to, as a column."""
    least = F.ceil(size * percent / 100.0)
    return F.least(F.ceil(least * percent / 100.0), F.greatest(F.lit(1), F.ceil(least * MARGIN / 100.0)))


class _Node:
    __slots__ = ("items", "last", "children", "low", "high", "rest", "docs", "known")


def _trie(order: list[int], sets: list[list[int]], sizes: list[int], depth: int) -> list[_Node]:
    """Nodes for sets in lexicographic order that agree up to depth."""
    out, i = [], 0
    while i < len(order):
        a = sets[order[i]]
        if len(a) == depth:  # ends here: a node without shingles
            j = i + 1
            while j < len(order) and len(sets[order[j]]) == depth:
                j += 1
            end = depth
        else:
            j = i + 1
            while j < len(order) and len(sets[order[j]]) > depth and sets[order[j]][depth] == a[depth]:
                j += 1
            b, end = sets[order[j - 1]], depth + 1  # the first and the last of a sorted range differ first
            most = min(len(a), len(b))
            while end < most and a[end] == b[end]:
                end += 1
        members, node = order[i:j], _Node()
        node.items, node.last = frozenset(a[depth:end]), a[end - 1] if end else -1
        node.low, node.high = min(sizes[m] for m in members), max(sizes[m] for m in members)
        node.rest = max(len(sets[m]) for m in members) - end
        node.docs = [m for m in members if len(sets[m]) == end]
        further = [m for m in members if len(sets[m]) > end]
        node.children = _trie(further, sets, sizes, end) if further else []
        node.known = members[0] if len(members) == 1 else None
        out.append(node)
        i = j
    return out


def tree_links(left: list[int], right: list[int], items: list[np.ndarray], sizes: list[int], percent: int, may=None, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between the sets numbered left and those numbered right, as many as connect what links connect. items:
    distinct shingles of each set, but for shingles that no other set has; sizes: with them. may(a, b): whether a
    pair belongs to this task. groups: sets of one group are connected already."""
    values, inverse, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -often))] = np.arange(len(values))
    ranks = np.split(rank[inverse], np.cumsum([len(x) for x in items])[:-1])
    sets = [np.sort(r).tolist() for r in ranks]
    first: dict[int, int] = {}
    parent = [first.setdefault(g, i) for i, g in enumerate(groups if groups is not None else range(len(items)))]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def known(node: _Node) -> int | None:
        """The component of all below, if they are of one."""
        if node.known is None:
            found = {find(d) for d in node.docs}
            for c in node.children:
                if len(found) > 1:
                    return None
                k = known(c)
                if k is None:
                    return None
                found.add(k)
            if len(found) != 1:
                return None
            node.known = found.pop()
        return find(node.known)

    roots = _trie(sorted(right, key=lambda d: sets[d]), sets, sizes, 0)
    out = []
    for q in left:
        own, own_set, size = sets[q], frozenset(sets[q]), sizes[q]
        low, high = least_common(size, percent), size * 100 // percent
        stack = [(node, 0) for node in roots]
        while stack:
            node, common = stack.pop()
            if node.high < low or node.low > high or known(node) == find(q):
                continue
            common += len(own_set & node.items)
            left_over = len(own) - _after(own, node.last)
            if (100 + percent) * (common + min(left_over, node.rest)) < percent * (size + max(node.low, low)):
                continue
            for d in node.docs:
                if d != q and 100 * common >= percent * (size + sizes[d] - common) and find(d) != find(q) and (may is None or may(q, d)):
                    parent[max(find(q), find(d))] = min(find(q), find(d))
                    out.append((q, d))
            stack += [(c, common) for c in node.children]
    return out


def _after(own: list[int], last: int) -> int:
    """How many of own come up to last."""
    low, high = 0, len(own)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if own[mid] <= last else (low, mid)
    return low


def _classes(heads: DataFrame) -> DataFrame:
    """A row for each distinct set that has shingles: class (a number), name, doc and print (of one row of it, the one
    of the smallest identifier), written."""
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "print")).alias("row")
    found = heads.where("size > 0").groupBy("name").agg(least).select("name", F.col("row.doc").alias("doc"), F.col("row.print").alias("print"))
    return written(found.withColumn("class", F.monotonically_increasing_id()), "classes")


def _near(heads: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """class, doc, print of the classes whose heads have enough in common with others."""
    same = (heads["name"] == classes["name"]) & heads["doc"].eqNullSafe(classes["doc"]) & (heads["print"] == classes["print"])
    single = heads.join(classes, same).select("class", "size", F.explode("head").alias("item"))
    met = _shared(single).groupBy("class", "size").agg(F.count("*").alias("n"))
    met = met.where(F.col("n") >= _floor(F.col("size"), percent)).select("class")
    return written(classes.select("class", "doc", "print").join(met, "class", "left_semi"), "near")


def _rest(docs: DataFrame, near: DataFrame, n: int, percent: int) -> DataFrame:
    """class, size, items, prefix of the classes whose sets have enough in common with others: the items that others
    have too, rarest first, and how many of them are the prefix."""
    few = written(near.select(*_row_key("doc", "print")[:2]).distinct(), "ids")  # small enough to be broadcast for longest
    texts = docs.select("text", *_row_key("doc", F.xxhash64("text")))
    texts = texts.join(few, ["__id", "__none"], "left_semi").groupBy(*ROW).agg(F.first("text").alias("text"))  # alike rows as one
    texts = texts.join(near.select("class", *_row_key("doc", "print")), ROW).select("class", "text")
    full = written(_sets(texts, n), "sets")
    shared = _shared(full.select("class", "size", F.explode("items").alias("item")))
    rest = shared.groupBy("class", "size").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items"))
    least = F.ceil(F.col("size") * percent / 100.0).cast("int")
    rest = rest.where(F.size("items") >= least)
    rest = written(rest.select("class", "size", F.transform("items", lambda x: x["item"]).alias("items"), (F.size("items") - least + 1).alias("prefix")), "rest")
    for table in (full, few):
        forget(table)
    return rest


#: What tells rows with different texts apart, without nulls, so that joins and groups deal alike.
ROW = ["__id", "__none", "__print"]


def _row_key(doc: str, print_: str | Column) -> list[Column]:
    return [F.coalesce(F.col(doc).cast("long"), F.lit(0)).alias("__id"), F.col(doc).isNull().alias("__none"), (F.col(print_) if isinstance(print_, str) else print_).alias("__print")]


def links(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows: doc, print, size, name of every row; classes: see _classes; and links a, b between classes, enough to
    connect all that is connected. docs: doc_id, text."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    heads = written(_heads(docs, n, percent), "heads")
    classes = _classes(heads)
    near = _near(heads, classes, percent)
    rest = _rest(docs, near, n, percent)
    forget(near)
    prefix = rest.select("class", F.explode(F.slice("items", F.lit(1), F.col("prefix"))).alias("item"))
    stars = by_other_key(prefix, "item", lambda x: x.agg(F.min("class").alias("star"), F.count("*").alias("n"))).where("n > 1").select("item", "star")
    edges = written(prefix.join(stars, "item").where("class > star").select(F.col("class").alias("a"), F.col("star").alias("b")).distinct(), "prefixes")
    clusters = components(edges)
    sizes = by_other_key(clusters, "component", lambda x: x.agg(F.count("*").alias("members")))
    clusters = clusters.join(sizes, "component")
    clustered = written(rest.join(clusters, rest["class"] == clusters["node"]).drop("node"), "clustered")
    forget(rest)
    few, many = clustered.where(F.col("members") <= BLOCK), clustered.where(F.col("members") > BLOCK)
    pivots = _pivot_links(many, edges, percent)
    small = few.select("component", F.lit(None).cast("long").alias("item"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side"), "class", "size", "items", F.col("class").alias("group"))
    met = small.unionByName(_dealt(many, pivots))
    found = written(_met(met, percent).unionByName(pivots), "links")
    for table in (clustered, edges, pivots):
        forget(table)
    return heads.select("doc", "print", "size", "name"), classes.select("class", "name", "doc", "print"), found


def _pivot_links(many: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """a, b: classes that link with their pivot, the smallest class with which they share a prefix shingle."""
    rows = many.select(F.col("class").alias("a"), F.col("size").alias("a_size"), F.col("items").alias("a_items"))
    theirs = many.select(F.col("class").alias("b"), F.col("size").alias("b_size"), F.col("items").alias("b_items"))
    pivots = by_other_key(edges, "a", lambda x: x.agg(F.min("b").alias("b")))
    met = rows.join(pivots, "a").join(theirs, "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    return written(met.where(100 * common >= percent * (F.col("a_size") + F.col("b_size") - common)).select("a", "b"), "pivots")


def _dealt(many: DataFrame, pivots: DataFrame) -> DataFrame:
    """The rows of large clusters, each sent to every tile that it is in: component, item, x, y, side, class, size,
    items, group. side 0 has a block of classes outside the largest group, side 1 a block of all classes."""
    groups = _roots(pivots)
    grouped = many.select("component", "class").join(groups.withColumnRenamed("component", "group"), many["class"] == groups["node"], "left")
    labels = _counted(grouped.select("component", "class", F.coalesce("group", "class").alias("group")), "component")
    large = labels.where(F.col("others") > BLOCK * MOST_BLOCKS).select("component", "class", "group")
    by_item = _counted(large.join(many.select("class", F.explode(F.slice("items", F.lit(1), F.col("prefix"))).alias("item")), "class"), "item")
    usual = labels.where(F.col("others") <= BLOCK * MOST_BLOCKS).withColumn("item", F.lit(None).cast("long"))
    return many.select("class", "size", "items").join(_tiles(usual.unionByName(by_item)), "class")


def _roots(pivots: DataFrame) -> DataFrame:
    """node, component: what each class's links to pivots lead to. Each step doubles the links followed; where more would
    follow, one group has several names, which costs work and no link."""
    now = pivots.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(3):
        further = now.select(F.col("node").alias("over"), F.col("component").alias("root"))
        after = written(now.join(further, now["component"] == further["over"], "left").select("node", F.coalesce("root", "component").alias("component")), "roots")
        now = after
    tops = now.select(F.col("component").alias("node"), "component").distinct().join(now.select("node"), "node", "left_anti")
    return now.unionByName(tops)


def _counted(labels: DataFrame, key: str) -> DataFrame:
    """Adds to labels (key, class, group): members of the key, others outside its largest group, and that group."""
    n = labels.groupBy(key, "group").agg(F.count("*").alias("n"))
    counts = by_other_key(n, key, lambda x: x.agg(F.sum("n").alias("members"), F.max(F.struct("n", (-F.col("group")).alias("group"))).alias("most")))
    counts = counts.select(key, "members", (F.col("members") - F.col("most.n")).alias("others"), (-F.col("most.group")).alias("largest"))
    return written(labels.join(counts, key), "labels")


def _tiles(labels: DataFrame) -> DataFrame:
    """Of labels with counts, the tiles that each class is in."""
    labels = labels.where("others > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), blocks(n)).cast("int")
    columns = ["component", "item", "x", "y", "side", "class", "group"]
    left = labels.where(F.col("group") != F.col("largest")).withColumn("y", numbers("members")).withColumn("x", own("others", 1)).withColumn("side", F.lit(0))
    right = labels.withColumn("x", numbers("others")).withColumn("y", own("members", 2)).withColumn("side", F.lit(1))
    return left.select(columns).unionByName(right.select(columns))


def _met(dealt: DataFrame, percent: int) -> DataFrame:
    """The links that each tile finds. side 2 is a small cluster as a whole."""

    def run(group: pa.Table) -> pa.Table:
        classes, sizes, sides, names = (group.column(k).to_pylist() for k in ("class", "size", "side", "group"))
        items = [np.array(x.as_py(), np.int64) for x in group.column("items")]
        item = group.column("item")[0].as_py()
        left = [i for i, s in enumerate(sides) if s != 1]
        right = [i for i, s in enumerate(sides) if s != 0]
        may = None
        if item is not None:  # dealt by shingle: a pair meets at its first common one
            heads = [frozenset(v[: v.tolist().index(item)].tolist()) for v in items]
            may = lambda a, b: heads[a].isdisjoint(heads[b])
        got = tree_links(left, right, items, sizes, percent, may, names) if left and right and len(classes) > 1 else []
        return pa.table({"a": pa.array([classes[i] for i, _ in got], pa.int64()), "b": pa.array([classes[j] for _, j in got], pa.int64())})

    return dealt.groupBy("component", "item", "x", "y").applyInArrow(run, "a long, b long")


def _named(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Adds to classes: component (the number of its smallest class)."""
    parts = components(found)
    return classes.join(parts, classes["class"] == parts["node"], "left").select(classes["*"], F.coalesce("component", "class").alias("component"))


def joined(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows, classes, found = links(docs, n, percent)
    named = _named(classes, found)
    least = by_other_key(named, "component", lambda x: x.agg(F.min("doc").alias("component_id")))
    names = named.join(least, "component").select("name", "component_id")
    alone = rows.where("size = 0").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("doc").alias("component_id"))
    linked = rows.where("size > 0").join(names, "name").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
    return linked.unionByName(alone)


def kept(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component, the one with the smallest identifier (rows without one come last; then a hash of the
    text decides, then one of the row), with its columns. Rows that repeat an identifier are documents of their own, so
    one of them goes only if it is a near copy of another row. Of rows without words, alike in identifier and text, one
    stays."""
    docs, names = plainly(docs, "doc_id", "text")
    rows, classes, found = links(docs, n, percent)
    best = by_other_key(_named(classes, found), "component", lambda x: x.agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "print")).alias("row")))
    stay = best.select(*_row_key("row.doc", "row.print")).unionByName(rows.where("size = 0").select(*_row_key("doc", "print"))).distinct()
    own = docs.select("*", *_row_key("doc_id", F.xxhash64(F.col("text").cast("string")))).join(stay, ROW)
    whole = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]  # maps have no hash
    first = F.row_number().over(Window.partitionBy(*ROW).orderBy(F.xxhash64(*whole)))
    return own.withColumn("__first", first).where("__first = 1").select(docs.columns).toDF(*names)
