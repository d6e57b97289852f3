"""Operator 2: byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary's byte strings: a whole pre-token that is a token itself is
found by one hash, one displacement and one comparison. Tier two is for the misses: the pre-token's bytes form a
linked list, a heap holds the mergeable neighbours by rank, and merging takes the lowest rank, leftmost first.

Each Python worker remembers what it resolved, in a table of bounded size, as natural text repeats its words. The
vocabulary is of a fixed size and goes to the executors as a broadcast.

Defined cases: a null text is an empty text; an empty text has no tokens (n_tokens 0, the digests of empty strings);
a very long text is split piece by piece, in lists of a bounded length; an empty table gives no rows; repeated rows give
repeated rows; other columns are kept by `encode` and `decode` unless they have the result's
name, in which case the result replaces them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graniteql.llm.common import groups, ship
from graniteql.llm.pretokens import Known, Splitter

#: Entries in a worker's table of resolved pre-tokens.
REMEMBERED = 150_000
_M64 = (1 << 64) - 1
_GOLDEN, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash by hash and displace: keys fall into buckets; a bucket of several keys has the first
    displacement that sends them to free slots, a bucket of one key names its slot."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        if len(set(keys)) != n:
            raise ValueError("keys repeat")
        self.n, self.buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.zeros(n, np.int64)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        home = (hashes >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1, dtype=np.uint64))
        sizes = np.diff(starts)
        free = np.ones(n, bool)
        single: list[tuple[int, int]] = []
        for b in np.argsort(-sizes, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) == 1:
                single.append((int(b), int(members[0])))
            elif len(members):
                first = 0
                while True:
                    tries = np.arange(first, first + 256, dtype=np.uint64)
                    slots = self._slots(hashes[members][None, :], tries[:, None])
                    fits = free[slots].all(1)
                    for t in np.flatnonzero(fits):
                        if len(set(slots[t].tolist())) == len(members):
                            break
                    else:
                        first += 256
                        continue
                    self.shift[b] = first + int(t)
                    free[slots[t]] = False
                    self.slot_key[slots[t]] = members
                    break
        for (b, key), slot in zip(single, np.flatnonzero(free), strict=True):
            self.shift[b], self.slot_key[slot] = -int(slot) - 1, key

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (((h ^ (d * np.uint64(_GOLDEN))) * np.uint64(_ODD)) >> np.uint64(24)) % np.uint64(self.n)

    def lookup(self):
        """A function from bytes to the only slot that can hold them."""
        shift, buckets, n, digest = self.shift.tolist(), self.buckets, self.n, xxhash.xxh3_64_intdigest

        def slot(key: bytes) -> int:
            h = digest(key)
            d = shift[(h >> 32) % buckets]
            return -d - 1 if d < 0 else ((((h ^ (d * _GOLDEN & _M64)) * _ODD) & _M64) >> 24) % n

        return slot


class Codec:
    """Encodes and decodes with the ranks of a tiktoken file. Picklable; tables are built where it is used."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.pattern = pattern
        self.tokens, self.ids = [], []
        for line in vocabulary.splitlines():
            if line:
                token, rank = line.split()
                self.tokens.append(base64.b64decode(token))
                self.ids.append(int(rank))
        self.hash = PerfectHash(self.tokens)
        self._ready = False

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pattern", "tokens", "ids", "hash")} | {"_ready": False}

    def ready(self) -> Codec:
        if not self._ready:
            self.splitter = Splitter(self.pattern)
            self.slot = self.hash.lookup()
            order = self.hash.slot_key.tolist()
            self.by_slot = [(self.tokens[k], self.ids[k].to_bytes(4, "little")) for k in order]
            self.ranks = dict(zip(self.tokens, self.ids, strict=True))
            self.bytes_of = [b""] * (max(self.ids, default=-1) + 1)
            for token, i in zip(self.tokens, self.ids, strict=True):
                self.bytes_of[i] = token
            self.known = Known(REMEMBERED, self.resolve)
            self._ready = True
        return self

    def merged(self, piece: bytes) -> bytes:
        """Tier two: a heap over linked bytes."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        live, heap = [-1] * n, []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                live[i] = r
                heap.append(r << 40 | i)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFFFF, top >> 40
            if live[i] != r:
                continue  # one of the two was merged meanwhile
            j = after[i]
            end = after[i] = after[j]
            live[j] = live[i] = -1
            if end < n:
                before[end] = i
                r = ranks.get(piece[i : after[end]])
                if r is not None:
                    live[i] = r
                    heappush(heap, r << 40 | i)
            if i:
                p = before[i]
                r = ranks.get(piece[p:end])
                live[p] = -1 if r is None else r
                if r is not None:
                    heappush(heap, r << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def resolve(self, pretoken: str) -> bytes:
        raw = pretoken.encode("utf-8", "surrogatepass")
        token, packed = self.by_slot[self.slot(raw)] if self.by_slot else (None, b"")
        return packed if token == raw else self.merged(raw)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        self.ready()
        return b"".join([b"".join(map(self.known.__getitem__, part)) for part in self.splitter.parts(text or "")])

    def decode(self, packed: bytes) -> bytes:
        self.ready()
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def load(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read(), pattern)


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, object]]:
    yield from enumerate(batch.column(column))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column as an array of int."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(codec)

    def run(batches):
        own = shared.value.ready()
        for batch in batches:
            packed = [np.frombuffer(own.encode(x.as_py()), "<i4") for _, x in _pieces(batch, text)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype(np.int32)
            values = np.concatenate([*packed, np.empty(0, np.int32)])
            yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, codec: Codec, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of ids stands for; a null array gives empty bytes."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(codec)

    def run(batches):
        own = shared.value.ready()
        for batch in batches:
            out = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()) for _, x in _pieces(batch, ids)]
            yield _with(batch, text, pa.array(out, pa.binary()))

    return df.mapInArrow(run, _schema(df, text, T.BinaryType()))


def digests(df: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """Encodes a text column and decodes the ids again, and adds n_tokens, ids_sha256 and decoded_sha256 in place of
    both: the round trip stays in one pass, and neither ids nor bytes travel through the plan."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(codec)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    fields = [f for f in df.schema.fields if f.name not in names]

    def run(batches):
        own = shared.value.ready()
        for batch in batches:
            counts, a, b = [], [], []
            for _, x in _pieces(batch, text):
                packed = own.encode(x.as_py())
                counts.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(own.decode(packed)).hexdigest())
            keep = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[*keep, *names])

    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.mapInArrow(run, schema)


def tokenized(docs: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """All columns but the text, and in place of it n_tokens, ids (array of int) and round_trip: whether the decoded ids
    are the text's bytes."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(codec)
    names = ["n_tokens", "ids", "round_trip"]
    fields = [(i, f) for i, f in enumerate(docs.schema.fields) if f.name not in (*names, text)]
    at_text = docs.columns.index(text)

    def run(batches):
        own = shared.value.ready()
        for batch in batches:
            at = 0
            for part in groups(batch.column(at_text)):
                packed = [own.encode(x) for x in part]
                whole = [own.decode(p) == x.encode("utf-8", "surrogatepass") for p, x in zip(packed, part, strict=True)]
                counts = np.array([len(p) // 4 for p in packed], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                own_rows = [batch.column(i).slice(at, len(part)) for i, _ in fields]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own_rows, pa.array(counts), ids, pa.array(whole)], names=[*(f.name for _, f in fields), *names])

    schema = T.StructType([*(f for _, f in fields), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema)  # names with dots can't be given to it
