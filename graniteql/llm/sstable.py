"""Operator 3: token ids in sorted-string-table shards.

A shard holds documents by ascending identifier. Its parts, in order:

* data blocks: entries of a prefix-compressed key and the document's packed ids; every RESTART-th entry has its whole
  key, and the block ends with the offsets of those entries, so that a key is found by binary search among them;
* the sparse index: the last key, offset and length of each block;
* a Bloom filter over the keys;
* a footer of a fixed length: where index and filter lie, documents, tokens, width of an id, a magic number.

Shards are dealt by quantiles of the identifier, so that shard n holds smaller identifiers than shard n+1, and no task
holds more than a shard. Ids of a vocabulary below 65,536 take two bytes. Writers name a file anew at each attempt and
only the successful attempt's name is returned, so that a lost executor or a second attempt never mixes files.

Defined cases: a null text is an empty text and yields the end id alone; a null identifier sorts first; repeated
identifiers lie side by side, all are kept, over several shards if they are many, and so do rows without identifier; a
very long text is encoded in parts that end where pre-tokens end; an empty table gives no shard; other columns take no
part.
"""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from graniteql.llm.common import about_chars, fresh_path, groups, ship
from graniteql.llm.pretokens import KEPT_CHARS, LATIN, LONG, _blank, _latin, pieces

MAGIC = b"GQLSST01"
FOOTER = struct.Struct("<QQQQQQI8s")
RESTART, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 16, 64 * 1024, 10, 7
#: Shards become larger rather than more than this.
MOST_SHARDS = 200_000
_SIGN = 1 << 63
#: What stands between pre-tokens that the library gets in one text.
BETWEEN = "\0"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, null first."""
    return b"\0" if doc_id is None else b"\1" + (doc_id + _SIGN).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - _SIGN


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, n: int, bits: bytearray | None = None):
        self.m = max(64, n * BLOOM_BITS)
        self.bits = bits if bits is not None else bytearray((self.m + 7) // 8)

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b = h & (2**64 - 1), h >> 64 | 1
        return [(a + i * b) % self.m for i in range(BLOOM_HASHES)]

    def add(self, key: bytes) -> None:
        for p in self._places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    """Writes one shard to a binary stream; keys come in ascending order."""

    def __init__(self, out, documents: int, width: int):
        self.out, self.width, self.bloom = out, width, Bloom(documents)
        self.at = self.documents = self.tokens = self.entries = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.block, self.restarts, self.last = bytearray(), [], b""

    def add(self, key: bytes, packed: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must not descend")
        shared = 0
        if self.entries % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        rest = key[shared:]
        self.block += _varint(shared) + _varint(len(rest)) + _varint(len(packed)) + rest + packed
        self.last, self.entries = key, self.entries + 1
        self.documents, self.tokens = self.documents + 1, self.tokens + len(packed) // self.width
        self.bloom.add(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            raw = pa.compress(raw, "zstd", asbytes=True) + struct.pack("<II", len(raw), zlib.crc32(raw))
            self.out.write(raw)
            self.index.append((self.last, self.at, len(raw)))
            self.at += len(raw)
            self.block, self.restarts, self.entries = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        self.out.write(index)
        self.out.write(bytes(self.bloom.bits))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(self.bloom.bits), self.documents, self.tokens, self.width, MAGIC))


class Reader:
    """Reads one shard from a random-access file: a point lookup reads the footer, index, filter and one block."""

    def __init__(self, file, size: int):
        self.file = file
        *where, self.documents, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, self.blocks, at = self._read(where[0], where[1]), [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            offset, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            self.blocks.append((key, offset, length))
        self.bloom = Bloom(self.documents, bytearray(self._read(where[2], where[3])))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, offset, length = self.blocks[i]
        data = self._read(offset, length)
        n, crc = struct.unpack("<II", data[-8:])
        raw = pa.decompress(data[:-8], n, "zstd", asbytes=True)
        if zlib.crc32(raw) != crc:
            raise ValueError("a block is damaged")
        count = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 * (count + 1)
        return raw[:end], list(struct.unpack(f"<{count}I", raw[end:-4]))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._entries(self._block(i)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key."""
        if key not in self.bloom:
            return []
        low, high = 0, len(self.blocks)
        while low < high:  # the first block whose last key isn't smaller
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.blocks[mid][0] < key else (low, mid)
        found: list[bytes] = []
        for i in range(low, len(self.blocks)):
            raw, restarts = self._block(i)
            a, b = 0, len(restarts) - 1
            while a < b:  # the last whole key that is smaller than this one
                mid = (a + b + 1) // 2
                a, b = (mid, b) if next(self._entries(raw, restarts[mid]))[0] < key else (a, mid - 1)
            for k, v in self._entries(raw, restarts[a]):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
        return found


class LibraryEncoder:
    """Ids by the tokenizers library. Texts of Latin letters are split by the file's own pattern first and the library
    encodes each distinct pre-token once, which gives the same ids, as its merges never cross pre-tokens. Texts that hold
    the content of an added token (the end of text, say) are given to it whole, which finds those first."""

    REMEMBERED = 900_000

    def __init__(self, json_text: str):
        self.json, self.tokenizer = json_text, None

    def __getstate__(self):
        return {"json": self.json, "tokenizer": None}

    def ready(self) -> LibraryEncoder:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            self.tokenizer, self.split, self.joined = (Tokenizer.from_str(self.json) for _ in range(3))
            added = self.tokenizer.get_added_tokens_decoder().values()
            self.added = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")
            # whether texts with added tokens can be cut at blanks between words: none has or takes such a blank
            self.cut = not any(t.lstrip or t.rstrip or _blank.search(t.content) for t in added)
            self.split.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # for single pre-tokens
            self.joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(BETWEEN), self.split.pre_tokenizer])  # for many at once
            self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
            self.bytes_of = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes_of[i] = len(token)  # the byte-level alphabet: a character for each byte
            self.known: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}
        return self

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def _packed(self, pretokens: list[str]) -> list[bytes]:
        """The packed ids of single pre-tokens. Many go to the library in one text, and the lengths of tokens in bytes
        tell where each ends; those that the text cannot hold go as a list, as do all if the lengths don't add up."""
        out: list[bytes] = []
        for i in range(0, len(pretokens), 2000):
            part = pretokens[i : i + 2000]
            text = BETWEEN.join(part)
            if text.count(BETWEEN) == len(part) - 1:
                ids = np.array(self.joined.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
                ends, want = np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)))
                at = np.searchsorted(ends, want)
                if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                    out += _cut(ids.tobytes(), ((at + 1) * self.width).tolist())
                    continue
            got = self.split.encode(part, is_pretokenized=True, add_special_tokens=False)
            packed, word = np.array(got.ids, f"<u{self.width}").tobytes(), np.array(got.word_ids)
            out += _cut(packed, [*((np.flatnonzero(word[1:] != word[:-1]) + 1) * self.width).tolist(), len(packed)])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; pre-tokens that are new to this worker go to the library in one call. When the
        table of known ones is full it becomes the older table, from which what is still in use comes back."""
        if any(len(t) > 2 * LONG for t in texts):  # one piece after another, so that lists stay short
            return [b"".join(self._short([p])[0] for p in (pieces(t) if self.cut or not self.added.search(t) else [t])) for t in texts]
        return self._short(texts)

    def _short(self, texts: list[str]) -> list[bytes]:
        parts = [_latin.findall(t) if LATIN.match(t) and not self.added.search(t) else None for t in texts]
        words = list(chain.from_iterable(p for p in parts if p))
        found = list(map(self.known.get, words))
        if None in found:
            at = [i for i, v in enumerate(found) if v is None]
            new = dict.fromkeys(words[i] for i in at)
            missing = [w for w in new if w not in self.older]
            new.update((w, self.older[w]) for w in new if w in self.older)
            new.update(zip(missing, self._packed(missing), strict=True))
            for i in at:
                found[i] = new[words[i]]
            if len(self.known) + len(new) > self.REMEMBERED:
                self.older, self.known = self.known, {}
            self.known.update((w, v) for w, v in new.items() if len(w) <= KEPT_CHARS)
        out, low = [], 0
        for t, p in zip(texts, parts, strict=True):
            out.append(self._whole(t) if p is None else b"".join(found[low : low + len(p)]))
            low += len(p or ())
        return out


def _cut(data: bytes, ends: list[int]) -> list[bytes]:
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at


def write_shards(docs: DataFrame, encoder: LibraryEncoder, end_id: int, folder: str, shard_chars: int = 64_000_000) -> list[dict]:
    """Encodes doc_id, text and writes shards into a shared folder. Returns a row for each shard, in order of the
    identifiers: path, documents, tokens, first and last key. The list is as long as there are shards."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = about_chars(docs)
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_SHARDS, max(1, math.ceil(chars / shard_chars), min(2 * deal, math.ceil(chars / 250_000))))
    at = [i / n for i in range(1, n)]
    null_first = F.coalesce("doc_id", F.lit(-_SIGN))
    bounds = np.array((docs.agg(F.percentile_approx(null_first, at, max(10_000, 20 * n))).first()[0] or []) if at else [], np.int64)
    shared = spark.sparkContext.broadcast((encoder, bounds))

    def encoded(batches):
        own, edges = shared.value[0].ready(), shared.value[1]
        end = np.array([end_id], f"<u{own.width}").tobytes()
        for batch in batches:
            ids = batch.column(0)
            packed = [x + end for part in groups(batch.column(1), 1 << 18) for x in own.encode(part)]
            known, null = ids.fill_null(-_SIGN).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(edges, known, side) for side in ("left", "right"))
            low = np.where((known == -_SIGN) & ~null, np.maximum(low, high - 1), low)  # after all null ones
            # an identifier so frequent that it is several bounds has several shards; a hash of the ids chooses
            shard = low + np.array([zlib.crc32(x) for x in packed], np.int64) % np.maximum(1, high - low)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, pa.array(packed, pa.binary())], names=["shard", "doc_id", "packed"])

    def stored(group: pa.Table) -> pa.Table:
        own = shared.value[0].ready()
        keys = [key_of(x) for x in group.column("doc_id").to_pylist()]
        values = group.column("packed").combine_chunks()
        values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
        path = f"{folder}/shard-{group.column('shard')[0].as_py():08d}-{uuid.uuid4().hex}.sst"
        fs, place = _opened(path)
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(place) as out:
            w = Writer(out, len(keys), own.width)
            repeated = len(set(keys)) < len(keys)  # then the ids decide, so that reruns agree
            for i in sorted(range(len(keys)), key=lambda i: (keys[i], values[i].as_py() if repeated else b"")):
                w.add(keys[i], values[i].as_py())
            w.close()
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "path": [path], "documents": pa.array([w.documents], pa.int64()), "tokens": pa.array([w.tokens], pa.int64()), "first": pa.array([min(keys)], pa.binary()), "last": pa.array([w.last], pa.binary())})

    dealt = docs.mapInArrow(encoded, "shard int, doc_id long, packed binary")
    rows = dealt.groupBy("shard").applyInArrow(stored, "shard int, path string, documents long, tokens long, first binary, last binary").collect()
    return [r.asDict() | {k: bytes(r[k]) for k in ("first", "last")} for r in sorted(rows, key=lambda r: r["shard"])]


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32. Tokens of the shards before a shard count into start."""
    ship(spark)
    rows, start = [], 0
    for s in shards:
        rows.append((s["path"], start))
        start += s["tokens"]

    def read(frames):
        for frame in frames:
            for path, at in frame.itertuples(index=False):
                fs, place = _opened(path)
                with fs.open_input_file(place) as file:
                    shard, out = Reader(file, file.size()), []
                    for key, packed in shard.scan():
                        ids = np.frombuffer(packed, f"<u{shard.width}").astype("<u4")
                        out.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _frame(out)
                            out = []
                    yield _frame(out)

    tasks = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    paths = spark.createDataFrame(rows, "path string, start long").repartition(tasks)
    return paths.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({k: pd.array([r[i] for r in rows], "Int64") for i, k in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))})


def lookup(shards: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document: one for each row of a repeated identifier. Bisects the shards' key ranges and opens those
    that can hold it, one unless an identifier is spread; a shard's filter spares reading its blocks."""
    found: list[np.ndarray] = []
    key = key_of(doc_id)
    for s in shards[bisect_left(shards, key, key=lambda s: s["last"]) :]:
        if s["first"] > key:
            break
        fs, place = _opened(s["path"])
        with fs.open_input_file(place) as file:
            r = Reader(file, file.size())
            found += [np.frombuffer(v, f"<u{r.width}").astype(np.int64) for v in r.get(key)]
    return found


def new_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "sstable")
