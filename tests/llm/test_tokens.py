"""Operators 2, 3: exact against the public libraries, and round trips."""

import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graniteql.llm import bpe, queries, sstable

from ..conftest import SMALL


@pytest.fixture(scope="module")
def codec():
    return bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_perfect_hash_is_minimal_and_perfect(codec):
    slot = codec.hash.lookup()
    assert sorted(map(slot, codec.tokens)) == list(range(len(codec.tokens)))


@given(st.sets(st.binary(max_size=6), max_size=200))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_of_any_keys(keys):
    keys = sorted(keys)
    if keys:
        h = bpe.PerfectHash(keys)
        assert sorted(map(h.lookup(), keys)) == list(range(len(keys)))
        assert [h.slot_key[h.lookup()(k)] for k in keys] == list(range(len(keys)))


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encodes_as_the_library(codec, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert ids == packed(library.encode_ordinary(text))
    assert codec.decode(ids) == text.encode()


def test_op2(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op2_byte_bpe"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = packed(library.encode_ordinary(docs[r["doc_id"]]))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_odd_documents(spark, codec, library, odd, odd_rows, empty):
    out = bpe.encode(odd, codec)
    assert out.columns.count("ids") == 1
    want = sorted((r[0] or 0, tuple(library.encode_ordinary(r[1] or ""))) for r in odd_rows)
    assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in out.collect()) == want
    back = bpe.decode(out, codec).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    made = bpe.tokenized(odd, codec)
    assert "text" not in made.columns and all(r["round_trip"] for r in made.collect())
    for f in (bpe.encode, bpe.digests, bpe.tokenized):
        assert f(empty, codec).count() == 0


def test_known_words_are_forgotten_in_turns(codec, library, monkeypatch):
    small = bpe.Codec.__new__(bpe.Codec)
    small.__dict__ |= codec.__getstate__()
    small.ready().known.most = 5
    for text in ("a b c d e f g h i j k a b c", "xyzzyq " * 50 + "plugh", "q" * 100):
        assert small.encode(text) == packed(library.encode_ordinary(text))
    assert len(small.known) <= 5


@pytest.fixture(scope="module")
def encoder():
    with open(P.path("byte_bpe_50k.json")) as f:
        return sstable.LibraryEncoder(f.read())


def whole(text):
    return Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def check_shards(rows, got):
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = packed([*whole(text or ""), 2])
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_op3(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_shards(rows, queries.QUERIES["op3_sstable"](spark, SMALL).collect())


def test_odd_shards(spark, encoder, odd, odd_rows, empty):
    shards = sstable.write_shards(odd, encoder, 2, sstable.new_folder(spark), shard_chars=20_000)
    assert len(shards) > 1
    check_shards([r[:2] for r in odd_rows], sstable.read_shards(spark, shards).collect())
    assert [x.tolist() for x in sstable.lookup(shards, 3)] == [[*whole("one"), 2]]
    assert len(sstable.lookup(shards, 5)) == 2 and len(sstable.lookup(shards, None)) == 1 and sstable.lookup(shards, 99) == []
    none = sstable.write_shards(empty, encoder, 2, sstable.new_folder(spark))
    assert none == [] and sstable.read_shards(spark, none).count() == 0


@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.binary(max_size=60).map(lambda b: b[: len(b) // 2 * 2])), max_size=60))
@settings(max_examples=60, deadline=None)
def test_shard_round_trip_and_lookup(entries):
    entries.sort()
    out = io.BytesIO()
    writer = sstable.Writer(out, len(entries), 2)
    for k, v in entries:
        writer.add(sstable.key_of(k), v)
        if len(writer.block) > 100:
            writer._flush()
    writer.close()
    reader = sstable.Reader(out, out.tell())
    assert [(sstable.id_of(k), v) for k, v in reader.scan()] == entries
    for k, _ in entries:
        assert sorted(reader.get(sstable.key_of(k))) == sorted(v for x, v in entries if x == k)
    assert reader.get(sstable.key_of(12345)) == [v for x, v in entries if x == 12345]


def test_keys_must_ascend():
    writer = sstable.Writer(io.BytesIO(), 2, 2)
    writer.add(sstable.key_of(5), b"")
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(4), b"")


def test_frequent_identifier_has_several_shards(spark, encoder):
    rows = [(7 if i % 2 else i, f"text number {i} " * 20) for i in range(120)]
    shards = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), encoder, 2, sstable.new_folder(spark), shard_chars=3000)
    got = sstable.read_shards(spark, shards).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    assert max(s["documents"] for s in shards) < 30 and len(sstable.lookup(shards, 7)) == 60


def test_rows_without_identifier_are_spread(spark, encoder):
    rows = [(None if i % 3 == 0 else -(2**63) if i == 1 else i, f"text number {i} " * 20) for i in range(120)]
    shards = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), encoder, 2, sstable.new_folder(spark), shard_chars=3000)
    got = sstable.read_shards(spark, shards).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert max(s["documents"] for s in shards) < 30 and len(sstable.lookup(shards, None)) == 40
    assert all(s["first"] <= s["last"] for s in shards) and all(a["last"] <= b["first"] for a, b in zip(shards, shards[1:], strict=False))


def test_lookup_opens_only_shards_that_can_hold_it(spark, encoder, monkeypatch):
    rows = [(i, f"text number {i} " * 20) for i in range(120)]
    shards = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), encoder, 2, sstable.new_folder(spark), shard_chars=3000)
    opened, real = [], sstable._opened
    monkeypatch.setattr(sstable, "_opened", lambda path: opened.append(path) or real(path))
    assert len(shards) > 5 and [len(sstable.lookup(shards, i)) for i in (0, 60, 119, 500)] == [1, 1, 1, 0]
    assert len(opened) == 3


def test_pretokens_that_hold_the_separator(encoder):
    own = encoder.ready()
    words = [" a", "\0", "b\0c", " é", "\0\0", " words"]
    assert own._packed(words) == [own._packed([w])[0] for w in words]
    text = "some\0 words \0\0 and more"
    assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == whole(text)


def test_known_pretokens_are_forgotten_in_turns(encoder, monkeypatch):
    own = sstable.LibraryEncoder(encoder.json).ready()
    monkeypatch.setattr(own, "REMEMBERED", 5, raising=False)
    for text in ("a b c d e f g h i j k a b c", "xyzzyq " * 50 + "plugh", "q" * 100, "a b c"):
        assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == whole(text)


def test_long_texts_are_cut_where_pretokens_end(encoder):
    from graniteql.llm import pretokens

    text = "Some words, 'tis 12 of  them\n\tand é more words " * 40 + "x" * 300
    parts = list(pretokens.pieces(text, 50))
    assert len(parts) > 10 and "".join(parts) == text
    assert b"".join(encoder.ready().encode([p])[0] for p in parts) == encoder.encode([text])[0]
    assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == whole(text)


def test_added_tokens_are_the_library_s(spark, encoder, monkeypatch):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"one{end}two", end, f" {end} {end}{end}\n", f"日本 {end} é", "<|endoftext", f"it's {end}'s 12", "one two"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0].count(50256) == 1
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.ready().encode(texts)] == want
    shards = sstable.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), encoder, 2, sstable.new_folder(spark))
    at = 0
    for r, ids in zip(sstable.read_shards(spark, shards).orderBy("doc_id").collect(), want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) + 1, zlib.crc32(packed([*ids, 2])))
        at += len(ids) + 1
    from graniteql.llm import pretokens

    monkeypatch.setattr(sstable, "LONG", 50)
    monkeypatch.setattr(sstable, "pieces", lambda t: pretokens.pieces(t, 50))
    long = f"Some words {end} of them {end}more words " * 40
    assert np.frombuffer(encoder.encode([long])[0], "<u2").tolist() == library.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("rstrip", [False, True])
def test_added_tokens_with_blanks(monkeypatch, rstrip):
    from tokenizers import AddedToken

    from graniteql.llm import pretokens

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.add_tokens([AddedToken("end of it", rstrip=rstrip, normalized=False)])
    own = sstable.LibraryEncoder(library.to_str()).ready()
    monkeypatch.setattr(sstable, "LONG", 20)
    monkeypatch.setattr(sstable, "pieces", lambda t: pretokens.pieces(t, 20))
    for text in ("the end of it and more", "some words at the end of it  some words " * 20):
        assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
