"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from tests.conftest import SF
from tessera.llm import bytebpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", " ", "  two  spaces \n\n x", "it's WE'LL 1²½_a 'tis", "日本 語 Σας ΣΑΣ", "\x1c a\x85b\u2028c", "😀 x😀 \x00", "é" * 700, "a" * 5000 + "b" * 3,
       "\u0558a \u16ff4 \U00011de0\U00011de11 \U0003fc2c!", "<|endoftext|>", "\t\t\tif x:\r\n", "١٢٣ 四五", "a\u0301e\u0301"]


@pytest.fixture(scope="module")
def lib():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytebpe.ByteEncoder(RANKS, PATTERN)


def parts(ids, counts):
    ends = np.cumsum(counts).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_query_gives_the_ids_of_the_library(spark, lib):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = entry.queries()["op11_byte_bpe"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_and_random_texts(lib, coder):
    rng = random.Random(3)
    chars = "ab c'stlé \n\t1!日\u0301\U0001f600\u0558\x85\xa0"
    texts = ODD + ["".join(rng.choices(chars, k=rng.randrange(60))) for _ in range(3000)]
    for _ in range(2):  # the second time from what is remembered
        assert parts(*coder.encode(texts)) == [lib.encode_ordinary(t) for t in texts]
    assert coder.encode([])[1].tolist() == []


def test_every_character_is_cut_like_the_library(lib, coder):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 61 == 0 and c < 0x20000 or c % 5003 == 0)]
    assert parts(*coder.encode(texts)) == lib.encode_ordinary_batch(texts, num_threads=4)


def test_minimal_hash(coder):
    keys = list(coder.ranks)
    table, n = coder.table, len(keys)
    lengths = np.array([len(k) for k in keys])
    flat = np.frombuffer(b"".join(keys), np.uint8)
    assert table.find(flat, np.cumsum(lengths) - lengths, lengths).tolist() == list(range(n))
    assert sorted(table.key_of.tolist()) == list(range(n))  # as many numbers as keys
    others = [k for k in {bytes(np.random.default_rng(s).integers(0, 256, 1 + s % 5).astype(np.uint8)) for s in range(3000)} if k not in coder.ranks]
    lengths = np.array([len(k) for k in others])
    assert (table.find(np.frombuffer(b"".join(others), np.uint8), np.cumsum(lengths) - lengths, lengths) == -1).all()
    with pytest.raises(ValueError, match="same 64-bit hash"):
        bytebpe.MinimalHash([b"a", b"a"])


def test_heap_alone_gives_the_merges_of_the_library(lib, coder):
    rng = random.Random(5)
    for _ in range(500):
        raw = "".join(rng.choices("etaoinéß日", k=rng.randrange(2, 40))).encode()
        if raw not in coder.ranks:
            assert coder.merge(raw) == lib._encode_single_piece(raw)


def test_beyond_what_is_remembered(lib, monkeypatch):
    monkeypatch.setattr(bytebpe, "KNOWN", 20)
    small = bytebpe.ByteEncoder(RANKS, PATTERN)
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) + "z" * 90 for k in range(8)]
    for k in range(0, 8, 3):
        assert parts(*small.encode(texts[k:k + 3])) == [lib.encode_ordinary(t) for t in texts[k:k + 3]]
    assert len(small.known) == 20


def test_columns_nulls_and_repeated_rows(spark, lib):
    rows = [(1, None, "x"), (1, "two words", "y"), (None, "two words", "z"), (2, "", None), (3, "long " * 40_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    coded = bytebpe.decode_bpe(bytebpe.encode_bpe(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    got = coded.collect()
    assert len(got) == 5
    for r in got:
        assert r["ids"] == lib.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    digest = bytebpe.bpe_digest(docs, RANKS, PATTERN)
    assert digest.count() == 5 and dict(digest.dtypes)["doc_id"] == "int"
    nothing = docs.where("false")
    assert bytebpe.encode_bpe(nothing, RANKS, PATTERN).count() == bytebpe.bpe_digest(nothing, RANKS, PATTERN).count() == 0
    lists = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert {None if r["decoded"] is None else bytes(r["decoded"]) for r in bytebpe.decode_bpe(lists, RANKS, PATTERN).collect()} == {None, b""}
