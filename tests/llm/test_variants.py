"""Spelling variants against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tessera.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_pairs(words):
    return {(a, b) for a in words for b in words if one_edit(a, b)}


def found_pairs(spark, words, **how):
    rows = variants.near_words(spark.createDataFrame([(w,) for w in words], "word string"), **how).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def random_words(seed, count, letters="abÀ", most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randrange(1, most))) for _ in range(count)})


def test_wavelet():
    rng = np.random.default_rng(1)
    for symbols in (2, 3, 9, 33):
        seq = rng.integers(0, symbols, 200)
        w = variants.Wavelet(seq, symbols)
        lo = rng.integers(0, 200, 400)
        hi = np.array([rng.integers(a, 201) for a in lo])
        c = rng.integers(0, symbols, 400)
        start, size, less = w.narrow(lo, hi - lo, c)
        for k in range(400):
            part = seq[lo[k]:hi[k]]
            assert (start[k], size[k], less[k]) == ((seq < c[k]).sum() + (seq[:lo[k]] == c[k]).sum(), (part == c[k]).sum(), (part < c[k]).sum())
        own, symbol, start, size, less = w.narrow_all(lo, hi - lo)
        got = collections.Counter(zip(own.tolist(), symbol.tolist()))
        assert set(got) == {(k, x) for k in range(400) for x in set(seq[lo[k]:hi[k]].tolist())} and max(got.values()) == 1
        again = w.narrow(lo[own], (hi - lo)[own], symbol)
        assert all((x == y).all() for x, y in zip((start, size, less), again))


def test_index_keeps_both_sides_in_step():
    words = random_words(4, 60)
    index = variants.WordIndex(words)
    head = np.array([len(w) // 2 for w in words])
    tail = np.array([len(w) - len(w) // 2 for w in words])
    nought = np.zeros(len(words), np.int64)
    got = set()
    for h, t in ((head, nought), (nought, tail)):
        place, number = index.near(words, h, t)
        got |= {(words[p], words[n]) for p, n in zip(place.tolist(), number.tolist())}
    assert got == {(a, b) for a, b in brute_pairs(words) if len(b) <= len(a)}
    assert variants.WordIndex(["zz"]).near(["qq", "z"], np.array([1, 0]), np.array([0, 0]))[0].tolist() == []


@pytest.mark.parametrize("how", [{}, {"shard_chars": 50}, {"group": 3}, {"group": 2, "shard_chars": 10}])
def test_near_words(spark, how):
    words = random_words(7, 220) + ["prefixed" + c for c in "abcdefghij"] + [c + "suffixed" for c in "abcdefghij"]
    words += ["thequickbrown" + a + b for a in "xyz" for b in "xyz"] + ["日本語", "日本", "", "é"]
    assert found_pairs(spark, words, **how) == brute_pairs(words)


def test_query_by_brute_force(spark):
    got = {r["word"]: r for r in entry.queries()["op12_spelling_variants"](spark, SF).collect()}
    count = collections.Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            count[w if h % 199 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    assert set(got) == set(n)
    near = collections.defaultdict(list)
    cut = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1:]].add(w)
    for rest, group in cut.items():
        group = group | ({rest} & set(n))
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    for w, r in got.items():
        others = sorted(set(near[w]), key=lambda x: (-n[x], x))
        form = others[0] if others and n[others[0]] >= 5 * n[w] else None
        assert (r["n"], r["n_near"], r["form"], r["form_n"]) == (n[w], len(others), form, form and n[form])
        root = w
        while got[root]["form"]:
            root = got[root]["form"]
        assert r["root"] == root
    assert any(r["form"] for r in got.values())


def test_chains_ties_and_empty_tables(spark):
    counts = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "zzzzzz": 4, "zzzzzy": 20, "zzzzyz": 20}
    got = {r["word"]: r for r in variants.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["aaaaaa"]["root"] == "abbbbb" and got["aaaabb"]["form"] == "aaabbb" and got["abbbbb"]["form"] is None
    assert got["zzzzzz"]["form"] == "zzzzyz" and got["zzzzzz"]["n_near"] == 2 and got["zzzzyz"]["root"] == "zzzzyz"
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_forms(empty).count() == variants.near_words(empty).count() == 0
    with pytest.raises(ValueError, match="circles"):
        variants.spelling_forms(empty, ratio=1)


def test_counting(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 3)
    monkeypatch.setattr(variants, "SLICE_BYTES", 40)
    rows = [(1, "Éclair ÉCLAIR éclairs-abcdef abc×def", "x"), (1, "abcdef ABCDEF Abcdefg", "y"), (None, "abcdef\x00abcdef", "z"), (2, None, ""), (3, "", ""), (4, "q" * 300_000, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, word string")
    got = {r["word"]: r["n"] for r in variants.count_words(docs, count=1).collect()}
    assert got == {"Éclair": 2, "éclairs": 1, "abcdef": 5, "abc×def": 1, "abcdefg": 1, "q" * 300_000: 1}
    assert {r["word"] for r in variants.count_words(docs, count=5).collect()} == {"abcdef"}
    assert variants.count_words(docs.where("false")).count() == 0
    long = "ab" * 3000
    assert found_pairs(spark, [long, long + "c", long[:-1] + "c"]) == brute_pairs([long, long + "c", long[:-1] + "c"])
