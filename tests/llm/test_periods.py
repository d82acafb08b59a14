"""Runs of words against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tessera.llm import periods


def brute(words, least=6, exponent=4):
    """Every period, every stretch of words that agree with those a period on; the smallest period of a stretch stays."""
    best, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def brute_kept(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in entry.queries()["op13_periodic_runs"](spark, SF).collect()}
    assert sorted(got) == sorted(texts) and sum(r["n_runs"] > 0 for r in got.values()) > 5
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = zlib.crc32(str(k).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = brute(words), got[k]
        longest = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (longest or (None,) * 3)
        assert r["exponent_milli"] == (longest and 1000 * longest[1] // longest[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(brute_kept(words, runs)).encode()).hexdigest()


def random_texts(rng, count):
    out = []
    for _ in range(count):
        words = []
        while rng.random() < 0.8:
            block = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
            words += (block * 9)[:rng.randrange(1, 40)] if rng.random() < 0.5 else block
        out.append(words)
    return out


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (7, 3)])
def test_random_texts(least, exponent):
    texts = random_texts(random.Random(least), 300) + [[], [0], [1] * 90, [0, 1] * 60, list(range(50)) * 4]
    for part in (texts, texts[::-1], texts[-1:], [[]], []):
        got = [[] for _ in part]
        for k, *run in zip(*[x.tolist() for x in periods.runs_of([np.array(t, np.int64) for t in part], least, exponent)]):
            got[k].append(tuple(run))
        assert got == [brute(t, least, exponent) for t in part]


def test_extensions():
    rng = random.Random(2)
    for size in (1, 2, 12, 13, 14, 200):
        seq = np.array([rng.randrange(2) for _ in range(size)] * 2 + [7], np.int64)
        at = periods.Extensions(seq)
        pairs = [(i, j) for i in range(len(seq)) for j in range(len(seq)) if i != j]
        rng.shuffle(pairs)
        i, j = np.array(pairs[:3000]).T
        want = []
        for a, b in pairs[:3000]:
            k = 0
            while max(a, b) + k < len(seq) and seq[a + k] == seq[b + k]:
                k += 1
            want.append(k)
        assert at.common(i, j).tolist() == want


def test_cover():
    v = periods.MODULUS
    assert {(a - b) % v for a in periods.COVER for b in periods.COVER} == set(range(v))


def test_nulls_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(periods, "SLICE_BYTES", 500)
    long = "a b c " * 30_000 + "end"
    rows = [(1, None, "x"), (1, "x " * 6, "y"), (None, "x x x\x0bx\tx\nx  x x", "z"), (2, "", None), (3, long, "w"), (0, "q " * 40, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = {(r["doc_id"], r["n_words"]): r for r in periods.find_runs(docs).collect()}
    assert len(got) == 6 and got[1, 0]["collapsed"] == "" and got[1, 0]["runs"] == []
    assert got[1, 6]["collapsed"] == "x" and [tuple(r) for r in got[1, 6]["runs"]] == [(0, 6, 1)]
    assert got[None, 7]["collapsed"] == "x x x"
    assert [tuple(r) for r in got[3, 90_001]["runs"]] == [(0, 90_000, 3)] and got[3, 90_001]["collapsed"] == "a b c end"
    again = periods.find_runs(docs, rewrite=lambda k, words: words[:2]).collect()
    assert max(r["n_words"] for r in again) == 2
    assert periods.run_digest(periods.find_runs(docs.where("false"))).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periods.find_runs(docs, exponent=1)
