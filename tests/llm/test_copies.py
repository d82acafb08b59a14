"""Near duplicates, repeated strings, top-k search and components against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tessera.llm import neardup, repeats, topk
from tessera.llm.common import connected_components


def brute_components(texts: dict[int, str | None], words: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for d, s in sorted(sets.items()):
        for x, n in collections.Counter(o for g in s for o in by[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[x]) - n):
                a, b = sorted((top(d), top(x)))
                root[b] = a
        for g in s:
            by[g].append(d)
    return {d: (len(sets[d]), top(d)) for d in sets}


def variants(rng: random.Random) -> dict[int, str | None]:
    """Copies with a few words changed, chains of changes, a passage that many texts share, and odd rows."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts: list[str | None] = [None, "", " \t\n", "one", "ONE", "one two", "One  Two", "É x y", "é x y"]
    shared = [word() for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    for _ in range(30):
        texts.append(" ".join(shared + [word() for _ in range(rng.randint(5, 40))]))
    rng.shuffle(texts)
    return dict(enumerate(texts, 1))


@pytest.mark.parametrize("words,percent,hot,block", [(3, 85, 64, 256), (5, 80, 2, 3), (1, 50, 4, 256)])
def test_near_components(spark, words, percent, hot, block, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "NODES", block)
    texts = variants(random.Random(words))
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in neardup.near_components(docs, words, percent).collect()}
    want = brute_components(texts, words, percent)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_components_of_a_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op10_minhash_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 3, 85)


def test_near_components_odd(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in neardup.near_components(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert neardup.near_components(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in neardup.drop_near_copies(docs).collect()) == [0, 1, 1]


def test_pairs_whatever_the_order_of_keys(spark):
    nodes = [(1, 10, 1, [5, 6], [7]), (2, 10, 2, [6, 5], [7]), (3, 10, 1, [6], [8]), (4, 10, 2, [5], [8])]
    top = {5: 2, 6: 1}
    few = spark.createDataFrame([(k, *x, top[k]) for x in nodes for k in x[3]], "key long, id long, n long, root long, u array<long>, v array<long>, top long")
    assert [tuple(r) for r in neardup.across(few, 80).collect()] == [(1, 2)]


def test_connected_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


def brute_repeats(texts: dict[int, bytes], span: int) -> dict[int, tuple]:
    count = collections.Counter(t[k:k + span] for t in texts.values() for k in range(len(t) - span + 1))
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if count[t[k:k + span]] > 1:
                gone[k:k + span] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def digest(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows}


@pytest.mark.parametrize("block,piece", [(1024, 1 << 19), (2, 3000)])
def test_remove_repeats(spark, block, piece, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_LEADERS", block)
    monkeypatch.setattr(repeats, "SLICE_BYTES", piece)
    rng = random.Random(block)
    raw = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [raw(n) for n in (150, 199, 200, 201, 230, 330, 700, 2500)]
    texts = ["", "a" * 199, "a" * 200, "b" * 201, "ab" * 300, raw(500), passages[5] + passages[5]]
    for _ in range(40):
        texts.append("".join(rng.choice([raw(rng.randint(0, 300)), rng.choice(passages)[rng.randint(0, 30):], rng.choice(passages)]) for _ in range(rng.randint(1, 4))))
    texts += [raw(9000) + passages[7] + raw(3000), passages[7][:900] + raw(8000) + passages[6]]
    texts = dict(enumerate(texts, 1))
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()] + [(1000, None, 1)], "doc_id long, text string, at int")
    got = digest(repeats.remove_repeats(docs).collect())
    assert got == brute_repeats({d: t.encode() for d, t in texts.items()} | {1000: b""}, 200)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_remove_repeats_of_a_table(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op4_repeated_strings"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(texts, 200)


@pytest.mark.parametrize("leaves,block,chunk", [(128, 512, 2048), (6, 3, 7)])
def test_top_k(spark, leaves, block, chunk, monkeypatch):
    for name, value in (("LEAVES", leaves), ("QUERY_BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(leaves)
    rows = [(i, (rng.normal(size=6) * 8 + 20 * (i % 4)).astype(int).astype(float).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 480)] + [(600, None), (601, [1.0]), (602, [])]
    got = topk.top_k(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, vec array<double>, rank int"), "vec_id % 9 = 0", 5).collect()
    full = {i: np.array(list(v) + [0.0] * (6 - len(v))) for i, v in rows if v is not None}
    want = set()
    for q in full:
        if q % 9 == 0:
            best = sorted((-int(full[q] @ x), i) for i, x in full.items() if i != q)[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)


def test_top_k_odd(spark):
    kinds = "vec_id long, embedding array<double>"
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [float("inf"), 0.0]), (4, None), (20, [0.5, -0.01])], kinds)
    whole = topk.whole_vectors(rows, "embedding")
    assert {r["vec_id"]: r["vec"] for r in whole.collect() if r["vec"] is not None} == {0: [64.0, 128.0], 20: [32.0, -1.0]}
    got = topk.top_k(whole, "vec_id % 20 = 0", 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 20, 64 * 32 - 128), (20, 1, 0, 64 * 32 - 128)]
    assert topk.top_k(whole.limit(0), "vec_id % 20 = 0", 20).count() == 0
