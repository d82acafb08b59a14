"""Exact dedup, mixing and pseudonyms: small cases and brute force."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, compare
from tests.conftest import SF
from tessera.llm import exact, mixing, pseudonyms

DOCS = "doc_id long, text string, source string, h string"


@pytest.mark.parametrize("name", ["op1_cover_tree_topk", "op6_exact_dedup", "op8_mix_sources"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()) == "ok"


ROWS = [(1, "a", "s", "x"), (2, "a", "s", "y"), (3, None, "s", None), (4, "", None, "z"), (5, "b", "s", "z"), (2, "a", "s", "y"),
        (7, "A", "s", ""), (None, "c", "s", "q"), (None, "a", "s", "q")]


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("keep,ab,empty", [("max", 2, 4), ("min", 1, 3)])
def test_exact_groups(spark, keep, ab, empty, collide):
    docs = spark.createDataFrame(ROWS, DOCS)
    hashed = (lambda t: F.length(t).cast("string").cast("binary")) if collide else exact.content_hash
    got = exact.exact_groups(docs, keep=keep, hashed=hashed).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["text_sha256"]), []).append((r["keep_id"], r["group_size"], r["kept"]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[1, sha("a")] == [(ab, 4, ab == 1)] and by[2, sha("a")] == [(ab, 4, ab == 2)] * 2
    assert by[3, sha("")] == [(empty, 2, empty == 3)] and by[4, sha("")] == [(empty, 2, empty == 4)]
    assert by[5, sha("b")] == [(5, 1, True)] and by[7, sha("A")] == [(7, 1, True)] and by[None, sha("c")] == [(None, 1, True)]


def test_drop_copies(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = {(r["doc_id"], r["text"]) for r in exact.drop_copies(docs, keep="max").collect()}
    assert got == {(2, "a"), (4, ""), (5, "b"), (7, "A"), (None, "c")}
    assert exact.drop_copies(docs).columns == docs.columns
    assert exact.drop_copies(docs.limit(0)).count() == 0 and exact.exact_groups(docs.limit(0)).count() == 0


def test_mixing_follows_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(9).alias("copy"),
                                    F.expr("CASE WHEN id % 4 = 0 THEN 'a' WHEN id % 4 < 3 THEN 'b' ELSE NULL END").alias("source"))
    got = mixing.mix_sources(docs, {"a": 3.0, "b": 1.0, "none": 5.0}, total=80_000, seed=3)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - 60_000) < 1500 and abs(n["b"] - 20_000) < 900
    rows = got.select("doc_id", "copy", "mix_key").collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and len({r["mix_key"] for r in rows}) == len(rows)
    per = got.where("source = 'a'").groupBy("doc_id").count().agg(F.variance("count")).first()[0]
    assert 45 < per < 75  # a Poisson's variance is its mean, 60
    assert sorted(r["mix_key"] for r in rows) == sorted(r["mix_key"] for r in mixing.mix_sources(docs, {"a": 3.0, "b": 1.0, "none": 5.0}, 80_000, 3).collect())
    assert mixing.mix_sources(docs.limit(0), {"a": 1.0}).count() == 0
    assert mixing.mix_sources(docs, {"none": 1.0}).count() == 0


def test_poisson_sums(spark):
    """Counts against an inversion in plain Python."""
    import math

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    got = {r["doc_id"]: r["n"] for r in mixing.mix_sources(docs, {"a": 1.0}, 600, 5).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for d in range(300):
        u = int(hashlib.md5(f"5:{d}:0".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, p, upto = 0, math.exp(-2), math.exp(-2)
        while u >= upto:
            k += 1
            p *= 2 / k
            upto += p
        assert got.get(d, 0) == k


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    cards = ["4539578763621486", "4539 5787 6362 1486", "378282246310005", "6011-1111-1111-1117"]
    other = ["+1 (543) 555-9258", "543-21-9876", "67.190.110.215", "2024-02-29", "29.02.2024"]
    bad = ["4539578763621487", "000-12-3456", "300.1.1.1", "2023-02-29", "1.2.3.04", "12345", "v1.2.3.4.5"]
    text = "See " + ", ".join(cards + other + bad) + " end"
    docs = spark.createDataFrame([(1, text, 1), (2, "x " + cards[0] + ".", 1), (3, None, 1), (4, "", 1), (5, "no digits", 1)],
                                 "doc_id long, text string, n_replaced int")
    rows = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs, "k1").collect()}
    new = rows[1]["text"][4:-4].split(", ")
    assert len(new) == len(cards + other + bad) and rows[1]["n_replaced"] == len(cards) + len(other)
    for old, now in zip(cards, new):
        assert luhn(re.sub(r"\D", "", now)) and re.sub(r"\d", "9", old) == re.sub(r"\d", "9", now) and old != now
    assert re.sub(r"\D", "", new[0]) == re.sub(r"\D", "", new[1])  # linked whatever the separators
    assert rows[2]["text"] == "x " + new[0] + "."  # and across documents
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", new[4]) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", new[5])
    assert new[7] == "-".join(reversed(new[8].split(".")))  # one date in two forms
    assert new[len(cards + other):] == bad
    assert rows[3]["text"] is None and rows[3]["n_replaced"] == 0 and rows[4]["text"] == "" and rows[5]["text"] == "no digits"
    assert pseudonyms.pseudonymise(docs, "k2").where("doc_id = 2").first()["text"] != rows[2]["text"]


def test_pseudonyms_of_phones(spark):
    phones = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (543) 055-1352", "+1-543-555-9258", "+1.543.555.9258", "543-555-9258", "(543) 555-9258",
              "543.555.9258", "+15435559258"]
    docs = spark.createDataFrame([(1, "; ".join(phones))], "doc_id long, text string")
    row = pseudonyms.pseudonymise(docs, "k1").first()
    new = row["text"].split("; ")
    assert row["n_replaced"] == len(phones) and not set(new) & set(phones)
    assert [re.sub(r"\d", "9", x.replace("+1", "")) for x in new] == [re.sub(r"\d", "9", x.replace("+1", "")) for x in phones]
    assert all(x.startswith("+1") == y.startswith("+1") for x, y in zip(new, phones))
    assert len({re.sub(r"\D", "", x)[-10:] for x in new[3:]}) == 1 and len({re.sub(r"\D", "", x)[-10:] for x in new[:4]}) == 4


def test_pseudonyms_next_to_digits(spark):
    card = "4539578763621486"
    texts = [f"{card} 12", f"9 {card}", "4539 5787 6362 1486 124", f"{card}-12", f"{card} 12a", f"1 22 {card} 2024-05-31 7 {card}", f"{card} {card}",
             "12345 2024-05-31", "12345-2024-05-31", "2024-05-31T10:00:00Z", "12 " * 40000 + card, "1234567890123 2023-02-29"]
    docs = spark.createDataFrame([*enumerate(texts), (98, card), (99, "2024-05-31")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs, "k1").collect()}
    new = [rows[i]["text"] for i in range(len(texts))]
    c, d = rows[98]["text"], rows[99]["text"]
    assert c != card and d != "2024-05-31"
    spaced = " ".join(c[i:i + 4] for i in range(0, 16, 4))
    assert new[:10] == [f"{c} 12", f"9 {c}", f"{spaced} 124", f"{c}-12", f"{c} 12a", f"1 22 {c} {d} 7 {c}", f"{c} {c}", f"12345 {d}", f"12345-{d}",
                        f"{d}T10:00:00Z"]
    assert new[10].endswith(c) and len(new[10]) == len(texts[10]) and new[11] == texts[11]
    assert [rows[i]["n_replaced"] for i in range(10)] == [1, 1, 1, 1, 1, 3, 2, 1, 1, 1]


def test_permutation_is_one_to_one(spark):
    got = spark.range(21 * 13).select(pseudonyms.permute(F.col("id"), 21, 13, "k", "t").alias("v")).collect()
    assert sorted(r["v"] for r in got) == list(range(21 * 13))
