"""Token files, piece encoding, quality scores and page extraction."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tessera.llm import extract, quality, sentencepieces, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  two  spaces ", "a<|endoftext|>b", "日本 語 Σας ΣΑΣ", "it's WE'LL 1²½_a", "\x1c a\x85b", "“quoted” – dash…", "a▁b", "😀 x😀 \x00", "é" * 70, "\n\n\t x"]


def texts_of(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_encoder_gives_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    texts = list(texts_of(spark).values()) + ODD
    encoder = tokens.WordEncoder(WORDS)
    for part in (texts[:50], texts, texts):  # the last time from what it remembers
        ids, counts = encoder.encode(part)
        want = [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert encoder.encode([])[1].tolist() == []


def test_encoder_takes_columns_and_every_character():
    encoder = tokens.WordEncoder(WORDS)
    marks = [chr(c) for c in range(1, 0x260)]
    texts = ["", " ", "\n", " \t a  b\r\n", *[f"{m}A{m}b7 {m}{m} X{m}" for m in marks], "".join(marks[31:126]), "İstanbul ǅ ẞ <|x|>"]
    column = pa.array(["not of the slice", *texts, "nor this"]).slice(1, len(texts))
    want = [e.ids for e in encoder.tok.encode_batch(texts, add_special_tokens=False)]
    for part, ids in [(column, want), *[(column.slice(i, 1), want[i:i + 1]) for i in range(0, len(texts), 9)]]:
        got, counts = encoder.encode(part)
        assert counts.tolist() == [len(w) for w in ids] and got.tolist() == [i for w in ids for i in w]


def test_encoder_beyond_its_memory(spark, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 100)
    texts = list(texts_of(spark).values())[:60]
    encoder, whole = tokens.WordEncoder(WORDS), tokens.WordEncoder(WORDS)
    for k in range(0, 60, 7):
        assert encoder.encode(texts[k:k + 7])[0].tolist() == [i for e in whole.tok.encode_batch(texts[k:k + 7], add_special_tokens=False) for i in e.ids]


def test_token_files(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    got = sorted(entry.queries()["op2_token_files"](spark, SF).collect())
    texts, start = texts_of(spark), 0
    assert [r["doc_id"] for r in got] == sorted(texts)
    for r in got:
        ids = np.array(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_format(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} " * (k % 7), "x") for k in range(400)] + [(5, None, "y"), (None, "z", "z")], "doc_id long, text string, ids string")
    tokens.write_tokens(docs, str(tmp_path / "t"), WORDS, end_id=None)
    got = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("start", "doc_id").collect()
    assert len(got) == 402 and got[0]["start"] == 0
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    seen = []
    for f, m in zip(files, meta):
        names = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for i in range(m.num_columns)}
        assert names["doc_id"].encodings and "DELTA_BINARY_PACKED" in names["doc_id"].encodings
        assert any("DICTIONARY" in e for n, c in names.items() if n.startswith("ids") for e in c.encodings)
        assert names["doc_id"].has_column_index and names["doc_id"].has_offset_index
        seen += [x for x in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert seen == sorted(seen, key=lambda x: -1 if x is None else x)
    tokens.write_tokens(docs.limit(0), str(tmp_path / "e"), WORDS)
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepieces.PieceModel(PIECES)
    rng = random.Random(4)
    known = list(model.ids)
    texts = list(texts_of(spark).values()) + ODD + [" " * k for k in range(40)]
    texts += ["".join(rng.choice("aabbeent  h \n\téß日.,12") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(known).lstrip("▁") for _ in range(rng.randint(1, 5))) for _ in range(6000)]
    ids, counts = model.encode(texts)
    want = lib.encode(texts, num_threads=1)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert all(model.decode(w) == t.replace("▁", " ") for t, w in zip(texts, want))
    assert model.decode([model.byte_ids[0xFF]]) == "�"


def test_piece_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7), (1, "a b", 5)], "doc_id long, text string, ids int")
    got = sentencepieces.decode_pieces(sentencepieces.encode_pieces(docs, PIECES), PIECES).collect()
    assert [(r["doc_id"], r["decoded"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(1, "a b"), (1, "a b"), (2, ""), (3, "")]
    assert sentencepieces.encode_pieces(docs.limit(0), PIECES).count() == 0
    assert entry.queries()["op9_sentencepiece"](spark, SF).where("NOT same").count() == 0


def test_quality(spark):
    got = entry.queries()["op5_quality_classifier"](spark, SF)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows if r["held_out"]]) > 0.9


def test_quality_learns_only_what_it_may(spark):
    docs = spark.createDataFrame([(k, ("good words here. " if k % 2 else "BAD!! BAD!! ") * 5) for k in range(60)] + [(99, None), (98, "")], "doc_id long, text string")
    told = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    lies = told.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, told), quality.fit_quality(docs, lies)
    assert np.array_equal(a, b) and np.abs(a).sum() > 0
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, a).collect()}
    assert scored[1] > 0.5 > scored[2] and scored[99] == scored[98]
    none = quality.fit_quality(docs, told.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), a).count() == 0


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header class="site"><h1>Site name. A good site.</h1></header>
<div id="cookie-notice"><p>We use cookies. This site uses cookies to give you a better experience, accept them.</p></div>
<nav><ul><li><a href=1>Home</a></li></ul></nav><main><div class="post"><h2>Title</h2><p>First   para, and it is
long.<p>Short.</p><div class="ad-box"><p>Buy now, the best thing ever made for you and all your friends.</p></div>
<p>Second &amp; third, with <a href=x>a link</a>&#33;<!-- not this --></p><ul><li>One</li><li>Two</li></ul></div>
<section class="comments"><p>I liked this long article, thank you for writing it. It was good.</p></section></main>
<aside><p>Related story number one is a long text, is it not.</p></aside><form><label>Name</label><button>Send</button></form>
<footer>&copy; someone</footer></body></html>"""


def test_main_text():
    want = "Title First para, and it is long. Short. Second & third, with a link! One Two"
    assert extract.main_text(PAGE) == want
    for html, text in (("", ""), ("just words", "just words"), ("<p>a<p>b <", "a b <"), ("<<>>&lt;", "<<>><"), ("<article><p>x</p", "x"),
                       ("<div" * 50, ""), ("<script>x", ""), ("<p>" + "y " * 50_000, ("y " * 50_000).strip())):
        assert extract.main_text(html) == text, html[:20]


def test_minimum_cut_is_minimal():
    """Against all labellings of small graphs."""
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.choice([-3, -1, -0.5, 0.4, 1, 2]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.1, 0.5, 1.5])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(labels):
            return sum(abs(s) for s, x in zip(scores, labels) if (s > 0) != x) + sum(c for i, j, c in edges if labels[i] != labels[j])

        got = extract.content_side(scores, edges)
        assert cost(got) == pytest.approx(min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n)))


def test_extraction_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, "u", "<p>Hello, you.</p>", 4), (2, "u", "<p>Hello, you.</p>", 4)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"], r["text"]) for r in extract.extract_text(pages).collect()) == [(1, ""), (2, "Hello, you."), (2, "Hello, you.")]
    assert extract.extract_text(pages.limit(0)).count() == 0
    import html as h
    import re

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in entry.queries()["op7_html_extraction"](spark, SF).collect():
        article = re.split("</article>", source[r["page_id"]].split("<article>")[1])[0]
        parts = [" ".join(h.unescape(re.sub("</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == " ".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_encode_and_check_in_one_pass(spark):
    rows = [(1, None, "x", True), (1, "two  words", "y", None), (None, "a\u2581b", "z", False), (2, "", "", None), (3, "long " * 60_000, "w", None)] + [(9, t, "", None) for t in ODD]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, same boolean")
    got = sentencepieces.encode_checked(docs, PIECES)
    assert got.columns == ["doc_id", "ids", "same"]
    want = sentencepieces.decode_pieces(sentencepieces.encode_pieces(docs.select("doc_id", "text"), PIECES), PIECES).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["ids"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert {(tuple(r["ids"]), r["same"]) for r in got.collect()} == {(tuple(r["ids"]), r["decoded"] == (r["text"] or "").replace("\u2581", " ")) for r in want}
    assert sentencepieces.encode_checked(docs.where("false"), PIECES).count() == 0
