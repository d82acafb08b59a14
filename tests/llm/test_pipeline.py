"""The pipeline and its stages against brute force on small tables."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_copies import brute_components
from tessera.llm import quality


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, and what it was given."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).cache()
        out.append((name, docs, got))
        docs = got
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing to target weights", "SentencePiece"]
    for _, docs, got in stages[:-1]:
        assert got.dtypes == docs.dtypes


def test_quality_stage(spark, stages):
    _, docs, got = stages[0]
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score_quality(docs, model).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in got.collect()} == want and 0 < len(want) < docs.count()


def test_exact_stage(stages):
    _, docs, got = stages[1]
    first = {}
    for r in docs.collect():
        first[r["text"]] = min(r["doc_id"], first.get(r["text"], r["doc_id"]))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())


def test_near_stage(stages):
    _, docs, got = stages[2]
    want = brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, 5, 80)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(d for d, (_, root) in want.items() if d == root)


def test_mix_stage(stages):
    _, docs, got = stages[3]
    known = {r["doc_id"]: tuple(r) for r in docs.collect()}
    rows = got.collect()
    assert all(known[r["doc_id"]] == tuple(r) for r in rows) and abs(len(rows) - len(known)) < 6 * len(known) ** 0.5
    assert max(collections.Counter(r["doc_id"] for r in rows).values()) > 1


def test_piece_stage(stages):
    _, docs, got = stages[4]
    assert got.count() == docs.count() and got.where("NOT same OR n_ids <> size(ids)").count() == 0


def test_run(spark):
    got = entry.queries()["pipeline"](spark, SF)
    assert got.count() > 0 and got.where("NOT same").count() == 0


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows and further columns pass all stages; so does an empty table."""
    good = [(k, f"good words number {k} are here, and these are some of them. " * 3, "en", f"src{k % 3}", 10, 1) for k in range(60)]
    bad = [(100 + k, f"BAD{k}!! BAD!! STUFF!! " * 6, "en", "src1", 10, 1) for k in range(30)]
    odd = [(200, None, None, None, None, 1), (201, "", "en", "src1", 0, 2), (3, *good[3][1:]), (202, "x" * 100_000 + ". end of it, and more.", "en", "src2", 9, None)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, source string, n_chars long, copy int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id < 200").select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality")).distinct().write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.where("NOT same").count() == 0 and got.where("doc_id BETWEEN 100 AND 199").count() == 0 and got.count() > 10
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
