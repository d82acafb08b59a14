"""From raw documents to token ids in five stages, each of which works on all that the one before has kept.

``run`` writes what a stage returns as Parquet in the shared folder and reads it again for the next one, so a
lost executor costs at most one stage. A null text counts as empty. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, mixing, quality, sentencepieces
from tessera.runtime import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts; it learns from ``labels`` that are not held out."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, out="_score").where("_score >= 0.5").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the smallest id stays."""
    from tessera.llm import neardup

    return neardup.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in random order."""
    return mixing.mix_sources(docs, mixing.TARGETS, seed=mixing.SEED).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and whether they decode to it."""
    import public_tokenizers

    coded = sentencepieces.encode_checked(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "same", "ids")


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage),
          ("mixing to target weights", mix_stage), ("SentencePiece", encode_stage)]

ORACLE_SQL = None  # training, near copies and pieces can't be expressed; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
