"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back
from tessera.llm.registry import query, table
from tessera.llm.tokens import slices

DIM = 1 << 18  # hash buckets
TRAIN_ROWS = 8_000  # labelled rows that a model is fitted on, about; chosen by hash from all that may be learned from
EPOCHS = 2
SLICE_CHARS = 1 << 20  # text whose n-grams are held at once

# rates of the updates
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4


def held_out(id_col: str = "doc_id"):
    """Whether labels of a document are kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, text by text; the first position of each text; its weight.

    A word is a run without white space. It gives two symbols: its letters in lower case, and its shape
    (letters as A or a, digits as 9, runs of one kind once). N-grams are single words and shapes, pairs of
    neighbouring shapes and pairs of neighbouring words; a word next to itself is a pair of its own kind.
    The weight of an n-gram is 1 / words, so that texts of any length have sums of like size.
    """
    import re

    import xxhash

    split = [t.split() for t in texts]
    number: dict[str, int] = {}
    put = number.setdefault
    order = np.fromiter((put(w, len(number)) for ws in split for w in ws), np.int64, sum(map(len, split)))
    bare, upper, lower, digit, twice = (re.compile(p).sub for p in (r"[\W_]+", r"[A-ZÀ-ÖØ-Þ]+", r"[a-zß-öø-ÿ]+", r"\d+", r"(.)\1+"))
    hashed = xxhash.xxh3_64_intdigest
    words = np.fromiter((hashed(bare("", w).lower().encode()) for w in number), np.uint64, len(number))[order]
    shapes = np.fromiter((hashed(twice(r"\1\1", digit("9", lower("a", upper("A", w)))).encode()) for w in number), np.uint64, len(number))[order]
    n = np.array([len(ws) for ws in split], np.int64)
    ends = np.cumsum(n)
    text = np.repeat(np.arange(len(texts)), n)
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * k2
        return (x ^ (x >> np.uint64(32))) % np.uint64(DIM)

    inner = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    pair = np.where(words[inner] == words[inner + 1], k3, words[inner] * k1 + words[inner + 1])
    grams = np.concatenate([mix(words), mix(shapes + k1), mix(shapes[inner] * k3 + shapes[inner + 1]), mix(pair ^ k2)])
    of = np.concatenate([text, text, text[inner], text[inner]])
    by = np.argsort(of, kind="stable")
    grams = grams[by].astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))[:-1]]) if len(texts) else ends
    return grams, first, 1.0 / np.maximum(n, 1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return upto[np.append(first[1:], len(values))] - upto[first]


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], state: tuple[np.ndarray, np.ndarray]) -> None:
    """One pass of updates over (buckets, values, label) rows; ``state`` holds z and n, the last place is the bias."""
    z, n = state
    for at, x, y in rows:
        w = weights(z[at], n[at])
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - step * w
        n[at] += g * g


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    small = np.abs(z) <= L1
    return np.where(small, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of all buckets and the bias, learned from labelled rows that are not held out.

    About ``train_rows`` labelled ids (all, if fewer) are chosen by hash, so the set sent to the scan of the
    documents has a known size, and a retry learns from the same rows. Ids with contradictory or null labels
    are left out. Words are hashed where the texts are; the updates, which are a sequence, run in one task
    over the chosen rows in hash order. Without labels all weights are 0 and every score is 0.5.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z"))
    share = train_rows / max(known.count(), 1)
    order = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    chosen = known.where(order < int(min(share, 1.0) * (1 << 30))).select("_id", "_y")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["_t"].tolist()
            for lo, hi in slices([len(t) for t in texts], SLICE_CHARS):
                grams, first, one = features(texts[lo:hi])
                cells = [np.unique(g, return_counts=True) for g in np.split(grams, first[1:])] if hi > lo else []
                yield pd.DataFrame({"_o": f["_o"].to_numpy()[lo:hi], "_y": f["_y"].to_numpy()[lo:hi],
                                    "_at": [np.append(a, DIM).astype(np.int32) for a, _ in cells],
                                    "_x": [np.append(c * o, 1.0).astype(np.float32) for (_, c), o in zip(cells, one)]})
            give_back()

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = [r for f in frames for r in zip(f["_at"], f["_x"], f["_y"])]
        z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
        for _ in range(EPOCHS):
            ftrl(iter(sample), (z, n))
        w = weights(z, n)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at.astype(np.int32), "w": w[at]})
        del sample
        give_back()

    sparse = (rows.withColumn("_o", order).select("_o", "_y", "_t")
              .mapInPandas(hashed, "_o long, _y int, _at array<int>, _x array<float>"))
    found = sparse.repartition(1).sortWithinPartitions("_o").mapInPandas(learn, "at int, w double").collect()  # at most DIM + 1 rows
    out = np.zeros(DIM + 1, np.float64)
    for r in found:
        out[r["at"]] = r["w"]
    return out


def score_quality(docs: DataFrame, model: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1, from the whole text alone.

    A null text counts as empty, which has the bias only. A column of the name of ``out`` is replaced; all
    others, and repeated rows, stay. The model goes to the tasks as a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for s in texts:
            rows = [t or "" for t in s.tolist()]
            parts = []
            for lo, hi in slices([len(t) for t in rows], SLICE_CHARS):
                grams, first, one = features(rows[lo:hi])
                logit = _sums(w[grams], first) * one + w[DIM]
                parts.append(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
            del rows, s
            give_back()

    udf = F.pandas_udf(score, "double")
    return docs.withColumn(out, udf(F.col(text_col)))


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
