"""Convex hull per level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut_lineage


FEW_POINTS = 64  # a level with no more points in a batch is passed on as it is
BUCKET_ROWS = 50_000  # survivors of all levels that a task takes at once


def _distinct(points: np.ndarray) -> np.ndarray:
    """Distinct points by x, then y."""
    pts = points[np.lexsort((points[:, 1], points[:, 0]))]
    return pts[np.r_[True, (pts[1:] != pts[:-1]).any(axis=1)]] if len(pts) else pts


def _chain(points: np.ndarray) -> np.ndarray:
    """Hull vertices counter-clockwise from the lowest x (monotone chain)."""
    pts = _distinct(points)
    if len(pts) < 3:
        return pts
    halves = []
    rows = pts.tolist()  # plain numbers: a step on array rows costs ten times as much
    for seq in (rows, rows[::-1]):
        half: list[list[float]] = []
        for p in seq:
            while len(half) > 1 and ((half[-1][0] - half[-2][0]) * (p[1] - half[-2][1])
                                     - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0])) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return np.array(halves[0] + halves[1])


def _extremes(points: np.ndarray, directions: int = 64) -> np.ndarray:
    """Drop points strictly inside the polygon of the extreme points along fixed directions."""
    if len(points) <= directions:
        return points
    angles = np.linspace(0, 2 * np.pi, directions, endpoint=False)
    corner = points[np.unique(np.argmax(points @ np.stack([np.cos(angles), np.sin(angles)]), axis=0))]
    ring = _chain(corner)
    if len(ring) < 3:
        return points
    outside = np.zeros(len(points), dtype=bool)
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        cross = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
        outside |= cross <= 0
    return points[outside]


def convex_hull(df: DataFrame, level: str, x: str, y: str, group_points: int = 200_000) -> DataFrame:
    """Vertices ``(level, seq, x, y)`` of the hull of each level, counter-clockwise.

    The hull of a union is the hull of the hulls: every batch is reduced where it lies, apart from levels of
    few points in it, which take longer to reduce than to send. Levels whose survivors still exceed
    ``group_points`` are reduced again in parts before a level meets in one task, which takes a bucket of levels.
    """
    level_type = df.schema[level].dataType.simpleString()
    flat = f"level {level_type}, x double, y double"

    def reduce_levels(pdf: pd.DataFrame) -> pd.DataFrame:
        lv, xy = pdf["level"].to_numpy(), pdf[["x", "y"]].to_numpy(dtype=float)
        order = np.argsort(lv, kind="stable")
        lv, xy = lv[order], xy[order]
        starts = np.flatnonzero(np.r_[True, lv[1:] != lv[:-1]]) if len(lv) else np.zeros(0, int)
        ends = np.append(starts[1:], len(lv))
        many = np.flatnonzero(ends - starts > FEW_POINTS)
        if not len(many):
            return pdf[["level", "x", "y"]]
        few = np.repeat(ends - starts <= FEW_POINTS, ends - starts)
        kept = [(starts[i], _chain(_extremes(xy[starts[i]:ends[i]]))) for i in many]
        pts = np.concatenate([xy[few], *[p for _, p in kept]])
        whose = np.repeat([a for a, _ in kept], [len(p) for _, p in kept])
        return pd.DataFrame({"level": np.concatenate([lv[few], lv[whose]]), "x": pts[:, 0], "y": pts[:, 1]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield reduce_levels(pdf)

    def final(rows: pa.Table) -> pa.Table:
        levels = rows["level"].combine_chunks()
        codes = levels.dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        xy = np.stack([rows[c].to_numpy()[order] for c in ("x", "y")], axis=1)
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        rings = [_chain(xy[a:b]) for a, b in zip(starts, np.append(starts[1:], len(xy)))]
        sizes = [len(r) for r in rings]
        pts = np.concatenate(rings)
        return pa.table({"level": levels.take(pa.array(np.repeat(order[starts], sizes))), "seq": np.concatenate([np.arange(n) for n in sizes]),
                         "x": pa.array(pts[:, 0], from_pandas=True), "y": pa.array(pts[:, 1], from_pandas=True)})

    whole = F.col(level)
    if level_type in ("float", "double"):
        whole = whole + F.lit(0).cast(level_type)  # zeros of both signs are one level
    rows = df.select(whole.alias("level"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    left = cut_lineage(rows.mapInPandas(partial, flat))
    while True:
        sizes = left.groupBy("level").count()
        most, total = (n or 0 for n in sizes.agg(F.max("count"), F.sum("count")).first())
        if most <= group_points:
            break
        parts = -(-most // (group_points // 2))
        large = sizes.where(F.col("count") > group_points).select(F.col("level").alias("_level"))
        mine = F.col("level").eqNullSafe(F.col("_level"))
        salted = left.join(large, mine, "left_semi").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).cast("int"))
        reduced = salted.groupBy("level", "part").applyInPandas(reduce_levels, flat)
        smaller = cut_lineage(reduced.unionByName(left.join(large, mine, "left_anti")))
        again = smaller.groupBy("level").count().agg(F.max("count")).first()[0]
        left = smaller
        if again > 0.9 * most:  # nearly all points are hull vertices: the answer itself is that large
            break
    bucket = F.pmod(F.xxhash64("level"), F.lit(-(-total // BUCKET_ROWS) or 1)).alias("_bucket")
    out = left.groupBy(bucket).applyInArrow(final, f"level {level_type}, seq long, x double, y double")
    return out.withColumnRenamed("level", level)
