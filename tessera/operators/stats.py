"""Whole-table statistics. Every reduction combines on the map side."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut_lineage

SMALL_ROWS = 1_000_000


def column_ranges(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    aggs = [a for c in cols for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    small_rows: int = SMALL_ROWS) -> dict[str, list[float]]:
    """Exact linear-interpolation quantiles of several columns, over values that are neither NULL nor NaN.

    ``percentile`` keeps every distinct value in one reducer, so it is used only for columns of at most
    ``small_rows`` values, all of them in one job. The others are found by radix selection: the bits of a number,
    put in the order of the numbers, are settled sixteen at a time, highest first. A pass counts the next sixteen
    bits of the values that agree with a wanted rank so far, for all columns and ranks at once, so four passes
    over the table do for any number of columns, and nothing but the chosen bits reaches the driver.
    """
    df = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])
    counts = cut_lineage(_digit_counts(df, [(i, 0) for i in range(len(cols))], 0))
    rows = {r["i"]: r["n"] for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one row per column
    out: dict[str, list[float]] = {c: [float("nan")] * len(probs) for c in cols}
    few = [i for i in range(len(cols)) if 0 < rows.get(i, 0) <= small_rows]
    if few:
        got = df.agg(*[F.percentile(f"v{i}", F.array(*[F.lit(float(p)) for p in probs])) for i in few]).first()
        out.update({cols[i]: list(got[k]) for k, i in enumerate(few)})
    many = [i for i in range(len(cols)) if rows.get(i, 0) > small_rows]
    wanted = [(i, r) for i in many for r in sorted({r for p in probs for r in (int(p * (rows[i] - 1)), min(int(p * (rows[i] - 1)) + 1, rows[i] - 1))})]
    if wanted:
        at = _order_statistics(df, counts, wanted)
        for i in many:
            out[cols[i]] = []
            for p in probs:
                pos = p * (rows[i] - 1)
                k = int(pos)
                a, b = at[i, k], at[i, min(k + 1, rows[i] - 1)]
                out[cols[i]].append(a if a == b else (k + 1 - pos) * a + (pos - k) * b)  # as percentile does
    return out


DIGIT = 16  # bits settled in one pass


def _digit_counts(df: DataFrame, open_: list[tuple[int, int]], level: int) -> DataFrame:
    """``i, prefix, digit, n``: of the values of column i whose first ``level`` digits are ``prefix``, how many go on with a digit."""
    prefixes: dict[int, list[int]] = {}
    for i, prefix in sorted(set(open_)):
        prefixes.setdefault(i, []).append(prefix)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i, known in prefixes.items():
                v = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                bits = v.view(np.int64)
                key = np.where(bits < 0, ~bits, bits ^ np.int64(-1 << 63)).view(np.uint64)  # in the order of the numbers
                own = key >> np.uint64(64 - DIGIT * (level + 1))
                if level:
                    own = own[np.isin(own >> np.uint64(DIGIT), np.array(known, np.uint64))]
                found, n = np.unique(own, return_counts=True)
                parts.append((np.full(len(found), i, np.int32), found.view(np.int64), n.astype(np.int64)))
            cols = [np.concatenate(x) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "head", "n"])

    heads = df.mapInArrow(count, "i int, head long, n long").groupBy("i", "head").agg(F.sum("n").alias("n"))
    # the head of the last pass fills all 64 bits: shift without a sign
    return heads.select("i", F.shiftrightunsigned("head", DIGIT).alias("prefix"), F.col("head").bitwiseAND((1 << DIGIT) - 1).alias("digit"), "n")


def _order_statistics(df: DataFrame, counts: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The values of column i at the 0-based ranks r."""
    state = [(i, r, 0, r) for i, r in wanted]  # column, rank, digits so far, rank among the values that share them
    upto = Window.partitionBy("i", "prefix").orderBy("digit")  # 2^16 digits at most
    for level in range(64 // DIGIT):
        if level:
            counts = _digit_counts(df, [(i, prefix) for i, _, prefix, _ in state], level)
        asked = df.sparkSession.createDataFrame(state, "i int, rank long, prefix long, left long")
        ends = counts.withColumn("end", F.sum("n").over(upto))
        hit = ends.join(F.broadcast(asked), ["i", "prefix"]).where((F.col("left") < F.col("end")) & (F.col("left") >= F.col("end") - F.col("n")))
        state = [(r["i"], r["rank"], r["prefix"] << DIGIT | r["digit"], r["left"] - r["end"] + r["n"]) for r in hit.collect()]  # one row per rank
    out = {}
    for i, rank, key, _ in state:
        bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
        out[i, rank] = struct.unpack("<d", struct.pack("<Q", bits))[0]
    return out


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "minmax") -> dict[str, tuple[float, float]]:
    """(offset, scale) per column: ``minmax``, ``standard`` or ``robust``; a zero scale becomes 1."""
    if kind == "robust":
        q = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
        pairs = {c: (v[1], v[2] - v[0]) for c, v in q.items()}
    else:
        make = {"minmax": (F.min, lambda c: F.max(c) - F.min(c)), "standard": (F.avg, F.stddev_pop)}[kind]
        row = df.agg(*[a for c in cols for a in (make[0](c), make[1](c))]).first()
        pairs = {c: (float(row[2 * i]), float(row[2 * i + 1])) for i, c in enumerate(cols)}
    return {c: (o, s if s else 1.0) for c, (o, s) in pairs.items()}


def scaler_table(spark, params: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(c, o, s) for c, (o, s) in params.items()],
                                 "column string, offset double, scale double")


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and the n x n population covariance, from two passes over the table.

    Only rows in which every column has a value count. The second pass adds up products of centred columns, which
    keeps the precision that raw sums of squares lose: a matrix product per batch, one matrix per task, whose rows
    are added up on the cluster. Only the n x n matrix reaches the driver, so columns may be many.
    """
    df = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    first = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in df.columns]).first()
    n, mean = first[0], np.array([float("nan") if m is None else m for m in first[1:]], float)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) - mean
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "line"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for b in batches:
            for i, line in zip(b.column(0).to_pylist(), b.column(1)):
                line = np.frombuffer(line.as_buffer())
                lines[i] = lines[i] + line if i in lines else line
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array([v.tobytes() for v in lines.values()], pa.binary())], ["i", "line"])

    lines = df.mapInArrow(products, "i int, line binary").repartition("i").mapInArrow(added, "i int, line binary").collect()  # one row per column
    cov = np.full((len(cols), len(cols)), float("nan"))
    for r in lines:
        cov[r["i"]] = np.frombuffer(bytes(r["line"])) / n
    return n, mean, cov


def correlation_matrix(df: DataFrame, cols: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Long table ``(var_i, var_j, r)`` of Pearson correlations; NULL where a column is constant."""
    cols = [c for c in cols if c not in exclude]
    _, _, cov = moments(df, cols)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            d = float(np.sqrt(cov[i, i] * cov[j, j]))
            rows.append((a, b, float(cov[i, j]) / d if d > 0 else None))
    return df.sparkSession.createDataFrame(rows, "var_i string, var_j string, r double")


def principal_direction(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """First principal component of the min-max scaled columns.

    The sign is fixed so that the component of largest magnitude is positive.
    """
    scaler = fit_scaler(df, cols, "minmax")
    _, _, cov = moments(df, cols)
    s = np.array([scaler[c][1] for c in cols])
    values, vectors = np.linalg.eigh(cov / np.outer(s, s))
    v = vectors[:, int(np.argmax(values))]
    v = v * np.sign(v[int(np.argmax(np.abs(v)))])
    return {c: float(w) for c, w in zip(cols, v)}


def mse(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Mean squared error per output and their mean as ``mse``."""
    aggs = [F.avg((p - r) * (p - r)).alias(f"mse_{n}") for n, (p, r) in pairs.items()]
    mean = reduce(lambda a, b: a + b, [F.col(f"mse_{n}") for n in pairs]) / F.lit(float(len(pairs)))
    return df.agg(*aggs).withColumn("mse", mean)


NAN_PREDICTION = 10.0  # stands in for a NaN prediction (fixed value)


def r2(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """1 - SSres/SStot per output, with the mean of the reference taken in a first pass."""
    means = df.agg(*[F.avg(r).alias(n) for n, (_, r) in pairs.items()]).first()
    aggs = []
    for n, (p, r) in pairs.items():
        p = F.when(p.isNull() | F.isnan(p), F.lit(NAN_PREDICTION)).otherwise(p)
        res = F.sum((r - p) * (r - p))
        tot = F.sum((r - F.lit(means[n])) * (r - F.lit(means[n])))
        aggs.append((F.lit(1.0) - F.try_divide(res, tot)).alias(f"r2_{n}"))
    return df.agg(*aggs)


def auto_bounds(df: DataFrame, pairs: dict[str, Sequence[str]]) -> DataFrame:
    """Min and max of the valid states, for each named coordinate set."""
    from tessera.operators.filters import drop_invalid

    out = None
    for name, cols in pairs.items():
        part = column_ranges(drop_invalid(df, cols), cols)
        part = part.select(F.lit(name).alias("coordinates"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"{c}_min").alias("lo"), F.col(f"{c}_max").alias("hi"))
            for c in cols])).alias("r")).select("coordinates", "r.*")
        out = part if out is None else out.unionByName(part)
    return out
