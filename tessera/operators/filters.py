"""Row, column and partition-value filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import global_index
from tessera.runtime import cut_lineage

RANGE_TOLERANCE = 1e-5  # smallest global range of a relevant column (fixed value)
FEW_NAMES = 20_000  # folder names that are sent to the rows; more of them are joined by a shuffle


def strided_values(values: DataFrame, col: str, stride: int, by: Sequence[str] = ()) -> DataFrame:
    """Every ``stride``-th distinct value of each group, counted in string order."""
    # stored, because they are counted, sampled and sorted
    names = cut_lineage(values.select(*by, F.col(col).cast("string").alias(col)).distinct())
    names = global_index(names, [*by, col], "_rn")
    if by:
        first = names.groupBy(*by).agg(F.min("_rn").alias("_first"))
        names = names.join(first, list(by)).withColumn("_rn", F.col("_rn") - F.col("_first")).drop("_first")
    return names.where(F.col("_rn") % stride == 0).drop("_rn")


def partition_filter(df: DataFrame, folder: str, prefix: str, lo: float, hi: float, stride: int = 1,
                     ignore_bounds: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Keep the rows of the chosen mixture folders (of each kind, when ``by`` names the kind column).

    Folder names are sorted as strings, strided, and only then matched against the prefix and the
    inclusive bounds. ``ignore_bounds`` skips prefix and bounds but not the stride.
    """
    chosen = strided_values(df, folder, stride, by)
    if not ignore_bounds:
        number = F.expr(f"try_cast(substring(`{folder}`, {len(prefix) + 1}) as double)")
        chosen = chosen.where(F.col(folder).startswith(prefix) & number.between(lo, hi))
    few = chosen.count() <= FEW_NAMES  # the names are stored, so they are counted cheaply
    return df.join(F.broadcast(chosen) if few else chosen, [*by, folder], "left_semi")


def parsed_bounds(df: DataFrame, name: str, kind: str, bounded_kind: str, pattern: str, lo: float,
                  hi: float) -> DataFrame:
    """Bounds on a number parsed from the file name, applied to one kind only."""
    number = F.expr(f"try_cast(regexp_extract(`{name}`, '{pattern}', 1) as double)")
    return df.where((F.col(kind) != bounded_kind) | number.between(lo, hi))


def drop_invalid(df: DataFrame, cols: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Keep rows that are flagged valid and hold neither NULL, NaN nor an infinity."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in cols]
    if valid is not None:
        ok.append(F.coalesce(valid, F.lit(False)))
    return df.where(reduce(lambda a, b: a & b, ok))


def drop_all_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in cols]))


def half_plane(df: DataFrame, x: str, y: str, p1: tuple[float, float], p2: tuple[float, float]) -> DataFrame:
    """Keep the points on or above the line through two reference points."""
    (x1, y1), (x2, y2) = p1, p2
    line = F.lit(y1) + (F.col(x) - F.lit(x1)) * F.lit((y2 - y1) / (x2 - x1))
    return df.where(F.col(y) >= line)


def column_spans(df: DataFrame, cols: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Long table ``(column, span)`` of max - min of each column, in one pass."""
    chosen = [c for c in cols if c not in exclude]
    row = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in chosen])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("span")) for c in chosen])).alias("r")).select("r.*")


def columns_by_range(df: DataFrame, cols: Sequence[str], tol: float = RANGE_TOLERANCE,
                     exclude: Sequence[str] = ("Y-N2",)) -> list[str]:
    """Names of the columns whose global range exceeds ``tol``, in their given order (one row on the driver)."""
    spans = {r["column"]: r["span"] for r in column_spans(df, cols, exclude).collect()}
    return [c for c in cols if spans.get(c) is not None and spans[c] > tol]


def columns_except(df: DataFrame, drop: Sequence[str]) -> list[str]:
    missing = [c for c in drop if c not in df.columns]
    if missing:
        raise ValueError(f"columns not present: {', '.join(missing)}")
    return [c for c in df.columns if c not in set(drop)]
