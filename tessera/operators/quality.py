"""Comparisons of tables and consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scaling import PERCENT_GUARD, percent_error
from tessera.operators.sequence import SeriesKey, following, previous


def compare_cells(a: DataFrame, b: DataFrame, key: Sequence[str], tol_pct: float = 0.0, floor: float = 0.0) -> DataFrame:
    """Cell-wise comparison of two tables: ``(key, column, delta, ignored, failed)``.

    ``a`` is the reference. Numbers are compared as relative percent where |reference| exceeds
    ``floor``; strings must be equal; a row missing on one side fails on every column.
    """
    types = dict(a.dtypes)
    cols = [c for c in a.columns if c not in key]
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    left = a.select(*key, F.struct(*cols).alias("_a"))
    right = b.select(*key, F.struct(*cols).alias("_b"))
    both = left.join(right, list(key), "full_outer")
    cells = []
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    for c in cols:
        x, y = F.col("_a")[c], F.col("_b")[c]
        if types[c] in numeric:
            skip = F.coalesce(F.abs(x) <= floor, F.lit(False)) | F.coalesce(x == 0, F.lit(False))
            delta = F.when(~skip, F.abs(F.try_divide((x - y).cast("double"), x.cast("double"))) * 100)
            fail = F.when(skip, F.lit(False)).otherwise(
                F.coalesce(delta > tol_pct, ~x.eqNullSafe(y)))
        else:
            skip, delta, fail = F.lit(False), F.lit(None).cast("double"), ~x.eqNullSafe(y)
        cells.append(F.struct(F.lit(c).alias("column"), delta.alias("delta"), skip.alias("ignored"),
                              (missing | fail).alias("failed")))
    return both.select(*key, F.explode(F.array(*cells)).alias("_c")).select(*key, "_c.*")


def approx_compare(a: DataFrame, b: DataFrame, key: Sequence[str], tol_pct: float = 0.0, floor: float = 0.0) -> DataFrame:
    """One row: row counts, compared and ignored cells, largest delta, failures, first failing cell."""
    cells = compare_cells(a, b, key, tol_pct, floor)
    where = F.struct(*[F.col(k) for k in key], F.col("column"))
    got = cells.agg(
        F.count_if(~F.col("ignored")).alias("compared"), F.count_if("ignored").alias("ignored"),
        F.max("delta").alias("max_delta"), F.count_if("failed").alias("failed"),
        F.min(F.when(F.col("failed"), where)).alias("first"))
    return got.select(
        a.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows_a"),
        b.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows_b"),
        "compared", "ignored", "max_delta", "failed",
        *[F.col("first")[k].alias(f"first_{k}") for k in key], F.col("first.column").alias("first_column"))


def finite_difference(df: DataFrame, key: SeriesKey, x: str, value: str, out: str = "fd") -> DataFrame:
    """Central difference over neighbouring rows; NULL at the ends of a line."""
    df = previous(df, key, {x: "_x0", value: "_v0"})
    df = following(df, key, {x: "_x1", value: "_v1"})
    return df.withColumn(out, F.try_divide(F.col("_v1") - F.col("_v0"), F.col("_x1") - F.col("_x0"))).drop(
        "_x0", "_v0", "_x1", "_v1")


def finite_difference_check(df: DataFrame, key: SeriesKey, x: str, value: str, analytic: str,
                            reference: str | None = None) -> DataFrame:
    """Percent deviation of a derivative column from central differences.

    ``consistency_error`` compares the analytic derivative with the differences, ``discretisation_error``
    the differences with a reference derivative (by default the analytic one).
    """
    df = finite_difference(df, key, x, value, "_fd").where("_fd is not null")
    ref = F.col(reference or analytic)
    return df.withColumns({
        "consistency_error": percent_error(F.col(analytic), F.col("_fd"), signed_reference=False),
        "discretisation_error": percent_error(F.col("_fd"), ref, signed_reference=False)}).withColumnRenamed("_fd", "fd")


def consistency_report(checked: DataFrame, slack: float = 0.0) -> DataFrame:
    """Largest errors and whether the consistency error never exceeds the discretisation error."""
    ok = F.col("consistency_error") <= F.col("discretisation_error") + F.lit(slack)
    return checked.agg(F.count(F.lit(1)).alias("points"), F.max("consistency_error").alias("worst_consistency"),
                       F.max("discretisation_error").alias("worst_discretisation"), F.every(ok).alias("consistent"))


def identity_check(df: DataFrame, computed: Column, stored: str) -> DataFrame:
    """Largest absolute difference between a computed expression and a stored column."""
    return df.agg(F.count(F.lit(1)).alias("points"), F.max(F.abs(computed - F.col(stored))).alias("max_error"))


__all__ = ["PERCENT_GUARD", "approx_compare", "compare_cells", "consistency_report", "finite_difference",
           "finite_difference_check", "identity_check"]
