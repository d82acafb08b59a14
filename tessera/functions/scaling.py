"""Scaling and error expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.mixture import col

# guard of the relative error (fixed value)
PERCENT_GUARD = 1e-6

Scaler = Mapping[str, tuple[float, float]]  # column -> (offset, scale)


def scale(params: Scaler, suffix: str = "") -> dict[str, Column]:
    return {c + suffix: (col(c) - F.lit(o)) / F.lit(s) for c, (o, s) in params.items()}


def unscale(params: Scaler, suffix: str = "") -> dict[str, Column]:
    """Inverse of ``scale``: reads ``<column><suffix>`` and writes the column."""
    return {c: col(c + suffix) * F.lit(s) + F.lit(o) for c, (o, s) in params.items()}


def percent_error(pred: Column, ref: Column, signed_reference: bool = True) -> Column:
    """100 |pred - ref| / (ref + guard); the other form divides by |ref| + guard."""
    denominator = (ref if signed_reference else F.abs(ref)) + F.lit(PERCENT_GUARD)
    return F.try_divide(F.lit(100.0) * F.abs(pred - ref), denominator)
