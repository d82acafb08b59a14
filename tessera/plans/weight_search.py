"""Profiles to the weights of the best progress variable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.definition import normalise_weights
from tessera.operators.filters import columns_by_range, parsed_bounds
from tessera.operators.search import PackedIncrements, evolve_weights, monotonic_check, refine_weights, weight_bounds
from tessera.operators.sequence import (SeriesKey, delta, having_last, max_step, progress_vector, thin_monotone,
                                        with_ranges)
from tessera.operators.stats import principal_direction
from tessera.runtime import cut_lineage

SEARCH_KINDS = ("freeflame", "burnerflame")  # profiles that the search looks at (fixed values)
LAST_DISTANCE = 0.15  # wider domains are left out (fixed value)
TEMPERATURE_PATTERN = r"_Tu([0-9.]+?)(?:\\.csv)?$"


@dataclass
class WeightResult:
    species: list[str]
    weights: np.ndarray
    penalty: float
    monotonic: bool


def increments(profiles: DataFrame, key: SeriesKey, species: Sequence[str], extra: Sequence[str] = (),
               tol: float = 1e-4, thin: bool = True) -> DataFrame:
    """Increment rows of all series: ``d_<species>`` and the progress vector ``y``.

    The thinned form keeps a monotone subset of each series; the plain form takes every row and the
    largest absolute increment as progress vector.
    """
    cols = list(species)
    if not thin:
        df = max_step(profiles, key, cols, "y")
        return delta(df, key, cols).where("y is not null").select(*["d_" + c for c in cols], "y")
    ranges = {c: f"_rng_{c}" for c in extra}
    df = with_ranges(profiles, key, ranges) if extra else profiles
    kept = thin_monotone(df, key, [*cols, *extra], tol)
    got = progress_vector(kept, key, cols, extra, ranges or None)
    return got.where("y is not null").select(*["d_" + c for c in cols], "y")


def optimise_weights(profiles: DataFrame, key: SeriesKey, reactants: Sequence[str] = (), product: str | None = None,
                     extra: Sequence[str] = (), temperature: tuple[float, float] | None = None, tol: float = 1e-4,
                     popsize: int | None = None, generations: int | None = None, seed: int = 1,
                     method: str = "penalty", states: DataFrame | None = None,
                     mixture: tuple[float, float] | None = None, kinds: Sequence[str] = SEARCH_KINDS) -> WeightResult:
    """Filter profiles, pick the relevant species, search and refine the weights.

    ``method``: ``penalty`` (largest slope), ``bound`` (lower-bound gene) or ``principal`` (first
    principal component). Only profiles of the given ``kinds`` (freely propagating and burner flames) take
    part, within the ``mixture`` bounds if there are any. ``states(species, y_unburnt, y_burnt)`` rescales the result.
    """
    df = profiles.where(F.col("kind").isin(list(kinds)))
    if mixture is not None:
        df = df.where(F.col("mix_status").between(*mixture))
    if temperature is not None:
        df = parsed_bounds(df, "file", "kind", "freeflame", TEMPERATURE_PATTERN, *temperature)
    df = having_last(df, key, "Distance", LAST_DISTANCE)
    species = columns_by_range(df, [c for c in df.columns if c.startswith("Y-")])
    names = [s[2:] for s in species]
    # names with dashes are awkward in expressions: work on plain aliases
    plain = {s: f"y{i}" for i, s in enumerate(species)}
    df = df.select(*key.part, key.order, *[F.col(f"`{s}`").alias(a) for s, a in plain.items()],
                   *[F.col(f"`{c}`").alias(c) for c in extra])
    cols = list(plain.values())
    rows = cut_lineage(increments(df, key, cols, extra, tol, thin=method != "bound"))
    d_cols = ["d_" + c for c in cols]
    if method == "principal":
        w = np.array(list(principal_direction(rows, d_cols).values()))
        penalty = float("nan")
    else:
        bounds = weight_bounds(names, reactants, product)
        gene = method == "bound"
        if gene:
            bounds = [(1e-1, 1e4), *bounds]
        packed = PackedIncrements(rows, d_cols, "y")
        w, _ = evolve_weights(packed, d_cols, "y", bounds, popsize, generations, seed, bound_gene=gene)
        w, penalty = refine_weights(packed, d_cols, "y", w, bounds, bound_gene=gene)
        packed.release()
        w = w[1:] if gene else w
        w = w / np.linalg.norm(w)
    monotonic = bool(monotonic_check(rows, d_cols, w).first()["monotonic"])
    if states is not None:
        table = profiles.sparkSession.createDataFrame(list(zip(names, map(float, w))), "species string, weight double")
        scaled = {r["species"]: r["weight"] for r in normalise_weights(table, states).collect()}
        w = np.array([scaled[n] for n in names])
    return WeightResult(names, w, penalty, monotonic)
