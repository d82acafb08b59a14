"""Labels of equilibrium boundary rows: reactant or product side, projections and target slopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNBURNT_MARGIN = 1e-3  # tolerance on the reactant value, as a share of the scale (fixed value)


@dataclass(frozen=True)
class MixtureRefs:
    """A weighted sum at pure oxidiser, pure fuel and the stoichiometric product, with z_st."""

    oxidiser: float
    fuel: float
    stoich: float
    z_st: float


def _side(unburnt: Column, rich: Column, stoich: Column, at_unb: Column, at_rich: Column, at_lean: Column) -> Column:
    return F.when(unburnt, at_unb).when(stoich, F.lit(0.0)).when(rich, at_rich).otherwise(at_lean)


def classify_boundary(df: DataFrame, pv: str, z: str, refs: MixtureRefs, pv_scale: float) -> DataFrame:
    """Add ``is_unburnt, is_rich, is_stoich, is_lean``.

    The reactant value is linear in the mixture fraction, clamped to [0, 1].
    """
    zc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(z)))
    reactant = F.lit(refs.oxidiser) + F.lit(refs.fuel - refs.oxidiser) * zc
    return df.withColumns({
        "is_unburnt": F.col(pv) <= reactant + F.lit(UNBURNT_MARGIN * pv_scale),
        "is_rich": F.col(z) > F.lit(refs.z_st), "is_stoich": F.col(z) == F.lit(refs.z_st),
        "is_lean": ~(F.col(z) > F.lit(refs.z_st))})


def slope_targets(refs: MixtureRefs) -> Column:
    """Piecewise slope over the mixture fraction of a value that is linear on each branch."""
    return _side(F.col("is_unburnt"), F.col("is_rich"), F.col("is_stoich"),
                 F.lit(refs.fuel - refs.oxidiser), F.lit((refs.fuel - refs.stoich) / (1.0 - refs.z_st)),
                 F.lit((refs.stoich - refs.oxidiser) / refs.z_st))


def boundary_targets(df: DataFrame, row: str, pv_refs: MixtureRefs, beta_pv_refs: MixtureRefs,
                     beta_z_refs: MixtureRefs, x_scale: dict[str, float], y_scale: dict[str, float],
                     cp: str = "Cp", beta_h1: str = "Beta_Enth_Thermal", sources: tuple[str, ...] = ("ProdRateTot_PV",)) -> DataFrame:
    """Long table ``(row, constraint, variable, p_pv, p_h, p_z, target)`` of classified rows.

    ``x_scale`` holds the scales of pv, h and z; ``y_scale`` those of T, beta_pv, beta_h2 and beta_z.
    Along enthalpy most targets are zero; temperature and the formation-enthalpy scalar have slopes
    from the heat capacity; along the mixture line the diffusion scalars follow their branch slopes.
    """
    along_z = slope_targets(pv_refs) * F.lit(x_scale["z"] / x_scale["pv"])
    rows = []

    def add(constraint: str, variable: str, direction: str, target: Column) -> None:
        p = (F.lit(0.0), F.lit(1.0), F.lit(0.0)) if direction == "h" else (along_z, F.lit(0.0), F.lit(1.0))
        rows.append(F.struct(F.lit(constraint).alias("constraint"), F.lit(variable).alias("variable"),
                             p[0].alias("p_pv"), p[1].alias("p_h"), p[2].alias("p_z"),
                             target.cast("double").alias("target")))

    zero = F.lit(0.0)
    for s in sources:
        add("pv-Z", s, "z", zero)
        add("h", s, "h", zero)
    for name, refs, scale in (("Beta_ProgVar", beta_pv_refs, "beta_pv"), ("Beta_MixFrac", beta_z_refs, "beta_z")):
        add("h", name, "h", zero)
        add("pv-Z", name, "z", slope_targets(refs) * F.lit(x_scale["z"] / y_scale[scale]))
    add("h", "MolarWeightMix", "h", zero)
    add("1/cp", "Temperature", "h", F.try_divide(F.lit(x_scale["h"] / y_scale["T"]), F.col(cp)))
    add("1-beta_h1/cp", "Beta_Enth", "h",
        (F.lit(1.0) - F.try_divide(F.col(beta_h1), F.col(cp))) * F.lit(x_scale["h"] / y_scale["beta_h2"]))
    return df.select(row, F.explode(F.array(*rows)).alias("_r")).select(row, "_r.*")


def bias_shift(predictions: DataFrame, cols: list[str], sources: list[str], scale: dict[str, float]) -> DataFrame:
    """Shift of the last bias per output so that the largest boundary prediction, floored at zero,
    maps to zero; outputs that are not sources keep theirs. Long table ``(output, shift)``."""
    top = predictions.agg(*[F.greatest(F.max(c), F.lit(0.0)).alias(c) for c in cols])
    shifts = [F.struct(F.lit(c).alias("output"),
                       (-F.col(c) / F.lit(scale[c]) if c in sources else F.lit(0.0)).alias("shift")) for c in cols]
    return top.select(F.explode(F.array(*shifts)).alias("_r")).select("_r.*")
