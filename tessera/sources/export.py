"""Translation of profiles to the legacy column layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.mixture import col

# legacy names and units of the scalar columns, and the prefixes of the species families (fixed values)
LEGACY_SCALARS = {
    "Distance": "Distance (m)",
    "Temperature": "T (K)",
    "Density": "rho (kg m^-3)",
    "Conductivity": "Conductivity (W/m/K)",
    "ViscosityDyn": "ViscosityDyn (kg/m/s)",
    "Cp": "cp (J/kg/K)",
    "EnthalpyTot": "Enthalpy total (J/kg)",
    "Heat_Release": "Heat release rate (W/m^3)",
    "MixtureFraction": "Mixture Fraction (-)",
}
LEGACY_FAMILIES = {
    "Y-": "Y-",
    "Y_dot_pos-": "ReacRatePos-",
    "Y_dot_neg-": "ReacRateNeg-",
    "Cp-": "cp-",
    "h-": "Enthalpy-",
    "Le-": "Le-",
}
RATE_FAMILIES = ("Y_dot_pos-", "Y_dot_neg-")


def export_projection(df: DataFrame, species: Sequence[str], molar: Mapping[str, float],
                      scalars: Mapping[str, str] = LEGACY_SCALARS, families: Mapping[str, str] = LEGACY_FAMILIES,
                      divided: Sequence[str] = RATE_FAMILIES) -> DataFrame:
    """Rename and reorder the columns; rates are divided by the molar weight of their species."""
    out = [col(c).alias(n) for c, n in scalars.items()]
    for prefix, legacy in families.items():
        for s in species:
            c = col(prefix + s)
            out.append((c / F.lit(float(molar[s])) if prefix in divided else c).alias(legacy + s))
    return df.select(*out)
