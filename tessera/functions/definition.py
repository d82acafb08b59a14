"""Small species tables: default weights, mixture-fraction coefficients, fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# atomic weights and the element factors of the mixture fraction (fixed values)
ATOMIC_WEIGHT = {"C": 12.011, "H": 1.008, "O": 15.999}
ELEMENT_FACTOR = {"C": 2.0 / 12.011, "H": 1.0 / (2.0 * 1.008), "O": -1.0 / 15.999}


def default_weights(roles: DataFrame, species: str = "species", role: str = "role",
                    molar: str = "molar_weight", diluent: str = "N2") -> DataFrame:
    """-1/W for reactants other than the diluent, +1/W for the major product, scaled to sum |w| = 1."""
    raw = (F.when((F.col(role) == "reactant") & (F.col(species) != diluent), F.lit(-1.0) / F.col(molar))
           .when(F.col(role) == "product", F.lit(1.0) / F.col(molar)))
    signed = roles.withColumn("_w", raw).where("_w is not null")
    norm = signed.agg(F.sum(F.abs("_w")).alias("_norm"))
    return signed.select(species, (F.col("_w") / norm.scalar()).alias("weight"))


def bilger_coefficients(composition: DataFrame, molar: DataFrame, fuel: DataFrame, oxidiser: DataFrame) -> DataFrame:
    """Mixture-fraction coefficient of every species and the shared constant ``z_c``.

    ``composition(species, element, n)``, ``molar(species, molar_weight)``, and the mass fractions
    ``(species, y)`` of pure fuel and pure oxidiser.
    """
    factor = F.when(F.lit(False), F.lit(0.0))
    for e in ATOMIC_WEIGHT:
        factor = factor.when(F.col("element") == e, F.lit(ELEMENT_FACTOR[e] * ATOMIC_WEIGHT[e]))
    w = (composition.join(molar, "species")
         .groupBy("species").agg(F.sum(factor.otherwise(0.0) * F.col("n") / F.col("molar_weight")).alias("w")))

    def beta(stream: DataFrame, name: str) -> DataFrame:
        return stream.join(w, "species").agg(F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0.0)).alias(name))

    ends = w.withColumn("_f", beta(fuel, "_f").scalar()).withColumn("_o", beta(oxidiser, "_o").scalar())
    span = F.col("_f") - F.col("_o")
    return ends.select("species", (F.col("w") / span).alias("z"), (-F.col("_o") / span).alias("z_c"))


def normalise_fractions(parts: DataFrame, name: str = "species", value: str = "part") -> DataFrame:
    """Fractions that sum to one; negative parts are refused when the query runs."""
    checked = parts.withColumn("_v", F.when(F.col(value) < 0, F.raise_error(
        F.concat(F.lit("negative part for "), F.col(name).cast("string"))).cast("double")).otherwise(F.col(value)))
    norm = checked.agg(F.sum("_v").alias("_sum"))
    return checked.select(name, (F.col("_v") / norm.scalar()).alias("fraction"))


def normalise_weights(weights: DataFrame, states: DataFrame) -> DataFrame:
    """Divide all weights by the change of the weighted sum from the unburnt to the burnt state.

    ``weights(species, weight)``, ``states(species, y_unburnt, y_burnt)``.
    """
    change = weights.join(states, "species").agg(
        F.sum(F.col("weight") * (F.col("y_burnt") - F.col("y_unburnt"))).alias("_change"))
    return weights.select("species", (F.col("weight") / change.scalar()).alias("weight"))
