"""State equations in (density, energy) from the entropy and its derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTROPY_COLUMNS = ("Density", "dsdrho_e", "dsde_rho", "d2sdrho2", "d2sde2", "d2sdedrho")


def entropic_state(df: DataFrame, rho: str = "Density", s_rho: str = "dsdrho_e", s_e: str = "dsde_rho",
                   s_rr: str = "d2sdrho2", s_ee: str = "d2sde2", s_re: str = "d2sdedrho") -> DataFrame:
    """Temperature, pressure, their derivatives, enthalpy derivatives, cp and squared speed of sound.

    Written as stages of dependent columns; Catalyst collapses them into one projection.
    """
    c = F.col
    df = df.withColumn("T", F.lit(1.0) / c(s_e))
    df = df.withColumns({
        "p": -(c(rho) * c(rho)) * c("T") * c(s_rho),
        "dTde_rho": -(c("T") * c("T")) * c(s_ee),
        "dTdrho_e": -(c("T") * c("T")) * c(s_re),
    })
    df = df.withColumns({
        "dpde_rho": -(c(rho) * c(rho)) * (c("dTde_rho") * c(s_rho) + c("T") * c(s_re)),
        "dpdrho_e": F.lit(-2.0) * c(rho) * c("T") * c(s_rho)
        - (c(rho) * c(rho)) * (c("dTdrho_e") * c(s_rho) + c("T") * c(s_rr)),
    })
    df = df.withColumns({
        "dhdrho_e": -c("p") / (c(rho) * c(rho)) + c("dpdrho_e") / c(rho),
        "dhde_rho": F.lit(1.0) + c("dpde_rho") / c(rho),
    })
    lean = -F.try_divide(c("dpde_rho"), c("dpdrho_e"))
    return df.withColumns({
        "dhdrho_p": c("dhdrho_e") - c("dhde_rho") * F.try_divide(c("dpdrho_e"), c("dpde_rho")),
        "dhdp_rho": F.try_divide(c("dhde_rho"), c("dpde_rho")),
        "dsdrho_p": c(s_rho) - c("dpdrho_e") * F.try_divide(c(s_e), c("dpde_rho")),
        "dsdp_rho": F.try_divide(c(s_e), c("dpde_rho")),
        "cp": F.try_divide(c("dhde_rho") + lean * c("dhdrho_e"), c("dTde_rho") + lean * c("dTdrho_e")),
        "c2": c("dpdrho_e") - c(s_rho) * c("dpde_rho") / c(s_e),
    })


def c2_compact(rho: str = "Density", s_rho: str = "dsdrho_e", s_e: str = "dsde_rho", s_rr: str = "d2sdrho2",
               s_ee: str = "d2sde2", s_re: str = "d2sdedrho") -> Column:
    """Squared speed of sound in one expression of the derivatives only."""
    r, a, e, rr, ee, re = (F.col(x) for x in (rho, s_rho, s_e, s_rr, s_ee, s_re))
    return -(r / e) * (F.lit(2.0) * a + r * (rr - F.lit(2.0) * a * re / e + a * a * ee / (e * e)))


def log_targets(s_rho: str = "dsdrho_e", s_rr: str = "d2sdrho2") -> dict[str, Column]:
    return {s_rho: F.ln(-F.col(s_rho)), s_rr: F.ln(F.col(s_rr))}


def inverse_log_targets(s_rho: str = "dsdrho_e", s_rr: str = "d2sdrho2") -> dict[str, Column]:
    return {s_rho: -F.exp(F.col(s_rho)), s_rr: F.exp(F.col(s_rr))}


def compressibility(df: DataFrame, p: str = "p", rho: str = "Density", t: str = "T",
                    threshold: float | None = None) -> DataFrame:
    """Z = p/(R rho T), with R from the row of lowest density; optionally keep rows above a threshold."""
    gas = df.agg(F.min_by(F.try_divide(F.col(p), F.col(rho) * F.col(t)),
                          F.struct(F.col(rho), F.col(t), F.col(p))).alias("gas_constant"))
    df = df.withColumn("gas_constant", gas.scalar()).withColumn(
        "compressibility", F.try_divide(F.col(p), F.col("gas_constant") * F.col(rho) * F.col(t)))
    return df if threshold is None else df.where(F.col("compressibility") > threshold)
