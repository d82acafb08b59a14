"""Column expressions over families of species columns (``Y-<s>``, ``Cp-<s>``, ...)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# guards against division by zero (fixed values)
RATE_GUARD = 1e-11
DIFFUSION_GUARD = 1e-15

# members of the nitrogen-oxide family (fixed values)
NOX_MEMBERS = ("NO2", "NO", "N2O")


def col(name: str) -> Column:
    """A column by literal name, also when the name holds dots or dashes."""
    return F.col(f"`{name}`")


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def weighted_sum(weights: Mapping[str, float], prefix: str = "Y-") -> Column:
    """Sum of weight times column over the definition (progress variable, mean weight)."""
    return total([F.lit(float(w)) * col(prefix + s) for s, w in weights.items()])


def weighted_source(weights: Mapping[str, float], pos: str = "Y_dot_pos-", neg: str = "Y_dot_neg-",
                    y: str = "Y-") -> Column:
    """Sum of weight times (production + destruction times mass fraction)."""
    return total([F.lit(float(w)) * (col(pos + s) + col(neg + s) * col(y + s)) for s, w in weights.items()])


def weighted_net_source(weights: Mapping[str, float], molar: Mapping[str, float],
                        net: str = "Y_dot_net-") -> Column:
    """The alternate source form: sum of weight times net molar rate times molar weight."""
    return total([F.lit(float(w)) * col(net + s) * F.lit(float(molar[s])) for s, w in weights.items()])


def diffusion_terms(species: Sequence[str], weights: Mapping[str, float], z: Mapping[str, float], z_c: float,
                    carrier: str, lewis: Mapping[str, Column] | None = None, cp: str = "Cp",
                    y: str = "Y-", cp_s: str = "Cp-", h_s: str = "h-", le_s: str = "Le-") -> dict[str, Column]:
    """The four preferential-diffusion scalars of a row.

    ``lewis`` may replace the local Lewis number of a species by any column, for instance one of the
    series averages.
    """
    def le(s: str) -> Column:
        return (lewis or {}).get(s, col(le_s + s))

    cp_c, h_c = col(cp_s + carrier), col(h_s + carrier)
    return {
        "Beta_ProgVar": total([F.lit(float(w)) * col(y + s) / le(s) for s, w in weights.items()]),
        "Beta_Enth_Thermal": reduce(lambda a, s: a - (col(cp_s + s) - cp_c) * col(y + s) / le(s),
                                    species, col(cp)),
        "Beta_Enth": total([(col(h_s + s) - h_c) * col(y + s) / le(s) for s in species]),
        "Beta_MixFrac": total([F.lit(float(z[s]) - z_c) * col(y + s) / le(s) for s in species]),
    }


def mixture_fraction(z: Mapping[str, float], z_c: float, prefix: str = "Y-") -> Column:
    return weighted_sum(z, prefix) + F.lit(float(z_c))


def ratio_coefficient(conductivity: str = "Conductivity", cp: str = "Cp", density: str = "Density") -> Column:
    """Thermal diffusivity; NULL where the denominator is zero."""
    return F.try_divide(col(conductivity), col(cp) * col(density))


def lewis_number(conductivity: str, cp: str, density: str, diffusion: str, unity: bool = False) -> Column:
    if unity:
        return F.lit(1.0)
    ratio = F.try_divide(F.try_divide(col(conductivity), col(cp)), col(density))
    return ratio / (col(diffusion) + F.lit(DIFFUSION_GUARD))


def rate_split(net: Column, destruction: Column, molar_weight: Column, y: Column) -> dict[str, Column]:
    """Net, production and destruction rate per mass of a species from its molar rates."""
    return {"net": net * molar_weight, "pos": (net - destruction) * molar_weight,
            "neg": destruction * molar_weight / (y + F.lit(RATE_GUARD))}


def is_nitrogen_oxide(species: str) -> bool:
    """The name rule: contains N and O, but neither H nor C."""
    return "N" in species and "O" in species and not ("H" in species or "C" in species)


def family_sum(columns: Sequence[str], prefix: str,
               members: Sequence[str] | Callable[[str], bool] = NOX_MEMBERS) -> Column:
    """Sum of the columns of a family, chosen by a list of members or a rule on the species name."""
    if callable(members):
        chosen = [c for c in columns if c.startswith(prefix) and members(c[len(prefix):])]
    else:
        chosen = [prefix + m for m in members]
    if not chosen:
        raise ValueError(f"no column of family {prefix!r} matches")
    return total([col(c) for c in chosen])


def passive_species(columns: Sequence[str], species: Sequence[str]) -> dict[str, Column]:
    """Production, destruction, net rate and mass fraction of each requested species."""
    out: dict[str, Column] = {}
    for s in species:
        for prefix in ("Y_dot_pos-", "Y_dot_neg-", "Y_dot_net-", "Y-"):
            out[prefix + s] = family_sum(columns, prefix) if s == "NOx" else col(prefix + s)
    return out


def derive(columns: Sequence[str], names: Sequence[str], builders: Mapping[str, Column],
           net: str = "Y_dot_net-") -> list[Column]:
    """Columns by name: a builder's name gives its expression, ``ProdRateTot_<s>`` the net rate of a
    species, any other name the raw column."""
    out = []
    for n in names:
        if n in builders:
            c = builders[n]
        elif n.startswith("ProdRateTot_"):
            c = col(net + n[len("ProdRateTot_"):])
        elif n in columns:
            c = col(n)
        else:
            raise ValueError(f"unknown column {n!r}")
        out.append(c.alias(n))
    return out
