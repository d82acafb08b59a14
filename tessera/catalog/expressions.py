"""Row-wise queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import (LI, MIX, MIXED, MOLAR, SPECIES, WEIGHTS, Z, Z_C, line_series, mixture_rows, rounded,
                                   sql_hash, table)
from tessera.functions import mixture as M
from tessera.functions import scaling, state, trials
from tessera.functions.definition import bilger_coefficients, default_weights, normalise_fractions, normalise_weights
from tessera.operators import sequence as S
from tessera.operators.boundary import MixtureRefs, bias_shift, boundary_targets, classify_boundary
from tessera.operators.stats import fit_scaler
from tessera.sources.export import export_projection

ROW = ["l_orderkey", "l_linenumber"]


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


def _mix_sql(cols: dict[str, str], digits: int | None = 6) -> str:
    picked = ", ".join(f'{e} AS "{n}"' if digits is None else f'round({e}, {digits}) AS "{n}"' for n, e in cols.items())
    return f"WITH {MIXED} SELECT l_orderkey, l_linenumber, {picked} FROM mix"


def _mix(spark, d, cols: dict, digits: int | None = 6):
    """Plain arithmetic is the same to the last bit in both engines, so ``digits`` may be None."""
    df = mixture_rows(spark, d).select(*ROW, *[c.alias(n) for n, c in cols.items()])
    return df if digits is None else rounded(df, digits)


@query("weighted_sum", _mix_sql({"pv": _sum([f'{w!r}e0 * "Y-{s}"' for s, w in WEIGHTS.items()])}, None))
def _weighted_sum(spark, d):
    return _mix(spark, d, {"pv": M.weighted_sum(WEIGHTS)}, None)


@query("weighted_source", _mix_sql({
    "source": _sum([f'{w!r}e0 * ("Y_dot_pos-{s}" + "Y_dot_neg-{s}" * "Y-{s}")' for s, w in WEIGHTS.items()]),
    "net_source": _sum([f'{w!r}e0 * "Y_dot_net-{s}" * {MOLAR[s]!r}e0' for s, w in WEIGHTS.items()])}, None))
def _weighted_source(spark, d):
    return _mix(spark, d, {"source": M.weighted_source(WEIGHTS), "net_source": M.weighted_net_source(WEIGHTS, MOLAR)}, None)


_BETA = {
    "Beta_ProgVar": _sum([f'{w!r}e0 * "Y-{s}" / "Le-{s}"' for s, w in WEIGHTS.items()]),
    "Beta_Enth_Thermal": '"Cp"' + "".join(f' - ("Cp-{s}" - "Cp-N2") * "Y-{s}" / "Le-{s}"' for s in SPECIES),
    "Beta_Enth": _sum([f'("h-{s}" - "h-N2") * "Y-{s}" / "Le-{s}"' for s in SPECIES]),
    "Beta_MixFrac": _sum([f'{Z[s] - Z_C!r}e0 * "Y-{s}" / "Le-{s}"' for s in SPECIES]),
}


@query("diffusion_terms", _mix_sql(_BETA, None))
def _diffusion(spark, d):
    return _mix(spark, d, M.diffusion_terms(SPECIES, WEIGHTS, Z, Z_C, "N2"), None)


@query("diffusion_terms_averaged", f"""WITH {MIXED}, av AS (SELECT *, {', '.join(f'''0.5e0 * (min("Le-{s}") OVER w + max("Le-{s}") OVER w) AS "La-{s}"''' for s in SPECIES)}
  FROM mix WINDOW w AS (PARTITION BY l_suppkey))
SELECT l_orderkey, l_linenumber, {', '.join(f'round({e.replace("Le-", "La-")}, 4) AS "{n}"' for n, e in _BETA.items())} FROM av""")
def _diffusion_averaged(spark, d):
    df, key = mixture_rows(spark, d), S.SeriesKey("l_suppkey", "l_orderkey")
    stats = df.groupBy("l_suppkey").agg(*[(F.lit(0.5) * (F.min(f"`Le-{s}`") + F.max(f"`Le-{s}`"))).alias(f"La-{s}") for s in SPECIES])
    df = df.join(stats, key.series)
    beta = M.diffusion_terms(SPECIES, WEIGHTS, Z, Z_C, "N2", {s: M.col(f"La-{s}") for s in SPECIES})
    return rounded(df.select(*ROW, *[c.alias(n) for n, c in beta.items()]), 4)


@query("mixture_fraction", _mix_sql({"z": _sum([f'{v!r}e0 * "Y-{s}"' for s, v in Z.items()]) + f" + {Z_C!r}e0"}, None))
def _mixture_fraction(spark, d):
    return _mix(spark, d, {"z": M.mixture_fraction(Z, Z_C)}, None)


@query("ratio_coefficient", _mix_sql({"alpha": '"Conductivity" / nullif("Cp" * "Density", 0)'}, 9))
def _ratio(spark, d):
    return _mix(spark, d, {"alpha": M.ratio_coefficient()}, 9)


# compared by their logarithms: the values span many orders of magnitude
@query("lewis_number", _mix_sql({
    **{f"le_{s}": f'log10("Conductivity" / "Cp" / "Density" / ("D-{s}" + 1e-15))' for s in ("NO2", "N2O")}, "le_unity": "0e0"}, 6))
def _lewis(spark, d):
    cols = {f"le_{s}": F.log10(M.lewis_number("Conductivity", "Cp", "Density", f"D-{s}")) for s in ("NO2", "N2O")}
    return _mix(spark, d, {**cols, "le_unity": F.log10(M.lewis_number("Conductivity", "Cp", "Density", "D-H2", unity=True))}, 6)


@query("rate_split", _mix_sql({
    "net": f'"Y_dot_net-NO" * {MOLAR["NO"]!r}e0', "pos": f'("Y_dot_net-NO" - "Y_dot_neg-NO") * {MOLAR["NO"]!r}e0',
    "neg": f'"Y_dot_neg-NO" * {MOLAR["NO"]!r}e0 / ("Y-NO" + 1e-11)'}, None))
def _rate_split(spark, d):
    return _mix(spark, d, M.rate_split(M.col("Y_dot_net-NO"), M.col("Y_dot_neg-NO"), F.lit(MOLAR["NO"]), M.col("Y-NO")), None)


@query("family_sum", _mix_sql({"nox": '"Y-NO2" + "Y-NO" + "Y-N2O"', "nox_rule": '"Y-NO" + "Y-NO2" + "Y-N2O"'}, None))
def _family(spark, d):
    df = mixture_rows(spark, d)
    return _mix(spark, d, {"nox": M.family_sum(df.columns, "Y-"), "nox_rule": M.family_sum(df.columns, "Y-", M.is_nitrogen_oxide)}, None)


@query("mean_weight", _mix_sql({"w": _sum([f'{w!r}e0 * "Y-{s}"' for s, w in MOLAR.items()])}, None))
def _mean_weight(spark, d):
    return _mix(spark, d, {"w": M.weighted_sum(MOLAR)}, None)


_FAMILIES = ("Y_dot_pos-", "Y_dot_neg-", "Y_dot_net-", "Y-")


@query("passive_species", _mix_sql({
    **{f"{p}H2": f'"{p}H2"' for p in _FAMILIES},
    **{f"{p}NOx": f'"{p}NO2" + "{p}NO" + "{p}N2O"' for p in _FAMILIES}}, None))
def _passive(spark, d):
    df = mixture_rows(spark, d)
    return _mix(spark, d, M.passive_species(df.columns, ["H2", "NOx"]), None)


@query("derive", f"""WITH {MIXED} SELECT l_orderkey, l_linenumber, {_sum([f'{w!r}e0 * "Y-{s}"' for s, w in WEIGHTS.items()])} AS "ProgressVariable",
  {_BETA["Beta_MixFrac"]} AS "Beta_MixFrac", "Y_dot_net-O2" AS "ProdRateTot_O2", "Temperature" FROM mix""")
def _derive(spark, d):
    df = mixture_rows(spark, d)
    builders = {"ProgressVariable": M.weighted_sum(WEIGHTS),
                "Beta_MixFrac": M.diffusion_terms(SPECIES, WEIGHTS, Z, Z_C, "N2")["Beta_MixFrac"]}
    return df.select(*ROW, *M.derive(df.columns, ["ProgressVariable", "Beta_MixFrac", "ProdRateTot_O2", "Temperature"], builders))


@query("export_projection", f"""WITH {MIXED} SELECT "Temperature" AS "T (K)", "Density" AS "rho (kg m^-3)",
  {', '.join(f'"Y-{s}" AS "Y-{s}"' for s in SPECIES)}, {', '.join(f'round("Y_dot_pos-{s}" / {MOLAR[s]!r}e0, 9) AS "ReacRatePos-{s}"' for s in SPECIES)} FROM mix""")
def _export(spark, d):
    df = export_projection(mixture_rows(spark, d), SPECIES, MOLAR, {"Temperature": "T (K)", "Density": "rho (kg m^-3)"},
                           {"Y-": "Y-", "Y_dot_pos-": "ReacRatePos-"})
    return df.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) if c.startswith("Reac") else F.col(f"`{c}`") for c in df.columns])


# --- state equations on states read off the line items --------------------------------------------------

_STATE = {"Density": "(1e0 + l_quantity)", "dsdrho_e": "(-1e0 - l_tax * 100e0)", "dsde_rho": "(0.002e0 + l_discount / 100e0)",
          "d2sdrho2": "(10e0 + l_quantity / 5e0)", "d2sde2": "(-1e-6 - l_tax * 1e-5)", "d2sdedrho": "(-1e-6 - l_discount * 1e-5)"}
_STATES = "st AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f'{e} AS "{n}"' for n, e in _STATE.items()) + " FROM lineitem)"
_STATE_SQL = f"""WITH {_STATES},
a AS (SELECT *, "Density" AS r, dsdrho_e AS sr, dsde_rho AS se, d2sdrho2 AS srr, d2sde2 AS see, d2sdedrho AS sre, 1e0 / dsde_rho AS T FROM st),
b AS (SELECT *, -r * r * T * sr AS p, -T * T * see AS te, -T * T * sre AS tr FROM a),
c AS (SELECT *, -r * r * (te * sr + T * sre) AS pe, -2e0 * r * T * sr - r * r * (tr * sr + T * srr) AS pr FROM b),
h AS (SELECT *, -p / (r * r) + pr / r AS hr, 1e0 + pe / r AS he, -pe / pr AS k FROM c)
SELECT l_orderkey, l_linenumber, T AS "T", p, te AS "dTde_rho", tr AS "dTdrho_e", pe AS dpde_rho, pr AS dpdrho_e, hr AS dhdrho_e, he AS dhde_rho,
  pr - sr * pe / se AS c2, he / pe AS dhdp_rho, se / pe AS dsdp_rho, sr - pr * (se / pe) AS dsdrho_p, hr - he * (pr / pe) AS dhdrho_p,
  (he + k * hr) / (te + k * tr) AS cp FROM h"""


def _states(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(n) for n, e in _STATE.items()])


@query("entropic_state", _STATE_SQL)
def _entropic(spark, d):
    got = state.entropic_state(_states(spark, d))
    return got.select("l_orderkey", "l_linenumber", "T", "p", "dTde_rho", "dTdrho_e", "dpde_rho", "dpdrho_e", "dhdrho_e", "dhde_rho",
                      "c2", "dhdp_rho", "dsdp_rho", "dsdrho_p", "dhdrho_p", "cp")


@query("sound_speed_compact", f"""WITH {_STATES} SELECT l_orderkey, l_linenumber,
  round(-("Density" / dsde_rho) * (2e0 * dsdrho_e + "Density" * (d2sdrho2 - 2e0 * dsdrho_e * d2sdedrho / dsde_rho
    + dsdrho_e * dsdrho_e * d2sde2 / (dsde_rho * dsde_rho))), 1) AS c2 FROM st""")
def _compact(spark, d):
    return _states(spark, d).select("l_orderkey", "l_linenumber", F.round(state.c2_compact(), 1).alias("c2"))


@query("log_targets", f"""WITH {_STATES} SELECT l_orderkey, l_linenumber, round(ln(-dsdrho_e), 6) AS dsdrho_e, round(ln(d2sdrho2), 6) AS d2sdrho2,
  round(-exp(ln(-dsdrho_e)), 6) AS dsdrho_back, round(exp(ln(d2sdrho2)), 6) AS d2sdrho2_back FROM st""")
def _logs(spark, d):
    df = _states(spark, d).withColumns(state.log_targets())
    back = state.inverse_log_targets()
    return rounded(df.select("l_orderkey", "l_linenumber", "dsdrho_e", "d2sdrho2", back["dsdrho_e"].alias("dsdrho_back"),
                             back["d2sdrho2"].alias("d2sdrho2_back")))


@query("compressibility", """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, l_quantity AS rho, 300e0 + l_tax * 1000e0 AS t FROM lineitem),
g AS (SELECT p / (rho * t) AS r FROM s ORDER BY rho, t, p LIMIT 1)
SELECT l_orderkey, l_linenumber, round(p / ((SELECT r FROM g) * rho * t), 6) AS compressibility FROM s
WHERE p / ((SELECT r FROM g) * rho * t) > 0.5""")
def _compressibility(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"),
                                            F.col("l_quantity").alias("rho"), F.expr("300e0 + l_tax * 1000e0").alias("t"))
    got = state.compressibility(df, "p", "rho", "t", 0.5)
    return got.select("l_orderkey", "l_linenumber", F.round("compressibility", 6).alias("compressibility"))


@query("scale_unscale", """WITH r AS (SELECT min(l_quantity) AS o1, max(l_quantity) - min(l_quantity) AS s1, min(l_extendedprice) AS o2,
  max(l_extendedprice) - min(l_extendedprice) AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - o1) / s1, 6) AS l_quantity_scaled, round((l_extendedprice - o2) / s2, 6) AS l_extendedprice_scaled,
  round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem, r""")
def _scale(spark, d):
    df = table(spark, d, "lineitem").select(*ROW, "l_quantity", "l_extendedprice")
    params = fit_scaler(df, ["l_quantity", "l_extendedprice"])
    df = df.withColumns(scaling.scale(params, "_scaled")).drop("l_quantity", "l_extendedprice")
    df = df.withColumns(scaling.unscale(params, "_scaled"))
    return df.select(*ROW, *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in params], *[F.round(c, 4).alias(c) for c in params])


@query("default_weights", """WITH s AS (SELECT p_brand AS species, CAST(avg(p_size) AS DOUBLE) AS molar_weight,
  CASE WHEN p_brand < 'Brand#2' THEN 'reactant' WHEN p_brand = 'Brand#9' THEN 'product' ELSE 'other' END AS role FROM part GROUP BY p_brand),
w AS (SELECT species, CASE WHEN role = 'reactant' AND species <> 'Brand#1' THEN -1e0 / molar_weight WHEN role = 'product' THEN 1e0 / molar_weight END AS w FROM s)
SELECT species, round(w / (SELECT sum(abs(w)) FROM w), 9) AS weight FROM w WHERE w IS NOT NULL""")
def _default_weights(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("species")).agg(F.avg("p_size").alias("molar_weight"))
    role = F.when(F.col("species") < "Brand#2", "reactant").when(F.col("species") == "Brand#9", "product").otherwise("other")
    return rounded(default_weights(s.withColumn("role", role), diluent="Brand#1"), 9)


@query("normalise_weights", """WITH s AS (SELECT p_brand AS species, min(p_retailprice) AS y_unburnt, max(p_retailprice) AS y_burnt,
  CAST(max(p_size) - min(p_size) AS DOUBLE) - 40e0 AS weight FROM part GROUP BY p_brand)
SELECT species, round(weight / (SELECT sum(weight * (y_burnt - y_unburnt)) FROM s), 9) AS weight FROM s""")
def _normalise_weights(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("species")).agg(
        F.min("p_retailprice").alias("y_unburnt"), F.max("p_retailprice").alias("y_burnt"),
        ((F.max("p_size") - F.min("p_size")).cast("double") - F.lit(40.0)).alias("weight"))
    return rounded(normalise_weights(s.select("species", "weight"), s.select("species", "y_unburnt", "y_burnt")), 9)


@query("normalise_fractions", "SELECT p_brand AS species, round(sum(p_size) * 1e0 / (SELECT sum(p_size) FROM part), 9) AS fraction FROM part GROUP BY p_brand")
def _normalise_fractions(spark, d):
    parts = table(spark, d, "part").groupBy(F.col("p_brand").alias("species")).agg(F.sum("p_size").cast("double").alias("part"))
    return rounded(normalise_fractions(parts), 9)


@query("bilger_coefficients", """WITH m AS (SELECT p_brand AS species, CAST(count(*) AS DOUBLE) AS molar_weight, avg(p_size) AS ysum FROM part GROUP BY p_brand),
c AS (SELECT p_brand AS species, CASE p_type WHEN 'ECONOMY' THEN 'C' WHEN 'STANDARD' THEN 'H' WHEN 'PROMO' THEN 'O' ELSE 'N' END AS element, count(*) AS n
  FROM part GROUP BY ALL),
w AS (SELECT species, sum(CASE element WHEN 'C' THEN 2e0 WHEN 'H' THEN 0.5e0 WHEN 'O' THEN -1e0 ELSE 0e0 END * n / molar_weight) AS w
  FROM c JOIN m USING (species) GROUP BY species),
b AS (SELECT sum(CASE WHEN species < 'Brand#2' THEN w * ysum END) AS f, sum(CASE WHEN species >= 'Brand#2' THEN w * ysum END) AS o FROM w JOIN m USING (species))
SELECT species, round(w / (f - o), 7) AS z, round(-o / (f - o), 7) AS z_c FROM w, b""")
def _bilger(spark, d):
    p = table(spark, d, "part")
    m = p.groupBy(F.col("p_brand").alias("species")).agg(F.count(F.lit(1)).cast("double").alias("molar_weight"), F.avg("p_size").alias("y"))
    element = F.when(F.col("p_type") == "ECONOMY", "C").when(F.col("p_type") == "STANDARD", "H").when(F.col("p_type") == "PROMO", "O").otherwise("N")
    c = p.groupBy(F.col("p_brand").alias("species"), element.alias("element")).agg(F.count(F.lit(1)).alias("n"))
    got = bilger_coefficients(c, m.select("species", "molar_weight"), m.where("species < 'Brand#2'").select("species", "y"),
                              m.where("species >= 'Brand#2'").select("species", "y"))
    return rounded(got, 7)


@query("percent_error", """SELECT l_orderkey, l_linenumber, round(100e0 * abs(l_discount - l_tax) / (l_tax + 1e-6), 4) AS signed,
  round(100e0 * abs(l_discount - (l_tax - 0.04e0)) / (abs(l_tax - 0.04e0) + 1e-6), 4) AS absolute FROM lineitem""")
def _percent(spark, d):
    df = table(spark, d, "lineitem")
    shifted = F.col("l_tax") - F.lit(0.04)
    return df.select(*ROW, F.round(scaling.percent_error(F.col("l_discount"), F.col("l_tax")), 4).alias("signed"),
                     F.round(scaling.percent_error(F.col("l_discount"), shifted, False), 4).alias("absolute"))


@query("trial_fitness", """SELECT p_partkey, round(-log10(p_size), 9) AS fitness, round(pow(10e0, log10(p_size)), 6) AS score_back,
  round(1000e0 / p_retailprice, 9) AS cost_fitness, round(1000e0 / (1000e0 / p_retailprice), 6) AS cost_back FROM part""")
def _fitness(spark, d):
    p = table(spark, d, "part")
    f, c = trials.score_fitness(trials.valid_score(F.col("p_size").cast("double"))), trials.cost_fitness(F.col("p_retailprice"))
    return p.select("p_partkey", F.round(f, 9).alias("fitness"), F.round(trials.score_from_fitness(f), 6).alias("score_back"),
                    F.round(c, 9).alias("cost_fitness"), F.round(trials.cost_from_fitness(c), 6).alias("cost_back"))


_ACT = ("linear", "elu", "relu", "tanh", "exponential", "gelu", "sigmoid", "swish")


@query("decode_genes", f"""WITH g AS (SELECT p_partkey, p_retailprice / -400e0 AS a, p_size / 50e0 AS b, 3 + p_partkey % 5 AS c, p_size % 8 AS f,
  CAST(p_size AS INTEGER) AS w1, p_partkey % 2 AS on2, p_size + 1 AS w2, p_partkey % 3 AS on3, p_size + 2 AS w3 FROM part)
SELECT p_partkey, round(a, 6) AS alpha_expo, round(b, 6) AS lr_decay, CAST(c AS INTEGER) AS batch_expo,
  ['{"','".join(_ACT)}'][f + 1] AS activation,
  array_to_string([w1] || CASE WHEN on2 > 0 THEN [w2] ELSE [] END || CASE WHEN on3 > 0 THEN [w3] ELSE [] END, '-') AS hidden_layers FROM g""")
def _genes(spark, d):
    p = table(spark, d, "part")
    num = lambda e: F.expr(e).cast("double")
    genes = F.array(*[num(e) for e in ("p_retailprice / -400e0", "p_size / 50e0", "3 + p_partkey % 5", "p_size % 8", "p_size",
                                       "p_partkey % 2", "p_size + 1", "p_partkey % 3", "p_size + 2")])
    df = p.select("p_partkey", genes.alias("g"))
    out = trials.decode_genes(F.col("g"), _ACT, 1)
    return df.select("p_partkey", F.round(out["alpha_expo"], 6).alias("alpha_expo"), F.round(out["lr_decay"], 6).alias("lr_decay"),
                     out["batch_expo"].alias("batch_expo"), out["activation"].alias("activation"),
                     F.array_join(out["hidden_layers"].cast("array<string>"), "-").alias("hidden_layers"))


# --- boundary labels --------------------------------------------------------------------------------

_PV = MixtureRefs(oxidiser=0.125, fuel=-0.5, stoich=0.75, z_st=0.5)
_BPV = MixtureRefs(oxidiser=0.25, fuel=-0.75, stoich=1.5, z_st=0.5)
_BZ = MixtureRefs(oxidiser=-0.25, fuel=1.25, stoich=0.5, z_st=0.5)
_XS = {"pv": 2.0, "h": 5000.0, "z": 0.5}
_YS = {"T": 100.0, "beta_pv": 4.0, "beta_h2": 250.0, "beta_z": 8.0}
_CLASS = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 105000e0 AS pv, l_quantity / 50e0 AS z, 1000e0 + l_quantity AS cp, l_tax * 100e0 AS bh1 FROM lineitem),
k AS (SELECT *, pv <= 0.125e0 + -0.625e0 * greatest(0e0, least(1e0, z)) + 0.002e0 AS is_unburnt, z > 0.5 AS is_rich, z = 0.5 AS is_stoich, NOT (z > 0.5) AS is_lean FROM b)"""


def _boundary(spark, d):
    df = table(spark, d, "lineitem").select(
        *ROW, F.expr("l_extendedprice / 105000e0").alias("pv"), F.expr("l_quantity / 50e0").alias("z"),
        F.expr("1000e0 + l_quantity").alias("Cp"), F.expr("l_tax * 100e0").alias("Beta_Enth_Thermal"))
    return classify_boundary(df, "pv", "z", _PV, _XS["pv"])


@query("classify_boundary", f"WITH {_CLASS} SELECT l_orderkey, l_linenumber, is_unburnt, is_rich, is_stoich, is_lean FROM k")
def _classify(spark, d):
    return _boundary(spark, d).select(*ROW, "is_unburnt", "is_rich", "is_stoich", "is_lean")


def _slope(r: MixtureRefs, f: float) -> str:
    return (f"CASE WHEN is_unburnt THEN {r.fuel - r.oxidiser!r}e0 WHEN is_stoich THEN 0e0 WHEN is_rich THEN {(r.fuel - r.stoich) / (1 - r.z_st)!r}e0 "
            f"ELSE {(r.stoich - r.oxidiser) / r.z_st!r}e0 END * {f!r}e0")


_PZ = _slope(_PV, _XS["z"] / _XS["pv"])
_TARGETS = [("pv-Z", "ProdRateTot_PV", "0e0"), ("h", "ProdRateTot_PV", "0e0"), ("h", "Beta_ProgVar", "0e0"),
            ("pv-Z", "Beta_ProgVar", _slope(_BPV, _XS["z"] / _YS["beta_pv"])), ("h", "Beta_MixFrac", "0e0"),
            ("pv-Z", "Beta_MixFrac", _slope(_BZ, _XS["z"] / _YS["beta_z"])), ("h", "MolarWeightMix", "0e0"),
            ("1/cp", "Temperature", f"{_XS['h'] / _YS['T']!r}e0 / cp"), ("1-beta_h1/cp", "Beta_Enth", f"(1e0 - bh1 / cp) * {_XS['h'] / _YS['beta_h2']!r}e0")]


@query("boundary_targets", f"WITH {_CLASS} " + " UNION ALL ".join(
    f"""SELECT l_orderkey, '{c}' AS "constraint", '{v}' AS variable, round({_PZ if c == 'pv-Z' else '0e0'}, 9) AS p_pv, {'0e0' if c == 'pv-Z' else '1e0'} AS p_h,
  {'1e0' if c == 'pv-Z' else '0e0'} AS p_z, round({t}, 9) AS target FROM k""" for c, v, t in _TARGETS))
def _targets(spark, d):
    return rounded(boundary_targets(_boundary(spark, d), "l_orderkey", _PV, _BPV, _BZ, _XS, _YS), 9)


@query("bias_shift", """SELECT 'ProdRateTot_PV' AS output, round(-greatest(max(l_discount - 0.05e0), 0e0) / 4e0, 9) AS shift FROM lineitem
UNION ALL SELECT 'Heat_Release', round(-greatest(max(l_tax - 1e0), 0e0) / 4e0, 9) FROM lineitem UNION ALL SELECT 'Temperature', 0e0""")
def _shift(spark, d):
    p = table(spark, d, "lineitem").select(F.expr("l_discount - 0.05e0").alias("ProdRateTot_PV"),
                                           F.expr("l_tax - 1e0").alias("Heat_Release"), F.col("l_quantity").alias("Temperature"))
    got = bias_shift(p, ["ProdRateTot_PV", "Heat_Release", "Temperature"], ["ProdRateTot_PV", "Heat_Release"],
                     {"ProdRateTot_PV": 4.0, "Heat_Release": 4.0, "Temperature": 1.0})
    return rounded(got, 9).withColumn("shift", F.col("shift") + F.lit(0.0))
