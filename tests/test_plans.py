from __future__ import annotations

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions.mixture import diffusion_terms, weighted_sum
from tessera.operators import search
from tessera.plans import weight_search
from tessera.plans.lookup_table import lookup_levels, lookup_text, tune_and_index
from tessera.plans.manifold_table import TableSpec, boundary_table, concatenate
from tessera.plans.weight_search import optimise_weights
from tessera.sources.level_table import read_level_text, write_level_text
from tessera.sources.profiles import read_profiles
from tests.conftest import SF, SPECIES, header

WEIGHTS = {"H2": -1.0, "H2O": 1.0}
CONTROLS = ["ProgressVariable", "EnthalpyTot", "MixtureFraction"]


def spec(**kw) -> TableSpec:
    def derive(df):
        beta = diffusion_terms(SPECIES, WEIGHTS, dict.fromkeys(SPECIES, 0.5), 0.1, "N2")
        return df.withColumn("ProgressVariable", weighted_sum(WEIGHTS)).withColumns(beta)

    return TableSpec(CONTROLS, ["Temperature", "Beta_MixFrac"], ["Heat_Release"], derive=derive, **kw)


def test_concatenate(spark, profile_tree):
    df, key = read_profiles(spark, profile_tree)
    out = concatenate(df, key, spec(nodes=16, lo=0.5, hi=2.0)).toPandas()
    # strings sort 0.5, 1.0, 10.0, 2.0; the non-burning and the flat profile are dropped
    per_kind = {"free": 3 * 2 + 1, "burner": 3, "equilibrium": 3}
    assert out.series_no.nunique() == sum(per_kind.values())
    assert not out.duplicated(CONTROLS).any()
    n = len(out)
    assert out.split.value_counts().to_dict() == {"train": int(0.8 * n), "val": int(0.1 * n), "test": n - int(0.8 * n) - int(0.1 * n)}
    raw = np.loadtxt(f"{profile_tree}/freeflame_data/phi_0.5/freeflamelet_phi0.5_Tu300.0.csv", delimiter=",", skiprows=1)
    col = {h: raw[:, i] for i, h in enumerate(header())}
    cv = np.column_stack([col["Y-H2O"] - col["Y-H2"], col["EnthalpyTot"], col["MixtureFraction"]])
    s = (cv - cv.min(0)) / (cv.max(0) - cv.min(0) + 1e-10)
    c = np.append(0, np.cumsum(np.sqrt((np.diff(s, axis=0) ** 2).sum(1))))
    q = 0.5 - 0.5 * np.cos(np.linspace(0, np.pi, 16))
    hr = col["Heat_Release"].copy()
    hr[[0, -1]] = 0.0
    mine = out[out.series_no == 0].sort_values("node")
    assert np.allclose(mine["Temperature"], np.interp(q, c / c.max(), col["Temperature"]))
    assert np.allclose(mine["Heat_Release"], np.interp(q, c / c.max(), hr), atol=1e-3)


def test_chunked_concatenate_and_stride(spark, profile_tree):
    plain, key = read_profiles(spark, profile_tree)
    cut, cut_key = read_profiles(spark, profile_tree, chunk_rows=70)
    s = spec(nodes=8, stride=2)
    a = concatenate(plain, key, s).toPandas().sort_values(["series_no", "node"]).reset_index(drop=True)
    b = concatenate(cut, cut_key, s).toPandas().sort_values(["series_no", "node"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    assert a.series_no.nunique() == 2 * 2 + 2 + 2  # phi_0.5 and phi_10.0 of each kind


def test_boundary_and_table_mode(spark, profile_tree):
    df, key = read_profiles(spark, profile_tree)
    out = boundary_table(df, key, spec(nodes=10, lo=5.0, hi=6.0)).toPandas()
    assert out.series_no.nunique() == 4  # bounds are ignored
    table = boundary_table(df, key, spec(nodes=10, table_mode=True)).toPandas()
    assert len(table) == 4 and (table.Heat_Release == 0).all()  # repeated first rows collapse on the controls


def test_weight_search(spark, profile_tree):
    df, key = read_profiles(spark, profile_tree, kinds=["freeflame"])
    got = optimise_weights(df, key, ["H2", "O2"], "H2O", popsize=10, generations=3, tol=1e-2, temperature=(300.0, 350.0))
    assert got.species == ["H2", "O2", "H2O", "NO"] and got.monotonic
    w = dict(zip(got.species, got.weights))
    assert w["H2"] <= 0 and w["O2"] <= 0 and w["H2O"] >= 0
    states = spark.createDataFrame([(s, a, b) for s, a, b in (("H2", 0.03, 0.0), ("O2", 0.22, 0.02), ("H2O", 0.0, 0.2), ("NO", 0.0, 1e-3))],
                                   "species string, y_unburnt double, y_burnt double")
    pca = optimise_weights(df, key, method="principal", tol=1e-2, states=states)
    change = {r.species: r.y_burnt - r.y_unburnt for r in states.collect()}
    assert sum(w * change[s] for s, w in zip(pca.species, pca.weights)) == pytest.approx(1.0)


def test_lookup_levels(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    pdf = pd.DataFrame(x, columns=["pv", "h", "z"]).assign(id=range(3000), split=np.where(np.arange(3000) % 10 == 0, "test", "train"))
    pdf["src"] = np.exp(-((pdf.pv - 0.5) / 0.1) ** 2)
    index, p, params = tune_and_index(spark.createDataFrame(pdf), ["pv", "h", "z"], "src", ["src"], "id", k_max=6, powers=(1, 2))
    assert 1 <= index.k <= 6 and p in (1, 2) and set(params) == {"pv", "h", "z"}
    levels = spark.createDataFrame([(i, z, 0.0, 1.0, 0.3, 1.0, 0.0, 0.7) for i, z in enumerate((0.3, 0.6))],
                                   "level int, z double, x_u double, x_b double, yu_lo double, yu_hi double, yb_lo double, yb_hi double")
    table = lookup_levels(index, p, levels, "src", ["src"], n=12, base=0.2, fine=0.05, radius=0.05, edge_nodes=5)
    got = table.nodes.toPandas()
    assert set(got.level) == {0, 1} and table.hull.groupBy("level").count().count() == 2
    assert got.src.between(pdf.src.min(), pdf.src.max()).all() and (got.k1 >= 0.3 - 0.3 * got.k0 - 1e-9).all()
    assert not got.duplicated(["level", "k0", "k1"]).any()
    lines = lookup_text(table, params, ["pv", "h", "z"], ["src"], {"H2": -1.0})
    write_level_text(lines, str(tmp_path / "table"))
    back = read_level_text(spark, str(tmp_path / "table"))
    assert back.variables == ["pv", "h", "z", "src"]
    mine = back.nodes.toPandas().sort_values(["level", "node"])
    want = got.sort_values(["level", "node"])
    assert np.allclose(mine.src, want.src, rtol=1e-12) and np.allclose(mine.pv, want.k0 * params["pv"][1] + params["pv"][0])
    assert sorted(map(tuple, back.triangles.collect())) == sorted(map(tuple, table.triangles.select("level", "tri", "a", "b", "c").collect()))
    assert sorted(map(tuple, back.hull.collect())) == sorted(map(tuple, table.outline.select("level", "seq", "node").collect()))


@pytest.mark.parametrize("name,module", [("evolve_weights", search), ("optimise_weights_penalty", weight_search),
                                         ("optimise_weights_bound", weight_search)])
def test_queries_search_with_the_defaults(spark, monkeypatch, name, module):
    asked = []

    def small(f, **few):
        bound = inspect.signature(f)

        def run(*a, **k):
            got = bound.bind(*a, **k).arguments
            asked.extend((x, got.get(x)) for x in few)
            return f(**{**got, **few})
        return run

    for f, few in (("evolve_weights", {"popsize": 2, "generations": 1}), ("refine_weights", {"rounds": 1})):
        monkeypatch.setattr(module, f, small(getattr(module, f), **few))
    rows = entry.queries()[name](spark, SF).collect()
    assert asked == [("popsize", None), ("generations", None), ("rounds", None)]
    assert rows and all(r["penalty"] > 0 for r in rows)
