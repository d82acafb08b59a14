from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import state
from tessera.functions.definition import normalise_fractions
from tessera.operators import pareto as P
from tessera.operators import split as SP
from tessera.operators import stats as ST
from tessera.operators import surrogate as SU
from tessera.operators.filters import columns_by_range, drop_invalid
from tessera.operators.groups import group_columns
from tessera.operators.quality import approx_compare
from tessera.operators.search import candidate_scores, evolve_weights, initial_population, refine_weights


def test_exact_quantiles_narrow(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(700, 3.25), rng.normal(size=900), 1e6 * rng.random(300)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    for small in (10, 100_000):
        assert np.allclose(ST.exact_quantiles(df, ["v"], probs, small)["v"], np.quantile(v, probs))


def test_quantiles_of_many_columns_by_radix(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = {"a": rng.normal(size=501), "b": -np.exp(rng.normal(size=501) * 90), "c": np.repeat([0.0, -0.0, 5e-324], 167), "d": rng.integers(-3, 3, 501) * 1.0, "e": np.full(501, np.nan)}
    data["d"][0], data["d"][1] = np.inf, -np.inf
    df = spark.createDataFrame(pd.DataFrame(data)).withColumn("n", F.lit(None).cast("double"))
    passes, counted = [], ST._digit_counts
    monkeypatch.setattr(ST, "_digit_counts", lambda *a: passes.append(a[2]) or counted(*a))
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = ST.exact_quantiles(df, [*data, "n"], probs, small_rows=10)
    assert passes == [0, 1, 2, 3]
    for c in "abcd":
        want = df.select(F.percentile(c, F.array(*[F.lit(p) for p in probs]))).first()[0]
        assert np.array_equal(got[c], want, equal_nan=True)
    assert np.isnan(got["e"]).all() and np.isnan(got["n"]).all()


def test_covariance_of_many_columns(spark):
    x = np.random.default_rng(4).normal(size=(300, 400)) + 1e6
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(400)])).repartition(3)
    n, mean, cov = ST.moments(df, df.columns)
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-9)
    assert np.isnan(ST.moments(df.where("false"), ["c0", "c1"])[2]).all()


def test_fit_scaler_zero_range(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert ST.fit_scaler(df, ["a", "b"]) == {"a": (1.0, 2.0), "b": (2.0, 1.0)}
    assert ST.fit_scaler(df, ["b"], "standard") == {"b": (2.0, 1.0)}


def test_correlation_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.1), (3.0, 5.0, 5.9)], "a double, b double, c double")
    got = {(r.var_i, r.var_j): r.r for r in ST.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["a", "a"] == pytest.approx(1.0)
    assert got["a", "c"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])


def test_principal_direction(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ np.array([[2, 1, 0], [0, 1, 0.3], [0, 0, 0.5]])
    got = np.array(list(ST.principal_direction(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), list("abc")).values()))
    s = (x - x.min(0)) / (x.max(0) - x.min(0))
    v = np.linalg.svd(s - s.mean(0))[2][0]
    assert abs(abs(got @ v) - 1) < 1e-9


# two fluids, states and their T, p, c2 (fixed values)
GOLD = [
    # Density, dsdrho_e, dsde_rho, d2sdrho2, d2sde2, d2sdedrho, T, p, c2
    (4.149123929432041, -68.9738807173635, 0.004086866522866435, 16.672668893509506, -2.3291210274413013e-08,
     -4.322563488977596e-06, 244.68623929969283, 290540.7287607017, 98377.92489381757),
    (2.5499999999999994, -112.71439986272247, 0.0019253255880933822, 44.14381586798911, -4.965846654397553e-09,
     -6.926530894755637e-07, 519.3926711327217, 380676.0735118867, 207234.6375866408),
    (1.1526304540753487, -43.70495034626679, 0.0029032258064516127, 38.53939991839812, -5.4051344200033895e-09,
     -3.8121485858810204e-06, 344.44444444444446, 19999.999999999996, 17680.12024243523),
]


def test_state_equations_gold(spark):
    df = spark.createDataFrame([g[:6] for g in GOLD], ", ".join(f"{c} double" for c in state.ENTROPY_COLUMNS))
    got = state.entropic_state(df).withColumn("c2c", state.c2_compact()).orderBy("dsde_rho").toPandas()
    want = sorted(GOLD, key=lambda g: g[2])
    assert np.allclose(got["T"], [g[6] for g in want], rtol=1e-10)
    assert np.allclose(got["p"], [g[7] for g in want], rtol=1e-10)
    assert np.allclose(got["c2"], [g[8] for g in want], rtol=1e-9)
    assert np.allclose(got["c2c"], got["c2"], rtol=1e-9)
    back = df.withColumns(state.log_targets()).withColumns(state.inverse_log_targets()).orderBy("dsde_rho").toPandas()
    assert np.allclose(back["dsdrho_e"], [g[1] for g in want])


def test_drop_invalid_and_range(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0), (float("inf"), 2.0), (None, 3.0), (2.0, 1e-6)], "`Y-a` double, `Y-N2` double")
    assert drop_invalid(df.withColumnRenamed("Y-a", "a").withColumnRenamed("Y-N2", "b"), ["a", "b"]).count() == 2
    flat = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 1.0, 1e-6)], "a double, b double, c double")
    assert columns_by_range(flat, ["a", "b", "c"], exclude=["b"]) == ["a"]


def test_negative_fraction_is_refused(spark):
    with pytest.raises(Exception, match="negative part"):
        normalise_fractions(spark.createDataFrame([("a", 1.0), ("b", -1.0)], "species string, part double")).collect()


@pytest.mark.parametrize("n,bits", [(77, 4), (1000, 2), (1000, 16)])
def test_split_sizes(spark, n, bits):
    df = spark.range(n)
    got = SP.split_exact(df, SP.integer_hash(["id"], 3), ["id"], 0.8, 0.1, ("train", "test", "val"), bits)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {
        "train": int(0.8 * n), "test": int(0.1 * n), "val": n - int(0.8 * n) - int(0.1 * n)}
    assert got.select("id").distinct().count() == n


def dominated(p: np.ndarray) -> np.ndarray:
    le = (p[None] <= p[:, None]).all(2) & (p[None] < p[:, None]).any(2)
    return le.any(1)


def test_pareto_brute_force(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.random((400, 2)) * 20)
    df = spark.createDataFrame(pd.DataFrame({"a": p[:, 0], "b": p[:, 1], "g": rng.integers(1, 5, 400)}))
    want = sorted(map(tuple, p[~dominated(p)]))
    for rows in (50, 10_000):
        assert sorted((r.a, r.b) for r in P.pareto_front(df, "a", "b", chunk_rows=rows).collect()) == want
    pdf = df.toPandas()
    cum = P.cumulative_front(df, "g", "a", "b").toPandas()
    for g in range(1, 5):
        q = np.unique(pdf[pdf.g <= g][["a", "b"]].to_numpy(), axis=0)
        assert sorted(map(tuple, cum[cum.g == g][["a", "b"]].to_numpy())) == sorted(map(tuple, q[~dominated(q)]))


def test_candidate_scores(spark):
    rng = np.random.default_rng(7)
    d, y = rng.normal(size=(500, 3)), rng.random(500)
    df = spark.createDataFrame(pd.DataFrame(d, columns=list("abc")).assign(y=y))
    pop = rng.normal(size=(5, 3))
    got = candidate_scores(df, list("abc"), "y", pop).toPandas().sort_values("candidate")
    for i, w in enumerate(pop):
        t = d @ (w / np.linalg.norm(w))
        f = y / t
        assert got.penalty.iloc[i] == pytest.approx(np.abs(f).max() + (f[t < 0] ** 2).sum(), rel=1e-9)
        assert got.lowest.iloc[i] == pytest.approx(t.min())


def test_weight_search_improves(spark):
    rng = np.random.default_rng(8)
    d = np.abs(rng.normal(size=(200, 3))) * np.array([1, 1, -1])
    df = spark.createDataFrame(pd.DataFrame(d, columns=list("abc")).assign(y=np.linalg.norm(d, axis=1))).cache()
    seen = []
    w, p = evolve_weights(df, list("abc"), "y", [(-1, 1)] * 3, popsize=12, generations=6, on_round=lambda g, s, x: seen.append(s))
    assert seen == sorted(seen, reverse=True)
    w2, p2 = refine_weights(df, list("abc"), "y", w, [(-1, 1)] * 3, rounds=6)
    assert p2 <= p and w2[0] > 0 and w2[1] > 0 and w2[2] < 0


def test_group_columns(spark):
    names = ["a", "b", "c", "d"]
    r = {(x, y): 1.0 if x == y else (0.95 if {x, y} in ({"a", "b"}, {"c", "d"}) else 0.1) for x in names for y in names}
    got = group_columns(spark, r, names, n_trials=300, theta=0.7).collect()
    assert got
    for t in got:
        assert sorted(v for g in t.groups for v in g) == names and t.affinity >= 0.7
    assert any(t.groups == [["a", "b"], ["c", "d"]] for t in got)


def test_initial_population(spark):
    got = initial_population(spark.range(200), 1, {"alpha_expo": -2.0, "lr_decay": 0.9}, ((-3.0, -1.0), (0.8, 1.0)), (3, 6), 8, (2, 5), (4, 30)).collect()
    for r in got:
        g = r.genes
        assert len(g) == 4 + 2 + 2 * 3
        assert abs(g[0] + 2.0) <= 0.1 and abs(g[1] - 0.9) <= 0.01 and 3 <= g[2] <= 6 and 0 <= g[3] <= 7
        flags, widths = g[6::2], [g[4], g[5], *[w for f, w in zip(g[6::2], g[7::2]) if f > 0]]
        assert flags == sorted(flags, reverse=True) and all(4 <= w < 30 for w in widths)
        top = widths.index(max(widths))
        assert widths[:top] == sorted(widths[:top]) and widths[top:] == sorted(widths[top:], reverse=True)


@pytest.mark.parametrize("activation", sorted(SU.ACTIVATIONS))
def test_scoring_forms_agree(spark, activation):
    rng = np.random.default_rng(9)
    net = SU.Network(["a", "b"], ["y"], [rng.normal(size=(2, 5)), rng.normal(size=(5, 1))], [rng.normal(size=5), rng.normal(size=1)], activation,
                     [(0.5, 2.0), (0.0, 1.0)], [(1.0, 3.0)])
    x = rng.normal(size=(50, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    assert np.allclose(SU.mlp_score(df, net).toPandas()["pred_y"], net.predict(x)[:, 0])
    if activation in SU.COLUMN_ACTIVATIONS:
        assert np.allclose(SU.mlp_score_columns(df, net).toPandas()["pred_y"], net.predict(x)[:, 0])


@pytest.mark.parametrize("activation", sorted(SU.ACTIVATIONS))
def test_gradient(spark, activation):
    rng = np.random.default_rng(10)
    net = SU.Network(["a", "b"], ["y"], [rng.normal(size=(2, 3)), rng.normal(size=(3, 1))], [rng.normal(size=3), rng.normal(size=1)], activation)
    pdf = pd.DataFrame(rng.normal(size=(40, 3)), columns=["a", "b", "y"])
    grad, loss = SU._gradient(spark.createDataFrame(pdf), net)

    def value() -> float:
        return float(((net.predict(pdf[["a", "b"]].to_numpy()) - pdf[["y"]].to_numpy()) ** 2).mean())

    assert loss == pytest.approx(value())
    at = 0
    for p in [*net.weights, *net.biases]:
        flat = p.reshape(-1)
        for i in range(flat.size):
            old = flat[i]
            flat[i] = old + 1e-6
            up = value()
            flat[i] = old - 1e-6
            down = value()
            flat[i] = old
            assert grad[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)
            at += 1


def test_fit_reduces_loss(spark):
    rng = np.random.default_rng(11)
    x = rng.random((300, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": x[:, 0] + x[:, 1] ** 2})).cache()
    net, losses = SU.mlp_fit(df, ["a", "b"], ["y"], [6], 25, alpha_expo=-1.0)
    assert losses[-1] < 0.2 * losses[0] and net.cost == 2 * 6 + 6


def test_early_stop_blocks_agree(spark):
    rng = np.random.default_rng(12)
    rows = [(r, e, float(v)) for r in range(4) for e, v in enumerate(np.minimum.accumulate(rng.random(120)) + (rng.random(120) > 0.4) * 0.1)]
    rows += [(9, e, 1.0 / (e + 1)) for e in range(50)] + [(8, 0, 1.0), (8, 1, float("nan")), (8, 2, 0.1)]
    df = spark.createDataFrame(rows, "run int, epoch int, loss double")
    a = SU.early_stop(df, "run", "epoch", "loss", patience=15).toPandas().sort_values("run").reset_index(drop=True)
    b = SU.early_stop(df, "run", "epoch", "loss", patience=15, block_rows=11).toPandas().sort_values("run").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    assert a[a.run == 8].stop_epoch.iloc[0] == 1 and pd.isna(a[a.run == 9].stop_epoch.iloc[0]) and a[a.run == 9].best_epoch.iloc[0] == 49


def test_approx_compare_rules(spark):
    a = spark.createDataFrame([(1, 100.0, "x"), (2, 0.0, "y"), (3, 1e-9, "z")], "id int, v double, t string")
    b = spark.createDataFrame([(1, 100.5, "x"), (2, 7.0, "y"), (3, 2e-9, "q")], "id int, v double, t string")
    r = approx_compare(a, b, ["id"], tol_pct=1.0, floor=1e-6).first()
    assert (r.rows_a, r.rows_b, r.failed, r.ignored, r.first_id, r.first_column) == (3, 3, 1, 2, 3, "t")
    assert r.max_delta == pytest.approx(0.5)
    gone = approx_compare(a, b.where("id < 3"), ["id"], 1.0).first()
    assert gone.rows_b == 2 and gone.failed == 2


def test_candidate_scores_leave_out_rows_without_increment(spark):
    df = spark.createDataFrame([(2.0, 0.0, 1.0), (0.0, 1.0, 5.0), (0.0, 0.0, 0.0)], "a double, b double, y double")
    got = candidate_scores(df, ["a", "b"], "y", [[1.0, 0.0], [-1.0, 0.0]]).orderBy("candidate").collect()
    assert [(r.worst, r.violation, r.lowest, r.penalty) for r in got] == [(0.5, 0.0, 0.0, 0.5), (0.5, 0.25, -2.0, 0.75)]


def test_correlation_counts_complete_rows(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 100.0), (50.0, None)]
    got = {(r.var_i, r.var_j): r.r for r in ST.correlation_matrix(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert np.isclose(got["a", "b"], np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])


def test_quantiles_leave_out_nan(spark):
    rows = [(float(k),) for k in range(9)] + [(float("nan"),), (None,)]
    for small in (3, 100):
        assert ST.exact_quantiles(spark.createDataFrame(rows, "v double"), ["v"], [0.0, 0.5, 1.0], small)["v"] == [0.0, 4.0, 8.0]


def test_group_columns_until_enough(spark):
    names = ["a", "b", "c"]
    r = {(x, y): 1.0 if x == y else 0.0 for x in names for y in names}
    got = group_columns(spark, r, names, n_trials=50, theta=0.0).collect()
    assert [g.trial for g in got] == list(range(50))
