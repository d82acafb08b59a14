from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tessera.operators import grid
from tessera.operators import knn as K
from tessera.operators.grid import inside_hull
from tessera.operators.hull import convex_hull


def clustered(n: int, d: int, seed: int) -> np.ndarray:
    """A third of the points at one place, a third in a tight cluster, the rest spread out."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, d))
    x[: n // 3] = 0.25
    x[n // 3: 2 * n // 3] = 0.7 + 1e-6 * rng.normal(size=(2 * n // 3 - n // 3, d))
    return x


@pytest.mark.parametrize("d,k", [(1, 3), (2, 4), (3, 5)])
def test_knn_is_brute_force(spark, d, k):
    keys = [f"k{i}" for i in range(d)]
    ref, q = clustered(900, d, 1), np.concatenate([clustered(150, d, 2), [[-3.0] * d, [9.0] * d]])
    r = spark.createDataFrame(pd.DataFrame(ref, columns=keys).assign(id=np.arange(len(ref))))
    index = K.build_index(r, keys, "id", k, leaf=8)
    got = K.knn_join(spark.createDataFrame(pd.DataFrame(q, columns=keys)), index).toPandas()
    for p in np.unique(q, axis=0):
        dist = np.sqrt(((ref - p) ** 2).sum(1))
        want = np.lexsort((np.arange(len(ref)), dist))[:k]
        mine = got[(got[keys] == p).all(axis=1)].sort_values("rank")
        assert np.allclose(mine.distance, dist[want], atol=1e-12)
        clear = np.diff(np.sort(dist)[: k + 1]) > 1e-12
        if clear.all():
            assert list(mine.neighbour) == list(want)


def test_idw_values(spark):
    rng = np.random.default_rng(4)
    ref, v, q = rng.random((300, 2)), rng.random(300), rng.random((50, 2))
    q[0] = ref[7]
    r = spark.createDataFrame(pd.DataFrame({"x": ref[:, 0], "y": ref[:, 1], "v": v, "id": range(300)}))
    qs = spark.createDataFrame(pd.DataFrame({"x": q[:, 0], "y": q[:, 1], "n": range(50)}))
    for k, p in ((1, 2), (3, 2), (6, 4)):
        got = K.idw_join(qs, r, ["x", "y"], ["v"], "id", k, p).toPandas().sort_values("n")
        d = np.sqrt(((q[:, None] - ref[None]) ** 2).sum(2))
        near = np.argsort(d, axis=1)[:, :k]
        for i in range(50):
            di, vi = d[i, near[i]], v[near[i]]
            want = vi[0] if k == 1 or di[0] < 1e-10 else (vi / di ** p).sum() / (1 / di ** p).sum()
            assert got.v.iloc[i] == pytest.approx(want, rel=1e-9)


def test_curve_visits_neighbours(spark):
    for d, bits in ((1, 6), (2, 4), (3, 3)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * d)).reshape(d, -1)
        at = K._curve(list(cells), bits)
        assert sorted(at) == list(range(1 << bits * d))
        path = cells[:, np.argsort(at)]
        assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()  # one step at a time


def test_index_of_several_levels_and_joins(spark, monkeypatch):
    monkeypatch.setattr(K, "FAN", 3)
    monkeypatch.setattr(K, "PART_ROWS", 150)
    monkeypatch.setattr(K, "GROUP", 7)
    ref = clustered(700, 2, 6)
    r = spark.createDataFrame(pd.DataFrame(ref, columns=["a", "b"]).assign(id=[f"p{i:04d}" for i in range(len(ref))]))
    r = r.unionByName(spark.createDataFrame([(None, 0.1, "n"), (float("nan"), 0.1, "nan"), (0.2, float("inf"), "inf")], "a double, b double, id string"))
    index = K.build_index(r, ["a", "b"], "id", 3, leaf=8)
    assert index.depth > 2 and len(index.roots) > 2 and index.rows == len(np.unique(ref, axis=0)) + 2
    for seed in (1, 2):  # the same index serves several joins
        q = clustered(90, 2, seed)
        asked = spark.createDataFrame([*map(tuple, q.tolist()), (None, 1.0)], "a double, b double")
        got = K.knn_join(asked, index, "id").toPandas()
        assert len(got) == 3 * len(np.unique(q, axis=0))
        for p in np.unique(q, axis=0):
            dist = np.sqrt(((ref - p) ** 2).sum(1))
            want = np.lexsort((np.arange(len(ref)), dist))[:3]
            mine = got[(got.a == p[0]) & (got.b == p[1])].sort_values("rank")
            assert np.allclose(mine.distance, dist[want], atol=1e-12) and (np.diff(np.sort(dist)[:4]) < 1e-12).any() | (list(mine.id) == [f"p{i:04d}" for i in want])


def test_few_points_and_none(spark):
    q = spark.createDataFrame([(0.5, 1.0), (0.1, 2.0)], "a double, b double")
    two = spark.createDataFrame([(0.0, 0.0, 1), (1.0, 1.0, 2)], "a double, b double, id int")
    assert K.knn_join(q, K.build_index(two, ["a", "b"], "id", 5)).count() == 4
    empty = K.build_index(two.where("false"), ["a", "b"], "id", 5)
    assert K.knn_join(q, empty).count() == 0
    assert K.knn_join(q.where("false"), K.build_index(two, ["a", "b"], "id", 5)).count() == 0


def test_inverse_lookup(spark):
    rng = np.random.default_rng(3)
    g = np.linspace(0, 1, 30)
    x, z = (a.ravel() for a in np.meshgrid(g, g))
    r = spark.createDataFrame(pd.DataFrame({"h": x, "z": z, "t": 1000 * x + 50 * z, "id": range(len(x))}))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.random(40), rng.uniform(60, 990, 40)))]
    rows += [(100, 0.5, -400.0), (101, 0.5, 4000.0), (102, None, 3.0), (103, 0.5, None), (104, rows[0][1], rows[0][2])]
    q = spark.createDataFrame(rows, "n int, z double, want double")
    index = K.build_index(r, ["h", "z"], "id", 4)
    got = K.inverse_lookup(q, index, "h", "want", "t", start=0.5).toPandas().set_index("n")
    assert len(got) == 45 and set(got.status[got.index >= 100]) == {"outside", got.status[0]}
    inner = got[got.index < 100]
    assert set(inner.status) <= {"converged", "jump"}
    ok = inner[inner.status == "converged"]
    assert len(ok) > 5 and (abs(ok.t - ok.want) <= 1e-2).all()
    again = K.idw_join(spark.createDataFrame(ok.reset_index()[["h", "z", "want"]]), index, ["h", "z"], ["t"], k=4).toPandas()
    assert (abs(again.t - again.want) <= 1e-2).all()
    # a jump has the target between the values on both of its sides
    jumps = inner[inner.status == "jump"].reset_index()
    if len(jumps):
        sides = [K.idw_join(spark.createDataFrame(jumps.assign(h=jumps.h + s)[["n", "h", "z", "want"]]), index, ["h", "z"], ["t"], k=4).toPandas().sort_values("n") for s in (0, 1.01e-9)]
        assert ((sides[0].t.to_numpy() - sides[0].want.to_numpy()) * (sides[1].t.to_numpy() - sides[1].want.to_numpy()) < 0).all()
    line = spark.createDataFrame([(float(v), 3.0 * v, i) for i, v in enumerate(range(20))], "h double, t double, id int")
    one = K.inverse_lookup(spark.createDataFrame([(7.3,), (55.0,)], "want double"), K.build_index(line, ["h"], "id", 2), "h", "want", "t").toPandas()
    assert list(one.status) == ["converged"] * 2


def test_convex_hull(spark):
    rng = np.random.default_rng(5)
    sets = {0: rng.normal(size=(3000, 2)), 1: np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [0.5, 0]]), 2: np.array([[2.0, 3.0]])}
    pdf = pd.concat([pd.DataFrame({"level": k, "x": p[:, 0], "y": p[:, 1]}) for k, p in sets.items()])
    got = convex_hull(spark.createDataFrame(pdf), "level", "x", "y", group_points=20).toPandas()
    assert set(map(tuple, got[got.level == 1][["x", "y"]].to_numpy())) == {(0, 0), (1, 0), (1, 1), (0, 1)}
    assert len(got[got.level == 2]) == 1
    ring = got[got.level == 0].sort_values("seq")[["x", "y"]].to_numpy()
    nxt = np.roll(ring, -1, axis=0)
    for a, b in zip(ring, nxt):  # every point lies left of every edge
        p = sets[0]
        assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= -1e-9).all()


def test_inside_hull(spark):
    rng = np.random.default_rng(8)
    sets = {0: rng.normal(size=(300, 2)), 1: np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 2.0]])}
    own = pd.concat([pd.DataFrame({"level": k, "x": p[:, 0], "y": p[:, 1]}) for k, p in sets.items()])
    asked = pd.concat([pd.DataFrame({"level": k, "x": rng.uniform(-4, 4, 400), "y": rng.uniform(-4, 4, 400)}) for k in sets])
    hull = convex_hull(spark.createDataFrame(own), "level", "x", "y")
    got = set(map(tuple, inside_hull(spark.createDataFrame(asked), hull, "level").toPandas()[["level", "x", "y"]].to_numpy()))
    ring = hull.orderBy("level", "seq").toPandas()
    want = set()
    for k, x, y in asked.itertuples(index=False):
        p = ring[ring.level == k][["x", "y"]].to_numpy()
        q = np.roll(p, -1, axis=0)
        if ((q[:, 0] - p[:, 0]) * (y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x - p[:, 0]) >= -1e-12).all():
            want.add((k, x, y))
    assert got == want and 0 < len(want) < len(asked)


def test_a_coordinate_that_is_null_stays_so(spark):
    df = spark.createDataFrame([(i % 2, float(i), None if i == 4 else i * i * 1.0) for i in range(12)], "level int, x double, y double")
    got = convex_hull(df, "level", "x", "y")
    assert got.where("x is null or isnan(x) or isnan(y)").isEmpty() and {r.level for r in got.where("y is null").collect()} == {0}


@pytest.mark.parametrize("large", [False, True])
def test_levels_share_buckets(spark, monkeypatch, large):
    """Tasks do not multiply with the number of levels; large levels are dealt out, among them that of no number."""
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 30, 40)
    level = np.repeat([*range(-1, 39)], sizes)
    own = pd.DataFrame({"level": level, "x": rng.integers(0, 9, len(level)) * 1.0, "y": rng.integers(0, 9, len(level)) * 1.0})
    own.loc[own.level == 5, "x"] = 3.0  # all above each other
    asked = pd.DataFrame({"level": rng.integers(-1, 42, 6000), "x": rng.uniform(-1, 9, 6000).round(1), "y": rng.uniform(-1, 9, 6000).round(1)})
    asked = pd.concat([asked, asked.assign(level=np.where(asked.level < 3, asked.level, 3)), own])
    number = F.when(F.col("level") >= 0, F.col("level")).alias("level")
    monkeypatch.setattr(grid, "BUCKET_ROWS", 3000)
    if large:
        monkeypatch.setattr(grid, "GROUP_ROWS", 1000)
    hull = convex_hull(spark.createDataFrame(own).select(number, "x", "y"), "level", "x", "y")
    ring = hull.select(F.coalesce("level", F.lit(-1)).alias("level"), "seq", "x", "y").orderBy("level", "seq").toPandas()
    groups = []
    real = PandasCogroupedOps.applyInArrow

    def spy(self, *a):
        for side in (self._gd1, self._gd2):
            groups.append(side.count().count())
        return real(self, *a)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", spy)
    got = inside_hull(spark.createDataFrame(asked).select(number, "x", "y"), hull, "level")
    got = got.fillna(-1, "level").toPandas().sort_values(["level", "x", "y"]).reset_index(drop=True)
    assert max(groups) < 35
    want = np.zeros(len(asked), bool)
    for k, p in ring.groupby("level"):
        p, mine = p[["x", "y"]].to_numpy(), (asked.level == k).to_numpy()
        x, y = asked.x.to_numpy()[mine], asked.y.to_numpy()[mine]
        ok = (x >= p[:, 0].min()) & (x <= p[:, 0].max()) & (y >= p[:, 1].min()) & (y <= p[:, 1].max())
        for a, b in zip(p, np.roll(p, -1, axis=0)):
            ok &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-12
        want[mine] = ok
    want = asked[want].sort_values(["level", "x", "y"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_hits_of_a_leaf_are_bounded():
    """Whatever the reach, a query takes no more of a leaf than its k nearest there and their ties."""
    rng = np.random.default_rng(3)
    axes, points = rng.random((40, 2)), np.round(rng.random((200, 2)), 1)
    for reach in (np.full(40, np.inf), np.full(40, 1.5), np.full(40, 0.1)):
        q, p, dist = K._hits(axes, points, reach, 3)
        every = np.sqrt(((axes[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
        kth = np.sort(every, axis=1)[:, 2]
        assert {(i, j) for i, j in zip(*np.nonzero(every <= np.minimum(kth, reach)[:, None]))} <= set(zip(q, p))
        assert np.allclose(dist, every[q, p]) and np.bincount(q, minlength=40).max() < 30


def test_idw_null_values(spark):
    """Null values are left out of the sum of values only; of nulls alone the result is null."""
    refs = spark.createDataFrame([(1, 0.0, 2.0, None), (2, 2.0, None, None), (3, 5.0, 4.0, None)], "id long, x double, v double, u double")
    got = K.idw_join(spark.createDataFrame([(1.0,), (2.0,)], "x double"), refs, ["x"], ["v", "u"], "id", 2, 2).orderBy("x")
    assert [tuple(r) for r in got.collect()] == [(1.0, 1.0, None), (2.0, None, None)]


def test_idw_sends_a_row_per_query(spark):
    """The neighbours of a query are summed where they were found: the plan groups no rows of neighbours by their place."""
    refs = spark.createDataFrame([(i, float(i), float(i)) for i in range(20)], "id long, x double, v double")
    asked = spark.createDataFrame([(0.5,), (7.25,)], "x double")
    plan = K.idw_join(asked, K.build_index(refs, ["x"], "id", 4), ["x"], ["v"], k=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(v#" not in plan and "arrays_zip" in plan


def test_targets_of_one_place_are_dealt_out(spark, monkeypatch):
    """Targets that share the other keys are judged by many tasks, whichever way they meet the probes."""
    cut, tasks = K.cut_lineage, []

    def spied(df):
        out = cut(df)
        if "status" in out.columns:
            tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(K, "cut_lineage", spied)
    monkeypatch.setattr(K, "TASK_TARGETS", 10, raising=False)
    refs = spark.createDataFrame([(i, i / 20, j / 2, i * 5.0) for i in range(21) for j in range(2)], "id long, x double, y double, v double")
    asked = spark.createDataFrame([(0.5, 1.0 + i) for i in range(60)], "y double, want double")
    index = K.build_index(refs.withColumn("id", F.monotonically_increasing_id()), ["x", "y"], "id", 3)
    got = []
    for places in (10, 0):
        monkeypatch.setattr(K, "SENT_PLACES", places, raising=False)
        got.append(sorted(map(repr, K.inverse_lookup(asked, index, "x", "want", "v", start=0.5).collect())))
        if places:
            assert tasks[0] == 6
    assert got[0] == got[1] and len(got[0]) == 60
