from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import resample as R
from tessera.operators import sequence as S

KEY = ["sid", "row_idx"]


@pytest.fixture(scope="module")
def rows(spark):
    """One series with a third of all rows, short ones, repeated values and a single-row series."""
    rng = np.random.default_rng(3)
    sizes = {0: 400, 1: 1, 2: 2, **{i: 60 for i in range(3, 13)}}
    parts = [pd.DataFrame({"sid": s, "k": np.arange(n), "a": np.round(np.cumsum(rng.normal(size=n)), 1), "b": rng.integers(0, 5, n) * 1.0})
             for s, n in sizes.items()]
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))


@pytest.fixture(scope="module")
def both(rows):
    plain, key = S.index_rows(rows, "sid", ["k"])
    cut, cut_key = S.index_rows(rows, "sid", ["k"], chunk_rows=37)
    assert key.chunk is None and cut_key.chunk == "chunk"
    assert cut.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 2 * 37
    return (plain, key), (cut, cut_key)


def frame(df, cols):
    return df.select(*KEY, *cols).toPandas().sort_values(KEY).reset_index(drop=True)


@pytest.mark.parametrize("op,cols", [
    (lambda d, k: S.delta(d, k, ["a", "b"]), ["d_a", "d_b"]),
    (lambda d, k: S.following(d, k, {"a": "n"}), ["n"]),
    (lambda d, k: S.running_sum(d, k, "b", "r", "t"), ["r", "t"]),
    (lambda d, k: S.arc_length(d, k, ["a", "b"]), ["s", "s_total"]),
    (lambda d, k: S.progress_vector(d, k, ["a"], ["b"]), ["d_a", "y"]),
    (lambda d, k: S.max_step(d, k, ["a", "b"]), ["max_step"]),
])
def test_chunked_equals_plain(both, op, cols):
    (p, pk), (c, ck) = both
    pd.testing.assert_frame_equal(frame(op(p, pk), cols), frame(op(c, ck), cols), rtol=1e-12)


def test_arc_length_definition(both):
    (p, pk), _ = both
    got = frame(S.arc_length(p, pk, ["a", "b"]), ["a", "b", "s"])
    for _, g in got.groupby("sid"):
        x = g[["a", "b"]].to_numpy()
        n = (x - x.min(0)) / (x.max(0) - x.min(0) + 1e-10)
        c = np.append(0, np.cumsum(np.sqrt((np.diff(n, axis=0) ** 2).sum(1))))
        assert np.allclose(g["s"], c / (c.max() + 1e-32), atol=1e-12)


@pytest.mark.parametrize("spacing", ["cosine", "uniform"])
def test_resample_is_interp(both, spacing):
    for df, key in both:
        curve = S.arc_length(df, key, ["a", "b"])
        src = frame(curve, ["a", "s"])
        got = R.resample(curve, key, "s", ["a"], 33, spacing).toPandas().sort_values(["sid", "node"])
        q = 0.5 - 0.5 * np.cos(np.linspace(0, np.pi, 33)) if spacing == "cosine" else np.linspace(0, 1, 33)
        for sid, g in src.groupby("sid"):
            assert np.allclose(got[got.sid == sid]["a"], np.interp(q, g["s"], g["a"]), atol=1e-9), sid
        assert len(got) == 33 * src.sid.nunique()


def thin(c: np.ndarray, tol: float) -> set[int]:
    """The rule, row by row."""
    keep, last, d = {len(c) - 1}, c[-1], tol * c[-1]
    for k in range(len(c) - 2, 0, -1):
        if c[k] < last - d:
            last = c[k]
            keep.add(k)
    keep.add(0)
    beyond = np.flatnonzero(c > d)
    return keep - set(range(1, beyond[0] - 1)) if len(beyond) else keep


@pytest.mark.parametrize("tol", [0.3, 0.02, 1e-4])
def test_thin_monotone(both, tol):
    for df, key in both:
        src = frame(S.curve_length(df, key, ["a", "b"], S.THIN_RANGE_GUARD, "c", "ct"), ["c"])
        got = S.thin_monotone(df, key, ["a", "b"], tol, chunk_rows=100).toPandas()
        for sid, g in src.groupby("sid"):
            assert set(got[got.sid == sid].row_idx) == thin(g["c"].to_numpy(), tol), sid


def test_thin_monotone_across_batches(spark, both):
    (df, key), _ = both
    src = frame(S.curve_length(df, key, ["a", "b"], S.THIN_RANGE_GUARD, "c", "ct"), ["c"])
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        for batch in ("1", "7", "60"):
            spark.conf.set(conf, batch)
            got = S.thin_monotone(df, key, ["a", "b"], 0.02).toPandas()
            for sid, g in src.groupby("sid"):
                assert sorted(got[got.sid == sid].row_idx) == sorted(thin(g["c"].to_numpy(), 0.02)), (batch, sid)
    finally:
        spark.conf.set(conf, before)


def test_global_index(rows):
    got = S.global_index(rows, ["b", "sid", "k"], rows_per_task=50).toPandas().sort_values("pos")
    assert list(got.pos) == list(range(len(got)))
    assert got[["b", "sid", "k"]].apply(tuple, axis=1).is_monotonic_increasing


def test_series_numbers_follow_kind_then_strings(spark):
    df = spark.createDataFrame([("b", "phi_10.0", "x"), ("b", "phi_2.0", "x"), ("a", "phi_1.0", "z"), ("a", "phi_1.0", "y")], "kind string, folder string, file string")
    got = S.series_number(df, "kind", "folder", "file", ["b", "a"]).orderBy("series_no").collect()
    assert [(r.kind, r.folder, r.file) for r in got] == [("b", "phi_10.0", "x"), ("b", "phi_2.0", "x"), ("a", "phi_1.0", "y"), ("a", "phi_1.0", "z")]
