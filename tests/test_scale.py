"""Tables cut into chunks, and steps that must not grow with the table, on small data."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.catalog import quality, tables, views
from tessera.operators import resample as R
from tessera.operators import search as SE
from tessera.operators import sequence as S
from tessera.operators.hull import convex_hull
from tessera.plans import manifold_table as M
from tessera.sources.trial_reports import read_trial_reports
from tests.conftest import SF


def test_only_large_series_are_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_ROWS", 50)
    rows = spark.createDataFrame(pd.DataFrame({"sid": np.repeat(np.arange(10), 50), "k": np.arange(500)}))
    df, key = S.index_rows(rows, "sid", ["k"])
    assert key.chunk is None and df.where("row_idx != k % 50").isEmpty()
    longer = rows.unionByName(spark.createDataFrame([(3, 1000)], "sid long, k long"))
    df, key = S.index_rows(longer, "sid", ["k"])
    assert key.chunk == "chunk" and df.where("sid = 3").agg(F.max("row_idx")).first()[0] == 50
    empty, key = S.index_rows(rows.where("sid < 0"), "sid", ["k"])
    assert key.chunk is None and empty.isEmpty()


@pytest.mark.parametrize("name", ["finite_difference_check", "consistency_report"])
def test_differences_over_chunks(spark, monkeypatch, name):
    want = entry.queries()[name](spark, SF).toPandas()
    monkeypatch.setattr(quality, "index_rows", partial(S.index_rows, chunk_rows=500))
    got = entry.queries()[name](spark, SF).toPandas()
    by = [c for c in ("l_suppkey", "row_idx") if c in got]
    if by:
        want, got = (df.sort_values(by).reset_index(drop=True) for df in (want, got))
    pd.testing.assert_frame_equal(got, want)


def test_weights_over_chunks(spark, monkeypatch):
    want = entry.queries()["optimise_weights"](spark, SF).toPandas()
    monkeypatch.setattr(tables, "line_series", partial(views.line_series, chunk_rows=2000))
    got = entry.queries()["optimise_weights"](spark, SF).toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


@pytest.fixture(scope="module")
def lines(spark):
    """Series of 1 to 40 rows and one of 130, some of them never hot, one without a number."""
    rng = np.random.default_rng(11)
    sizes = [*rng.integers(1, 41, 30), 130]
    sid = np.repeat(np.arange(len(sizes)), sizes)
    own = pd.DataFrame({"sid": sid, "k": np.concatenate([rng.permutation(n) for n in sizes]), "a": rng.normal(size=len(sid)).round(2), "b": rng.integers(0, 5, len(sid)) * 1.0,
                        "Temperature": np.where(sid % 6 == 5, 500.0, 900.0) - rng.integers(0, 90, len(sid)), "Source": rng.random(len(sid))})
    df = spark.createDataFrame(own.sample(frac=1, random_state=3)).withColumns({
        "kind": F.expr("element_at(array('freeflame', 'burnerflame', 'equilibrium'), cast(sid % 3 + 1 as int))"),
        "folder": F.expr("concat('phi_', cast(sid % 4 as string))"), "file": F.col("sid").cast("string")})
    return df.unionByName(df.limit(3).withColumn("sid", F.lit(None).cast("long")))


@pytest.mark.parametrize("few", [True, False])
def test_rows_are_sorted_and_stored_once(lines, monkeypatch, few):
    if not few:
        monkeypatch.setattr(S, "FEW_SERIES", 0)
    real, stored = S.cut_lineage, []

    def store(df):
        stored.append(df.count())
        return real(df)

    monkeypatch.setattr(S, "cut_lineage", store)
    got, key = S.index_rows(lines, "sid", ["k"], chunk_rows=50)
    if few:  # and one row per series, or two
        assert sum(n >= lines.count() for n in stored) == 1
    rows = got.toPandas().sort_values(["sid", "k"]).reset_index(drop=True)
    want = lines.where("sid is not null").toPandas().sort_values(["sid", "k"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(rows[want.columns], want, check_dtype=False)
    assert (rows.row_idx == rows.groupby("sid").cumcount()).all()
    assert (rows.chunk == (np.arange(len(rows)) + 3) // 50).all()  # those without a number come first
    assert (rows[key.cut] == (rows.groupby("sid").chunk.transform("nunique") > 1)).all()


@pytest.mark.parametrize("marked", [True, False])
def test_only_series_across_a_border_go_by_chunks(lines, monkeypatch, marked):
    """The others need no chunk tables: their operators take all rows of a series at once."""
    spec = M.TableSpec(["a", "b"], ["Temperature"], ["Source"], nodes=9, lo=1.0, hi=3.0)
    plain = M.concatenate(*S.index_rows(lines, "sid", ["k"]), spec).toPandas()
    cut, key = S.index_rows(lines, "sid", ["k"], chunk_rows=50)
    if not marked:
        key = S.SeriesKey(key.series, key.order, key.chunk)
    crossing = {r.sid for r in cut.groupBy("sid").agg(F.countDistinct("chunk").alias("n")).where("n > 1").collect()}
    real, seen = M.arc_length, []

    def spy(df, k, *rest):
        seen.append((k.chunk, {r.sid for r in df.select("sid").distinct().collect()}))
        return real(df, k, *rest)

    monkeypatch.setattr(M, "arc_length", spy)
    got = M.concatenate(cut, key, spec).toPandas()
    by = ["series_no", "node"]
    plain, got = (x.sort_values(by).reset_index(drop=True) for x in (plain, got))
    pd.testing.assert_frame_equal(got, plain, rtol=1e-9)
    assert [c for c, _ in seen] == [None, "chunk"]
    assert seen[1][1] and seen[1][1] <= crossing and seen[0][1] and not seen[0][1] & crossing


@pytest.mark.parametrize("chunk_rows", [None, 50])
def test_hot_series_by_key(lines, chunk_rows):
    df, key = S.index_rows(lines, "sid", ["k"], chunk_rows=chunk_rows)
    want = S.having_max(df, "sid", "Temperature", 600.0).select("sid", "row_idx", "k").collect()
    got = S.having_max(df, key, "Temperature", 600.0).select("sid", "row_idx", "k")
    assert 0 < len(want) < df.count() and sorted(got.collect()) == sorted(want)


def test_nodes_are_sought_once_a_row(lines):
    """The first node of the following row is read from it, and no filter repeats the search."""
    df, key = S.index_rows(lines, "sid", ["k"])
    plan = R.resample(S.arc_length(df, key, ["a", "b"]), key, "s", ["a"], 9)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "acos" in plan and not any("acos" in line and "filter" in line for line in plan.splitlines())
    assert sum("acos" in line for line in plan.splitlines()) == 1


def test_reports_of_a_folder(spark, tmp_path):
    """Folders may be named instead of every report below them."""
    for worker, model in ((0, 1), (0, 2), (3, 1)):
        folder = tmp_path / f"w=Worker_{worker}" / f"m=Model_{model}"
        folder.mkdir(parents=True)
        (folder / "report.txt").write_text(f"Validation score: {worker + model / 8}\nArchitecture: 4 {model}\n")
    want = {(0, 1, 0.125), (0, 2, 0.25), (3, 1, 3.125)}
    for glob in ("w=*", "w=*/m=*/*.txt"):
        got = read_trial_reports(spark, f"{tmp_path}/{glob}").collect()
        assert {(r.worker, r.model, r.score) for r in got} == want and len(got) == 3


def test_hull_of_levels_thin_and_crowded(spark):
    """Levels with a few points in a batch are passed on, only crowded ones are cut: each ends as its own hull."""
    rng = np.random.default_rng(8)
    own = pd.DataFrame({"level": np.r_[np.zeros(2000, int), np.repeat(np.arange(1, 301), 6)], "x": rng.integers(0, 9, 3800) * 1.0,
                        "y": rng.integers(0, 9, 3800) * 1.0}).sample(frac=1, random_state=2)
    got = convex_hull(spark.createDataFrame(own), "level", "x", "y", group_points=70).toPandas()
    for level, g in own.groupby("level"):
        ring = got[got.level == level].sort_values("seq")[["x", "y"]].to_numpy()
        pts = np.unique(g[["x", "y"]].to_numpy(), axis=0)
        assert {tuple(p) for p in ring} <= {tuple(p) for p in pts} and len({tuple(p) for p in ring}) == len(ring)
        if len(ring) > 2:
            for a, b in zip(ring, np.roll(ring, -1, axis=0)):
                assert ((b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) >= 0).all()


def test_reports_are_written_by_many_tasks(spark, monkeypatch):
    """A table of small bytes and many files is not written by one task."""
    monkeypatch.setattr(tables, "_TASK_FILES", 2)
    written = []
    monkeypatch.setattr(tables, "read_trial_reports", lambda s, glob: (written.append(glob), read_trial_reports(s, glob))[1])
    got = entry.queries()["read_trial_reports"](spark, SF)
    files = spark.read.option("recursiveFileLookup", True).text(written[0]).select("_metadata.file_name").distinct().collect()
    assert got.count() == views.table(spark, SF, "supplier").count()
    assert len({f.file_name.split("-")[1] for f in files}) > 1  # the number of the task that wrote it


@pytest.mark.parametrize("gene", [False, True])
def test_search_reads_few_rows_and_decides_as_with_every_penalty(spark, monkeypatch, gene):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 3))
    y = np.abs(x).max(axis=1)
    x[:50], y[50:90] = 0.0, 0.0  # rows without a direction
    x[100:4000] = x[100]  # rows of one direction
    df = spark.createDataFrame(pd.DataFrame({**dict(zip("abc", x.T)), "y": y})).repartition(3)
    monkeypatch.setattr(SE, "BLOCK_ROWS", 100)
    packed = SE.PackedIncrements(df, list("abc"), "y")
    pop = rng.uniform(-1, 1, size=(40, 4))
    pop[:, 0] = np.abs(pop[:, 0]) + 0.1
    pop = pop if gene else pop[:, 1:]
    want = np.array([r.penalty for r in SE.candidate_scores(df, list("abc"), "y", pop, gene).orderBy("candidate").collect()])
    low, high = packed.bounds(pop, gene)
    assert np.allclose(packed.penalties(pop, gene), want, rtol=1e-9)
    assert (low <= want * (1 + 1e-8)).all() and (want <= high * (1 + 1e-8)).all() and (high <= low * 1.5).all()

    bounds = [(0.1, 10.0)] * gene + [(-1, 1)] * 3
    scored, whole = [], SE.PackedIncrements.penalties
    monkeypatch.setattr(SE.PackedIncrements, "penalties", lambda self, p, *a: scored.append(len(p)) or whole(self, p, *a))
    got = SE.evolve_weights(packed, list("abc"), "y", bounds, popsize=6, generations=8, bound_gene=gene)
    assert 0 < sum(scored) < 6 * len(bounds) * 9 / 2
    monkeypatch.setattr(SE.PackedIncrements, "bounds", lambda self, p, g=False: (whole(self, p, g),) * 2)
    every = SE.evolve_weights(packed, list("abc"), "y", bounds, popsize=6, generations=8, bound_gene=gene)
    assert np.array_equal(got[0], every[0]) and np.isclose(got[1], every[1], rtol=1e-9)
    packed.release()


@pytest.mark.parametrize("mounted", [True, False])
def test_search_goes_through_few_blocks_of_files_in_single_precision(spark, monkeypatch, mounted):
    """Rough bounds hold, decide as the others do, and the rows of a mounted folder stay in their files."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40_000, 3))
    y = np.linalg.norm(x, axis=1)
    x[:30], y[30:60] = 0.0, 0.0
    x[100:300] = x[100]
    df = spark.createDataFrame(pd.DataFrame({**dict(zip("abc", x.T)), "y": y})).repartition(3)
    if not mounted:
        monkeypatch.setattr(SE, "checkpoint_dir", lambda s: "hdfs://store/kept")
    monkeypatch.setattr(SE, "BLOCK_ROWS", 100)
    packed = SE.PackedIncrements(df, list("abc"), "y")
    assert packed.rows == 40_000 and packed.blocks.where("block is not null").isEmpty() == mounted
    pop = rng.uniform(-1, 1, size=(40, 3))
    want = packed.penalties(pop)
    scale = float(np.median(want))
    low, high = packed.rough_bounds(pop, scale)
    assert (low <= want).all() and (want <= high).all() and np.median(high - low) < 0.05 * scale
    assert packed.rough_bounds(pop, 1.0) is None and packed.rough_bounds(pop, np.inf) is None

    sharp, rough = [], SE.PackedIncrements.bounds
    monkeypatch.setattr(SE.PackedIncrements, "bounds", lambda self, p, g=False: sharp.append(len(p)) or rough(self, p, g))
    got = SE.evolve_weights(packed, list("abc"), "y", [(-1, 1)] * 3, popsize=6, generations=8)
    assert sum(sharp) < 18 * 4  # of 18 * 9 candidates
    monkeypatch.setattr(SE.PackedIncrements, "rough_bounds", lambda self, p, s: None)
    every = SE.evolve_weights(packed, list("abc"), "y", [(-1, 1)] * 3, popsize=6, generations=8)
    assert np.array_equal(got[0], every[0]) and np.isclose(got[1], every[1], rtol=1e-9)
    packed.release()
