from __future__ import annotations

import os
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.grid import lattice_triangles
from tessera.operators.resample import resample
from tessera.operators.sequence import arc_length, drop_degenerate
from tessera.sources import profiles
from tessera.sources.export import export_projection
from tessera.sources.level_table import level_table_text, read_level_text, write_level_table, write_level_text
from tessera.sources.profiles import profile_schema, read_profiles, require_columns, write_profiles
from tessera.sources.splits import read_splits, write_splits
from tessera.sources.trial_reports import append_history, read_trial_reports
from tessera.streaming.profiles import ingest_profiles
from tests.conftest import SPECIES


def test_read_profiles(spark, profile_tree):
    df, key = read_profiles(spark, profile_tree)
    assert df.select("series_id").distinct().count() == 4 * 2 + 4 + 4 + 3
    one = df.where("kind = 'freeflame' and folder = 'phi_10.0' and file like '%Tu350.0.csv'").orderBy("row_idx").toPandas()
    want = np.loadtxt(f"{profile_tree}/freeflame_data/phi_10.0/freeflamelet_phi10.0_Tu350.0.csv", delimiter=",", skiprows=1)
    assert len(one) == len(want) and list(one.row_idx) == list(range(len(want)))
    assert np.array_equal(one["Distance"], want[:, 0]) and (one.mix_status == 10.0).all()
    cut, _ = read_profiles(spark, profile_tree, chunk_rows=60)
    a = df.select("series_id", "row_idx", "Distance").exceptAll(cut.select("series_id", "row_idx", "Distance"))
    assert a.count() == 0


def test_rows_are_numbered_over_the_splits_of_a_file(spark, tmp_path):
    folder = tmp_path / "freeflame_data" / "phi_1.0"
    folder.mkdir(parents=True)
    for name, n in (("a", 5000), ("b", 1), ("c", 700), ("none", 0)):
        (folder / f"{name}.csv").write_text("n,v\n" + "".join(f"{i},{i * 0.5}\n" for i in range(n)))
    (tmp_path / "other_data").mkdir()
    (tmp_path / "other_data" / "x.csv").write_text("not,a,profile\n1,2,3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for chunk_rows in (10**6, 900):
            df, key = read_profiles(spark, str(tmp_path), kinds=["freeflame"], chunk_rows=chunk_rows)
            assert df.where("row_idx != n").isEmpty() and df.count() == 5701 and (key.chunk is None) == (chunk_rows > 5701)
            if key.chunk:
                assert df.groupBy("series_id", "chunk").count().agg(F.max("count")).first()[0] == 900
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ragged_and_foreign_files_fail(spark, tmp_path):
    d = tmp_path / "freeflame_data" / "phi_1.0"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("x,y\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|number of columns"):
        read_profiles(spark, str(tmp_path))[0].collect()
    (d / "a.csv").write_text("x,y\n1,2\n")
    schema = profile_schema(spark, str(tmp_path))
    (d / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(Exception):
        read_profiles(spark, str(tmp_path), schema=schema)[0].collect()


def test_require_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ['"a"', " b"])
    assert require_columns(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="nope"):
        require_columns(df, ["nope"])


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_splits_round_trip(spark, tmp_path, fmt):
    df = spark.range(50).select("id", (F.col("id") * 1.5).alias("v"), F.when(F.col("id") < 40, "train").otherwise("val").alias("split"))
    write_splits(df, str(tmp_path / fmt), fmt)
    got = read_splits(spark, str(tmp_path / fmt), ["id"], ["v"], "val", fmt)
    assert got.count() == 10 and got.columns == ["id", "v", "split"]
    assert read_splits(spark, str(tmp_path / fmt), ["id"], ["v"], "full", fmt).count() == 50
    if fmt == "parquet":
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(split" in plan


def test_level_table(spark, tmp_path):
    nodes = spark.range(12).select(F.floor(F.col("id") / 6).cast("int").alias("level"), (F.col("id") % 6).alias("node")).withColumns(
        {"i": F.floor(F.col("node") / 3), "j": F.col("node") % 3, "x": F.col("node") * 0.5, "v": F.col("node") * -1.25})
    tri = lattice_triangles(nodes, "level", "i", "j", "node").withColumn("tri", F.monotonically_increasing_id())
    hull = nodes.where("node in (0, 2, 3, 5)").select("level", F.col("node").alias("seq"), "node")
    levels = spark.createDataFrame([(0, 0.25), (1, 0.75)], "level int, level_value double")
    text = level_table_text(nodes, tri, hull, levels, ["x", "v"], {"H2": -0.5, "O2": 1.0})
    write_level_text(text, str(tmp_path / "text"), lines_per_file=20)
    parts = sorted(p for p in os.listdir(tmp_path / "text") if p.startswith("part"))
    lines = "".join(pathlib.Path(tmp_path / "text" / p).read_text() for p in parts).split("\n")
    at = lines.index
    assert lines[at("[Number of table levels]") + 1] == "2"
    assert lines[at("[Table levels]") + 1:][:2] == ["+2.5000000000000000e-01", "+7.5000000000000000e-01"]
    assert lines[at("[Number of points]") + 1:][:2] == ["6", "6"]
    assert lines[at("[Number of triangles]") + 1:][:2] == ["4", "4"]
    assert lines[at("[Number of hull points]") + 1:][:2] == ["4", "4"]
    assert lines[at("[Progress variable definition]") + 1] == "-5.0000e-01 * H2++1.0000e+00 * O2"
    assert lines[at("<Data>") + 1] == "<Level>" and lines[at("<Data>") + 3] == "+5.00000000000000e-01\t-1.25000000000000e+00"
    assert lines[at("<Hull>"):at("</Hull>") + 1] == ["<Hull>", *(["<Level>", "1", "3", "4", "6", "</Level>"] * 2), "</Hull>"]
    assert len(parts) > 2
    for k, folder in enumerate(("text", "whole")):  # sections begin in one file and go on in the next
        if k:
            write_level_text(text, str(tmp_path / folder))
        back = read_level_text(spark, str(tmp_path / folder))
        assert back.variables == ["x", "v"] and sorted(map(tuple, back.levels.collect())) == [(0, 0.25), (1, 0.75)]
        assert sorted(map(tuple, back.nodes.collect())) == [(v, n, n * 0.5, n * -1.25) for v in (0, 1) for n in range(6)]
        assert sorted(r[2:] for r in back.triangles.collect()) == sorted(tuple(r) for r in tri.select("a", "b", "c").collect())
        assert sorted(map(tuple, back.hull.collect())) == [(v, i, n) for v in (0, 1) for i, n in enumerate((0, 2, 3, 5))]
    write_level_table(nodes, tri, hull, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "triangles")).count() == 8


REPORT = """Training time[minutes]: +1.000e+00
Validation score: {score}
Total neuron count:  20
Evaluation time[seconds]: +2.000e-01
Evaluation cost parameter: +1.400000e+02
Alpha exponent: -2.6000000000000001e+00
Learning rate decay: +9.8999999999999999e-01
Batch size exponent: 6
Decay steps: 77
Activation function index: 3
Number of hidden layers: 2
Architecture: 10 10
"""


def test_trial_reports_and_history(spark, tmp_path):
    for w, m, s in ((0, 1, "+1.5e-03"), (2, 7, "nan")):
        d = tmp_path / f"Worker_{w}" / f"Model_{m}"
        d.mkdir(parents=True)
        (d / "MLP_performance.txt").write_text(REPORT.format(score=s))
    got = {(r.worker, r.model): r for r in read_trial_reports(spark, str(tmp_path / "Worker_*" / "Model_*" / "*.txt")).collect()}
    assert got[0, 1].score == 1.5e-3 and got[2, 7].score == 10.0 and got[0, 1].architecture == [10, 10] and got[0, 1].cost == 140.0
    for g in range(3):
        append_history(spark.createDataFrame([(g, 0.1)], "generation int, score double"), str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 3


def test_export(spark, profile_tree):
    df, _ = read_profiles(spark, profile_tree, kinds=["equilibrium"])
    molar = dict(zip(SPECIES, (2.016, 31.998, 28.014, 18.015, 30.006)))
    out = export_projection(df, SPECIES, molar)
    assert out.columns[:2] == ["Distance (m)", "T (K)"] and len(out.columns) == 9 + 6 * 5
    a, b = df.agg(F.sum("Y_dot_pos-H2")).first()[0], out.agg(F.sum("ReacRatePos-H2")).first()[0]
    assert b == pytest.approx(a / 2.016)


def test_stream_equals_batch(spark, profile_tree, tmp_path):
    cols = ["Temperature", "Density"]
    schema = profile_schema(spark, profile_tree)
    run = ingest_profiles(spark, profile_tree, str(tmp_path / "out"), str(tmp_path / "state"), schema, cols, ["Cp"], 12)
    run.awaitTermination()
    assert run.exception() is None
    streamed = spark.read.parquet(str(tmp_path / "out")).select("series_id", "node", *[F.round(c, 9).alias(c) for c in [*cols, "Cp"]])
    df, key = read_profiles(spark, profile_tree)
    curve = drop_degenerate(arc_length(df, key, cols), "s_total", F.col("kind") == "equilibrium")
    batch = resample(curve, key, "s", [*cols, "Cp"], 12).select("series_id", "node", *[F.round(c, 9).alias(c) for c in [*cols, "Cp"]])
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count() > 0


def test_series_files_are_written_by_the_tasks(spark, tmp_path):
    """One whole file a series and none beside it under a mounted root; the same rows as by Spark's writer elsewhere."""
    rows = [(u, i, None if i == 3 else u * 10.0 + i, float("nan") if i == 4 else i / 3) for u in (1, 2, None) for i in range(12, -1, -1) if u]
    rows += [(None, i, 1e300 * i, float("inf")) for i in range(3)]
    df = spark.createDataFrame(rows, "u long, i long, v double, w double").withColumn("f", F.concat(F.lit("phi_"), F.col("u").cast("string")))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("v", "w")])
    got = []
    for name, root in (("a", f"file:{tmp_path}/a"), ("b", f"{tmp_path}/b")):
        write_profiles(df, f"{root}/freeflame_data", "u", "f", "i", ["v", "w"])
        read, _ = read_profiles(spark, root, kinds=["freeflame"], header="f=phi_" if name == "b" else "folder=phi_", schema=schema)
        got.append(sorted(map(repr, read.select("mix_status", "row_idx", "v", "w").collect())))
    assert got[0] == got[1] and len(got[0]) == 29
    files = sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "a").rglob("*") if p.is_file())
    assert files == [f"a/freeflame_data/folder={f}/part-00000.csv" for f in ("__HIVE_DEFAULT_PARTITION__", "phi_1", "phi_2")]


def test_small_files_share_tasks_and_whole_series_need_no_chunks(spark, tmp_path, monkeypatch):
    """Not a task for every 32 files, in a stream neither; only a file too long for a task is cut."""
    names = ["spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"]
    rng = np.random.default_rng(2)
    for u in range(400):
        folder = tmp_path / "in" / "freeflame_data" / f"phi_{u}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text("n,v\n" + "".join(f"{i},{v}\n" for i, v in enumerate(rng.random(1 + u % 7).round(3))))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in "nv"])
    parts, stored = [], profiles.cut_lineage
    monkeypatch.setattr(profiles, "cut_lineage", lambda df: parts.append(df.rdd.getNumPartitions()) or stored(df))
    monkeypatch.setattr(profiles, "CHUNK_ROWS", 7)
    df, key = read_profiles(spark, str(tmp_path / "in"), ["freeflame"], schema=schema)
    assert key.chunk is None and df.where("row_idx != n").isEmpty() and df.count() == sum(1 + u % 7 for u in range(400))

    settings, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        run = ingest_profiles(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), schema, ["n", "v"], [], 5,
                              derive=lambda df: settings.append(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) or df)
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert run.exception() is None and settings == ["3"] and max(parts) <= 6 and len(parts) == 2
    got = spark.read.parquet(str(tmp_path / "out"))
    curve = drop_degenerate(arc_length(df, key, ["n", "v"]), "s_total")
    cols = ["mix_status", "node", F.round("v", 9).alias("v")]
    assert got.select(cols).exceptAll(resample(curve, key, "s", ["n", "v"], 5, carry=["mix_status"]).select(cols)).isEmpty() and got.count() == 5 * sum(u % 7 > 0 for u in range(400))
    assert [spark.conf.get(n, None) for n in names] == [None, None]

    (tmp_path / "in" / "freeflame_data" / "phi_0" / "b.csv").write_text("n,v\n" + "".join(f"{i},1.0\n" for i in range(8)))
    cut, key = read_profiles(spark, str(tmp_path / "in"), ["freeflame"], schema=schema)
    assert key.chunk == "chunk" and cut.where("row_idx != n").isEmpty() and cut.count() == df.count() + 8
