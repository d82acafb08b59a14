"""File round trips and the whole-table plans, on files and profiles derived from the supplied tables."""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import query
from tessera.catalog.series import _COSINE, NODES, _resample_sql
from tessera.catalog.rows import _TIE, _split_sql
from tessera.catalog.views import (EV, LI, LINE_ORDER, PT, event_series, line_series, rounded, sql_hash, table)
from tessera.operators import split as SP
from tessera.operators.sequence import SeriesKey
from tessera.plans.lookup_table import lookup_levels, tune_and_index
from tessera.plans.manifold_table import TableSpec, boundary_table, concatenate
from tessera.plans.weight_search import optimise_weights
from tessera.runtime import checkpoint_dir
from tessera.sources.profiles import read_profiles, write_profiles
from tessera.sources.splits import read_splits, write_splits
from tessera.sources.trial_reports import read_trial_reports
from tessera.streaming.profiles import ingest_profiles

_PROFILE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("event_id", "x", "value")])


def _event_files(spark, d) -> str:
    """One CSV per event series, rows in series order; returns the root of the tree."""
    root = f"{checkpoint_dir(spark)}/profiles-{uuid.uuid4().hex}"
    df, key = event_series(spark, d)
    rows = df.select("user_id", "row_idx", F.col("event_id").cast("double").alias("event_id"), "x", "value",
                     F.concat(F.lit("phi_"), F.col("user_id").cast("string")).alias("folder"))
    write_profiles(rows, f"{root}/freeflame_data", "user_id", "folder", "row_idx", ["event_id", "x", "value"])
    return root


@query("read_profiles", f"WITH {EV} SELECT 'freeflame' AS kind, CAST(user_id AS DOUBLE) AS mix_status, row_idx, CAST(event_id AS DOUBLE) AS event_id, x, value FROM ev")
def _read(spark, d):
    df, _ = read_profiles(spark, _event_files(spark, d), header="folder=phi_", schema=_PROFILE)
    return df.select("kind", "mix_status", "row_idx", "event_id", "x", "value")


@query("ingest_profiles", _resample_sql(_COSINE))
def _ingest(spark, d):
    root = _event_files(spark, d)
    run = ingest_profiles(spark, root, f"{root}-out", f"{root}-state", _PROFILE, ["x", "value"], [], NODES)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    got = spark.read.parquet(f"{root}-out")
    user = F.regexp_extract("series_id", r"phi_(\d+)/", 1).cast("long")
    return got.select(user.alias("user_id"), "node", F.round("q", 6).alias("q"), F.round("x", 4).alias("x"), F.round("value", 4).alias("value"))


@query("write_read_splits", f"WITH s AS ({_split_sql(('train', 'val', 'test'))}) SELECT l_orderkey, l_partkey, l_suppkey, split FROM s WHERE split = 'test'")
def _splits(spark, d):
    path = f"{checkpoint_dir(spark)}/splits-{uuid.uuid4().hex}"
    df = table(spark, d, "lineitem").select(*_TIE)
    write_splits(SP.split_exact(df, SP.integer_hash(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5), _TIE, 0.8, 0.1), path)
    return read_splits(spark, path, ["l_orderkey", "l_partkey"], ["l_suppkey"], "test")


# --- concatenation of all suppliers as profiles -----------------------------------------------------------

_KINDS = ("freeflame", "burnerflame", "equilibrium")


def _supplier_profiles(spark, d, chunk_rows: int | None = None, kinds: tuple[str, ...] = _KINDS):
    df, key = line_series(spark, d) if chunk_rows is None else line_series(spark, d, chunk_rows)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_suppkey") % len(kinds) + 1).cast("int"))
    return df.withColumns({
        "kind": kind, "folder": F.concat(F.lit("phi_"), (F.col("l_suppkey") % 7).cast("string")),
        "file": F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
        "Temperature": F.expr("300e0 + l_quantity * 40e0"), "Source": F.expr("l_discount * l_quantity")}), key


def _concat_sql(kinds: str, bounded: str, every: tuple[str, ...] = _KINDS, table_mode: bool = False) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in every) + "]"
    edge = ("300e0 + l_quantity * 40e0 - min(300e0 + l_quantity * 40e0) OVER w < 0.02e0 * (max(300e0 + l_quantity * 40e0) OVER w - min(300e0 + l_quantity * 40e0) OVER w) "
            "OR max(300e0 + l_quantity * 40e0) OVER w - (300e0 + l_quantity * 40e0) < 0.02e0 * (max(300e0 + l_quantity * 40e0) OVER w - min(300e0 + l_quantity * 40e0) OVER w)"
            if table_mode else "row_idx = 0 OR row_idx = count(*) OVER w - 1")
    flames, repeated = "", ""
    if table_mode:
        flames = "kind <> 'equilibrium' AND "
        repeated = f"UNION ALL SELECT series_no, CAST(i AS BIGINT), ya, yb, yc, Temperature, 0e0 FROM ar, range({NODES}) t(i) WHERE kind = 'equilibrium' AND row_idx = 0"
    q = f"CASE WHEN kind = 'equilibrium' THEN i * {1.0 / (NODES - 1)!r} ELSE 0.5e0 - 0.5e0 * cos(i * {math.pi / (NODES - 1)!r}) END"
    nrm = lambda c: f"({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-10) AS n_{c}"
    sq = " + ".join(f"(n_{c} - lag(n_{c}) OVER o) * (n_{c} - lag(n_{c}) OVER o)" for c in ("ya", "yb", "yc"))
    interp = ", ".join(f"CASE WHEN s1 IS NULL THEN {c} ELSE {c} + (n1_{c} - {c}) * ((q - s0) / (s1 - s0)) END AS {c}" for c in ("ya", "yb", "yc", "Temperature", "Source"))
    return f"""WITH {LI}, pr AS (SELECT l_suppkey, row_idx, ya, yb, yc, 300e0 + l_quantity * 40e0 AS Temperature,
  CASE WHEN {edge} THEN 0e0 ELSE l_discount * l_quantity END AS Source,
  {names}[CAST(l_suppkey % {len(every)} + 1 AS INTEGER)] AS kind, 'phi_' || CAST(l_suppkey % 7 AS VARCHAR) AS folder,
  lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS file FROM li WINDOW w AS (PARTITION BY l_suppkey)),
ch AS (SELECT *, dense_rank() OVER (ORDER BY list_position({names}, kind), folder, file) - 1 AS series_no FROM pr WHERE kind IN ({kinds}) {bounded}),
bu AS (SELECT * FROM ch WHERE l_suppkey IN (SELECT l_suppkey FROM ch GROUP BY l_suppkey HAVING max(Temperature) >= 600)),
n AS (SELECT *, {nrm('ya')}, {nrm('yb')}, {nrm('yc')} FROM bu WINDOW w AS (PARTITION BY l_suppkey)),
st AS (SELECT *, coalesce(sqrt({sq}), 0) AS step FROM n WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx)),
cu AS (SELECT *, sum(step) OVER (PARTITION BY l_suppkey ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS c FROM st),
ar AS (SELECT *, c / (max(c) OVER (PARTITION BY l_suppkey) + 1e-32) AS s0 FROM cu),
sg AS (SELECT *, lead(s0) OVER o AS s1, {', '.join(f'lead({c}) OVER o AS n1_{c}' for c in ('ya', 'yb', 'yc', 'Temperature', 'Source'))} FROM ar WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx)),
nd AS (SELECT *, {q} AS q FROM sg, range({NODES}) t(i)),
rs AS (SELECT series_no, CAST(i AS BIGINT) AS node, {interp} FROM nd WHERE {flames}q >= s0 AND (s1 IS NULL OR q < s1) {repeated}),
dd AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY ya, yb, yc ORDER BY series_no, node) = 1),
sp AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(['series_no', 'node'], 7)}, series_no, node) - 1 AS rn, count(*) OVER () AS cnt FROM dd)
SELECT round(ya, 6) AS ya, round(yb, 6) AS yb, round(yc, 6) AS yc, round(Temperature, 4) AS "Temperature", round(Source, 6) AS "Source", series_no, node,
  CASE WHEN rn < floor(0.8 * cnt) THEN 'train' WHEN rn < floor(0.8 * cnt) + floor(0.1 * cnt) THEN 'val' ELSE 'test' END AS split FROM sp"""


_SPEC = TableSpec(["ya", "yb", "yc"], ["Temperature"], ["Source"], _KINDS, NODES, lo=1.0, hi=5.0)


def _tidy(df):
    return df.select(*[F.round(c, 4 if c == "Temperature" else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_ALL = ", ".join(f"'{k}'" for k in _KINDS)
_BOUNDED = "AND CAST(substring(folder, 5) AS DOUBLE) BETWEEN 1 AND 5"


@query("concatenate", _concat_sql(_ALL, _BOUNDED))
def _concatenate(spark, d):
    return _tidy(concatenate(*_supplier_profiles(spark, d), _SPEC))


@query("concatenate_chunked", _concat_sql(_ALL, _BOUNDED))
def _concatenate_chunked(spark, d):
    return _tidy(concatenate(*_supplier_profiles(spark, d, 20_000), _SPEC))


_FOUR = (*_KINDS, "counterflame")


@query("concatenate_counterflow", _concat_sql(f"{_ALL}, 'counterflame'", f"AND (kind = 'counterflame' OR {_BOUNDED[4:]})", _FOUR))
def _concatenate_counterflow(spark, d):
    """With a kind that has no mixture folders, so no bounds."""
    return _tidy(concatenate(*_supplier_profiles(spark, d, kinds=_FOUR), replace(_SPEC, kinds=_FOUR)))


@query("concatenate_table_mode", _concat_sql(_ALL, _BOUNDED, table_mode=True))
def _concatenate_table_mode(spark, d):
    """Sources vanish near both ends of the temperature; equilibrium states repeat their first row."""
    return _tidy(concatenate(*_supplier_profiles(spark, d), replace(_SPEC, table_mode=True)))


@query("concatenate_fuzzy")
def _concatenate_fuzzy(spark, d):
    """With a kind of which random rows are taken, its bounds in force though those of the others are not."""
    kinds = ("freeflame", "fuzzy")
    return _tidy(concatenate(*_supplier_profiles(spark, d, kinds=kinds), replace(_SPEC, kinds=kinds, ignore_bounds=True)))


_REPORTS = """r AS (SELECT s_suppkey, s_suppkey % 5 AS worker, s_suppkey AS model, 1 + s_nationkey AS minutes, CASE WHEN s_suppkey % 7 = 0 THEN 'nan' ELSE CAST(s_nationkey / 64e0 AS VARCHAR) END AS score,
  s_suppkey % 90 AS neurons, s_acctbal AS cost, s_suppkey % 3 AS layers FROM supplier)"""


_TASK_FILES = 500  # files that a task writes; by its bytes alone the table would end in one task


@query("read_trial_reports", f"""WITH {_REPORTS} SELECT CAST(worker AS INTEGER) AS worker, CAST(model AS INTEGER) AS model, minutes * 1e0 AS train_minutes,
  CASE WHEN score = 'nan' THEN 10e0 ELSE CAST(score AS DOUBLE) END AS score, CAST(neurons AS INTEGER) AS neurons, round(cost * 1e0, 6) AS cost, CAST(layers + 1 AS INTEGER) AS hidden_layers,
  CAST(neurons * (layers + 1) AS BIGINT) AS width FROM r""")
def _reports(spark, d):
    """A report file per supplier, its lines in another order for every other one, written and read back."""
    r = table(spark, d, "supplier")
    score = F.when(F.col("s_suppkey") % 7 == 0, "nan").otherwise((F.col("s_nationkey") / F.lit(64.0)).cast("string"))
    neurons, layers = F.col("s_suppkey") % 90, F.col("s_suppkey") % 3 + 1
    held = {"Training time[minutes]": (F.col("s_nationkey") + 1).cast("string"), "Validation score": score, "Total neuron count": neurons.cast("string"),
            "Evaluation cost parameter": F.col("s_acctbal").cast("string"), "Number of hidden layers": layers.cast("string"),
            "Architecture": F.array_join(F.array_repeat(neurons.cast("string"), layers.cast("int")), " ")}
    lines = F.array(*[F.concat(F.lit(k + ": "), v) for k, v in held.items()])
    lines = F.when(F.col("s_suppkey") % 2 == 0, F.reverse(lines)).otherwise(lines)
    path = f"{checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    (r.select(F.concat(F.lit("Worker_"), F.col("s_suppkey") % 5).alias("w"), F.concat(F.lit("Model_"), F.col("s_suppkey")).alias("m"), F.array_join(lines, "\n").alias("value"))
     .repartition(max(1, -(-r.count() // _TASK_FILES)), "w", "m").write.partitionBy("w", "m").text(path))
    got = read_trial_reports(spark, f"{path}/w=*")
    width = F.aggregate("architecture", F.lit(0).cast("long"), lambda a, v: a + v)
    return got.select("worker", "model", "train_minutes", "score", "neurons", F.round("cost", 6).alias("cost"), "hidden_layers", width.alias("width"))


@query("boundary_table", _concat_sql("'equilibrium'", ""))
def _boundary(spark, d):
    return _tidy(boundary_table(*_supplier_profiles(spark, d), _SPEC))


def _optimised(spark, d, method):
    """Weights over all suppliers of the search kinds: filters, relevant columns, thinning, and the search of ``method``."""
    df, key = _supplier_profiles(spark, d)
    df = df.select(*key.part, "row_idx", "kind", F.expr("cast(substring(folder, 5) as double)").alias("mix_status"),
                   F.expr("2 * l_tax").alias("Distance"), *[F.col(c).alias(f"Y-{c}") for c in ("ya", "yb", "yc", "yd")])
    return optimise_weights(df, key, method=method, mixture=(1.0, 5.0))


@query("optimise_weights")
def _weights(spark, d):
    """Weights along the principal direction."""
    got = _optimised(spark, d, "principal")
    return spark.createDataFrame([(s, float(w), got.monotonic) for s, w in zip(got.species, got.weights)],
                                 "species string, weight double, monotonic boolean")


def _searched(spark, d, method):
    got = _optimised(spark, d, method)
    return spark.createDataFrame([(s, float(w), float(got.penalty), got.monotonic) for s, w in zip(got.species, got.weights)],
                                 "species string, weight double, penalty double, monotonic boolean")


@query("optimise_weights_penalty")
def _weights_penalty(spark, d):
    return _searched(spark, d, "penalty")


@query("optimise_weights_bound")
def _weights_bound(spark, d):
    return _searched(spark, d, "bound")


@query("lookup_table")
def _lookup(spark, d):
    """Parts interpolated, with tuned neighbours, on graded meshes of four levels over the price-size plane; probe and cell sizes are the defaults."""
    pt = table(spark, d, "part").select("p_partkey", F.expr("p_retailprice").alias("pv"), F.expr("p_size * 1e0").alias("h"),
                                        F.expr("(p_partkey % 97) / 97e0").alias("z"), F.expr("p_retailprice * p_size").alias("src"))
    pt = SP.split_exact(pt, SP.integer_hash(["p_partkey"], 4), ["p_partkey"], 0.8, 0.1)
    index, p, _ = tune_and_index(pt, ["pv", "h", "z"], "src", ["src"], "p_partkey")
    levels = pt.groupBy(F.floor(F.col("z") * 4).cast("int").alias("level")).agg(F.avg("z").alias("z"))
    one, zero = F.lit(1.0), F.lit(0.0)
    levels = levels.withColumns({"x_u": zero, "x_b": one, "yu_lo": F.lit(0.3), "yu_hi": one, "yb_lo": zero, "yb_hi": F.lit(0.7)})
    return lookup_levels(index, p, levels, "src", ["src"]).nodes
