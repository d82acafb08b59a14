"""Filters, statistics, splits and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import LI, LINE_ORDER, MIXED, mixture_rows, line_series, rounded, sql_hash, table
from tessera.operators import filters as FI
from tessera.operators import split as SP
from tessera.operators import stats as ST
from tessera.operators.sequence import index_rows
from tessera.operators.stats import SMALL_ROWS
from tessera.runtime import checkpoint_dir, cut_lineage
from tessera.sources.splits import read_splits, write_splits
from tessera.sources.trial_reports import append_history

_FOLDER = "'phi_' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS folder"
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _folders(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("phi_"), F.col("l_quantity").cast("int").cast("string")).alias("folder"))


_CHOSEN = f"""f AS (SELECT l_orderkey, l_linenumber, {_FOLDER} FROM lineitem),
n AS (SELECT folder, row_number() OVER (ORDER BY folder) - 1 AS rn FROM (SELECT DISTINCT folder FROM f))"""


@query("partition_filter", f"""WITH {_CHOSEN} SELECT * FROM f WHERE folder IN (SELECT folder FROM n WHERE rn % 3 = 0
  AND CAST(substring(folder, 5) AS DOUBLE) BETWEEN 5 AND 40)""")
def _partition(spark, d):
    return FI.partition_filter(_folders(spark, d), "folder", "phi_", 5.0, 40.0, 3)


@query("partition_filter_unbounded", f"WITH {_CHOSEN} SELECT * FROM f WHERE folder IN (SELECT folder FROM n WHERE rn % 3 = 0)")
def _partition_all(spark, d):
    return FI.partition_filter(_folders(spark, d), "folder", "phi_", 5.0, 40.0, 3, ignore_bounds=True)


@query("stride", f"WITH {_CHOSEN} SELECT folder FROM n WHERE rn % 4 = 0")
def _stride(spark, d):
    return FI.strided_values(_folders(spark, d), "folder", 4)


@query("parsed_bounds", """WITH o AS (SELECT o_orderkey, o_orderpriority AS kind, 'flame_Tu' || CAST(o_totalprice AS VARCHAR) || '.csv' AS file FROM orders)
SELECT o_orderkey, kind, file FROM o WHERE kind <> '1-URGENT' OR TRY_CAST(regexp_extract(file, '_Tu([0-9.]+?)\\.csv', 1) AS DOUBLE) BETWEEN 50000 AND 250000""")
def _parsed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"),
                                         F.concat(F.lit("flame_Tu"), F.col("o_totalprice").cast("string"), F.lit(".csv")).alias("file"))
    return FI.parsed_bounds(o, "file", "kind", "1-URGENT", r"_Tu([0-9.]+?)\\.csv", 50000.0, 250000.0)


@query("drop_invalid", """WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_tax, 0) AS a,
  CASE WHEN l_discount = 0.05 THEN 'nan'::DOUBLE WHEN l_discount = 0.06 THEN 'inf'::DOUBLE ELSE l_discount END AS b, l_quantity < 45 AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, a, b FROM b WHERE ok AND a IS NOT NULL AND b IS NOT NULL AND isfinite(a) AND isfinite(b)""")
def _invalid(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.try_divide("l_extendedprice", "l_tax").alias("a"),
        F.when(F.col("l_discount") == 0.05, float("nan")).when(F.col("l_discount") == 0.06, float("inf")).otherwise(F.col("l_discount")).alias("b"),
        (F.col("l_quantity") < 45).alias("ok"))
    return FI.drop_invalid(df, ["a", "b"], F.col("ok")).drop("ok")


@query("drop_all_zero", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0")
def _zero(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return FI.drop_all_zero(df, ["l_discount", "l_tax"])


@query("half_plane", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_extendedprice >= 10000e0 + (l_quantity - 10e0) * 1500e0")
def _half(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return FI.half_plane(df, "l_quantity", "l_extendedprice", (10.0, 10000.0), (30.0, 40000.0))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("columns_by_range", "WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", max({c}) - min({c}) AS span FROM lineitem" for c in _NUM[:3])
       + ") SELECT \"column\", span FROM s WHERE span > 0.5")
def _by_range(spark, d):
    spans = FI.column_spans(table(spark, d, "lineitem"), _NUM, exclude=["l_tax"])
    return spans.where(F.col("span") > 0.5)


@query("columns_except", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _except(spark, d):
    o = table(spark, d, "orders")
    return o.select(*FI.columns_except(o, ["o_custkey", "o_orderdate", "o_orderpriority"]))


@query("column_ranges", "SELECT l_suppkey, " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in _NUM) + " FROM lineitem GROUP BY l_suppkey")
def _ranges(spark, d):
    return ST.column_ranges(table(spark, d, "lineitem"), _NUM, ["l_suppkey"])


_SCALER = {
    "minmax": ("min({c})", "max({c}) - min({c})"), "standard": ("avg({c})", "stddev_pop({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}
for _kind, (_o, _s) in _SCALER.items():
    @query(f"fit_scaler_{_kind}", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round({_o.format(c=c)}, 6) AS \"offset\", round({_s.format(c=c)}, 6) AS scale FROM lineitem" for c in _NUM))
    def _scaler(spark, d, kind=_kind):
        return rounded(ST.scaler_table(spark, ST.fit_scaler(table(spark, d, "lineitem"), _NUM, kind)))


@query("fit_scaler_robust_narrowed", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round({_SCALER['robust'][0].format(c=c)}, 6) AS \"offset\", round({_SCALER['robust'][1].format(c=c)}, 6) AS scale FROM lineitem" for c in _NUM))
def _scaler_narrowed(spark, d):
    """All columns by radix selection, which small tables need not."""
    q = ST.exact_quantiles(table(spark, d, "lineitem"), _NUM, (0.25, 0.5, 0.75), small_rows=200)
    return rounded(ST.scaler_table(spark, {c: (v[1], v[2] - v[0]) for c, v in q.items()}))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(corr({a}, {b}), 6) + 0e0 AS r FROM lineitem" for a in _NUM[:3] for b in _NUM[:3]))
def _corr(spark, d):
    return rounded(ST.correlation_matrix(table(spark, d, "lineitem"), _NUM, exclude=["l_tax"]))


@query("mse", """SELECT round(avg((l_discount - l_tax) * (l_discount - l_tax)), 9) AS mse_a, round(avg((l_quantity / 50e0 - l_tax) * (l_quantity / 50e0 - l_tax)), 9) AS mse_b,
  round((avg((l_discount - l_tax) * (l_discount - l_tax)) + avg((l_quantity / 50e0 - l_tax) * (l_quantity / 50e0 - l_tax))) / 2, 9) AS mse FROM lineitem""")
def _mse(spark, d):
    return rounded(ST.mse(table(spark, d, "lineitem"), {"a": (F.col("l_discount"), F.col("l_tax")), "b": (F.expr("l_quantity / 50e0"), F.col("l_tax"))}), 9)


@query("r2", """WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem)
SELECT round(1 - sum((l_extendedprice - l_quantity * 2000e0) * (l_extendedprice - l_quantity * 2000e0)) / sum((l_extendedprice - m) * (l_extendedprice - m)), 6) AS r2_price FROM lineitem, m""")
def _r2(spark, d):
    return rounded(ST.r2(table(spark, d, "lineitem"), {"price": (F.expr("l_quantity * 2000e0"), F.col("l_extendedprice"))}))


_D = ("ya", "yb", "yc", "yd")
_ROW = lambda i: " + ".join(f"c{min(i, j)}{max(i, j)} * v{j}" for j in range(4))  # of the scaled covariance, times v


# the direction by power iteration
@query("principal_direction", f"""WITH RECURSIVE {LI}, dd AS (SELECT {', '.join(f'{c} - lag({c}) OVER o AS d{i}' for i, c in enumerate(_D))} FROM li WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx)),
cv AS MATERIALIZED (SELECT {', '.join(f'covar_pop(d{i}, d{j}) / ((max(d{i}) - min(d{i})) * (max(d{j}) - min(d{j}))) AS c{i}{j}' for i in range(4) for j in range(i, 4))} FROM dd WHERE d0 IS NOT NULL),
it AS (SELECT 0 AS n, 1e0 AS v0, 0.7e0 AS v1, 0.4e0 AS v2, 0.2e0 AS v3 UNION ALL
  SELECT n + 1, {', '.join(f'w{i} / sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3)' for i in range(4))} FROM (SELECT n, {', '.join(f'{_ROW(i)} AS w{i}' for i in range(4))} FROM it, cv WHERE n < 1000)),
top AS (SELECT [v0, v1, v2, v3] AS v, [abs(v0), abs(v1), abs(v2), abs(v3)] AS m FROM it WHERE n = 1000)
SELECT 'd_' || ['ya', 'yb', 'yc', 'yd'][i] AS "column", round(v[i] * sign(v[list_position(m, list_max(m))]), 5) AS weight FROM top, range(1, 5) t(i)""")
def _pca(spark, d):
    df, key = line_series(spark, d)
    from tessera.plans.weight_search import increments

    w = ST.principal_direction(increments(df, key, ["ya", "yb", "yc", "yd"], thin=False), ["d_ya", "d_yb", "d_yc", "d_yd"])
    return spark.createDataFrame([(c, round(v, 5)) for c, v in w.items()], "column string, weight double")


@query("auto_bounds", " UNION ALL ".join(f"SELECT '{n}' AS coordinates, '{c}' AS \"column\", min({c}) AS lo, max({c}) AS hi FROM lineitem"
                                        for n, cs in (("de", _NUM[:2]), ("pt", _NUM[2:])) for c in cs))
def _bounds(spark, d):
    return ST.auto_bounds(table(spark, d, "lineitem"), {"de": _NUM[:2], "pt": _NUM[2:]})


@query("dedupe_first", """WITH r AS (SELECT l_quantity, l_discount, l_tax, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (
  PARTITION BY l_quantity, l_discount, l_tax ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem)
SELECT l_quantity, l_discount, l_tax, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE rn = 1""")
def _dedupe(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_orderkey", "l_linenumber", "l_extendedprice")
    return SP.dedupe_first(df, ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_extendedprice"])


# with the place of each row in the new order
@query("shuffle", f"""SELECT {', '.join(_TIE[:-1])}, row_number() OVER (ORDER BY {sql_hash(_KEY, 11)}, {', '.join(_TIE)}) - 1 AS place FROM lineitem""")
def _shuffle(spark, d):
    df = table(spark, d, "lineitem").select(*_TIE)
    shuffled = SP.shuffle(df, SP.integer_hash(_KEY, 11), _TIE)
    # places as the rows lie: rows of the partitions before, and the row's number in its own
    rows = cut_lineage(shuffled.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").select(*_TIE[:-1], (F.col("start") + F.col("at")).alias("place"))


def _split_sql(names: tuple[str, str, str]) -> str:
    return f"""WITH r AS (SELECT {', '.join(_TIE)}, row_number() OVER (ORDER BY {sql_hash(_KEY, 5)}, {', '.join(_TIE)}) - 1 AS rn, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN rn < floor(0.8 * n) THEN '{names[0]}' WHEN rn < floor(0.8 * n) + floor(0.1 * n) THEN '{names[1]}' ELSE '{names[2]}' END AS split FROM r"""


for _layout in (("train", "val", "test"), ("train", "test", "val")):
    @query(f"split_exact_{_layout[1]}_second", _split_sql(_layout))
    def _split(spark, d, layout=_layout):
        df = table(spark, d, "lineitem").select(*_TIE)
        return SP.split_exact(df, SP.integer_hash(_KEY, 5), _TIE, 0.8, 0.1, layout).select(*_KEY, "split")


@query("mini_batches", f"""SELECT {', '.join(_KEY)}, CAST((row_number() OVER (ORDER BY {sql_hash(_KEY, 2)}, {', '.join(_TIE)}) - 1) // 64 AS BIGINT) AS batch FROM lineitem""")
def _batches(spark, d):
    df = table(spark, d, "lineitem").select(*_TIE).withColumn("_h", SP.integer_hash(_KEY, 2))
    return SP.mini_batches(df, ["_h", *_TIE], 6, rows_per_task=20_000).select(*_KEY, "batch")


@query("cycle_join", """WITH dom AS (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS BIGINT) AS batch FROM orders),
bnd AS (SELECT CAST(s_suppkey // 8 AS BIGINT) AS batch, sum(s_acctbal) AS total FROM supplier GROUP BY 1)
SELECT o_orderkey, dom.batch, bnd.batch AS boundary_batch, round(total, 2) AS total FROM dom JOIN bnd ON dom.batch % (SELECT max(batch) + 1 FROM bnd) = bnd.batch""")
def _cycle(spark, d):
    dom = SP.mini_batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5)
    bnd = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 8).cast("long").alias("batch")).agg(F.round(F.sum("s_acctbal"), 2).alias("total"))
    return SP.cycle_join(dom, bnd)


@query("sample_series", f"""WITH s AS (SELECT DISTINCT l_suppkey FROM lineitem), k AS (SELECT l_suppkey FROM s ORDER BY {sql_hash(['l_suppkey'], 9)}, l_suppkey LIMIT 5)
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM k)""")
def _sample(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return SP.sample_series(df, "l_suppkey", 5, SP.integer_hash(["l_suppkey"], 9))


@query("top_rows", "SELECT p_partkey, p_retailprice FROM part WHERE p_type <> 'ECONOMY' ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _top(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_type")
    return SP.top_rows(p, [F.desc("p_retailprice"), F.col("p_partkey")], 10, F.col("p_type") == "ECONOMY").drop("p_type")


_KINDS = {"free": "1-URGENT", "burner": "2-HIGH", "equilibrium": "5-LOW"}


@query("union_kinds", " UNION ALL ".join(f"SELECT o_orderkey, o_totalprice, '{k}' AS kind FROM orders WHERE o_orderpriority = '{v}'" for k, v in _KINDS.items()))
def _union(spark, d):
    o = table(spark, d, "orders")
    return SP.union_kinds({k: o.where(F.col("o_orderpriority") == v).select("o_orderkey", "o_totalprice") for k, v in _KINDS.items()})


@query("distinct_sorted", "SELECT DISTINCT l_discount FROM lineitem")
def _distinct(spark, d):
    return SP.distinct_sorted(table(spark, d, "lineitem"), "l_discount")


@query("stack_series", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey")
def _stack(spark, d):
    # the per-series results are already one table, so stacking them is grouping it
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("zip_blocks", f"""WITH {MIXED} SELECT l_orderkey, l_linenumber, "Temperature", "Cp", "Y-H2", "Y_dot_net-H2", "Heat_Release" FROM mix""")
def _zip(spark, d):
    controls, thermo, sources, lookup = ["Temperature"], ["Cp", "Y-H2"], ["Y_dot_net-H2"], ["Heat_Release"]
    return mixture_rows(spark, d).select("l_orderkey", "l_linenumber", *[F.col(f"`{c}`") for c in [*controls, *thermo, *sources, *lookup]])


@query("coef_join", """WITH c AS (SELECT p_partkey, p_retailprice / 1000e0 AS w FROM part)
SELECT l_suppkey, round(sum(l_quantity * w), 4) AS total FROM lineitem JOIN c ON l_partkey = p_partkey GROUP BY l_suppkey""")
def _coef(spark, d):
    coefs = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr("p_retailprice / 1000e0").alias("w"))
    got = SP.coef_join(table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity"), coefs, "l_partkey", ["l_suppkey"], "l_quantity", "w", "total")
    return got.withColumn("total", F.round("total", 4))


@query("read_splits", f"""WITH s AS ({_split_sql(("train", "val", "test"))}) SELECT l_orderkey, l_partkey, split FROM s WHERE split = 'val'""")
def _read_splits(spark, d):
    """The wanted part and columns of a written split table."""
    df = table(spark, d, "lineitem").select(*_TIE)
    path = f"{checkpoint_dir(spark)}/splits-{uuid.uuid4().hex}"
    write_splits(SP.split_exact(df, SP.integer_hash(_KEY, 5), _TIE, 0.8, 0.1), path)
    return read_splits(spark, path, ["l_orderkey"], ["l_partkey"], "val")


@query("append_history", "SELECT p_partkey, p_size AS generation, p_retailprice AS score FROM part")
def _append_history(spark, d):
    """Two runs append to one history."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("generation"), F.col("p_retailprice").alias("score"))
    path = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    append_history(rows.where("generation <= 20"), path)
    append_history(rows.where("generation > 20"), path)
    return spark.read.parquet(path)
