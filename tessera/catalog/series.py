"""Ordered-series queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import (ARC, EV, LI, MIXED, event_series, line_series, mixture_rows, rounded, sql_hash,
                                   sql_rounded, table)
from tessera.operators import resample as R
from tessera.operators import sequence as S
from tessera.operators.split import integer_hash
from tessera.plans.weight_search import increments

NODES = 16
CHUNK = 2_000  # rows per chunk of the *_chunked forms, which take the path of tables too large for one task

_DELTA = f"WITH {EV} SELECT event_id, round(value - lag(value) OVER o, 6) AS d_value, round(x - lag(x) OVER o, 6) AS d_x FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY row_idx)"


def _delta(spark, d, **kw):
    df, key = event_series(spark, d, **kw)
    return rounded(S.delta(df, key, ["value", "x"]).select("event_id", "d_value", "d_x"))


query("delta", _DELTA)(lambda spark, d: _delta(spark, d))
query("delta_chunked", _DELTA)(lambda spark, d: _delta(spark, d, chunk_rows=CHUNK))

_ARC = f"WITH {ARC} SELECT event_id, row_idx, round(s, 6) AS s, round(s_total, 6) AS s_total FROM arc"


def _arc(spark, d, **kw):
    df, key = event_series(spark, d, **kw)
    return rounded(S.arc_length(df, key, ["x", "value"]).select("event_id", "row_idx", "s", "s_total"))


query("arc_length", _ARC)(lambda spark, d: _arc(spark, d))
query("arc_length_chunked", _ARC)(lambda spark, d: _arc(spark, d, chunk_rows=CHUNK))


def _resample_sql(q: str) -> str:
    return f"""WITH {ARC}, seg AS (SELECT user_id, s AS s0, lead(s) OVER o AS s1, x AS x0, lead(x) OVER o AS x1,
  value AS v0, lead(value) OVER o AS v1 FROM arc WINDOW o AS (PARTITION BY user_id ORDER BY row_idx)),
nodes AS (SELECT CAST(i AS BIGINT) AS node, {q} AS q FROM range({NODES}) t(i))
SELECT user_id, node, round(q, 6) AS q,
  round(CASE WHEN s1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * ((q - s0) / (s1 - s0)) END, 4) AS x,
  round(CASE WHEN s1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((q - s0) / (s1 - s0)) END, 4) AS value
FROM seg JOIN nodes ON q >= s0 AND (s1 IS NULL OR q < s1)"""


_COSINE = f"0.5e0 - 0.5e0 * cos(i * {math.pi / (NODES - 1)!r})"


def _resampled(spark, d, spacing, **kw):
    df, key = event_series(spark, d, **kw)
    got = R.resample(S.arc_length(df, key, ["x", "value"]), key, "s", ["x", "value"], NODES, spacing)
    return got.select("user_id", "node", F.round("q", 6).alias("q"), F.round("x", 4).alias("x"), F.round("value", 4).alias("value"))


query("resample", _resample_sql(_COSINE))(lambda spark, d: _resampled(spark, d, "cosine"))
query("resample_uniform", _resample_sql(f"i * {1.0 / (NODES - 1)!r}"))(lambda spark, d: _resampled(spark, d, "uniform"))
query("resample_chunked", _resample_sql(_COSINE))(lambda spark, d: _resampled(spark, d, "cosine", chunk_rows=CHUNK))


@query("bracket_join", f"""WITH {LI}, seg AS (SELECT l_suppkey, row_idx, ya, lead(ya) OVER o AS ya1,
  (row_idx * 1e0) / (count(*) OVER (PARTITION BY l_suppkey) - 1) AS s0,
  ((row_idx + 1) * 1e0) / (count(*) OVER (PARTITION BY l_suppkey) - 1) AS s1
  FROM li WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx)),
nodes AS (SELECT CAST(i AS BIGINT) AS node, i * {1.0 / 9!r} AS q FROM range(10) t(i))
SELECT l_suppkey, node, round(CASE WHEN ya1 IS NULL THEN ya ELSE ya + (ya1 - ya) * ((q - s0) / (s1 - s0)) END, 6) AS ya
FROM seg JOIN nodes ON q >= s0 AND (ya1 IS NULL OR q < s1)""")
def _bracket(spark, d):
    df, key = line_series(spark, d)
    df = S.with_series_aggregates(df, key, {"_n": F.count(F.lit(1))})
    df = df.withColumn("s", F.try_divide(F.col("row_idx") * F.lit(1.0), F.col("_n") - 1))
    return R.resample(df, key, "s", ["ya"], 10, "uniform").select("l_suppkey", "node", F.round("ya", 6).alias("ya"))


_PV = f"""WITH {LI}, dd AS (SELECT *, ya - lag(ya) OVER o AS da, yb - lag(yb) OVER o AS db, yc - lag(yc) OVER o AS dc,
  (yd - lag(yd) OVER o) / (max(yd) OVER w - min(yd) OVER w + 1e-32) AS dx
  FROM li WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx), w AS (PARTITION BY l_suppkey))
SELECT l_suppkey, row_idx, round(da, 6) AS d_ya, round(db, 6) AS d_yb, round(dc, 6) AS d_yc,
  round(sqrt(da * da + db * db + dc * dc + dx * dx), 6) AS y FROM dd"""


@query("progress_vector", _PV)
def _progress(spark, d):
    df, key = line_series(spark, d)
    got = S.progress_vector(df, key, ["ya", "yb", "yc"], ["yd"])
    return rounded(got.select("l_suppkey", "row_idx", "d_ya", "d_yb", "d_yc", "y"))


# every row points to the row kept next; the kept rows are those on the way from the last row
_THIN = "WITH RECURSIVE " + ARC.replace("1e-10", "1e-32") + """,
tol AS (SELECT user_id, 0.02e0 * max(c) AS t FROM cum GROUP BY user_id),
nxt AS (SELECT a.user_id, a.row_idx, max(b.row_idx) AS below FROM cum a JOIN tol USING (user_id) JOIN cum b ON b.user_id = a.user_id AND b.c < a.c - t GROUP BY ALL),
k(user_id, row_idx) AS (SELECT user_id, max(row_idx) FROM cum GROUP BY user_id
  UNION ALL SELECT k.user_id, below FROM k JOIN nxt ON nxt.user_id = k.user_id AND nxt.row_idx = k.row_idx WHERE below > 0),
far AS (SELECT user_id, min(row_idx) AS beyond FROM cum JOIN tol USING (user_id) WHERE c > t GROUP BY user_id)
SELECT ev.user_id, ev.row_idx, event_id, x, value FROM ev LEFT JOIN far USING (user_id) LEFT JOIN k ON k.user_id = ev.user_id AND k.row_idx = ev.row_idx
WHERE ev.row_idx = 0 OR (k.row_idx IS NOT NULL AND NOT coalesce(ev.row_idx >= 1 AND ev.row_idx < beyond - 1, false))"""


@query("thin_monotone", _THIN)
def _thin(spark, d):
    df, key = event_series(spark, d)
    return S.thin_monotone(df, key, ["x", "value"], 0.02).select("user_id", "row_idx", "event_id", "x", "value")


@query("thin_monotone_chunked", _THIN)
def _thin_chunked(spark, d):
    df, key = event_series(spark, d, chunk_rows=CHUNK)
    return S.thin_monotone(df, key, ["x", "value"], 0.02, chunk_rows=CHUNK).select("user_id", "row_idx", "event_id", "x", "value")


@query("max_step", f"""WITH {LI} SELECT l_suppkey, row_idx, round(greatest(abs(ya - lag(ya) OVER o), abs(yb - lag(yb) OVER o),
  abs(yc - lag(yc) OVER o)), 6) AS max_step FROM li WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx)""")
def _max_step(spark, d):
    df, key = line_series(spark, d)
    return rounded(S.max_step(df, key, ["ya", "yb", "yc"]).select("l_suppkey", "row_idx", "max_step"))


@query("series_number", """WITH k AS (SELECT DISTINCT o_orderpriority AS kind, o_orderstatus AS folder,
  'c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS file FROM orders)
SELECT kind, folder, file, dense_rank() OVER (ORDER BY CASE kind WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2
  WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END, folder, file) - 1 AS series_no FROM k""")
def _series_number(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("folder"),
        F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("file"))
    kinds = ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED"]
    return S.series_number(o, "kind", "folder", "file", kinds)


@query("nodes_per_series", "SELECT CAST(count(*) // count(DISTINCT (o_orderpriority, o_custkey)) AS BIGINT) AS nodes FROM orders")
def _nodes(spark, d):
    return S.nodes_per_series(table(spark, d, "orders"), ["o_orderpriority", "o_custkey"])


@query("series_summary", f"""WITH {EV} SELECT user_id, arg_min(value, row_idx) AS value_first, arg_max(value, row_idx) AS value_last,
  min(value) AS value_min, max(value) AS value_max, max(value) - min(value) AS value_range FROM ev GROUP BY user_id""")
def _summary(spark, d):
    df, key = event_series(spark, d)
    return S.series_summary(df, key, ["value"])


for _method, _expr in {"start_end": "0.5e0 * (arg_min(yc, row_idx) OVER w + arg_max(yc, row_idx) OVER w)",
                       "arithmetic": "avg(yc) OVER w", "min_max": "0.5e0 * (min(yc) OVER w + max(yc) OVER w)",
                       "unity": "1e0", "constant": "0.7e0", "local": "yc"}.items():
    @query(f"series_average_{_method}", f"""WITH {LI} SELECT l_suppkey, row_idx, round({_expr}, 6) AS le_av FROM li
  WINDOW w AS (PARTITION BY l_suppkey)""")
    def _average(spark, d, method=_method):
        df, key = line_series(spark, d)
        got = S.series_average(df, key, "yc", method, 0.7, "le_av")
        return rounded(got.select("l_suppkey", "row_idx", "le_av"))


@query("value_at_extreme", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, row_idx) AS hi,
  row_number() OVER (PARTITION BY user_id ORDER BY value, row_idx) AS lo FROM ev)
SELECT user_id, max(CASE WHEN hi = 1 THEN x END) AS x_at_max, max(CASE WHEN lo = 1 THEN x END) AS x_at_min FROM r GROUP BY user_id""")
def _extreme(spark, d):
    df, _ = event_series(spark, d)
    hi = S.value_at_extreme(df, ["user_id"], "x", "value", ["row_idx"], True, "x_at_max")
    lo = S.value_at_extreme(df, ["user_id"], "x", "value", ["row_idx"], False, "x_at_min")
    return hi.join(lo, "user_id")


@query("residence_time", f"""WITH {EV}, n AS (SELECT user_id, value, lead(x) OVER (PARTITION BY user_id ORDER BY row_idx) - x AS dx FROM ev)
SELECT user_id, round(sum(dx / nullif(value, 0)), 3) AS residence_time FROM n GROUP BY user_id""")
def _residence(spark, d):
    df, key = event_series(spark, d)
    return rounded(S.residence_time(df, key, "x", "value"), 3)


@query("having_max", f"""WITH {EV}, k AS (SELECT user_id FROM ev GROUP BY user_id HAVING max(value) >= 200)
SELECT event_id, user_id, row_idx, value FROM ev WHERE user_id IN (SELECT user_id FROM k)""")
def _having_max(spark, d):
    df, key = event_series(spark, d)
    return S.having_max(df, "user_id", "value", 200.0).select("event_id", "user_id", "row_idx", "value")


@query("having_last", f"""WITH {EV}, k AS (SELECT user_id FROM ev GROUP BY user_id HAVING arg_max(value, row_idx) <= 40)
SELECT event_id, user_id, row_idx, value FROM ev WHERE user_id IN (SELECT user_id FROM k)""")
def _having_last(spark, d):
    df, key = event_series(spark, d)
    return S.having_last(df, key, "value", 40.0).select("event_id", "user_id", "row_idx", "value")


@query("drop_degenerate", """WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS row_idx FROM orders),
k AS (SELECT o_custkey, o_orderpriority FROM o GROUP BY ALL HAVING max(o_totalprice) > min(o_totalprice) OR o_orderpriority = '5-LOW')
SELECT o_orderkey, o.o_custkey, row_idx FROM o JOIN k USING (o_custkey, o_orderpriority)""")
def _degenerate(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice",
                                         F.concat_ws("|", "o_custkey", "o_orderpriority").alias("series"))
    df, key = S.index_rows(o, "series", ["o_orderkey"])
    got = S.drop_degenerate(S.arc_length(df, key, ["o_totalprice"]), "s_total", F.col("o_orderpriority") == "5-LOW")
    return got.select("o_orderkey", "o_custkey", "row_idx")


@query("zero_edges", f"""WITH {EV} SELECT event_id, CASE WHEN row_idx = min(row_idx) OVER w OR row_idx = max(row_idx) OVER w
  THEN 0e0 ELSE value END AS value FROM ev WINDOW w AS (PARTITION BY user_id)""")
def _zero_edges(spark, d):
    df, key = event_series(spark, d)
    return S.zero_edges(df, key, ["value"]).select("event_id", "value")


@query("zero_near_extremes", f"""WITH {EV} SELECT event_id, CASE WHEN x - min(x) OVER w < 0.02e0 * (max(x) OVER w - min(x) OVER w)
  OR max(x) OVER w - x < 0.02e0 * (max(x) OVER w - min(x) OVER w) THEN 0e0 ELSE value END AS value
  FROM ev WINDOW w AS (PARTITION BY user_id)""")
def _zero_near(spark, d):
    df, key = event_series(spark, d)
    return S.zero_near_extremes(df, "user_id", "x", ["value"]).select("event_id", "value")


@query("resample_random", f"""WITH {EV}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {sql_hash(['event_id'], 3)}, row_idx) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, event_id, row_idx FROM h WHERE rn <= 70
UNION ALL SELECT user_id, event_id, row_idx FROM h, LATERAL (SELECT unnest(range(70 - n))) WHERE row_idx = 0 AND n < 70""")
def _resample_random(spark, d):
    df, key = event_series(spark, d)
    return R.resample_random(df, key, 70, integer_hash(["event_id"], 3)).select("user_id", "event_id", "row_idx")


@query("first_row_repeat", f"""WITH {EV} SELECT user_id, x, 0e0 AS value, CAST(i AS INTEGER) AS node FROM ev, range(8) t(i) WHERE row_idx = 0""")
def _first_row(spark, d):
    df, key = event_series(spark, d)
    return R.first_row_repeat(df, key, 8, ["value"]).select("user_id", "x", "value", "node")


@query("increments", f"""WITH {LI}, dd AS (SELECT ya - lag(ya) OVER o AS a, yb - lag(yb) OVER o AS b, yc - lag(yc) OVER o AS c
  FROM li WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx))
SELECT round(a, 6) AS d_ya, round(b, 6) AS d_yb, round(c, 6) AS d_yc, round(greatest(abs(a), abs(b), abs(c)), 6) AS y FROM dd WHERE a IS NOT NULL""")
def _increments(spark, d):
    df, key = line_series(spark, d)
    return rounded(increments(df, key, ["ya", "yb", "yc"], thin=False))


@query("increments_thinned")
def _increments_thinned(spark, d):
    df, key = line_series(spark, d)
    return increments(df, key, ["ya", "yb", "yc"], ["yd"], tol=1e-3)
