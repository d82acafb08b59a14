"""Nearest-neighbour queries on scattered points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import PT, part_points, rounded, sql_hash, table
from tessera.operators import knn as K
from tessera.operators import split as SP

_Q = "q AS (SELECT c_custkey, c_acctbal / 10000e0 AS x, c_nationkey / 25e0 AS y FROM customer)"
_NEAR = """d AS (SELECT c_custkey, p_partkey, v, w, sqrt((q.x - pt.x) * (q.x - pt.x) + (q.y - pt.y) * (q.y - pt.y)) AS dist FROM q, pt),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, p_partkey) AS rank FROM d)"""


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr("c_acctbal / 10000e0").alias("x"), F.expr("c_nationkey / 25e0").alias("y"))


@query("knn_join", f"WITH {PT}, {_Q}, {_NEAR} SELECT c_custkey, CAST(rank AS INTEGER) AS rank, p_partkey AS neighbour, round(dist, 9) AS distance FROM n WHERE rank <= 5")
def _knn(spark, d):
    index = K.build_index(part_points(spark, d), ["x", "y"], "p_partkey", 5)
    q = _customers(spark, d)
    got = q.join(K.knn_join(q, index), ["x", "y"])
    return got.select("c_custkey", "rank", "neighbour", F.round("distance", 9).alias("distance"))


def _idw_sql(weight: str) -> str:
    return f"""WITH {PT}, {_Q}, {_NEAR} SELECT c_custkey, round(CASE WHEN min(dist) < 1e-10 THEN arg_min(v, rank)
  ELSE sum({weight} * v / (dist * dist)) / sum({weight} / (dist * dist)) END, 4) AS v FROM n WHERE rank <= 6 GROUP BY c_custkey"""


@query("idw_join", _idw_sql("1e0"))
def _idw(spark, d):
    got = K.idw_join(_customers(spark, d), part_points(spark, d), ["x", "y"], ["v"], "p_partkey", 6, 2)
    return got.select("c_custkey", F.round("v", 4).alias("v"))


@query("idw_join_weighted", _idw_sql("w"))
def _idw_weighted(spark, d):
    got = K.idw_join(_customers(spark, d), part_points(spark, d), ["x", "y"], ["v"], "p_partkey", 6, 2, weight="w")
    return got.select("c_custkey", F.round("v", 4).alias("v"))


@query("idw_lineitem", f"""WITH {PT}, l AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 105000e0 AS h, l_quantity / 50e0 AS y FROM lineitem),
near AS (SELECT s.h, s.y, min({{'d': sqrt((s.h - pt.x) * (s.h - pt.x) + (s.y - pt.y) * (s.y - pt.y)), 'id': p_partkey, 'v': pt.v, 'w': pt.w}}, 6) AS n
  FROM (SELECT DISTINCT h, y FROM l) s, pt GROUP BY s.h, s.y)
SELECT l_orderkey, l_linenumber, {', '.join(f"round(CASE WHEN n[1].d < 1e-10 THEN n[1].{c} ELSE list_sum(list_transform(n, lambda r: r.{c} / (r.d * r.d))) / list_sum(list_transform(n, lambda r: 1 / (r.d * r.d))) END, 4) AS {c}" for c in "vw")}
FROM l JOIN near USING (h, y)""")
def _idw_lines(spark, d):
    """Every line item interpolated on the parts: many queries per point."""
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_extendedprice / 105000e0").alias("x"),
                                           F.expr("l_quantity / 50e0").alias("y"))
    got = K.idw_join(q, part_points(spark, d), ["x", "y"], ["v", "w"], "p_partkey", 6, 2)
    return got.select("l_orderkey", "l_linenumber", F.round("v", 4).alias("v"), F.round("w", 4).alias("w"))


@query("idw_dense")
def _idw_dense(spark, d):
    """Orders interpolated on all line items: many points, clustered on 50 quantities."""
    li = table(spark, d, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"),
        F.expr("l_extendedprice / 105000e0").alias("x"), F.expr("l_quantity / 50e0").alias("y"), "l_discount", "l_tax")
    q = table(spark, d, "orders").select("o_orderkey", F.expr("o_totalprice / 500000e0").alias("x"),
                                         F.expr("(o_custkey % 50 + 1) / 50e0").alias("y"))
    return K.idw_join(q, li, ["x", "y"], ["l_discount", "l_tax"], "id", 3, 2)


_SPLIT = f"""sp AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(['p_partkey'], 4)}, p_partkey) - 1 AS rn, count(*) OVER () AS n FROM pt),
tr AS (SELECT * FROM sp WHERE rn < floor(0.8 * n)), te AS (SELECT * FROM sp WHERE rn >= floor(0.8 * n) AND rn < floor(0.8 * n) + floor(0.1 * n)),
d AS (SELECT te.p_partkey AS t, te.v AS target, tr.p_partkey AS r, tr.v AS v, sqrt((te.x - tr.x) * (te.x - tr.x) + (te.y - tr.y) * (te.y - tr.y)) AS dist FROM te, tr),
nn AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY dist, r) AS k FROM d QUALIFY k <= 24),
pp AS (SELECT *, p, CASE WHEN dist > 0 THEN 1 / pow(dist, p) END AS wt FROM nn, (SELECT unnest([1, 2, 3, 4, 5]) AS p)),
pr AS (SELECT t, k, p, target, CASE WHEN first(dist) OVER w < 1e-10 OR k = 1 THEN first(v) OVER w ELSE sum(wt * v) OVER w / sum(wt) OVER w END AS pred
  FROM pp WINDOW w AS (PARTITION BY t, p ORDER BY k ROWS UNBOUNDED PRECEDING))"""


def _tuned(spark, d):
    pt = part_points(spark, d)
    parts = SP.split_exact(pt, SP.integer_hash(["p_partkey"], 4), ["p_partkey"], 0.8, 0.1)
    return K.idw_tune(parts.where("split = 'val'"), parts.where("split = 'train'"), ["x", "y"], "v", "p_partkey", 24, (1, 2, 3, 4, 5))


@query("idw_tune", f"WITH {PT}, {_SPLIT} SELECT CAST(k AS INTEGER) AS k, CAST(p AS INTEGER) AS p, round(avg((pred - target) * (pred - target)), 2) AS mse FROM pr GROUP BY ALL")
def _tune(spark, d):
    return _tuned(spark, d).select("k", "p", F.round("mse", 2).alias("mse"))


@query("idw_best_parameters", f"""WITH {PT}, {_SPLIT}, m AS (SELECT CAST(k AS INTEGER) AS k, CAST(p AS INTEGER) AS p, avg((pred - target) * (pred - target)) AS mse FROM pr GROUP BY ALL)
SELECT k, p, round(mse, 2) AS mse FROM m ORDER BY m.mse, k, p LIMIT 1""")
def _best(spark, d):
    return K.best_parameters(_tuned(spark, d)).select("k", "p", F.round("mse", 2).alias("mse"))


_PROBE = """{'d': sqrt((s.h - pt.x) * (s.h - pt.x) + (s.y - pt.y) * (s.y - pt.y)), 'id': p_partkey, 'v': pt.v}"""
_BLEND = """CASE WHEN n[1].d < 1e-10 THEN n[1].v ELSE list_sum(list_transform(n, lambda r: r.v / (r.d * r.d))) / list_sum(list_transform(n, lambda r: 1 / (r.d * r.d))) END"""


def _judged(values: str, number: str) -> str:
    """Where the target is met, or the next bracket: of rows (y, target, h, v, e) in the order of h."""
    return f"""SELECT y, target, coalesce(met.h, nx.a.h) AS h, coalesce(met.v, nx.a.v) AS v,
  CASE WHEN met IS NOT NULL THEN 'converged' WHEN nx IS NULL THEN 'outside' WHEN nx.b.h - nx.a.h <= (SELECT ext FROM box) * 1e-9 THEN 'jump' END AS status,
  rounds, nx.a.h AS ah, nx.a.e AS ae, nx.b.h AS bh, nx.b.e AS be
FROM (SELECT y, target, {number} AS rounds, min({{'d': abs(h - 0.5e0), 'h': h, 'v': v}}) FILTER (abs(e) <= 0.01e0) AS met,
    min({{'d': abs((h + h2) / 2 - 0.5e0), 'a': {{'h': h, 'v': v, 'e': e}}, 'b': {{'h': h2, 'v': v2, 'e': e2}}}}) FILTER (e * e2 < 0) AS nx
  FROM (SELECT *, lead(h) OVER w AS h2, lead(v) OVER w AS v2, lead(e) OVER w AS e2 FROM ({values}) WINDOW w AS (PARTITION BY y, target ORDER BY h))
  GROUP BY ALL)"""


_LADDER = f"""SELECT need.y, target, h, v, v - target AS e FROM need JOIN (
  SELECT y, h, {_BLEND} AS v FROM (SELECT s.y, s.h, min({_PROBE}, 3) AS n FROM ladder s, pt GROUP BY s.y, s.h)) USING (y)"""
_CUTS = f"""SELECT y, target, rounds, h, v, v - target AS e FROM (SELECT y, target, rounds, h, {_BLEND} AS v FROM (
  SELECT s.y, s.target, s.rounds, s.h, min({_PROBE}, 3) AS n FROM (
    SELECT y, target, rounds + 1 AS rounds, unnest(list_distinct(list_concat(list_transform(range(0, 9), lambda j: ah + (bh - ah) * (j / 8e0)),
      [bh, ah - ae * ((bh - ah) / (be - ae))]))) AS h FROM found WHERE status IS NULL) s, pt GROUP BY ALL))"""


@query("inverse_lookup", f"""WITH RECURSIVE {PT.replace("pt AS (", "pt0 AS (")}, pt AS (SELECT p_partkey, x, y, x * 100 + y AS v FROM pt0),
q AS (SELECT c_custkey, c_nationkey / 25e0 AS y, 20e0 + abs(c_acctbal) / 200e0 AS target FROM customer), need AS (SELECT DISTINCT y, target FROM q),
box AS (SELECT min(x) AS lo, (max(x) - min(x)) * (1 + 1e-9) AS ext FROM pt),
ladder AS (SELECT DISTINCT y, h FROM need, (SELECT lo + ext * j / 64 AS h FROM box, range(65) t(j) UNION SELECT 0.5e0)),
found AS ({_judged(_LADDER, "0")} UNION ALL {_judged(_CUTS, "rounds")})
SELECT c_custkey, round(h, 6) AS x, round(v, 4) AS v, status, rounds FROM q JOIN found USING (y, target) WHERE status IS NOT NULL""")
def _inverse(spark, d):
    """The x at which the interpolated value meets the target of every customer, at the operator's defaults."""
    index = K.build_index(part_points(spark, d).select("p_partkey", "x", "y", (F.col("x") * 100 + F.col("y")).alias("v")), ["x", "y"], "p_partkey", 3)
    q = table(spark, d, "customer").select("c_custkey", F.expr("c_nationkey / 25e0").alias("y"),
                                           F.expr("20e0 + abs(c_acctbal) / 200e0").alias("target"))
    got = K.inverse_lookup(q, index, "x", "target", "v", start=0.5)
    return got.select("c_custkey", F.round("x", 6).alias("x"), F.round("v", 4).alias("v"), "status", "rounds")
