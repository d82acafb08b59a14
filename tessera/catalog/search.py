"""Weight search, grouping and Pareto queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import LI, TRIALS, line_series, rounded, table, trial_rows
from tessera.operators import pareto as P
from tessera.operators import search as SE
from tessera.operators.groups import best_groups, group_columns
from tessera.operators.stats import correlation_matrix
from tessera.plans.weight_search import increments
from tessera.runtime import cut_lineage

_COLS = ["d_ya", "d_yb", "d_yc"]
_POP = [[0.5, 0.25, 1.0], [1.0, -0.5, 0.125], [-0.75, 0.5, 0.25], [0.125, 1.0, -1.0]]
_X0 = [0.5, 2.0, 10.0, 0.25]
_DD = f"""{LI}, dd AS (SELECT ya - lag(ya) OVER o AS a, yb - lag(yb) OVER o AS b, yc - lag(yc) OVER o AS c FROM li WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx)),
inc AS (SELECT a, b, c, greatest(abs(a), abs(b), abs(c)) AS y FROM dd WHERE a IS NOT NULL)"""


def _unit(w):
    return [float(v) for v in np.asarray(w) / np.linalg.norm(w)]


_CAND = "cand(candidate, wa, wb, wc, x0) AS (VALUES " + ", ".join(
    f"({i}, {', '.join(repr(v) + 'e0' for v in _unit(w))}, {_X0[i]!r}e0)" for i, w in enumerate(_POP)) + ")"


def _inc(spark, d):
    df, key = line_series(spark, d)
    return increments(df, key, ["ya", "yb", "yc"], thin=False)


@query("penalty", f"""WITH {_DD}, {_CAND}, t AS (SELECT candidate, y, a * wa + b * wb + c * wc AS t FROM inc, cand)
SELECT CAST(candidate AS BIGINT) AS candidate, round(log10(max(abs(y / nullif(t, 0))) + sum(CASE WHEN t < 0 THEN (y / t) * (y / t) ELSE 0 END)), 3) AS log_penalty,
  round(log10(max(abs(y / nullif(t, 0)))), 3) AS log_worst, round(min(t), 6) AS lowest FROM t GROUP BY candidate""")
def _penalty(spark, d):
    s = SE.candidate_scores(_inc(spark, d), _COLS, "y", _POP)
    return s.select("candidate", F.round(F.log10("penalty"), 3).alias("log_penalty"), F.round(F.log10("worst"), 3).alias("log_worst"),
                    F.round("lowest", 6).alias("lowest"))


@query("penalty_bound", f"""WITH {_DD}, {_CAND}, t AS (SELECT candidate, x0, a * wa + b * wb + c * wc - x0 * y AS t FROM inc, cand),
s AS (SELECT candidate, x0, sum(CASE WHEN t < 0 THEN -t ELSE 0 END) AS v FROM t GROUP BY ALL)
SELECT CAST(candidate AS BIGINT) AS candidate, round(log10(1e0 / x0 + v * v), 6) AS log_penalty FROM s""")
def _bound(spark, d):
    s = SE.candidate_scores(_inc(spark, d), _COLS, "y", [[x, *w] for x, w in zip(_X0, _POP)], bound_gene=True)
    return s.select("candidate", F.round(F.log10("penalty"), 6).alias("log_penalty"))


@query("monotonic_check", f"""WITH {_DD} SELECT round(min(a * {_unit(_POP[0])[0]!r}e0 + b * {_unit(_POP[0])[1]!r}e0 + c * {_unit(_POP[0])[2]!r}e0), 6) AS lowest,
  min(a * {_unit(_POP[0])[0]!r}e0 + b * {_unit(_POP[0])[1]!r}e0 + c * {_unit(_POP[0])[2]!r}e0) > 0 AS monotonic FROM inc""")
def _monotonic(spark, d):
    return rounded(SE.monotonic_check(_inc(spark, d), _COLS, _POP[0]))


@query("evolve_weights")
def _evolve(spark, d):
    packed = SE.PackedIncrements(_inc(spark, d), _COLS, "y")
    bounds = SE.weight_bounds(["ya", "yb", "yc"], reactants=["ya"], product="yc")
    w, penalty = SE.evolve_weights(packed, _COLS, "y", bounds)
    w, penalty = SE.refine_weights(packed, _COLS, "y", w, bounds)
    packed.release()
    return spark.createDataFrame([(c, float(v), penalty) for c, v in zip(_COLS, w)], "column string, weight double, penalty double")


@query("initial_population")
def _population(spark, d):
    """One individual per part."""
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return SE.initial_population(ids, 1, {"alpha_expo": -2.6, "lr_decay": 0.98}, ((-3.0, -1.0), (0.85, 1.0)), (3, 7), 8, (1, 5), (4, 40))


@query("group_columns")
def _groups(spark, d):
    return _grouped(spark, d)


def _grouped(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "value", "tax"]
    li = table(spark, d, "lineitem").select(*names[:4], (F.col("l_quantity") * F.col("l_extendedprice")).alias("value"),
                                            (F.col("l_tax") * F.lit(2.0) + F.col("l_discount") / 8).alias("tax"))
    corr = {(r["var_i"], r["var_j"]): r["r"] for r in correlation_matrix(li, names).collect()}  # columns x columns
    return group_columns(spark, corr, names, theta=0.6)


@query("group_columns_best")
def _grouped_best(spark, d):
    return best_groups(_grouped(spark, d), {"thermo": ["l_quantity", "l_extendedprice"], "source": ["l_tax", "tax"]})


_WORDS = """t AS (SELECT p_partkey AS trial, CAST(p_size % 5 + 2 AS INTEGER) AS n_groups, p_retailprice / 1000e0 AS affinity,
  split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)"""
_FAMILY = {"thermo": ["small", "red", "ring"], "diffusion": ["widget", "blue"], "source": ["large", "anvil", "red"]}
_EVAL = " + ".join(f"CAST({w} IN ({', '.join(repr(m) for m in ms)}) AS INTEGER)" for ms in _FAMILY.values() for w in ("w1", "w2"))


@query("best_groups", f"""WITH {_WORDS}, b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY n_groups ORDER BY affinity DESC, trial) = 1),
e AS (SELECT trial, n_groups, affinity, CAST({_EVAL} AS INTEGER) AS evaluations FROM b)
SELECT trial, n_groups, affinity, evaluations, row_number() OVER (ORDER BY evaluations, n_groups) = 1 AS chosen FROM e""")
def _best_groups(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("trial"), (F.col("p_size") % 5 + 2).cast("int").alias("n_groups"),
                                       (F.col("p_retailprice") / F.lit(1000.0)).alias("affinity"),
                                       F.transform(F.split("p_name", " "), lambda w: F.array(w)).alias("groups"))
    return best_groups(t, _FAMILY).drop("groups")


# --- Pareto -------------------------------------------------------------------------------------------

_PARETO = f"""WITH {TRIALS} SELECT trial, generation, cost, score FROM trials t WHERE NOT EXISTS (SELECT 1 FROM trials o
  WHERE o.cost <= t.cost AND o.score <= t.score AND (o.cost < t.cost OR o.score < t.score))"""


@query("pareto_front", _PARETO)
def _pareto(spark, d):
    return P.pareto_front(trial_rows(spark, d), "cost", "score")


@query("pareto_front_chunked", _PARETO)
def _pareto_chunked(spark, d):
    return P.pareto_front(trial_rows(spark, d), "cost", "score", chunk_rows=100)


@query("pareto_front_lineitem", """WITH m AS (SELECT l_extendedprice AS cost, min(l_discount) AS s FROM lineitem GROUP BY 1),
f AS (SELECT cost, s, min(s) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM m)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem JOIN f ON l_extendedprice = cost AND l_discount = s WHERE low IS NULL OR s < low""")
def _pareto_lines(spark, d):
    return P.pareto_front(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), "l_extendedprice", "l_discount")


@query("cumulative_front", f"""WITH {TRIALS}, g AS (SELECT unnest(range(min(generation), max(generation) + 1)) AS generation FROM trials),
c AS (SELECT DISTINCT g.generation, cost, score FROM g JOIN trials t ON t.generation <= g.generation)
SELECT generation, cost, score FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.generation = c.generation AND o.cost <= c.cost AND o.score <= c.score
  AND (o.cost < c.cost OR o.score < c.score))""")
def _cumulative(spark, d):
    # generations may be missing, so they count from the first one present
    return P.cumulative_front(trial_rows(spark, d), "generation", "cost", "score")


_SC = f"""{TRIALS}, l AS (SELECT min(cost) AS c0, max(cost) AS c1, min(log10(score)) AS s0, max(log10(score)) AS s1 FROM trials WHERE generation = (SELECT max(generation) FROM trials)),
sc AS (SELECT trial, generation, (cost - c0) / (c1 - c0) AS x, (log10(score) - s0) / (s1 - s0) AS y FROM trials, l)"""


@query("hypervolume", f"""WITH {_SC}, m AS (SELECT generation, x, min(y) AS y FROM sc WHERE x < 0.5 AND y < 0.5 GROUP BY ALL),
f AS (SELECT *, min(y) OVER (PARTITION BY generation ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM m),
h AS (SELECT generation, (coalesce(lead(x) OVER (PARTITION BY generation ORDER BY x), 0.5) - x) * (0.5 - y) AS area FROM f WHERE low IS NULL OR y < low)
SELECT generation, round(coalesce(sum(area), 0), 6) AS hypervolume FROM (SELECT DISTINCT generation FROM sc) LEFT JOIN h USING (generation) GROUP BY generation""")
def _hypervolume(spark, d):
    return rounded(P.hypervolume(trial_rows(spark, d), "generation", "cost", "score"))


@query("front_distance", f"""WITH {_SC}, z AS (SELECT x AS zx, y AS zy FROM sc WHERE generation = (SELECT max(generation) FROM sc)),
n AS (SELECT trial, generation, min(sqrt(greatest(x - zx, 0) * greatest(x - zx, 0) + greatest(y - zy, 0) * greatest(y - zy, 0))) AS d FROM sc, z GROUP BY ALL)
SELECT generation, round(avg(d), 6) AS distance FROM n GROUP BY generation""")
def _distance(spark, d):
    return rounded(P.front_distance(trial_rows(spark, d), "generation", "cost", "score"))
