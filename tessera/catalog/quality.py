"""Comparison and consistency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import EV, MIXED, SPECIES, Z, Z_C, event_series, mixture_rows, rounded, table
from tessera.functions.mixture import mixture_fraction
from tessera.operators import quality as Q
from tessera.operators.sequence import SeriesKey, index_rows

_B = """b AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 = 7 THEN o_totalprice * 1.002 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_custkey % 97 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 101 <> 5)"""
_CELLS = f"""{_B}, j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL OR b.o_orderkey IS NULL AS missing,
  a.o_totalprice AS pa, b.o_totalprice AS pb, a.o_orderstatus AS sa, b.o_orderstatus AS sb FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
c AS (SELECT o_orderkey, 'o_totalprice' AS "column", abs((pa - pb) / pa) * 100 AS delta, false AS ignored, missing OR coalesce(abs((pa - pb) / pa) * 100 > 0.1, pa IS DISTINCT FROM pb) AS failed FROM j
  UNION ALL SELECT o_orderkey, 'o_orderstatus', NULL, false, missing OR sa IS DISTINCT FROM sb FROM j)"""


def _pair(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    b = o.where(F.col("o_custkey") % 101 != 5).select(
        "o_orderkey", F.when(F.col("o_custkey") % 50 == 7, F.col("o_totalprice") * F.lit(1.002)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_custkey") % 97 == 3, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return o.drop("o_custkey"), b


@query("compare_cells", f'WITH {_CELLS} SELECT o_orderkey, "column", round(delta, 6) AS delta, ignored, failed FROM c')
def _cells(spark, d):
    return rounded(Q.compare_cells(*_pair(spark, d), ["o_orderkey"], 0.1))


@query("approx_compare", f"""WITH {_CELLS}, f AS (SELECT o_orderkey, "column" FROM c WHERE failed ORDER BY 1, 2 LIMIT 1)
SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM b) AS rows_b, count(*) AS compared, CAST(0 AS BIGINT) AS ignored, round(max(delta), 6) AS max_delta,
  count(*) FILTER (failed) AS failed, (SELECT o_orderkey FROM f) AS first_o_orderkey, (SELECT "column" FROM f) AS first_column FROM c""")
def _compare(spark, d):
    return rounded(Q.approx_compare(*_pair(spark, d), ["o_orderkey"], 0.1))


# a smooth curve over a fine grid of days: value = x^2, slope 2x
_LINE = """ln AS (SELECT l_suppkey, d * 1e0 AS x, d * 1e0 * d AS v, 2e0 * d + (l_suppkey % 3) * 0.001e0 AS slope, row_number() OVER (PARTITION BY l_suppkey ORDER BY d) - 1 AS row_idx
  FROM (SELECT DISTINCT l_suppkey, date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS d FROM lineitem)),
fd AS (SELECT *, (lead(v) OVER o - lag(v) OVER o) / (lead(x) OVER o - lag(x) OVER o) AS fd FROM ln WINDOW o AS (PARTITION BY l_suppkey ORDER BY row_idx)),
er AS (SELECT *, 100 * abs(slope - fd) / (abs(fd) + 1e-6) AS consistency_error, 100 * abs(fd - 2e0 * x) / (abs(2e0 * x) + 1e-6) AS discretisation_error FROM fd WHERE fd IS NOT NULL)"""


def _checked(spark, d):
    day = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))
    df = table(spark, d, "lineitem").select("l_suppkey", day.alias("d")).distinct()
    df, key = index_rows(df, "l_suppkey", ["d"])
    x = F.col("d") * F.lit(1.0)
    df = df.select(*key.part, "row_idx", x.alias("x"), (x * F.col("d")).alias("v"), (F.lit(2.0) * F.col("d") + (F.col("l_suppkey") % 3) * F.lit(0.001)).alias("slope"),
                   (x * 2).alias("reference"))
    return Q.finite_difference_check(df, key, "x", "v", "slope", "reference")


@query("finite_difference_check", f"WITH {_LINE} SELECT l_suppkey, row_idx, round(fd, 6) AS fd, round(consistency_error, 6) AS consistency_error, round(discretisation_error, 6) AS discretisation_error FROM er")
def _fd(spark, d):
    return rounded(_checked(spark, d).select("l_suppkey", "row_idx", "fd", "consistency_error", "discretisation_error"))


@query("consistency_report", f"""WITH {_LINE} SELECT count(*) AS points, round(max(consistency_error), 6) AS worst_consistency,
  round(max(discretisation_error), 6) AS worst_discretisation, bool_and(consistency_error <= discretisation_error) AS consistent FROM er""")
def _report(spark, d):
    return rounded(Q.consistency_report(_checked(spark, d)))


@query("identity_check", f"""WITH {MIXED}, s AS (SELECT *, {' + '.join(f'{v!r}e0 * "Y-{k}"' for k, v in Z.items())} + {Z_C!r}e0 + (l_linenumber % 2) * 1e-9 AS stored FROM mix)
SELECT count(*) AS points, round(max(abs({' + '.join(f'{v!r}e0 * "Y-{k}"' for k, v in Z.items())} + {Z_C!r}e0 - stored)), 12) AS max_error FROM s""")
def _identity(spark, d):
    z = mixture_fraction(Z, Z_C)
    df = mixture_rows(spark, d).withColumn("stored", z + (F.col("l_linenumber") % 2) * F.lit(1e-9))
    return rounded(Q.identity_check(df, z, "stored"), 12)
