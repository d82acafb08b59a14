"""The supplied tables seen as ordered series, species rows, scattered points and trials.

Expressions that both engines need are plain arithmetic SQL, used as they are on both sides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sequence import SeriesKey, index_rows
from tessera.operators.split import HASH_SPACE, _MULTIPLIERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def sql_columns(cols: Mapping[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in cols.items())


def sql_rounded(cols: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)


def sql_hash(cols: Sequence[str], seed: int = 0) -> str:
    h = f"CAST({seed} AS BIGINT)"
    for i, c in enumerate(cols):
        h = f"(({h} * 31 + (CAST({c} AS BIGINT) % {1 << 30}) * {_MULTIPLIERS[i % 4]}) % {HASH_SPACE})"
    return h


# --- events: one series per user -----------------------------------------------------------------

def event_series(spark: SparkSession, sf_dir: str, chunk_rows: int | None = None) -> tuple[DataFrame, SeriesKey]:
    """Series of ``value`` over ``x``, the seconds since a fixed start."""
    start = F.unix_micros(F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - start
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "ts",
                                               (micros / F.lit(1e6)).alias("x"))
    df, key = index_rows(df, "user_id", ["ts", "event_id"], chunk_rows)
    return df.drop("ts"), key


EV = """ev AS (SELECT event_id, user_id, value, event_type,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx FROM events)"""

ARC = EV + """, nrm AS (SELECT *,
  (x - min(x) OVER u) / (max(x) OVER u - min(x) OVER u + 1e-10) AS nx,
  (value - min(value) OVER u) / (max(value) OVER u - min(value) OVER u + 1e-10) AS nv
  FROM ev WINDOW u AS (PARTITION BY user_id)),
stp AS (SELECT *, coalesce(sqrt((nx - lag(nx) OVER o) * (nx - lag(nx) OVER o) + (nv - lag(nv) OVER o) * (nv - lag(nv) OVER o)), 0) AS step
  FROM nrm WINDOW o AS (PARTITION BY user_id ORDER BY row_idx)),
cum AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS c FROM stp),
arc AS (SELECT *, max(c) OVER (PARTITION BY user_id) AS s_total, c / (max(c) OVER (PARTITION BY user_id) + 1e-32) AS s FROM cum)"""

# --- line items: one series per supplier -----------------------------------------------------------

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_SPECIES = {"ya": "l_quantity / 50e0", "yb": "l_extendedprice / 105000e0", "yc": "l_discount * 10e0", "yd": "l_tax * 12.5e0"}


def line_series(spark: SparkSession, sf_dir: str, chunk_rows: int | None = None) -> tuple[DataFrame, SeriesKey]:
    """Four species columns ``ya..yd`` per supplier, ordered by ship date and line."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", *LINE_ORDER)
    df, key = index_rows(df, "l_suppkey", LINE_ORDER, chunk_rows)
    # computed from the indexed rows, so that they need not be sorted and stored with them
    rest = [c for c in df.columns if c not in ("l_suppkey", *LINE_ORDER)]
    return df.select("l_suppkey", *LINE_ORDER, *[F.expr(e).alias(n) for n, e in LINE_SPECIES.items()], *rest), key


LI = f"""li AS (SELECT *, {sql_columns(LINE_SPECIES)},
  row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS row_idx FROM lineitem)"""

# --- line items as species rows --------------------------------------------------------------------

SPECIES = ("H2", "O2", "N2", "NO", "NO2", "N2O")
MOLAR = {"H2": 2.016, "O2": 31.998, "N2": 28.014, "NO": 30.006, "NO2": 46.005, "N2O": 44.013}
WEIGHTS = {"H2": -0.5, "O2": -0.25, "NO": 1.25}
Z = {"H2": 0.75, "O2": -0.5, "N2": 0.125, "NO": -0.25, "NO2": 0.5, "N2O": 0.375}
Z_C = 0.25
_BASE = {"H2": "l_discount", "O2": "l_tax", "N2": "(l_quantity / 50e0)", "NO": "(l_extendedprice / 105000e0)",
         "NO2": "(l_discount * l_tax)", "N2O": "(l_tax / 2e0)"}
MIX = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_suppkey": "l_suppkey",
       "Temperature": "(300e0 + l_quantity * 40e0)", "Cp": "(1000e0 + l_quantity)",
       "Density": "(1e0 + l_tax)", "Conductivity": "(0.02e0 + l_discount)",
       "MolarWeightMix": "(20e0 + l_quantity / 10e0)", "Heat_Release": "(l_extendedprice * l_discount)"}
for _i, _s in enumerate(SPECIES):
    MIX["Y-" + _s] = _BASE[_s]
    MIX["Y_dot_pos-" + _s] = f"({_BASE[_s]} * {_i + 2}e0)"
    MIX["Y_dot_neg-" + _s] = f"(l_discount * -{_i + 1}e0)"
    MIX["Y_dot_net-" + _s] = f"({_BASE[_s]} - l_tax * {_i + 1}e0)"
    MIX["Cp-" + _s] = f"(900e0 + l_quantity * {_i + 1}e0)"
    MIX["h-" + _s] = f"(l_extendedprice / {_i + 3}e0)"
    MIX["Le-" + _s] = f"(0.5e0 + l_discount * {_i + 1}e0)"
    MIX["D-" + _s] = f"(l_tax / {_i + 4}e0)"


def mixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as thermo-chemical rows; column pruning keeps the scan to what a query uses."""
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in MIX.items()])


MIXED = f"mix AS (SELECT {sql_columns(MIX)} FROM lineitem)"

# --- scattered points and trials --------------------------------------------------------------------

def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("(p_retailprice - 900e0) / 100e0").alias("x"), F.expr("p_size / 50e0").alias("y"),
        F.expr("p_retailprice * p_size").alias("v"), F.expr("p_retailprice / p_size").alias("w"))


PT = """pt AS (SELECT p_partkey, (p_retailprice - 900e0) / 100e0 AS x, p_size / 50e0 AS y,
  p_retailprice * p_size AS v, p_retailprice / p_size AS w FROM part)"""


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as trials: the brand number is the generation, price the cost, size the score."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trial"), F.expr("cast(substring(p_brand, 7) as int)").alias("generation"),
        F.col("p_retailprice").alias("cost"), F.col("p_size").cast("double").alias("score"))


TRIALS = """trials AS (SELECT p_partkey AS trial, CAST(substring(p_brand, 7) AS INTEGER) AS generation,
  p_retailprice AS cost, CAST(p_size AS DOUBLE) AS score FROM part)"""
