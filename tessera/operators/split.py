"""Deduplication, permutation, exact splitting and batching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import global_index

HASH_SPACE = 1 << 32
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)


def integer_hash(cols: Sequence[str], seed: int = 0) -> Column:
    """An arithmetic hash of integer columns in [0, 2^32), the same in any SQL dialect."""
    h = F.lit(seed % HASH_SPACE).cast("long")
    for i, c in enumerate(cols):
        m = _MULTIPLIERS[i % len(_MULTIPLIERS)]
        h = (h * F.lit(31) + (F.col(c).cast("long") % F.lit(1 << 30)) * F.lit(m)) % F.lit(HASH_SPACE)
    return h


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per distinct key, the first in ``order``.

    Spark applies the rank limit before the shuffle, so a key with many copies sends one row per
    map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def shuffle(df: DataFrame, hashed: Column, tie: Sequence[str]) -> DataFrame:
    """A deterministic full permutation: range exchange and sort on the hash."""
    return df.withColumn("_h", hashed).orderBy("_h", *tie).drop("_h")


def split_exact(df: DataFrame, hashed: Column, tie: Sequence[str], f_train: float, f_test: float,
                layout: tuple[str, str, str] = ("train", "val", "test"), bits: int = 16,
                out: str = "split") -> DataFrame:
    """Assign rows to three parts of exact size: floor(f_train n), floor(f_test n) and the rest.

    ``hashed`` is a hash in [0, 2^32) and, with the ``tie`` columns, identifies a row. Ranks are settled from the
    highest bits of the hash down: the counts of 2^bits buckets decide the part of all rows except those in the two
    buckets that hold a border; the counts of single hash values decide all of these but the rows of the two values
    at the borders, and only those are ranked, by the ``tie`` columns.
    """
    buckets = 1 << bits
    base = df.withColumn("_h", hashed).withColumn(
        "_b", F.floor(F.col("_h") / F.lit(HASH_SPACE // buckets)).cast("long"))
    counts = base.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most 2^bits rows here
    limits = counts.withColumn("_end", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(whole))
    n1 = F.floor(F.lit(f_train) * F.col("_total")).cast("long")
    n2 = n1 + F.floor(F.lit(f_test) * F.col("_total")).cast("long")
    limits = limits.select("_b", (F.col("_end") - F.col("_n")).alias("_start"), "_n", n1.alias("_n1"), n2.alias("_n2"))

    def part() -> Column:
        """The part of all rows with ranks from ``_start`` on, ``_n`` of them; null where a border lies between."""
        end = F.col("_start") + F.col("_n")
        return (F.when(end <= F.col("_n1"), layout[0]).when((F.col("_start") >= F.col("_n1")) & (end <= F.col("_n2")), layout[1])
                .when(F.col("_start") >= F.col("_n2"), layout[2]))

    base = base.join(F.broadcast(limits.withColumn("_part", part())), "_b").drop("_n")
    clear, border = base.where("_part is not null"), base.where("_part is null").drop("_part")
    # two buckets of 2^(32 - bits) hash values at most
    before = Window.partitionBy("_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    values = border.groupBy("_b", "_h").agg(F.count(F.lit(1)).alias("_n"), F.first("_start").alias("_start"), F.first("_n1").alias("_n1"), F.first("_n2").alias("_n2"))
    values = values.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_part", part())
    values = values.select("_b", "_h", "_start", "_part")
    border = border.drop("_start").join(F.broadcast(values) if bits >= 16 else values, ["_b", "_h"])
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_b", "_h").orderBy(*tie)) - 1
    tied = border.where("_part is null").withColumn("_rank", rank).withColumn(
        "_part", F.when(F.col("_rank") < F.col("_n1"), layout[0]).when(F.col("_rank") < F.col("_n2"), layout[1])
        .otherwise(layout[2])).drop("_rank")
    parts = clear.unionByName(border.where("_part is not null")).unionByName(tied)
    return parts.withColumn(out, F.col("_part")).drop("_h", "_b", "_part", "_start", "_n1", "_n2")


def mini_batches(df: DataFrame, order: Sequence[str | Column], exponent: int, out: str = "batch",
                 rows: int | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """Number consecutive blocks of 2^exponent rows in the given order."""
    indexed = global_index(df, order, "_pos", rows, rows_per_task)
    return indexed.withColumn(out, F.floor(F.col("_pos") / F.lit(1 << exponent)).cast("long")).drop("_pos")


def cycle_join(domain: DataFrame, boundary: DataFrame, batch: str = "batch") -> DataFrame:
    """Pair domain batch i with boundary batch i mod n; ``boundary`` is one row per batch."""
    n = boundary.agg((F.max(batch) + 1).alias("_n"))
    keyed = domain.withColumn("_k", F.col(batch) % n.scalar())
    other = boundary.select(F.col(batch).alias("boundary_batch"), *[c for c in boundary.columns if c != batch])
    return keyed.join(other, F.col("_k") == F.col("boundary_batch")).drop("_k")


def sample_series(df: DataFrame, series: str, k: int, hashed: Column) -> DataFrame:
    """All rows of ``k`` series drawn in hash order."""
    drawn = (df.select(series).distinct().withColumn("_h", hashed).orderBy("_h", series).limit(k).select(series))
    return df.join(drawn, series, "left_semi")


def top_rows(df: DataFrame, order: Sequence[Column], k: int, exclude: Column | None = None) -> DataFrame:
    if exclude is not None:
        df = df.where(~exclude)
    return df.orderBy(*order).limit(k)


def union_kinds(parts: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    """Concatenate the enabled kinds, tagged by name."""
    return reduce(lambda a, b: a.unionByName(b), [d.withColumn(kind, F.lit(k)) for k, d in parts.items()])


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def coef_join(rows: DataFrame, coefs: DataFrame, on: str, by: Sequence[str], value: str, coef: str, out: str) -> DataFrame:
    """Weighted sum per group of long rows: each row takes the coefficient of its name; rows without one don't count.

    Spark broadcasts the coefficients if they are small; otherwise both sides are shuffled by name and partial
    sums combine on the map side.
    """
    return rows.join(coefs, on).groupBy(*by).agg(F.sum(F.col(value) * F.col(coef)).alias(out))
