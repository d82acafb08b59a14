"""Two-objective Pareto fronts (both objectives minimised) and convergence measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import CHUNK_ROWS, following, global_index, index_rows


def front_points(df: DataFrame, a: str, b: str, by: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distinct front points ``(by, a, b)``.

    Rows are first reduced to the least ``b`` per ``a`` with map-side combine. A running minimum over
    ``a`` then finds the front; tables above ``chunk_rows`` run it per chunk of the sorted order, with
    the minima of the earlier chunks carried in a one-row-per-chunk table.
    """
    by = list(by)
    least = df.groupBy(*by, a).agg(F.min(b).alias(b))
    n = least.count()
    before = Window.unboundedPreceding
    if n <= chunk_rows:
        w = Window.partitionBy(*by).orderBy(a).rowsBetween(before, -1)
        least = least.withColumn("_low", F.min(b).over(w))
    else:
        least = global_index(least, [*by, a], "_pos", n, rows_per_task=chunk_rows)
        least = least.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(chunk_rows)).cast("long"))
        chunk_low = least.groupBy(*by, "_chunk").agg(F.min(b).alias("_m"))
        chunk_low = chunk_low.select(*by, "_chunk", F.min("_m").over(
            Window.partitionBy(*by).orderBy("_chunk").rowsBetween(before, -1)).alias("_carry"))
        w = Window.partitionBy(*by, "_chunk").orderBy("_pos").rowsBetween(before, -1)
        least = (least.withColumn("_in", F.min(b).over(w)).join(chunk_low, [*by, "_chunk"])
                 .withColumn("_low", F.least("_in", "_carry")))
    return least.where(F.col("_low").isNull() | (F.col(b) < F.col("_low"))).select(*by, a, b)


def pareto_front(df: DataFrame, a: str, b: str, by: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Non-dominated rows; rows equal to a front point are all kept."""
    return df.join(front_points(df, a, b, by, chunk_rows), [*by, a, b], "left_semi")


def cumulative_front(df: DataFrame, generation: str, a: str, b: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Front of everything up to each generation: ``(generation, a, b)``.

    Only the front of each generation can enter a later front, so only those points are repeated for
    the following generations.
    """
    own = front_points(df, a, b, [generation], chunk_rows)
    last = df.agg(F.max(generation).alias("m"))
    grown = own.select(F.explode(F.sequence(F.col(generation).cast("long"), last.scalar().cast("long"))).alias("_g"), a, b)
    return front_points(grown, a, b, ["_g"], chunk_rows).withColumnRenamed("_g", generation)


def _scaled(df: DataFrame, generation: str, cost: str, score: str) -> DataFrame:
    """Cost and log10(score) scaled by their ranges in the last generation."""
    df = df.select(generation, F.col(cost).cast("double").alias("_c"), F.log10(score).alias("_s"))
    last = df.agg(F.max(generation).alias("m"))
    tail = df.where(F.col(generation) == last.scalar())
    ends = tail.agg(F.struct(F.min("_c").alias("c0"), F.max("_c").alias("c1"), F.min("_s").alias("s0"),
                             F.max("_s").alias("s1")).alias("e"))
    df = df.withColumn("_e", ends.scalar())
    return df.select(generation,
                     F.try_divide(F.col("_c") - F.col("_e.c0"), F.col("_e.c1") - F.col("_e.c0")).alias("x"),
                     F.try_divide(F.col("_s") - F.col("_e.s0"), F.col("_e.s1") - F.col("_e.s0")).alias("y"))


def hypervolume(df: DataFrame, generation: str, cost: str, score: str) -> DataFrame:
    """Area dominated by each generation up to the mid-range point of the last one."""
    pts = _scaled(df, generation, cost, score)
    gens = pts.select(generation).distinct()
    ref = 0.5  # midpoint of the unit range the last generation is scaled to
    front = front_points(pts.where((F.col("x") < ref) & (F.col("y") < ref)), "x", "y", [generation])
    front, key = index_rows(front, generation, ["x"])
    front = following(front, key, {"x": "_x1"})
    area = (F.coalesce("_x1", F.lit(ref)) - F.col("x")) * (F.lit(ref) - F.col("y"))
    got = front.groupBy(generation).agg(F.sum(area).alias("hypervolume"))
    return gens.join(got, generation, "left").select(generation, F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"))


def front_distance(df: DataFrame, generation: str, cost: str, score: str, slice_rows: int = 10_000) -> DataFrame:
    """Mean distance-plus of each generation to the last one.

    Only excess over a target counts as distance, so of all points of the last generation only those
    no other one exceeds in both objectives can be nearest. These are met in slices of about
    ``slice_rows`` points, each packed in one array, so memory per task is bounded; the minimum over
    slices is exact.
    """
    pts = _scaled(df, generation, cost, score)
    last = df.agg(F.max(generation).alias("m"))
    final = pts.where(F.col(generation) == last.scalar()).select((-F.col("x")).alias("nx"), (-F.col("y")).alias("ny"))
    front = front_points(final, "nx", "ny").select((-F.col("nx")).alias("fx"), (-F.col("ny")).alias("fy"))
    n = front.count()
    slices = max(1, -(-n // slice_rows))
    packed = (front.groupBy(F.pmod(F.xxhash64("fx", "fy"), F.lit(slices)).alias("_slice"))
              .agg(F.collect_list(F.struct("fx", "fy")).alias("_front")))
    keyed = pts.groupBy(generation, "x", "y").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def gap(p):
        dx = F.greatest(F.col("x") - p["fx"], F.lit(0.0))
        dy = F.greatest(F.col("y") - p["fy"], F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)

    near = keyed.join(packed, "_slice").withColumn("_d", F.array_min(F.transform("_front", gap)))
    best = near.groupBy(generation, "x", "y", "_n").agg(F.min("_d").alias("_d"))
    return best.groupBy(generation).agg((F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("distance"))
