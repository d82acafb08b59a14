"""Concatenated table to refined lookup-table levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scaling import scale, unscale
from tessera.operators.grid import edge_points, refinement_points
from tessera.operators.hull import convex_hull
from tessera.operators.mesh import graded_mesh
from tessera.operators.knn import PointIndex, best_parameters, build_index, idw_join, idw_tune
from tessera.operators.stats import fit_scaler
from tessera.runtime import cut_lineage
from tessera.sources.level_table import level_table_text


def tune_and_index(table: DataFrame, controls: Sequence[str], target: str, values: Sequence[str], row_id: str,
                   k_max: int = 24, powers: Sequence[int] = (1, 2, 3, 4, 5)) -> tuple[PointIndex, int, dict]:
    """Fit the scaler on the full table, choose (k, p) on train/test, index the full table.

    Scaled keys are named ``k0, k1, ...``.
    """
    params = fit_scaler(table, controls)
    keys = [f"k{i}" for i in range(len(controls))]
    scaled = table.withColumns({k: e for k, e in zip(keys, scale(params).values())})
    tuned = idw_tune(scaled.where("split = 'test'"), scaled.where("split = 'train'"), keys, target, row_id, k_max, powers)
    best = best_parameters(tuned).first()
    cols = list(dict.fromkeys([row_id, *keys, *values]))
    return build_index(scaled.select(*cols), keys, row_id, best["k"]), best["p"], params


def level_grids(levels: DataFrame, n: int) -> DataFrame:
    """An n x n probe grid in the box of every level; rows above its lower-left to upper-right line.

    ``levels``: ``level, z, x_u, x_b`` and the corner values ``yu_lo, yu_hi, yb_lo, yb_hi`` (scaled).
    """
    grid = levels.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long"))))
    i, j = F.floor(F.col("_c") / n).cast("long"), F.col("_c") % n
    share = lambda a, b, at: F.col(a) + (F.col(b) - F.col(a)) * (at / F.lit(float(n - 1)))
    return grid.select("level", i.alias("i"), j.alias("j"), share("x_u", "x_b", j).alias("k0"),
                       share("yb_lo", "yu_hi", i).alias("k1"), F.col("z").alias("k2"),
                       "x_u", "x_b", "yu_lo", "yb_lo")


@dataclass(frozen=True)
class LookupTable:
    """Levels with their meshes: ``nodes (level, node, <keys>, <values>)``, ``triangles (level, tri, a, b, c)``,
    ``outline (level, seq, node)`` and the corners ``hull (level, seq, x, y)``."""

    nodes: DataFrame
    triangles: DataFrame
    outline: DataFrame
    hull: DataFrame


def lookup_levels(index: PointIndex, p: float, levels: DataFrame, target: str, values: Sequence[str], n: int = 100,
                  base: float = 1e-2, fine: float = 1e-3, radius: float = 5e-3, edge_nodes: int = 30,
                  threshold: float = 0.3) -> LookupTable:
    """Meshes of all levels, graded towards strong curvature and both edges, with interpolated data at every node.

    All levels are one table: probe grid, hull, curvature, mesh and the final interpolation are each one job over
    all of them. Cell sizes go by the length of a level's outline.
    """
    grid = level_grids(levels, n)
    probe = cut_lineage(idw_join(grid, index, list(index.keys), [target], k=index.k, p=p))
    line = F.col("yu_lo") + (F.col("k0") - F.col("x_u")) * F.try_divide(
        F.col("yb_lo") - F.col("yu_lo"), F.col("x_b") - F.col("x_u"))
    hull = cut_lineage(convex_hull(probe.where(F.col("k1") >= line), "level", "k0", "k1"))
    edges = edge_points(levels, "level", edge_nodes)
    points = refinement_points(probe, "level", "i", "j", target, "k0", "k1", edges, threshold)
    box = hull.groupBy("level").agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
                                    F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))
    w, ring = Window.partitionBy("level").orderBy("seq"), Window.partitionBy("level")
    ahead = [F.coalesce(F.lead(c).over(w), F.min_by(c, "seq").over(ring)) - F.col(c) for c in ("x", "y")]
    length = hull.select("level", F.hypot(*ahead).alias("side")).groupBy("level").agg(F.sum("side").alias("size"))
    nodes, triangles, outline = graded_mesh(box.join(length, "level"), cut_lineage(points), hull, "level", base, fine, radius)
    keyed = nodes.join(levels.select("level", F.col("z").alias("k2")), "level").withColumnsRenamed({"x": "k0", "y": "k1"})
    return LookupTable(idw_join(keyed, index, list(index.keys), list(values), k=index.k, p=p), triangles, outline, hull)


def lookup_text(table: LookupTable, params: dict, controls: Sequence[str], values: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Lines of the text form: controlling variables in their own units, then the values; levels are named by the last control."""
    keys = {f"k{i}": params[c] for i, c in enumerate(controls)}
    own = unscale(keys)
    nodes = table.nodes.select("level", "node", *[own[f"k{i}"].alias(c) for i, c in enumerate(controls)], *[F.col(v).alias(f"_{v}") for v in values])
    nodes = nodes.withColumnsRenamed({f"_{v}": v for v in values})
    levels = nodes.groupBy("level").agg(F.min(controls[-1]).alias("level_value"))
    return level_table_text(nodes, table.triangles, table.outline, levels, [*controls, *values], weights)
