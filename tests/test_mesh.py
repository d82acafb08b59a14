"""Graded meshes: triangles that share whole edges and fill the outline."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import mesh as M
from tessera.operators.hull import _chain


def outlines():
    rng = np.random.default_rng(11)
    return {
        1: np.array([[0.0, 0.0], [3.0, 0.0], [3.0, 2.0], [0.0, 2.0]]),
        2: np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 1.0]]),
        3: _chain(rng.normal(size=(400, 2))),
        4: np.array([[0.1, 0.3], [0.9, 0.25], [1.0, 1.0], [0.0, 1.0]]),
        5: _chain(np.stack([np.cos(np.linspace(0, 6.28, 90)), np.sin(np.linspace(0, 6.28, 90))], axis=1) * 0.7 + 5),
        6: np.array([[0.0, 0.0], [0.5, 0.0], [1.0, 0.5], [1.0, 1.0], [0.5, 1.0], [0.0, 0.5]]),  # through lattice corners
    }


def area(p):
    x, y = np.asarray(p)[:, 0], np.asarray(p)[:, 1]
    return 0.5 * (x * np.roll(y, -1) - np.roll(x, -1) * y).sum()


def made(spark, shapes, points, base, fine, radius, size=1.0):
    hull = pd.concat([pd.DataFrame({"level": k, "seq": range(len(p)), "x": p[:, 0], "y": p[:, 1]}) for k, p in shapes.items()])
    levels = pd.DataFrame([(k, *p.min(0), *p.max(0), size) for k, p in shapes.items()], columns=["level", "x_lo", "y_lo", "x_hi", "y_hi", "size"])
    near = pd.DataFrame(points, columns=["level", "x", "y"])
    got = M.graded_mesh(spark.createDataFrame(levels), spark.createDataFrame(near), spark.createDataFrame(hull), "level", base, fine, radius)
    return [d.toPandas() for d in got]


@pytest.mark.parametrize("base, fine, radius", [(0.25, 0.25, 0.1), (0.5, 0.0625, 0.2), (0.3, 0.05, 0.15)])
def test_triangles_fill_the_outline(spark, base, fine, radius):
    shapes = outlines()
    rng = np.random.default_rng(2)
    points = [(k, *(p[rng.integers(len(p))] * 0.7 + p.mean(0) * 0.3)) for k, p in shapes.items() for _ in range(3)]
    nodes, tris, rim = made(spark, shapes, points, base, fine, radius)
    for k, p in shapes.items():
        own = nodes[nodes.level == k].sort_values("node")
        assert own.node.tolist() == list(range(len(own)))
        xy, t = own[["x", "y"]].to_numpy(), tris[tris.level == k].sort_values("tri")
        assert t.tri.tolist() == list(range(len(t)))
        abc = t[["a", "b", "c"]].to_numpy()
        u, v = xy[abc[:, 1]] - xy[abc[:, 0]], xy[abc[:, 2]] - xy[abc[:, 0]]
        each = 0.5 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        assert (each > 0).all() and each.sum() == pytest.approx(area(p), rel=1e-9)
        edges = pd.Series([tuple(sorted(e)) for a, b, c in abc for e in ((a, b), (b, c), (c, a))]).value_counts()
        assert edges.max() <= 2 and len(xy) - len(edges) + len(abc) == 1 and set(np.unique(abc)) == set(range(len(xy)))
        around = rim[rim.level == k].sort_values("seq").node.to_numpy()
        assert len(around) == (edges == 1).sum() and area(xy[around]) == pytest.approx(area(p), rel=1e-9)
        ends = set(map(tuple, np.round(p, 9)))
        assert ends <= set(map(tuple, np.round(xy[around], 9)))


def test_cells_follow_the_size_asked_for(spark):
    shapes, points = {7: np.array([[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0]])}, [(7, 3.1, 3.3)]
    nodes, tris, _ = made(spark, shapes, points, 1.0, 0.125, 1.0)
    xy = nodes.sort_values("node")[["x", "y"]].to_numpy()
    corner = xy[tris[["a", "b", "c"]].to_numpy()]
    longest = np.sqrt(((corner - np.roll(corner, 1, axis=1)) ** 2).sum(2)).max(1)
    away = np.sqrt(((corner.mean(1) - [3.1, 3.3]) ** 2).sum(1))
    asked = 0.125 + 0.875 * np.clip((away - 1.0) / 0.5, 0, 1)
    assert (longest <= asked * np.sqrt(2) + 1e-9 + 0.9 * (away > 1.0)).all()
    assert longest[away < 0.9].max() <= 0.125 * np.sqrt(2) + 1e-9 and longest.max() >= 1.0


def test_levels_without_an_area_and_bad_sizes(spark):
    shapes = {1: np.array([[0.0, 0.0], [1.0, 1.0]]), 2: np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])}
    nodes, tris, rim = made(spark, shapes, [(1, 0.0, 0.0)], 2.0, 1.0, 0.1)
    assert set(nodes.level) == set(tris.level) == set(rim.level) == {2} and len(tris) == 1
    with pytest.raises(ValueError, match="grow"):
        made(spark, shapes, [(1, 0.0, 0.0)], 1.0, 2.0, 0.1)
