"""Triangles on a lattice of graded cells that fills a convex outline exactly.

Square cells of the base size cover the box of a level. A cell is split in four, again and again, as long as it
is larger than the size that its distance to the refinement points asks for. Neighbours differ by one split at
most (2:1 balance), so an edge carries one node in its middle or none, and two cells that share an edge agree on
its nodes. A cell without such nodes gives two triangles; any other cell gives a fan around its centre. Cells on
the outline are cut by it; the places where outline and lattice lines meet depend on the two lines alone, so
cells on both sides of a lattice line find the same node. Only cells that an edge of the outline passes see that
edge: the edge names the base cells on its way.

All levels are one table, and all steps are joins on whole cell numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import global_index
from tessera.runtime import cut_lineage

RAMP = 0.5  # width of the ramp from fine to base cells as a share of the radius (fixed value)
KEY_BITS = 20  # places within half a finest cell that tell nodes apart
_SIDES = ((0, -1), (1, 0), (0, 1), (-1, 0))  # below, right, above, left: bits 1, 2, 4, 8


def _splits(base: float, fine: float) -> int:
    return max(0, math.ceil(math.log2(base / fine) - 1e-9))


def _base_cells(levels: DataFrame, hull: DataFrame, level: str, base: float) -> DataFrame:
    """Base cells inside or on the outline: ``level, bx, by`` and the edges that pass them (null: none do)."""
    w, ring = Window.partitionBy(level).orderBy("seq"), Window.partitionBy(level)
    nxt = {c: F.coalesce(F.lead(c).over(w), F.min_by(c, "seq").over(ring)) for c in ("x", "y")}
    edges = hull.select(level, "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), nxt["x"].alias("bx"), nxt["y"].alias("by"))
    edges = edges.join(levels.select(level, "x_lo", "y_lo", "nx", "ny", "h"), level)
    slack = F.lit(1e-9)

    def cell(v: Column, lo: str, n: str, shift: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor((v - F.col(lo)) / F.col("h") + shift))).cast("long")

    # columns that an edge passes, and its rows within each column
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    edges = edges.withColumn("cx", F.explode(F.sequence(cell(left, "x_lo", "nx", -slack), cell(right, "x_lo", "nx", slack))))
    slope = F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))

    def at(x: Column) -> Column:
        inner = F.col("ay") + (F.greatest(left, F.least(right, x)) - F.col("ax")) * slope
        return F.greatest(F.least("ay", "by"), F.least(F.greatest("ay", "by"), inner))

    y0, y1 = at(F.col("x_lo") + F.col("cx") * F.col("h")), at(F.col("x_lo") + (F.col("cx") + 1) * F.col("h"))
    flat = F.col("ax") == F.col("bx")
    lo, hi = F.when(flat, F.least("ay", "by")).otherwise(F.least(y0, y1)), F.when(flat, F.greatest("ay", "by")).otherwise(F.greatest(y0, y1))
    edges = edges.withColumns({"r0": cell(lo, "y_lo", "ny", -slack), "r1": cell(hi, "y_lo", "ny", slack)})
    passed = (edges.withColumn("cy", F.explode(F.sequence("r0", "r1"))).groupBy(level, "cx", "cy")
              .agg(F.collect_list(F.struct("seq", "ax", "ay", "bx", "by")).alias("edges")))
    # between the lower and the upper edges of a column nothing passes
    column = edges.groupBy(level, "cx").agg(F.max(F.when(F.col("bx") > F.col("ax"), F.col("r1"))).alias("low"),
                                            F.min(F.when(F.col("bx") < F.col("ax"), F.col("r0"))).alias("high"))
    inner = column.where("high - low > 1").withColumn("cy", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1))).select(level, "cx", "cy")
    inner = inner.join(passed, [level, "cx", "cy"], "left_anti").withColumn("edges", F.lit(None).cast(passed.schema["edges"].dataType))
    return passed.unionByName(inner).select(level, F.col("cx").alias("bx"), F.col("cy").alias("by"), "edges")


def graded_cells(levels: DataFrame, points: DataFrame, cells: DataFrame, level: str, base: float, fine: float, radius: float) -> DataFrame:
    """The cells ``level, depth, ix, iy`` within the base cells, and ``mask``: the sides with a node in the middle.

    The size asked for is ``fine`` up to ``radius`` from a refinement point and grows in proportion to ``base``
    at one and a half times the radius. Distances are those between cells of equal depth, so a cell is never
    larger than asked for, and the cells to split at one depth lie within those of the depth before.
    """
    depth = _splits(base, fine)
    held = cells.select(level, "bx", "by")
    split: dict[int, DataFrame] = {}
    for k in range(depth - 1, -1, -1):
        h = F.col("h") / (1 << k)
        share = (base / (1 << k) - fine) / (base - fine)
        reach = F.lit(radius) * F.sqrt("size") * F.lit(1 + RAMP * share)
        most = [(F.col(n) * (1 << k)).cast("long") - 1 for n in ("nx", "ny")]
        own = [F.greatest(F.lit(0).cast("long"), F.least(m, F.floor((F.col(c) - F.col(lo)) / h).cast("long"))) for m, c, lo in zip(most, ("x", "y"), ("x_lo", "y_lo"))]
        near = points.join(levels, level).select(level, "h", "size", "nx", "ny", own[0].alias("px"), own[1].alias("py")).distinct()
        wide = F.ceil(reach / h).cast("long")
        near = near.withColumns({"_w": wide, "ix": F.explode(F.sequence(F.greatest(F.lit(0), F.col("px") - wide), F.least(most[0], F.col("px") + wide)))})
        near = near.withColumn("iy", F.explode(F.sequence(F.greatest(F.lit(0), F.col("py") - F.col("_w")), F.least(most[1], F.col("py") + F.col("_w")))))
        gap = [F.greatest(F.abs(F.col(c) - F.col(p)) - 1, F.lit(0)) * h for c, p in (("ix", "px"), ("iy", "py"))]
        asked = near.where(gap[0] * gap[0] + gap[1] * gap[1] < reach * reach).select(level, "ix", "iy")
        if k + 1 in split:  # what is split next to a cell keeps that cell's neighbours at its own size
            finer = split[k + 1].withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _SIDES])))
            finer = finer.select(level, F.shiftright(F.col("ix") + F.col("s.a"), 1).alias("ix"), F.shiftright(F.col("iy") + F.col("s.b"), 1).alias("iy"))
            asked = asked.unionByName(finer)
        asked = asked.distinct().withColumns({"bx": F.shiftright("ix", k), "by": F.shiftright("iy", k)})
        split[k] = cut_lineage(asked.join(held, [level, "bx", "by"], "left_semi").select(level, "ix", "iy"))
    found = None
    for k in range(depth + 1):
        if k == 0:
            here = held.select(level, F.col("bx").alias("ix"), F.col("by").alias("iy"))
        else:
            quarter = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
            here = split[k - 1].withColumn("q", quarter).select(level, (F.col("ix") * 2 + F.col("q.a")).alias("ix"), (F.col("iy") * 2 + F.col("q.b")).alias("iy"))
        if k in split:
            here = here.join(split[k], [level, "ix", "iy"], "left_anti")
            # a split cell puts a node on the facing side of its neighbours
            facing = F.explode(F.array(*[F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b"), F.lit(1 << s).alias("bit")) for s, (a, b) in enumerate(_SIDES)]))
            marks = (split[k].withColumn("s", facing).select(level, (F.col("ix") + F.col("s.a")).alias("ix"), (F.col("iy") + F.col("s.b")).alias("iy"), "s.bit")
                     .groupBy(level, "ix", "iy").agg(F.sum("bit").cast("int").alias("mask")))
            here = here.join(marks, [level, "ix", "iy"], "left")
        else:
            here = here.withColumn("mask", F.lit(0))
        here = here.select(level, F.lit(k).alias("depth"), "ix", "iy", F.coalesce("mask", F.lit(0)).alias("mask"))
        found = here if found is None else found.unionByName(here)
    return found


_NODE = "struct<kx: long, ky: long, x: double, y: double>"


def _whole_cells(cells: DataFrame, depth: int) -> DataFrame:
    """Nodes and triangles of the cells that no edge passes: in turn from the lower left corner."""
    unit = F.expr(f"shiftleft(1L, {depth + 1} - depth)")  # in half finest cells
    half, step = F.shiftright(unit, 1), F.col("h") / (2 << depth)
    x, y = F.col("ix") * unit, F.col("iy") * unit

    def node(kx: Column, ky: Column) -> Column:
        return F.struct(F.shiftleft(kx, KEY_BITS).alias("kx"), F.shiftleft(ky, KEY_BITS).alias("ky"),
                        (F.col("x_lo") + kx * step).alias("x"), (F.col("y_lo") + ky * step).alias("y"))

    corners = [node(x, y), node(x + unit, y), node(x + unit, y + unit), node(x, y + unit)]
    middles = [node(x + half, y), node(x + unit, y + half), node(x + half, y + unit), node(x, y + half)]
    ring = F.filter(F.array(*[n for s in range(4) for n in (corners[s], F.when(F.col("mask").bitwiseAND(1 << s) > 0, middles[s]))]), lambda n: n.isNotNull())
    rows = cells.withColumn("ring", ring)
    # numbers of nodes in the cell; -1 is the centre
    fan = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: F.struct(F.lit(-1).alias("a"), i.alias("b"), ((i + 1) % F.size("ring")).alias("c")))
    two = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("abc", t)]) for t in ((0, 1, 2), (0, 2, 3))])
    plain = F.col("mask") == 0
    return rows.select("cell", "lv", "ring", F.when(~plain, node(x + half, y + half)).alias("centre"), F.when(plain, two).otherwise(fan).alias("tris"))


def _cut_cells(cells: DataFrame, depth: int) -> DataFrame:
    """The same for the cells on the outline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut(r) for r in b.select(["cell", "lv", "depth", "ix", "iy", "mask", "edges", "x_lo", "y_lo", "h"]).to_pylist()]
            yield pa.RecordBatch.from_pylist([r for r in out if r is not None], schema=schema)

    def cut(r: dict) -> dict | None:
        unit, step = 1 << (depth + 1 - r["depth"]), r["h"] / (2 << depth)
        x0, y0, half = r["ix"] * unit, r["iy"] * unit, unit // 2
        quantum, eps = step / (1 << KEY_BITS), 1e-9 * r["h"]

        def lattice(kx: int, ky: int) -> dict:
            return {"kx": kx << KEY_BITS, "ky": ky << KEY_BITS, "x": r["x_lo"] + kx * step, "y": r["y_lo"] + ky * step}

        def node(x: float, y: float) -> dict:
            return {"kx": round((x - r["x_lo"]) / quantum), "ky": round((y - r["y_lo"]) / quantum), "x": x, "y": y}

        def inside(n: dict) -> bool:
            return all((e["bx"] - e["ax"]) * (n["y"] - e["ay"]) - (e["by"] - e["ay"]) * (n["x"] - e["ax"])
                       >= -eps * (abs(e["bx"] - e["ax"]) + abs(e["by"] - e["ay"])) for e in r["edges"])

        ring = []
        for s, (kx, ky) in enumerate(((x0, y0), (x0 + unit, y0), (x0 + unit, y0 + unit), (x0, y0 + unit))):
            ring.append(lattice(kx, ky))
            if r["mask"] >> s & 1:
                ring.append(lattice(kx + (half, 0, -half, 0)[s], ky + (0, half, 0, -half)[s]))
        left, low, right, top = ring[0]["x"], ring[0]["y"], lattice(x0 + unit, y0)["x"], lattice(x0, y0 + unit)["y"]
        kept = [n for n in ring if inside(n)]
        if len(kept) == len(ring):
            if not r["mask"]:
                return {"cell": r["cell"], "lv": r["lv"], "ring": ring, "centre": None, "tris": [{"a": 0, "b": 1, "c": 2}, {"a": 0, "b": 2, "c": 3}]}
            centre = lattice(x0 + half, y0 + half)
        else:
            for e in r["edges"]:
                ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
                for x, y in ((ax, ay), (bx, by)):
                    if left - eps <= x <= right + eps and low - eps <= y <= top + eps:
                        kept.append(node(x, y))
                for line in (left, right):  # these places depend on the edge and the lattice line alone
                    if min(ax, bx) + eps < line < max(ax, bx) - eps:
                        y = ay + (line - ax) * ((by - ay) / (bx - ax))
                        if low - eps <= y <= top + eps:
                            kept.append(node(line, y))
                for line in (low, top):
                    if min(ay, by) + eps < line < max(ay, by) - eps:
                        x = ax + (line - ay) * ((bx - ax) / (by - ay))
                        if left - eps <= x <= right + eps:
                            kept.append(node(x, line))
            # nodes closer than rounding are one; lattice nodes come first and stay
            ring = []
            for n in kept:
                if all(abs(n["kx"] - m["kx"]) > 8 or abs(n["ky"] - m["ky"]) > 8 for m in ring):
                    ring.append(n)
            if len(ring) < 3:
                return None
            cx, cy = math.fsum(n["x"] for n in ring) / len(ring), math.fsum(n["y"] for n in ring) / len(ring)
            ring.sort(key=lambda n: math.atan2(n["y"] - cy, n["x"] - cx))
            area = sum((m["x"] - cx) * (n["y"] - cy) - (n["x"] - cx) * (m["y"] - cy) for m, n in zip(ring, ring[1:] + ring[:1]))
            if area <= eps * r["h"]:
                return None
            if len(ring) == 3:
                return {"cell": r["cell"], "lv": r["lv"], "ring": ring, "centre": None, "tris": [{"a": 0, "b": 1, "c": 2}]}
            centre = node(cx, cy)
        tris = [{"a": -1, "b": i, "c": (i + 1) % len(ring)} for i in range(len(ring))]
        return {"cell": r["cell"], "lv": r["lv"], "ring": ring, "centre": centre, "tris": tris}

    place = pa.struct([("kx", pa.int64()), ("ky", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])
    schema = pa.schema([("cell", pa.int64()), ("lv", pa.int64()), ("ring", pa.list_(place)), ("centre", place),
                        ("tris", pa.list_(pa.struct([(c, pa.int32()) for c in "abc"])))])
    return cells.mapInArrow(run, f"cell long, lv long, ring array<{_NODE}>, centre {_NODE}, tris array<struct<a: int, b: int, c: int>>")


def graded_mesh(levels: DataFrame, points: DataFrame, hull: DataFrame, level: str, base: float, fine: float, radius: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes ``(level, node, x, y)``, triangles ``(level, tri, a, b, c)`` and outline ``(level, seq, node)`` of every level.

    ``levels`` has one row per level (whole numbers): the box ``x_lo, x_hi, y_lo, y_hi`` of its outline and its
    ``size``; cells are ``base * size`` wide, ``fine * size`` next to refinement points ``(level, x, y)``, with
    the radius ``radius * sqrt(size)``. ``hull (level, seq, x, y)`` lists the corners of the convex outline
    counter-clockwise. Nodes and triangles are numbered from 0 within a level. Triangles run counter-clockwise,
    share whole edges and fill the outline. Levels without an outline of three corners are left out.
    """
    if not 0 < fine <= base:
        raise ValueError("cells grow from fine to base")
    depth = _splits(base, fine)
    h = F.lit(base) * F.col("size")
    corners = hull.groupBy(level).agg(F.count(F.lit(1)).alias("corners")).where("corners >= 3").select(level)
    levels = levels.join(corners, level).select(level, "x_lo", "y_lo", "size", h.alias("h"), *[
        F.greatest(F.lit(1), F.ceil((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / h - F.lit(1e-9))).cast("long").alias(f"n{c}") for c in ("x", "y")])
    levels = cut_lineage(levels)
    base_cells = cut_lineage(_base_cells(levels, hull, level, base))
    cells = graded_cells(levels, points.select(level, "x", "y"), base_cells, level, base, fine, radius)
    cells = cells.withColumns({"bx": F.expr("shiftright(ix, depth)"), "by": F.expr("shiftright(iy, depth)")}).join(base_cells, [level, "bx", "by"])
    cells = cells.join(levels.select(level, "x_lo", "y_lo", "h"), level)
    cells = cells.withColumns({"lv": F.col(level).cast("long"), "cell": F.xxhash64(level, "depth", "ix", "iy")})
    shapes = _whole_cells(cells.where("edges IS NULL"), depth).unionByName(_cut_cells(cells.where("edges IS NOT NULL").drop(level), depth))
    shapes = cut_lineage(shapes)
    spots = shapes.select("lv", F.explode(F.concat("ring", F.when(F.col("centre").isNull(), F.slice("ring", 1, 0)).otherwise(F.array("centre")))).alias("n"))
    # nodes of one key differ by rounding at most
    spots = spots.groupBy("lv", "n.kx", "n.ky").agg(F.min(F.struct("n.x", "n.y")).alias("at"))
    nodes = _numbered(spots.select("lv", "kx", "ky", "at.x", "at.y"), ["lv", "kx", "ky"], "node")
    corner = shapes.select("lv", "cell", "ring", "centre", F.posexplode("tris").alias("n", "t"))
    pick = lambda c: F.when(F.col(f"t.{c}") < 0, F.col("centre")).otherwise(F.get("ring", F.col(f"t.{c}")))
    corner = corner.select("lv", "cell", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), pick(c)["kx"].alias("kx"), pick(c)["ky"].alias("ky")) for c in "abc"])).alias("v"))
    tris = (corner.select("lv", "cell", "n", "v.*").join(nodes.select("lv", "kx", "ky", "node"), ["lv", "kx", "ky"]).groupBy("lv", "cell", "n")
            .agg(*[F.max(F.when(F.col("c") == c, F.col("node"))).alias(c) for c in "abc"]))
    tris = _numbered(tris.select("lv", "a", "b", "c"), ["lv", "a", "b", "c"], "tri")
    rim = outline(tris.withColumnRenamed("lv", level), nodes.withColumnRenamed("lv", level), level)
    kind = hull.schema[level].dataType
    named = lambda df, cols: df.select(F.col("lv").cast(kind).alias(level), *cols)
    return named(nodes, ["node", "x", "y"]), named(tris, ["tri", "a", "b", "c"]), rim.withColumn(level, F.col(level).cast(kind))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows from 0 within each level ``lv``: a global order, less the rows of the levels before."""
    rows = global_index(cut_lineage(rows), order, "_pos")
    first = rows.groupBy("lv").agg(F.min("_pos").alias("_first"))
    return rows.join(first, "lv").withColumn(name, F.col("_pos") - F.col("_first")).drop("_pos", "_first")


def mesh_edges(triangles: DataFrame, level: str) -> DataFrame:
    """Edges ``(level, lo, hi, sides)``: how many triangles share each; the direction ``first`` of the single one."""
    ends = F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca")]))
    edge = triangles.select(level, ends.alias("e")).select(level, F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi"), F.col("e.p").alias("p"))
    return edge.groupBy(level, "lo", "hi").agg(F.count(F.lit(1)).alias("sides"), F.min("p").alias("first"))


def outline(triangles: DataFrame, nodes: DataFrame, level: str) -> DataFrame:
    """Nodes on the outline ``(level, seq, node)`` counter-clockwise: where edges of one triangle only begin.

    The outline is convex, so its order is that of the angle around its middle.
    """
    rim = mesh_edges(triangles, level).where("sides = 1").select(level, F.col("first").alias("node")).join(nodes.select(level, "node", "x", "y"), [level, "node"])
    middle = rim.groupBy(level).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    turn = rim.join(middle, level).withColumn("_t", F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx")))
    return turn.select(level, (F.row_number().over(Window.partitionBy(level).orderBy("_t", "node")) - 1).cast("long").alias("seq"), "node")
