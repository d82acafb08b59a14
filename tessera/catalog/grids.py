"""Grids, levels and hulls."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import PT, part_points, rounded, table
from tessera.operators import grid as G
from tessera.operators import mesh as M
from tessera.operators.hull import convex_hull
from tessera.runtime import checkpoint_dir
from tessera.sources.level_table import level_table_text, read_level_text, write_level_text

_LAT = """lat AS (SELECT CAST(round(l_tax * 100) AS INTEGER) AS level, CAST(floor((l_quantity - 1) / 5) AS INTEGER) AS i,
  CAST(round(l_discount * 100) AS INTEGER) AS j, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY ALL)"""


def _lattice(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.round(F.col("l_tax") * 100).cast("int").alias("level"), F.floor((F.col("l_quantity") - 1) / 5).cast("int").alias("i"),
                      F.round(F.col("l_discount") * 100).cast("int").alias("j")).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))


@query("tensor_grid", f"""WITH r AS (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1,
  count(DISTINCT l_suppkey) AS nx, count(DISTINCT l_discount) AS ny FROM lineitem)
SELECT i, j, round((x0 - x1) * cos(i * ({math.pi / 2!r} / (nx - 1))) + x1, 4) AS x, round(y0 + j * ((y1 - y0) / (ny - 1)), 6) AS y
FROM r, LATERAL (SELECT unnest(range(nx)) AS i), LATERAL (SELECT unnest(range(ny)) AS j)""")
def _tensor(spark, d):
    r = table(spark, d, "lineitem").agg(F.min("l_extendedprice"), F.max("l_extendedprice"), F.min("l_quantity"), F.max("l_quantity"),
                                        F.count_distinct("l_suppkey"), F.count_distinct("l_discount")).first()
    got = G.tensor_grid(spark, (r[0], r[1], r[4]), (r[2], r[3], r[5]))
    return got.select("i", "j", F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))


@query("split_ladder", """WITH r AS (SELECT min(s_acctbal) AS lo, round(avg(s_acctbal), 2) AS mid, max(s_acctbal) AS hi, count(*) // 2 AS h, count(*) - count(*) // 2 + 1 AS u FROM supplier)
SELECT round(CASE WHEN i = h - 1 THEN mid ELSE lo + i * ((mid - lo) / (h - 1)) END, 4) AS value FROM r, LATERAL (SELECT unnest(range(h)) AS i)
UNION ALL SELECT round(CASE WHEN i = u - 1 THEN hi ELSE mid + i * ((hi - mid) / (u - 1)) END, 4) FROM r, LATERAL (SELECT unnest(range(1, u)) AS i)""")
def _split_ladder(spark, d):
    lo, mid, hi, n = table(spark, d, "supplier").agg(F.min("s_acctbal"), F.round(F.avg("s_acctbal"), 2), F.max("s_acctbal"), F.count(F.lit(1))).first()
    return rounded(G.split_ladder(spark, lo, mid, hi, n), 4)


@query("level_ladder", """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
e AS (SELECT lo + 0.1e0 * (hi - lo) AS a, hi - 0.1e0 * (hi - lo) AS b FROM r)
SELECT DISTINCT round(v, 6) AS level_value FROM (SELECT CASE WHEN i = 17 THEN b ELSE a + i * ((b - a) / 17) END AS v FROM e, range(18) t(i)
  UNION ALL SELECT unnest([20000e0, 50000e0]))""")
def _levels(spark, d):
    return rounded(G.level_ladder(table(spark, d, "lineitem"), "l_extendedprice", 20, (20000.0, 50000.0)))


def _grad(src: str, p: str) -> str:
    return (f"CASE WHEN lag({src}) OVER {p} IS NULL THEN lead({src}) OVER {p} - {src} WHEN lead({src}) OVER {p} IS NULL THEN {src} - lag({src}) OVER {p} "
            f"ELSE (lead({src}) OVER {p} - lag({src}) OVER {p}) / 2e0 END")


_CURV = _LAT + f""", q0 AS (SELECT *, (v - min(v) OVER l) / (max(v) OVER l - min(v) OVER l) AS q FROM lat WINDOW l AS (PARTITION BY level)),
g0 AS (SELECT *, {_grad('q', 'wi')} AS di, {_grad('q', 'wj')} AS dj FROM q0 WINDOW wi AS (PARTITION BY level, j ORDER BY i), wj AS (PARTITION BY level, i ORDER BY j)),
g1 AS (SELECT *, sqrt(di * di + dj * dj) / max(sqrt(di * di + dj * dj)) OVER (PARTITION BY level) AS g FROM g0),
g2 AS (SELECT level, i, j, v, {_grad('g', 'wi')} AS di, {_grad('g', 'wj')} AS dj FROM g1 WINDOW wi AS (PARTITION BY level, j ORDER BY i), wj AS (PARTITION BY level, i ORDER BY j)),
cv AS (SELECT level, i, j, v, sqrt(di * di + dj * dj) / max(sqrt(di * di + dj * dj)) OVER (PARTITION BY level) AS k FROM g2)"""


@query("grid_curvature", f"WITH {_CURV} SELECT level, i, j, v, round(k, 6) AS curvature, k > 0.3 AS flagged FROM cv")
def _curvature(spark, d):
    got = G.grid_curvature(_lattice(spark, d), "level", "i", "j", "v")
    return got.select("level", "i", "j", "v", F.round("curvature", 6).alias("curvature"), "flagged")


_SPEC = "spec AS (SELECT level, min(i) * 1e0 AS x_u, max(i) * 1e0 AS x_b, min(j) * 1e0 AS y_lo, max(j) * 1e0 AS y_hi FROM lat GROUP BY level)"


@query("refinement_points", f"""WITH {_CURV}, {_SPEC} SELECT level, i * 1e0 AS x, j * 1e0 AS y FROM cv WHERE k > 0.3
UNION ALL SELECT level, x_u, y_lo + (y_hi - y_lo) * (n / 8e0) FROM spec, range(9) t(n)
UNION ALL SELECT level, x_b, y_lo + (y_hi - y_lo) * (n / 8e0) FROM spec, range(9) t(n)""")
def _refinement(spark, d):
    return _refine(spark, d)[0]


def _refine(spark, d):
    lat = _lattice(spark, d).withColumns({"x": F.col("i") * F.lit(1.0), "y": F.col("j") * F.lit(1.0)})
    spec = lat.groupBy("level").agg(F.min("x").alias("x_u"), F.max("x").alias("x_b"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))
    spec = spec.withColumns({"yu_lo": F.col("y_lo"), "yu_hi": F.col("y_hi"), "yb_lo": F.col("y_lo"), "yb_hi": F.col("y_hi")})
    edges = G.edge_points(spec, "level", 9)
    return G.refinement_points(lat, "level", "i", "j", "v", "x", "y", edges), spec


@query("refined_nodes", f"""WITH {_CURV}, {_SPEC}, pts AS (SELECT level, i * 1e0 AS px, j * 1e0 AS py FROM cv WHERE k > 0.3
  UNION SELECT level, x_u, y_lo + (y_hi - y_lo) * (n / 8e0) FROM spec, range(9) t(n) UNION SELECT level, x_b, y_lo + (y_hi - y_lo) * (n / 8e0) FROM spec, range(9) t(n)),
lt AS (SELECT level, h, reach, x_u + a * h AS x, y_lo + b * h AS y FROM spec, (VALUES (1e0, NULL), (0.25e0, 0.5e0), (0.5e0, 0.75e0)) s(h, reach), range(80) t(a), range(80) u(b)
  WHERE x_u + a * h <= x_b AND y_lo + b * h <= y_hi)
SELECT DISTINCT level, x, y FROM lt WHERE reach IS NULL
UNION SELECT lt.level, x, y FROM lt JOIN pts ON lt.level = pts.level AND (x - px) * (x - px) + (y - py) * (y - py) <= reach * reach WHERE reach IS NOT NULL""")
def _nodes(spark, d):
    points, spec = _refine(spark, d)
    levels = spec.select("level", F.col("x_u").alias("x_lo"), F.col("x_b").alias("x_hi"), "y_lo", "y_hi", F.lit(1.0).alias("size"))
    return G.refined_nodes(levels, points, "level", 1.0, 0.25, 0.5)


@query("convex_hull")
def _hull(spark, d):
    return convex_hull(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity"), "l_suppkey", "l_extendedprice", "l_quantity")


# a point is inside if two chords, from a leftmost and to a rightmost point of some quantities, enclose it at its height
@query("inside_hull", """WITH li AS (SELECT l_suppkey, l_extendedprice AS x, l_quantity AS y FROM lineitem),
ends AS (SELECT l_suppkey, y, min(x) AS x0, max(x) AS x1 FROM li GROUP BY ALL),
asked AS (SELECT DISTINCT l_suppkey, 51e0 - y AS y FROM li),
chord AS (SELECT q.l_suppkey, q.y, min(a.x0 + (b.x0 - a.x0) * t) AS lo, max(a.x1 + (b.x1 - a.x1) * t) AS hi
  FROM asked q JOIN ends a ON a.l_suppkey = q.l_suppkey AND a.y <= q.y JOIN ends b ON b.l_suppkey = q.l_suppkey AND b.y >= q.y,
    LATERAL (SELECT CASE WHEN b.y > a.y THEN (q.y - a.y) / (b.y - a.y) ELSE 0 END AS t) GROUP BY ALL)
SELECT li.l_suppkey, li.x, 51e0 - li.y AS y FROM li JOIN chord c ON c.l_suppkey = li.l_suppkey AND c.y = 51e0 - li.y
WHERE li.x BETWEEN c.lo - 1e-7 AND c.hi + 1e-7""")
def _inside(spark, d):
    """Lattice points of all suppliers that lie within the hull of their line items."""
    hull = convex_hull(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity"), "l_suppkey", "l_extendedprice", "l_quantity")
    pts = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x"), F.expr("51e0 - l_quantity").alias("y"))
    return G.inside_hull(pts, hull, "l_suppkey")


@query("hull_area_bound", """WITH p AS (SELECT l_suppkey, l_extendedprice AS x, l_quantity AS y FROM lineitem),
a AS (SELECT unnest([0e0, 0.7e0, 1.3e0, 2.2e0, 3.1e0, 4.4e0, 5.5e0]) AS t)
SELECT l_suppkey, t, round(max(x * cos(t) / 2000e0 + y * sin(t)), 6) AS support FROM p, a GROUP BY ALL""")
def _support(spark, d):
    """Farthest reach of every hull in seven directions: equal for a point set and its hull."""
    hull = convex_hull(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity"), "l_suppkey", "l_extendedprice", "l_quantity")
    at = hull.withColumn("t", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.7, 1.3, 2.2, 3.1, 4.4, 5.5)])))
    reach = F.max(F.col("x") * F.cos("t") / F.lit(2000.0) + F.col("y") * F.sin("t"))
    return at.groupBy("l_suppkey", "t").agg(F.round(reach, 6).alias("support"))


_TRI = _LAT + """, nd AS (SELECT level, i, j, CAST(i * 100 + j AS BIGINT) AS node FROM lat),
quad AS (SELECT a.level, a.node AS n00, b.node AS n10, c.node AS n01, e.node AS n11 FROM nd a JOIN nd b ON a.level = b.level AND b.i = a.i + 1 AND b.j = a.j
  JOIN nd c ON a.level = c.level AND c.i = a.i AND c.j = a.j + 1 JOIN nd e ON a.level = e.level AND e.i = a.i + 1 AND e.j = a.j + 1),
tri AS (SELECT level, n00 AS a, n10 AS b, n11 AS c FROM quad UNION ALL SELECT level, n00, n11, n01 FROM quad)"""


def _mesh(spark, d):
    nodes = _lattice(spark, d).withColumn("node", (F.col("i") * 100 + F.col("j")).cast("long"))
    return nodes, G.lattice_triangles(nodes, "level", "i", "j", "node")


@query("lattice_triangles", f"WITH {_TRI} SELECT level, a, b, c FROM tri")
def _triangles(spark, d):
    return _mesh(spark, d)[1]


@query("level_counts", f"""WITH {_TRI}, n AS (SELECT level, count(*) AS nodes FROM nd GROUP BY level), t AS (SELECT level, count(*) AS triangles FROM tri GROUP BY level),
h AS (SELECT level, count(*) AS hull_points FROM nd WHERE i = 0 GROUP BY level)
SELECT level, nodes, coalesce(triangles, 0) AS triangles, coalesce(hull_points, 0) AS hull_points FROM n LEFT JOIN t USING (level) LEFT JOIN h USING (level)""")
def _counts(spark, d):
    nodes, tri = _mesh(spark, d)
    return G.level_counts(nodes, tri, nodes.where("i = 0"), "level")


@query("level_table_data", f"WITH {_LAT} SELECT level, i, j, printf('%+.14e\t%+.14e', i * 1e0, v) AS line FROM lat")
def _table_lines(spark, d):
    """The data lines of lattice nodes alone."""
    lat = _lattice(spark, d).withColumns({"x": F.col("i") * F.lit(1.0), "node": F.col("i") * 100 + F.col("j")})
    none = lat.where("false")
    text = level_table_text(lat, none.select("level", F.lit(0).alias("tri"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")),
                            none.select("level", F.lit(0).alias("seq"), "node"),
                            lat.select("level").distinct().withColumn("level_value", F.col("level") * F.lit(1.0)), ["x", "v"], {"H2": -0.5})
    rows = text.where("part = 11 and seq = 1")
    return rows.select(F.col("lv").cast("int").alias("level"), F.floor(F.col("ord") / 100).cast("int").alias("i"),
                       (F.col("ord") % 100).cast("int").alias("j"), F.col("value").alias("line"))


# the graded mesh over the boxes of the lattice levels: cells of 1, 1/2 and 1/4, distances as in refined_nodes.
# Nodes are whole numbers of eighths from the corner of the box.
_MESH = f"""{_CURV}, {_SPEC}, box AS (SELECT level, x_u AS x0, y_lo AS y0, CAST(x_b - x_u AS BIGINT) AS nx, CAST(y_hi - y_lo AS BIGINT) AS ny FROM spec),
pts AS (SELECT level, i * 1e0 AS px, j * 1e0 AS py FROM cv WHERE k > 0.3
  UNION SELECT level, x_u, y_lo + (y_hi - y_lo) * (n / 8e0) FROM spec, range(9) t(n) UNION SELECT level, x_b, y_lo + (y_hi - y_lo) * (n / 8e0) FROM spec, range(9) t(n)),
src AS (SELECT DISTINCT level, d, nx, ny, least(nx * CAST(1 / h AS BIGINT) - 1, CAST(floor((px - x0) / h) AS BIGINT)) AS px, least(ny * CAST(1 / h AS BIGINT) - 1, CAST(floor((py - y0) / h) AS BIGINT)) AS py, h, reach
  FROM pts JOIN box USING (level), (VALUES (0, 1e0, 0.75e0), (1, 0.5e0, 0.5e0 * (1 + 0.5e0 * (0.25e0 / 0.75e0)))) s(d, h, reach)),
near AS (SELECT DISTINCT level, d, px + a AS ix, py + b AS iy FROM src, range(-2, 3) t(a), range(-2, 3) u(b)
  WHERE px + a BETWEEN 0 AND nx * CAST(1 / h AS BIGINT) - 1 AND py + b BETWEEN 0 AND ny * CAST(1 / h AS BIGINT) - 1
    AND pow(greatest(abs(a) - 1, 0) * h, 2) + pow(greatest(abs(b) - 1, 0) * h, 2) < reach * reach),
side AS (SELECT * FROM (VALUES (1, 0, -1), (2, 1, 0), (4, 0, 1), (8, -1, 0)) v(bit, a, b)),
split AS (SELECT level, d, ix, iy FROM near UNION
  SELECT level, 0, (ix + a) >> 1, (iy + b) >> 1 FROM near JOIN box USING (level), side WHERE d = 1 AND ix + a >= 0 AND iy + b >= 0 AND (ix + a) >> 1 < nx AND (iy + b) >> 1 < ny),
every AS (SELECT level, 0 AS d, ix, iy FROM box, LATERAL (SELECT unnest(range(nx)) AS ix), LATERAL (SELECT unnest(range(ny)) AS iy)
  UNION ALL SELECT level, d + 1, ix * 2 + a, iy * 2 + b FROM split, range(2) t(a), range(2) u(b)),
cell AS (SELECT * FROM every ANTI JOIN split USING (level, d, ix, iy)),
masked AS (SELECT c.level, c.d, c.ix, c.iy, coalesce(sum(bit) FILTER (s.level IS NOT NULL), 0)::BIGINT AS mask
  FROM cell c, side LEFT JOIN split s ON s.level = c.level AND s.d = c.d AND s.ix = c.ix + side.a AND s.iy = c.iy + side.b GROUP BY ALL),
ring AS (SELECT level, d, ix, iy, mask, [x + u // 2, y + u // 2] AS mid, list_filter([[x, y], CASE WHEN mask & 1 > 0 THEN [x + u // 2, y] END, [x + u, y], CASE WHEN mask & 2 > 0 THEN [x + u, y + u // 2] END,
    [x + u, y + u], CASE WHEN mask & 4 > 0 THEN [x + u // 2, y + u] END, [x, y + u], CASE WHEN mask & 8 > 0 THEN [x, y + u // 2] END], lambda n: n IS NOT NULL) AS r
  FROM (SELECT *, 8 >> d AS u, ix * (8 >> d) AS x, iy * (8 >> d) AS y FROM masked)),
corner AS (SELECT level, r[1] AS a, r[2] AS b, r[3] AS c FROM ring WHERE mask = 0 UNION ALL SELECT level, r[1], r[3], r[4] FROM ring WHERE mask = 0
  UNION ALL SELECT level, mid, r[i], r[i % len(r) + 1] FROM ring, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i) WHERE mask > 0),
spot AS (SELECT DISTINCT level, unnest([a, b, c]) AS n FROM corner),
mn AS (SELECT level, n, row_number() OVER (PARTITION BY level ORDER BY n[1], n[2]) - 1 AS node, x0 + n[1] * 0.125e0 AS x, y0 + n[2] * 0.125e0 AS y FROM spot JOIN box USING (level)),
mt AS (SELECT t.level, row_number() OVER (PARTITION BY t.level ORDER BY p.node, q.node, r.node) - 1 AS tri, p.node AS a, q.node AS b, r.node AS c FROM corner t
  JOIN mn p ON p.level = t.level AND p.n = t.a JOIN mn q ON q.level = t.level AND q.n = t.b JOIN mn r ON r.level = t.level AND r.n = t.c),
me AS (SELECT level, least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS sides, min(p) AS head
  FROM (SELECT level, a AS p, b AS q FROM mt UNION ALL SELECT level, b, c FROM mt UNION ALL SELECT level, c, a FROM mt) GROUP BY ALL),
mo AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY atan2(y - cy, x - cx), node) - 1 AS seq
  FROM (SELECT m.*, avg(m.x) OVER l AS cx, avg(m.y) OVER l AS cy FROM me JOIN mn m ON m.level = me.level AND m.node = me.head WHERE sides = 1 WINDOW l AS (PARTITION BY m.level)))"""


def _graded(spark, d):
    """Nodes, triangles and outline over the boxes of the lattice levels."""
    points, spec = _refine(spark, d)
    levels = spec.select("level", F.col("x_u").alias("x_lo"), F.col("x_b").alias("x_hi"), "y_lo", "y_hi", F.lit(1.0).alias("size"))
    corners = F.posexplode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x_lo", "y_lo"), ("x_hi", "y_lo"), ("x_hi", "y_hi"), ("x_lo", "y_hi"))]))
    hull = levels.select("level", corners.alias("seq", "p")).select("level", "seq", "p.*")
    return M.graded_mesh(levels, points, hull, "level", 1.0, 0.25, 0.5)


@query("lookup_nodes", f"WITH {_MESH} SELECT level, node, round(x, 6) AS x, round(y, 6) AS y FROM mn")
def _mesh_nodes(spark, d):
    return rounded(_graded(spark, d)[0], 6)


@query("lookup_triangles", f"WITH {_MESH} SELECT level, tri, a, b, c FROM mt")
def _mesh_triangles(spark, d):
    return _graded(spark, d)[1]


@query("mesh_edges", f"""WITH {_MESH}, ar AS (SELECT level, count(*) AS triangles, sum((b[1] - a[1]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[1] - a[1])) / 128e0 AS area FROM corner GROUP BY level),
nn AS (SELECT level, count(*) AS nodes FROM mn GROUP BY level), ee AS (SELECT level, count(*) AS edges, count(*) FILTER (sides = 1) AS border FROM me GROUP BY level)
SELECT level, nodes, triangles, edges, border, round(area, 6) AS area FROM ar JOIN nn USING (level) JOIN ee USING (level)
WHERE area = (SELECT nx * ny FROM box WHERE box.level = ar.level)""")
def _mesh_edges(spark, d):
    """Nodes, edges and triangles per level, and the area of all triangles: that of the box."""
    nodes, tris, _ = _graded(spark, d)
    at = lambda c: nodes.select("level", F.col("node").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"))
    spread = tris.join(at("a"), ["level", "a"]).join(at("b"), ["level", "b"]).join(at("c"), ["level", "c"])
    area = F.expr("((xb - xa) * (yc - ya) - (yb - ya) * (xc - xa)) / 2")
    tri = spread.groupBy("level").agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum(area), 6).alias("area"))
    edge = M.mesh_edges(tris, "level").groupBy("level").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("sides") == 1, 1)).alias("border"))
    return tri.join(edge, "level").join(nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes")), "level")


_TEXT = f"""WITH {_MESH}, lv AS (SELECT DISTINCT level FROM mn), ln AS (
  SELECT 0 AS part, -1 AS lv, 0 AS seq, i AS ord, t AS value FROM (SELECT generate_subscripts(f, 1) - 1 AS i, unnest(f) AS t FROM (SELECT ['Dragon library', '', '<Header>', '', '[Version]', '1.1.0', '',
    '[Progress variable definition]', '-5.0000e-01 * H2++1.0000e+00 * O2', '', '[Number of table levels]'] AS f))
  UNION ALL SELECT 1, -1, 0, 0, count(*)::VARCHAR FROM lv
  UNION ALL SELECT p, -1, 0, i, t FROM (SELECT p, generate_subscripts(f, 1) - 1 AS i, unnest(f) AS t FROM (VALUES (2, ['', '[Table levels]']), (4, ['', '[Number of points]']), (6, ['', '[Number of triangles]']),
    (8, ['', '[Number of hull points]']), (10, ['', '[Number of variables]', '3', '', '[Variable names]', '1:x', '2:y', '3:v', '', '</Header>', '', '<Data>']), (12, ['</Data>', '', '<Connectivity>']),
    (14, ['</Connectivity>', '', '<Hull>']), (16, ['</Hull>', ''])) v(p, f))
  UNION ALL SELECT 3, level, 0, 0, printf('%+.16e', level * 0.01e0) FROM lv
  UNION ALL SELECT 5, level, 0, 0, count(*)::VARCHAR FROM mn GROUP BY level
  UNION ALL SELECT 7, level, 0, 0, count(*)::VARCHAR FROM mt GROUP BY level
  UNION ALL SELECT 9, level, 0, 0, count(*)::VARCHAR FROM mo GROUP BY level
  UNION ALL SELECT p, level, s, 0, t FROM lv, (VALUES (11), (13), (15)) v(p), (VALUES (0, '<Level>'), (2, '</Level>')) u(s, t)
  UNION ALL SELECT 11, level, 1, node, printf('%+.14e\t%+.14e\t%+.14e', x, y, x * 10 + y) FROM mn
  UNION ALL SELECT 13, level, 1, tri, (a + 1) || '\t' || (b + 1) || '\t' || (c + 1) FROM mt
  UNION ALL SELECT 15, level, 1, seq, (node + 1)::VARCHAR FROM mo)
SELECT part, CAST(lv AS BIGINT) AS lv, seq, CAST(ord AS BIGINT) AS ord, value FROM ln"""


def _mesh_text(spark, d):
    nodes, tris, rim = _graded(spark, d)
    nodes = nodes.withColumn("v", F.col("x") * 10 + F.col("y"))
    levels = nodes.select("level").distinct().withColumn("level_value", F.col("level") * F.lit(0.01))
    return level_table_text(nodes, tris, rim, levels, ["x", "y", "v"], {"H2": -0.5, "O2": 1.0})


@query("level_table_text", _TEXT)
def _table_text(spark, d):
    """Every line of the text form, all sections, in its place."""
    return _mesh_text(spark, d)


@query("read_level_text", f"WITH {_MESH} SELECT 'node' AS what, level, node AS id, round(x, 6) AS a, round(y, 6) AS b, round(x * 10 + y, 6) AS c FROM mn "
       "UNION ALL SELECT 'triangle', level, tri, a * 1e0, b * 1e0, c * 1e0 FROM mt UNION ALL SELECT 'outline', level, seq, node * 1e0, NULL, NULL FROM mo")
def _read_text(spark, d):
    """The text form written to part files and read back."""
    path = f"{checkpoint_dir(spark)}/levels-{uuid.uuid4().hex}"
    write_level_text(_mesh_text(spark, d), path, 20_000)
    got = read_level_text(spark, path)
    own = F.row_number().over(Window.orderBy("level")) - 1  # one row per level
    names = _lattice(spark, d).select("level").distinct().select(own.cast("int").alias("at"), F.col("level").alias("name"))
    kinds = (("node", got.nodes, "node", got.variables), ("triangle", got.triangles, "tri", "abc"), ("outline", got.hull, "seq", ["node"]))
    rows = [df.select(F.lit(what).alias("what"), "level", F.col(i).alias("id"), *[F.round(F.col(c).cast("double"), 6).alias(out) for c, out in zip(cols, "abc")])
            for what, df, i, cols in kinds]
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2], allowMissingColumns=True)
    return rows.join(names, rows["level"] == names["at"]).select("what", names["name"].alias("level"), "id", "a", "b", "c")


@query("level_averages", f"""WITH {_MESH}, n AS (SELECT level, count(*) AS n FROM mn GROUP BY level), t AS (SELECT level, count(*) AS n FROM mt GROUP BY level), o AS (SELECT level, count(*) AS n FROM mo GROUP BY level)
SELECT CAST(floor(avg(n.n)) AS BIGINT) AS nodes, CAST(floor(avg(t.n)) AS BIGINT) AS triangles, CAST(floor(avg(o.n)) AS BIGINT) AS hull_points FROM n JOIN t USING (level) JOIN o USING (level)""")
def _averages(spark, d):
    return G.level_averages(G.level_counts(*_graded(spark, d), "level"))


_U = "(((p_partkey * 31 + s) * 2654435761) % 4294967296) / 4294967296e0"


@query("jitter", f"""WITH {PT}, r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt),
m AS (SELECT p_partkey, CAST(s AS INTEGER) AS sample, x, y, {_U} * 0.05e0 AS rad, (((p_partkey * 17 + s) * 2246822519) % 4294967296) / 4294967296e0 * {2 * math.pi!r} AS a FROM pt, range(4) t(s))
SELECT p_partkey, sample, round(greatest(x0, least(x1, x + rad * cos(a) * (x1 - x0))), 9) AS x_jitter, round(greatest(y0, least(y1, y + rad * sin(a) * (y1 - y0))), 9) AS y_jitter FROM m, r""")
def _jitter(spark, d):
    u = [F.expr("((p_partkey * 31 + sample) * 2654435761) % 4294967296 / 4294967296e0"),
         F.expr("((p_partkey * 17 + sample) * 2246822519) % 4294967296 / 4294967296e0")]
    got = G.jitter(part_points(spark, d).select("p_partkey", "x", "y"), "x", "y", 4, u)
    return rounded(got.select("p_partkey", "sample", "x_jitter", "y_jitter"), 9)
