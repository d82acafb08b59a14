"""Exact k-nearest-neighbour join and inverse-distance interpolation of scattered points.

Spark has no spatial join, and pairing every query with every point (or with everything in its grid cell) is
quadratic where points cluster. Here the points are kept as an index that any number of joins can use:

* the points are sorted along a Hilbert curve and cut into leaves of equal count, one row per leaf with its box
  and its points as lists, so a leaf is small where points are dense and no leaf is crowded;
* every 64 leaves in a row form a node, every 64 nodes one of the next level, up to one root per partition.

The queries of a join are sorted and cut in the same way, so the queries of one group lie close together. A
join goes down the levels without looking at points: a node stays with a group if it may hold one of the k
nearest of any of its queries, judged by the least of the largest box distances of nodes with k points. What
the k-th nearest point really is at most is then taken from the leaf that suits the group best, which leaves
few leaves to be met. A group meets its leaves one after another, nearest first, and keeps the k best of each
query, so memory stays bounded whatever the number of leaves.

Points with equal coordinates are reduced to ``k`` beforehand, since no query can need more of them, and
queries with equal coordinates are answered once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut_lineage

LEAF = 256  # points of a leaf
GROUP = 256  # queries that go down together
FAN = 64  # children of a node
ROOTS = 1024  # range partitions of an index at most, so a literal list can hold their boxes
PART_ROWS = 100_000  # points of a partition unless there are more than ROOTS of them
CURVE_BITS = 62  # of a position on the curve, all axes together
_SLACK = 1.0 + 1e-9  # rounding room when comparing distance bounds

TASK_TARGETS = 20_000  # targets that a task compares with all probes
SENT_PLACES = 10_000  # places whose probes are sent to all tasks; of more the targets are brought to them

EXACT_HIT = 1e-10  # below this distance the nearest value is taken as is (fixed value)


@dataclass(frozen=True)
class PointIndex:
    """Reference points prepared for repeated searches."""

    leaves: DataFrame  # part, num, n, box, and every column of the points as a list
    nodes: DataFrame  # level, part, num and the boxes of the children
    roots: tuple[tuple, ...]  # part, n, box
    depth: int
    keys: tuple[str, ...]
    ref_id: str
    k: int
    lo: tuple[float, ...]
    width: tuple[float, ...]
    rows: int


def _box(d: int) -> list[str]:
    return [f"{side}{i}" for side in ("lo", "hi") for i in range(d)]


def _curve(cells, bits: int):
    """Positions on a Hilbert curve of whole coordinates (axes x points) below 2^bits."""
    import numpy as np

    x = [c.copy() for c in cells]
    zero = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):  # from the largest quadrant down: turn or mirror what lies in it
        low = (1 << b) - 1
        for c in x:
            inside = (c >> b) & 1 == 1
            swap = np.where(inside, zero, (x[0] ^ c) & low)
            x[0] ^= np.where(inside, low, swap)
            if c is not x[0]:
                c ^= swap
    for a, b in zip(x, x[1:]):
        b ^= a
    turn = zero.copy()
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = zero.copy()
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | ((c ^ turn) >> b) & 1
    return out


def _packed(df: DataFrame, keys: Sequence[str], lo: Sequence[float], width: Sequence[float], size: int, parts: int | None) -> DataFrame:
    """Rows along the curve in lists of ``size``: ``part, num, n``, the box, and every column as a list."""
    d, names = len(keys), df.columns
    bits = min(CURVE_BITS // d, 26)
    at = [names.index(c) for c in keys]

    @F.pandas_udf("long")
    def position(*axes: pd.Series) -> pd.Series:
        import numpy as np

        top = float(1 << bits)
        cells = [np.clip((a.to_numpy() - lo[i]) / width[i] * top, 0, top - 1).astype(np.int64) for i, a in enumerate(axes)]
        return pd.Series(_curve(cells, bits))

    rows = df.withColumn("_at", position(*keys))
    rows = rows.repartitionByRange(parts, "_at") if parts else rows.repartitionByRange("_at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, num = TaskContext.get().partitionId(), 0

        def lists(t: pa.Table) -> pa.RecordBatch:
            nonlocal num
            t = t.combine_chunks()
            offsets = np.append(np.arange(0, t.num_rows, size), t.num_rows).astype(np.int32)
            axes = [t.column(i).to_numpy() for i in at]
            count = len(offsets) - 1
            cols = [pa.array(np.full(count, part), pa.int32()), pa.array(num + np.arange(count), pa.int64()), pa.array(np.diff(offsets), pa.int32())]
            cols += [pa.array(f.reduceat(a, offsets[:-1])) for f in (np.minimum, np.maximum) for a in axes]
            for c in t.columns:
                chunk = c.chunk(0) if c.num_chunks else pa.array([], c.type)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), chunk))
            num += count
            return pa.RecordBatch.from_arrays(cols, ["part", "num", "n", *_box(d), *names])

        held = None
        for b in batches:
            t = pa.Table.from_batches([b]).select(names)
            held = t if held is None else pa.concat_tables([held, t])
            full = held.num_rows - held.num_rows % size
            if full:
                yield lists(held.slice(0, full))
                held = held.slice(full)
        if held is not None and held.num_rows:
            yield lists(held)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(["part int, num long, n int", *[f"{c} double" for c in _box(d)], *[f"`{c}` array<{types[c]}>" for c in names]])
    return rows.sortWithinPartitions("_at").mapInArrow(pack, schema)


def _finite(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.abs(F.col(c)) < F.lit(float("inf")) for c in keys]))


def build_index(refs: DataFrame, keys: Sequence[str], ref_id: str, k: int, leaf: int | None = None) -> PointIndex:
    """Sort, cut and store the points once; points with a null or non-finite coordinate take no part."""
    d = len(keys)
    refs = _finite(refs.withColumns({c: F.col(c).cast("double") for c in keys}), keys)
    w = Window.partitionBy(*keys).orderBy(ref_id)
    points = cut_lineage(refs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn"))
    box = points.agg(F.count(F.lit(1)), *[a for c in keys for a in (F.min(c), F.max(c))]).first()
    if not box[0]:
        return PointIndex(points, points, (), 0, tuple(keys), ref_id, k, (0.0,) * d, (1.0,) * d, 0)
    lo, hi = [box[1 + 2 * i] for i in range(d)], [box[2 + 2 * i] for i in range(d)]
    width = [(h - a) * (1 + 1e-9) if h > a else 1.0 for a, h in zip(lo, hi)]
    parts = min(-(-box[0] // PART_ROWS), ROOTS)
    leaves = cut_lineage(_packed(points, keys, lo, width, leaf or max(LEAF, 2 * k), parts))
    ends = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(d)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(d)]
    below = leaves.select("part", "num", "n", *_box(d))
    roots = below.groupBy("part").agg(F.sum("n").alias("n"), *ends, F.count(F.lit(1)).alias("held")).collect()
    depth, most = 1, max(r["held"] for r in roots)
    while FAN ** depth < most:
        depth += 1
    levels = []
    for level in range(1, depth + 1):
        kid = F.struct("num", F.col("n").cast("long").alias("n"), *_box(d))
        below = (below.withColumn("up", F.expr(f"num div {FAN}")).groupBy("part", "up")
                 .agg(F.sum("n").alias("n"), *ends, F.collect_list(kid).alias("kids")).withColumnRenamed("up", "num"))
        levels.append(below.select(F.lit(level).alias("level"), "part", "num", "kids"))
    nodes = cut_lineage(reduce(lambda a, b: a.unionByName(b), levels))
    tops = tuple((r["part"], int(r["n"]), *[float(r[c]) for c in _box(d)]) for r in roots)
    return PointIndex(leaves, nodes, tops, depth, tuple(keys), ref_id, k, tuple(lo), tuple(width), box[0])


def _judged(rows: DataFrame, index: PointIndex, whole: bool) -> DataFrame:
    """Of the boxes ``kids`` that a group has come to, those that may hold one of the k nearest of its queries.

    ``bound`` is the square of what the k-th nearest is at most away; ``whole`` says that a group is one row.
    """
    d = len(index.keys)

    def gaps(kid: Column, far: bool) -> Column:
        total = None
        for i in range(d):
            ahead, behind = kid[f"lo{i}"] - F.col(f"ghi{i}"), F.col(f"glo{i}") - kid[f"hi{i}"]
            gap = (F.greatest(kid[f"hi{i}"] - F.col(f"glo{i}"), F.col(f"ghi{i}") - kid[f"lo{i}"]) if far
                   else F.greatest(F.lit(0.0), ahead, behind))
            total = gap * gap if total is None else total + gap * gap
        return total

    rows = rows.withColumn("kids", F.transform("kids", lambda kid: F.struct(
        kid["part"].alias("part"), kid["num"].alias("num"), kid["n"].alias("n"), gaps(kid, False).alias("near"), gaps(kid, True).alias("far"))))
    own = F.array_min(F.transform(F.filter("kids", lambda kid: kid["n"] >= index.k), lambda kid: kid["far"]))
    if not whole:
        own = F.min(own).over(Window.partitionBy("gpart", "gnum"))
    rows = rows.withColumn("bound", F.least("bound", own))
    fits = F.filter("kids", lambda kid: F.col("bound").isNull() | (kid["near"] <= F.col("bound") * F.lit(_SLACK) + F.lit(1e-300)))
    return rows.withColumn("kid", F.explode(fits)).drop("kids")


def _candidates(groups: DataFrame, index: PointIndex) -> DataFrame:
    """Pairs of a group and a leaf that may matter to it: ``gpart, gnum, part, num, n, near, far`` (squares)."""
    d = len(index.keys)
    own = [f"g{c}" for c in _box(d)]
    rows = groups.select(F.col("part").alias("gpart"), F.col("num").alias("gnum"), *[F.col(c).alias(f"g{c}") for c in _box(d)])
    tops = [F.struct(F.lit(r[0]).alias("part"), F.lit(0).cast("long").alias("num"), F.lit(r[1]).cast("long").alias("n"),
                     *[F.lit(v).alias(c) for c, v in zip(_box(d), r[2:])]) for r in index.roots]
    rows = _judged(rows.withColumns({"kids": F.array(*tops), "bound": F.lit(None).cast("double")}), index, True)
    for level in range(index.depth, 0, -1):
        node = index.nodes.where(F.col("level") == level).select("part", "num", "kids")
        node = node.withColumn("kids", F.transform("kids", lambda kid: F.struct(F.col("part").alias("part"), *[kid[c].alias(c) for c in ["num", "n", *_box(d)]])))
        rows = rows.select("gpart", "gnum", *own, "bound", "kid.part", "kid.num").join(node, ["part", "num"]).drop("part", "num")
        rows = _judged(rows, index, False)
    return rows.select("gpart", "gnum", "kid.*")


def _hits(axes, points, reach, k: int):
    """Pairs of a query and a point of one leaf within ``reach`` of the query, and their distances.

    No query needs more of a leaf than its own k nearest there (and ties), however many lie within its reach.
    """
    import numpy as np

    total = None
    for i in range(axes.shape[1]):
        diff = axes[:, i][:, None] - points[:, i][None, :]
        total = diff * diff if total is None else total + diff * diff
    limit = reach ** 2 * _SLACK + 1e-300
    near = total <= limit[:, None]
    many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * k) if len(points) > 2 * k else []
    if len(many):
        some = total[many]
        near[many] = some <= (np.partition(some, k - 1, axis=1)[:, k - 1] * _SLACK + 1e-300)[:, None]
    q, p = np.nonzero(near)
    return q, p, np.sqrt(total[q, p])


def _met(groups: DataFrame, pairs: DataFrame, index: PointIndex, names: Sequence[str], radius: bool) -> DataFrame:
    """Every group meets its leaves in turn, nearest first: the k best of each query, or how far they reach at most."""
    keys, k, d = list(index.keys), index.k, len(index.keys)
    cols = [*keys, *names]
    types = {f.name: f.dataType.elementType.simpleString() for f in index.leaves.schema.fields if f.name in cols}
    met = pairs.join(index.leaves.select("part", "num", *cols), ["part", "num"]).select("gpart", "gnum", "near", *cols)
    asked = groups.select(F.col("part").alias("gpart"), F.col("num").alias("gnum"), F.lit(-1.0).alias("near"), *keys,
                          *[F.lit(None).cast(f"array<{types[c]}>").alias(c) for c in names])
    rows = met.unionByName(asked).repartition("gpart", "gnum").sortWithinPartitions("gpart", "gnum", "near")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        group = None
        for b in batches:
            parts, nums, near = (b.column(i).to_pylist() for i in range(3))
            for i in range(b.num_rows):
                lists = [b.column(3 + j)[i].values for j in range(len(cols))]
                if near[i] < 0:
                    if group is not None:
                        yield from given(group)
                    axes = np.stack([x.to_numpy(zero_copy_only=False) for x in lists[:d]], axis=1)
                    group = [(parts[i], nums[i]), axes, np.full(len(axes), np.inf), np.zeros(0, np.int64), np.zeros(0), None]
                elif near[i] <= float(group[2].max()) ** 2 * _SLACK + 1e-300:
                    meet(group, np.stack([x.to_numpy(zero_copy_only=False) for x in lists[:d]], axis=1), pa.table(lists[d:], list(names)))
        if group is not None:
            yield from given(group)

    def meet(group, points, table) -> None:
        import numpy as np
        import pyarrow.compute as pc

        _, axes, reach, of, dist, best = group
        gap = np.maximum(0.0, np.maximum(points.min(axis=0) - axes, axes - points.max(axis=0)))
        open_ = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= reach * _SLACK + 1e-150)
        if not len(open_):
            return
        q, p, fresh = _hits(axes[open_], points, reach[open_], k)
        of, dist = np.concatenate([of, open_[q]]), np.concatenate([dist, fresh])
        picked = table.take(pa.array(p))
        best = picked if best is None else pa.concat_tables([best, picked])
        ids = best.column(0)
        order = (np.lexsort((ids.to_numpy(), dist, of)) if pa.types.is_integer(ids.type) and not ids.null_count else
                 pc.sort_indices(pa.table({"of": of, "dist": dist, "id": ids.combine_chunks()}), [("of", "ascending"), ("dist", "ascending"), ("id", "ascending")]).to_numpy())
        sorted_of = of[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_of, sorted_of)
        order = order[rank < k]
        of, dist = of[order], dist[order]
        full = np.flatnonzero(np.bincount(of, minlength=len(axes)) >= k)
        reach[full] = dist[np.searchsorted(of, full, side="right") - 1]
        group[3:] = [of, dist, best.take(pa.array(order)).combine_chunks()]

    def given(group) -> Iterator[pa.RecordBatch]:
        import numpy as np

        (part, num), axes, reach, of, dist, best = group
        if radius:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([num], pa.int64()), pa.array([float(reach.max())])], ["gpart", "gnum", "reach"])
        elif best is not None:
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][:len(of)])
            ends = pa.array(np.append(starts, len(of)), pa.int32())
            lists = [pa.array(dist), *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in best.columns]]
            yield pa.RecordBatch.from_arrays([*[pa.array(axes[of[starts], i]) for i in range(d)], *[pa.ListArray.from_arrays(ends, v) for v in lists]],
                                             [*keys, "distance", *names])

    if radius:
        return rows.mapInArrow(walk, "gpart int, gnum long, reach double")
    schema = ", ".join([*[f"`{c}` double" for c in keys], "distance array<double>", *[f"`{c}` array<{types[c]}>" for c in names]])
    return rows.mapInArrow(walk, schema)


def _neighbours(queries: DataFrame, index: PointIndex, names: Sequence[str]) -> DataFrame:
    """A row per distinct query coordinate with neighbours: the keys, ``distance`` and ``names`` as lists, nearest first."""
    keys = list(index.keys)
    points = _finite(queries.select(*[F.col(c).cast("double").alias(c) for c in keys]), keys).distinct()
    if not index.rows:
        kinds = dict(index.leaves.dtypes)
        fields = [*[f"`{c}` double" for c in keys], "distance array<double>", *[f"`{c}` array<{kinds[c]}>" for c in names]]
        return queries.sparkSession.createDataFrame([], ", ".join(fields))
    groups = cut_lineage(_packed(points, keys, index.lo, index.width, GROUP, None))
    pairs = cut_lineage(_candidates(groups, index))
    own = pairs.where(F.col("n") >= index.k).groupBy("gpart", "gnum").agg(F.min_by(F.struct("part", "num", "near"), "far").alias("leaf"))
    reach = _met(groups, own.select("gpart", "gnum", "leaf.*"), index, [index.ref_id], True)
    pairs = pairs.join(reach, ["gpart", "gnum"], "left").where(
        F.col("reach").isNull() | (F.col("near") <= F.col("reach") * F.col("reach") * F.lit(_SLACK) + F.lit(1e-300)))
    return _met(groups, pairs.select("gpart", "gnum", "part", "num", "near"), index, names, False)


def knn_join(queries: DataFrame, index: PointIndex, out: str = "neighbour",
             carry: Sequence[str] = ()) -> DataFrame:
    """The k nearest points of each distinct query coordinate.

    Returns the key columns, ``rank`` (1-based), ``distance``, the id and the carried columns of the
    point. Ties are broken by the point id. Join it back to the queries on the key columns. Queries with a
    null or non-finite coordinate have no neighbours.
    """
    keys, names = list(index.keys), list(dict.fromkeys([index.ref_id, *carry]))
    near = _neighbours(queries, index, names)
    near = near.select(*keys, F.posexplode(F.arrays_zip("distance", *names)).alias("_pos", "_one"))
    return near.select(*keys, "_one.distance", F.col("_one")[index.ref_id].alias(out), *[F.col("_one")[c].alias(c) for c in carry],
                       (F.col("_pos") + 1).alias("rank"))


def idw_join(queries: DataFrame, refs: DataFrame | PointIndex, keys: Sequence[str], values: Sequence[str],
             ref_id: str | None = None, k: int = 3, p: float = 2, weight: str | None = None) -> DataFrame:
    """Inverse-distance interpolation of ``values`` at the queries.

    The nearest value is used for k = 1 and for an exact hit. ``weight`` names an optional column of
    per-point weights.
    """
    index = refs if isinstance(refs, PointIndex) else build_index(refs, keys, ref_id, k)
    carry = [*values, *([weight] if weight else [])]
    near = _neighbours(queries, index, list(dict.fromkeys([index.ref_id, *carry])))
    near = near.select(*keys, F.arrays_zip("distance", *dict.fromkeys(carry)).alias("_near"))

    def inverse(q: Column) -> Column:
        inv = F.lit(1.0) / F.pow(q["distance"], F.lit(float(p)))
        return F.when(q["distance"] > 0, inv * q[weight] if weight else inv)

    def total(term: Callable[[Column], Column]) -> Column:
        """The sum of a term over the neighbours; like ``sum``, nulls don't count and of nulls alone it is null."""
        return F.aggregate("_near", F.lit(None).cast("double"), lambda have, q: F.coalesce(have + term(q), term(q), have))

    hit = (F.col("_near")[0]["distance"] < EXACT_HIT) | F.lit(index.k == 1)
    got = near.select(*keys, *[
        F.when(hit, F.col("_near")[0][v]).otherwise(F.try_divide(total(lambda q, v=v: inverse(q) * q[v]), total(inverse)))
        .alias(v) for v in values])
    return queries.join(got, list(keys))


def idw_tune(test: DataFrame, train: DataFrame, keys: Sequence[str], target: str | Sequence[str], ref_id: str,
             k_max: int, powers: Sequence[int]) -> DataFrame:
    """Mean squared error for every neighbour count up to ``k_max`` and every distance power.

    One join at ``k_max`` serves all combinations: sums over the first k ranks are prefix sums. Of several
    target columns (scaled alike by the caller) the errors are averaged.
    """
    targets = [target] if isinstance(target, str) else list(target)
    vs = [f"_v{i}" for i in range(len(targets))]
    index = build_index(train.select(ref_id, *keys, *[F.col(t).alias(v) for t, v in zip(targets, vs)]), keys, ref_id, k_max)
    near = knn_join(test, index, "_ref", vs)
    near = near.withColumn("p", F.explode(F.array(*[F.lit(int(p)) for p in powers])))
    near = near.withColumn("_w", F.when(F.col("distance") > 0, F.lit(1.0) / F.pow(F.col("distance"), F.col("p"))))
    prefix = Window.partitionBy(*keys, "p").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    first_d = F.first("distance").over(prefix)

    def pred(v: str) -> Column:
        blend = F.try_divide(F.sum(F.col("_w") * F.col(v)).over(prefix), F.sum("_w").over(prefix))
        return F.when((first_d < EXACT_HIT) | (F.col("rank") == 1), F.first(v).over(prefix)).otherwise(blend)

    near = near.select(*keys, F.col("rank").alias("k"), "p", *[pred(v).alias(v) for v in vs])
    # equal coordinates may carry different targets
    scored = test.select(*keys, *[F.col(t).alias(f"_t{i}") for i, t in enumerate(targets)]).join(near, list(keys))
    errors = [F.avg((F.col(v) - F.col(f"_t{i}")) * (F.col(v) - F.col(f"_t{i}"))) for i, v in enumerate(vs)]
    return scored.groupBy("k", "p").agg((reduce(lambda a, b: a + b, errors) / len(errors)).alias("mse"))


def best_parameters(tuned: DataFrame) -> DataFrame:
    """The combination of least error; the smallest k, then the smallest p, wins ties."""
    return tuned.orderBy("mse", "k", "p").limit(1)


def inverse_lookup(queries: DataFrame, index: PointIndex, moving: str, target: str, value: str, start: float | None = None,
                   p: float = 2, tol: float = 1e-2, probes: int = 64, parts: int = 8) -> DataFrame:
    """The place on the axis ``moving`` at which the interpolated ``value`` meets the query's ``target``.

    Queries hold the other keys of the index and ``target``. First the values at ``probes + 1`` even places over
    the extent of the points, and at ``start``, are interpolated, once for all targets of equal keys. The one
    within ``tol`` of the target, or the two neighbouring places with the target between their values, nearest
    to ``start`` (default: the lowest) are taken. Then every bracket that is still open is cut, all in one join
    a round, at ``parts - 1`` even places and where the secant meets the target, so a bracket shrinks to a
    ``parts``-th or less and the number of rounds is bounded.

    Adds ``moving``, ``value``, ``status`` and ``rounds``. Interpolation by nearest points jumps where the set
    of points changes, so a row need not have a solution: ``converged`` is within ``tol``; ``jump`` is a bracket
    cut down to a billionth of the extent, the values on both sides farther than ``tol`` from the target;
    ``outside`` are targets that no two neighbouring places have between them, and rows with a null in a key or target.
    """
    others = [c for c in index.keys if c != moving]
    at = index.keys.index(moving)
    lo, extent = index.lo[at], index.width[at]
    start = lo if start is None else float(start)
    need = queries.select(*others, target).distinct()
    row = [*others, target]

    def interpolated(rows: DataFrame) -> DataFrame:
        return idw_join(rows, index, list(index.keys), [value], k=index.k, p=p)

    def judged(rows: DataFrame, number: int) -> DataFrame:
        """``_at``: places and values in order. Where the target is met, or the next bracket."""
        rows = rows.withColumn("_at", F.array_sort(F.transform("_at", lambda q: F.struct(
            q[moving].alias("h"), q[value].alias("v"), (q[value] - F.col(target)).alias("e")))))
        away = lambda h: F.abs(h - F.lit(start))
        met = F.transform(F.filter("_at", lambda q: F.abs(q["e"]) <= tol), lambda q: F.struct(away(q["h"]).alias("d"), q["h"].alias("h"), q["v"].alias("v")))
        pair = F.zip_with(F.slice("_at", 1, F.size("_at") - 1), F.slice("_at", 2, F.size("_at")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        cross = F.filter(pair, lambda q: q["a"]["e"] * q["b"]["e"] < 0)
        next_ = F.transform(cross, lambda q: F.struct(away((q["a"]["h"] + q["b"]["h"]) / 2).alias("d"), q["a"].alias("a"), q["b"].alias("b")))
        rows = rows.withColumns({"_met": F.array_min(met), "_next": F.array_min(next_)})
        status = (F.when(F.col("_met").isNotNull(), "converged").when(F.col("_next").isNull(), "outside")
                  .when(F.col("_next.b.h") - F.col("_next.a.h") <= F.lit(extent * 1e-9), "jump"))
        return rows.select(*row, F.coalesce("_met.h", "_next.a.h").alias(moving), F.coalesce("_met.v", "_next.a.v").alias(value), status.alias("status"),
                           F.lit(number).alias("rounds"), F.col("_next.a").alias("_a"), F.col("_next.b").alias("_b"))

    ladder = F.explode(F.array_distinct(F.array(*[F.lit(lo + extent * j / probes) for j in range(probes + 1)], F.lit(start))))
    places = need.select(*others).distinct() if others else need.limit(1)
    first = interpolated(places.select(*others, ladder.alias(moving))).groupBy(*others).agg(F.collect_list(F.struct(moving, value)).alias("_at"))
    # many targets can share few places, so they are dealt out by themselves and not by place
    need = need.repartition(max(1, -(-need.count() // TASK_TARGETS)), *row)
    if others and places.count() <= SENT_PLACES:
        first = F.broadcast(first)
    state = need.join(first, others) if others else need.withColumn("_at", first.scalar())
    state, number = cut_lineage(judged(state, 0)), 0
    done = [state.where("status IS NOT NULL")]
    while not (open_ := state.where("status IS NULL")).isEmpty():
        number += 1
        a, b = F.col("_a"), F.col("_b")
        cuts = [a["h"] + (b["h"] - a["h"]) * F.lit(j / parts) for j in range(1, parts)]
        cuts.append(a["h"] - a["e"] * ((b["h"] - a["h"]) / (b["e"] - a["e"])))
        asked = open_.select(*row, F.explode(F.array_distinct(F.array(*cuts))).alias(moving))
        got = interpolated(asked).groupBy(*row).agg(F.collect_list(F.struct(moving, value)).alias("_in"))
        ends = F.array(*[F.struct(e["h"].alias(moving), e["v"].alias(value)) for e in (a, b)])
        state = open_.join(got, row).withColumn("_at", F.concat("_in", ends))
        state = cut_lineage(judged(state, number))
        done.append(state.where("status IS NOT NULL"))
    found = reduce(lambda x, y: x.unionByName(y), done).drop("_a", "_b")
    return queries.join(found, row, "left").withColumns({"status": F.coalesce("status", F.lit("outside")), "rounds": F.coalesce("rounds", F.lit(0))})
