"""Scoring of candidate weight vectors over increment tables, and the searches built on it.

A generation of candidates is scored in one pass: the candidates travel with the task, every Arrow
batch is one matrix product, and each task emits one partial result per candidate. Candidates and
rows are never paired in a table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.knn import _curve
from tessera.runtime import checkpoint_dir, cut_lineage


CHUNK = 256  # rows scored at once: with all candidates they fit in a core's cache
CHUNK_CELLS = 48_000  # rows times candidates scored at once if there are few candidates


class _Fold:
    """Partial scores of all candidates over some rows."""

    def __init__(self, pop: np.ndarray, bound_gene: bool):
        w = pop[:, 1:] if bound_gene else pop
        self.w = (w / np.linalg.norm(w, axis=1, keepdims=True)).T
        self.gene = pop[:, 0] if bound_gene else None
        n = len(pop)
        # worst, bad, low, short
        self.parts = np.stack([np.zeros(n), np.zeros(n), np.full(n, np.inf), np.zeros(n)])

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        worst, bad, low, short = self.parts
        size = max(CHUNK, CHUNK_CELLS // max(1, self.w.shape[1]))
        for start in range(0, len(x), size):
            ys = y[start:start + size, None]
            t = x[start:start + size] @ self.w
            least = t.min(axis=0)
            np.minimum(low, least, out=low)
            if self.gene is not None:
                a = t - ys * self.gene
                short -= np.minimum(a, 0.0, out=a).sum(axis=0)
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                f = np.divide(ys, t, out=t if least.min() > 0 else None)
            top, bottom = f.max(axis=0), f.min(axis=0)
            if not (np.isfinite(top).all() and np.isfinite(bottom).all()):  # increments of zero have no slope
                f = np.where(np.isfinite(f), f, 0.0)
                top, bottom = f.max(axis=0), f.min(axis=0)
            np.maximum(worst, np.maximum(top, -bottom), out=worst)
            if least.min() < 0:
                if ys.min() < 0:
                    f = np.where(t < 0, f, 0.0)
                else:  # the slope has the sign of the increment
                    np.minimum(f, 0.0, out=f)
                bad += np.einsum("ij,ij->j", f, f)

    def add_some(self, x: np.ndarray, y: np.ndarray, some: np.ndarray) -> None:
        """Add the rows for some of the candidates only, given by a mask."""
        if some.all():
            return self.add(x, y)
        part = object.__new__(_Fold)
        part.w, part.gene = self.w[:, some], None if self.gene is None else self.gene[some]
        part.parts = self.parts[:, some]
        part.add(x, y)
        self.parts[:, some] = part.parts

    def merge(self, other: np.ndarray) -> None:
        worst, bad, low, short = self.parts
        np.maximum(worst, other[0], out=worst)
        bad += other[1]
        np.minimum(low, other[2], out=low)
        short += other[3]


def candidate_scores(increments: DataFrame, cols: Sequence[str], y: str,
                     candidates: Sequence[Sequence[float]], bound_gene: bool = False) -> DataFrame:
    """One row per candidate: ``candidate, penalty, worst, violation, lowest``.

    With unit-length weights w and t the weighted increment of a row, the slope is y/t; rows with t = 0
    have none and count only for ``lowest``. ``worst`` is
    the largest |slope|, ``violation`` the sum of squared slopes over rows of negative t, ``penalty``
    their sum, and ``lowest`` the smallest t (positive for a monotonic choice). With ``bound_gene``
    the first entry x0 of a candidate is a lower bound and the penalty is 1/x0 plus the squared sum
    of the shortfalls of t - x0 y.
    """
    pop = np.asarray(candidates, dtype=float)
    names = list(cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, seen = _Fold(pop, bound_gene), False
        for pdf in batches:
            seen = seen or len(pdf) > 0
            fold.add(pdf[names].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float))
        if seen:
            yield pd.DataFrame({"candidate": np.arange(len(pop)), **dict(zip(("worst", "bad", "low", "short"), fold.parts))})

    rows = increments.select(*names, F.col(y).alias("_y")).dropna()
    parts = rows.mapInPandas(partial, "candidate long, worst double, bad double, low double, short double")
    got = parts.groupBy("candidate").agg(F.max("worst").alias("worst"), F.sum("bad").alias("violation"),
                                         F.min("low").alias("lowest"), F.sum("short").alias("_short"))
    if bound_gene:
        x0 = F.element_at(F.array(*[F.lit(float(g)) for g in pop[:, 0]]), (F.col("candidate") + 1).cast("int"))
        penalty = F.lit(1.0) / x0 + F.col("_short") * F.col("_short")
    else:
        penalty = F.col("worst") + F.col("violation")
    return got.select("candidate", penalty.alias("penalty"), "worst", "violation", "lowest")


FEW_TASKS = 256  # partial results that the driver merges itself
BLOCK_ROWS = 1024  # rows of a block at most
TASK_ROWS = 2_000_000  # rows of a task, unless that leaves cores without one
CURVE_AXES = 12  # columns that place a row on the curve; further ones only widen the boxes
CLOSE = 3.0  # a plane nearer to a block's middle than so many times the reach of its box cuts the block
ROUGH = 5e-3  # of the scale: about what rough bounds may leave open
ROUGH_MOST = 0.25  # margin about a plane, of a unit direction; with a wider one, rough bounds save nothing
FINE = 16  # part of the margin within which rows are taken in double precision
_ROOM = 1e-9  # rounding room of bounds


def _head(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What bounds the penalties of a block: whether it is ``odd``, its row count, the mean of u = x/y, the middle and
    half width of the box of u, and the sums of x and y. A block with a row without a direction is odd."""
    with np.errstate(all="ignore"):
        u = x / y[:, None]
    if not (np.isfinite(u).all() and (y > 0).all()):
        return np.concatenate([[1.0, len(x)], np.zeros(4 * x.shape[1] + 1)])
    lo, hi = u.min(axis=0), u.max(axis=0)
    return np.concatenate([[0.0, len(x)], u.mean(axis=0), (lo + hi) / 2, (hi - lo) / 2, x.sum(axis=0), [y.sum()]])


class PackedIncrements:
    """Increments as blocks of numbers, one binary value per block of rows, kept for the rounds of a search.

    Blocks hold rows of like direction: the rows are sorted along a Hilbert curve through their directions. A row's slope
    depends on its direction alone, so the blocks far from a candidate's plane give close bounds of the penalty
    from one line of sums each, and only the few others are gone through row by row (``bounds``). A search asks for
    ``penalties``, which take every row, where bounds leave a decision open.

    A round reads the blocks in place and returns one partial result per task, a few numbers per candidate; of
    more than FEW_TASKS tasks the partial results are merged on the executors first. Under a ``file:`` checkpoint
    folder the blocks lie in files there, one per task, which a round maps into memory: it touches the blocks that it
    goes through and no others are handed to a worker. Other stores keep them in the table.
    """

    def __init__(self, increments: DataFrame, cols: Sequence[str], y: str):
        names = [*cols, "_y"]
        self.width = len(names)
        axes = min(len(cols), CURVE_AXES)
        bits = min(62 // axes, 16)

        def matrix(b: pa.RecordBatch) -> np.ndarray:
            return np.stack([c.to_numpy(zero_copy_only=False).astype("<f8") for c in b.columns[:len(names)]], axis=1)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0
            for b in batches:
                if not b.num_rows:
                    continue
                m = matrix(b)
                with np.errstate(all="ignore"):
                    v = m[:, :-1] / np.linalg.norm(m[:, :-1], axis=1, keepdims=True)
                    usual = np.isfinite(v).all(axis=1) & (m[:, -1] > 0) & np.isfinite(m / m[:, -1:]).all(axis=1)
                cells = np.where(usual[:, None], (v + 1) / 2, 0.0)[:, :axes] * float(1 << bits)
                at = _curve([np.clip(c, 0, (1 << bits) - 1).astype(np.int64) for c in cells.T], bits)
                tie = np.arange(seen, seen + len(m))  # rows of equal direction may go to several tasks
                seen += len(m)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(usual, at, -1)), pa.array(tie)], [*names, "_at", "_tie"])

        size = BLOCK_ROWS
        root = checkpoint_dir(increments.sparkSession)
        folder = f"/{root.removeprefix('file:').lstrip('/')}/search-{uuid.uuid4().hex}" if root.startswith("file:/") else None

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            path, at = folder and f"{folder}/{TaskContext.get().taskAttemptId()}", 0
            for b in batches:
                if b.num_rows:
                    parts = np.array_split(matrix(b), -(-b.num_rows // size))
                    heads = [_head(p[:, :-1], p[:, -1]).tobytes() for p in parts]
                    starts = at + np.cumsum([0, *[len(p) for p in parts]])
                    held = [p.tobytes() for p in parts]
                    if path:
                        os.makedirs(folder, exist_ok=True)
                        with open(path, "ab" if at else "wb") as out:
                            out.writelines(held)
                        at, held = int(starts[-1]), [None] * len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(held, pa.binary()), pa.array([path] * len(parts), pa.string()),
                                                      pa.array(starts[:-1])], ["head", "block", "path", "start"])

        rows = increments.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("_y")).dropna()
        schema = ", ".join([*[f"`{c}` double" for c in names], "_at long, _tie long"])
        rows = cut_lineage(rows.mapInArrow(place, schema))
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.rows = rows.count()
        tasks = cores * max(1, -(-self.rows // (cores * TASK_ROWS)))
        rows = rows.repartitionByRange(tasks, "_at", "_tie").sortWithinPartitions("_at").select(*names)
        self.blocks = cut_lineage(rows.mapInArrow(pack, "head binary, block binary, path string, start long")).persist()
        self.tasks = self.blocks.select(F.spark_partition_id().alias("task")).distinct().count()  # also fills the cache

    def _folded(self, pop: np.ndarray, bound_gene: bool, add: Callable[[_Fold, np.ndarray, list[np.ndarray]], None]) -> _Fold | None:
        """What ``add`` makes of the blocks, merged; it is given a fold, the heads and the blocks of a batch."""
        width = self.width

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold, seen = _Fold(pop, bound_gene), False
            for b in batches:
                if b.num_rows:
                    heads = np.stack([np.frombuffer(h.as_buffer(), "<f8") for h in b.column(0)])
                    if b.column(2).null_count:
                        blocks = [np.frombuffer(r.as_buffer(), "<f8").reshape(-1, width) for r in b.column(1)]
                    else:
                        files = {f: np.memmap(f, "<f8", "r").view(np.ndarray).reshape(-1, width) for f in b.column(2).unique().to_pylist()}
                        blocks = [files[f][a:a + int(n)] for f, a, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), heads[:, 1])]
                    add(fold, heads, blocks)
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([fold.parts.tobytes()], pa.binary())], ["part"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold, seen = _Fold(pop, bound_gene), False
            for b in batches:
                for part in b.column(0):
                    fold.merge(np.frombuffer(part.as_buffer()).reshape(4, -1))
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([fold.parts.tobytes()], pa.binary())], ["part"])

        parts = self.blocks.mapInArrow(partial, "part binary")
        if self.tasks > FEW_TASKS:
            parts = parts.repartition(FEW_TASKS).mapInArrow(merge, "part binary")
        whole = _Fold(pop, bound_gene)
        found = parts.collect()
        for r in found:  # one row per task, FEW_TASKS at most
            whole.merge(np.frombuffer(bytes(r["part"])).reshape(4, -1))
        return whole if found else None

    def bounds(self, pop: np.ndarray, bound_gene: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """What the penalty of every candidate is at least and at most."""
        pop = np.asarray(pop, dtype=float)
        n = len(pop)

        def add(fold: _Fold, heads: np.ndarray, blocks: list[np.ndarray]) -> None:
            # columns: blocks gone through, then the least and the most of the others, for all candidates each
            w = fold.w[:, :n]
            rows, mean, mid, half, x, y = np.split(heads[:, 1:], np.cumsum([1, *[len(w)] * 4]), axis=1)
            worst, bad, _, short = (part[n:].reshape(2, n) for part in fold.parts)
            with np.errstate(all="ignore"):
                centre, reach = mid @ w, (half @ np.abs(w)) * (1 + _ROOM) + 1e-12 * (np.abs(mid) @ np.abs(w))
                if fold.gene is not None:
                    gene = fold.gene[:n]
                    centre, reach = centre - gene, reach + 1e-12 * np.abs(gene)
                    far = (heads[:, :1] == 0) & (np.abs(centre) > reach)
                    short += np.where(far & (centre < 0), np.maximum(y * gene - x @ w, 0.0), 0.0).sum(axis=0)
                else:
                    far = (heads[:, :1] == 0) & (np.abs(centre) > CLOSE * reach)
                    behind = far & (centre < 0)
                    near, ends = np.abs(centre) - reach, 2 * reach
                    ahead = np.clip(np.abs(mean @ w) - near, 0.0, ends)  # of the mean, 1/t^2 being convex
                    low = rows / (near + ahead) ** 2
                    share = np.where(ends > 0, ahead / ends, 0.0)
                    high = rows * ((1 - share) / near ** 2 + share / (near + ends) ** 2)
                    for i, (slope, square) in enumerate(((1 / (near + ahead), low), (1 / near, high))):
                        np.maximum(worst[i], np.where(far, slope, 0.0).max(axis=0), out=worst[i])
                        bad[i] += np.where(behind, square, 0.0).sum(axis=0)
            none = np.zeros(2 * n, bool)
            for i in np.flatnonzero(~far.all(axis=1)):
                fold.add_some(blocks[i][:, :-1], blocks[i][:, -1], np.concatenate([~far[i], none]))

        whole = self._folded(np.tile(pop, (3, 1)), bound_gene, add)
        if whole is None:
            return np.full(n, np.inf), np.full(n, np.inf)
        ends = []
        for i, room in ((1, 1 - _ROOM), (2, 1 + _ROOM)):
            fold = _Fold(pop, bound_gene)
            for part in (whole.parts[:, :n], whole.parts[:, i * n:(i + 1) * n]):
                fold.merge(part)
            end = self._penalty(pop, fold, bound_gene) * room
            ends.append(np.where(np.isfinite(end), end, np.inf))
        return ends[0], ends[1]

    def rough_bounds(self, pop: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Wider bounds of penalties without a gene, for much less work; none if the scale is too small for that.

        Most of a large penalty are the slopes of the few rows next to a candidate's plane. A block farther from it than
        a margin has its line of sums, the others are gone through in single precision, apart from the rows next to the
        plane. The margin is chosen so that about ``ROUGH`` of ``scale`` is left open.
        """
        pop = np.asarray(pop, dtype=float)
        n = len(pop)
        if not (np.isfinite(scale) and scale > 0):
            return None
        margin = 0.64 * self.rows / (ROUGH * scale)  # of directions spread evenly in four columns
        if margin > ROUGH_MOST:
            return None
        fine = max(margin / FINE, 1e-4)

        def add(fold: _Fold, heads: np.ndarray, blocks: list[np.ndarray]) -> None:
            # columns: the least and the most, for all candidates each
            w = fold.w[:, :n]
            rows, _, mid, half, _, _ = np.split(heads[:, 1:], np.cumsum([1, *[len(w)] * 4]), axis=1)
            worst, bad, _, _ = (part.reshape(2, n) for part in fold.parts)
            odd = heads[:, 0] != 0
            with np.errstate(all="ignore"):
                centre, reach = mid @ w, (half @ np.abs(w)) * (1 + _ROOM) + 1e-12 * (np.abs(mid) @ np.abs(w))
                least, most = np.abs(centre) - reach, np.abs(centre) + reach
                far = ~odd[:, None] & ((least > margin) | (np.abs(centre) > CLOSE * reach))
                behind = far & (centre < 0)
                for i, slope in enumerate((1 / most, 1 / least)):
                    np.maximum(worst[i], np.where(far, slope, 0.0).max(axis=0), out=worst[i])
                    bad[i] += np.where(behind, rows * slope * slope, 0.0).sum(axis=0)
            single, turned = w.astype("<f4"), np.ascontiguousarray(w.T)
            for i in np.flatnonzero(~far.all(axis=1)):
                x, y = blocks[i][:, :-1], blocks[i][:, -1]
                if odd[i]:
                    fold.add(x, y)
                    continue
                some = np.flatnonzero(~far[i])
                u = (x / y[:, None]).astype("<f4")
                t = u @ single[:, some]
                room = 1e-6 * float((np.abs(mid[i]) + half[i]).sum())  # what single precision may be off, and more
                hits = np.flatnonzero(np.abs(t) < fine + room)
                row, own = np.divmod(hits, len(some))
                own = some[own]
                t.reshape(-1)[hits] = np.inf
                f = np.reciprocal(t, out=t)
                np.minimum(f, 0.0, out=f)
                squares = np.einsum("ij,ij->j", f, f)
                t = np.einsum("ij,ij->i", x[row], turned[own])
                with np.errstate(divide="ignore", invalid="ignore"):
                    f = y[row] / t
                f[~np.isfinite(f)] = 0.0  # increments of zero have no slope
                near = np.bincount(own, np.where(t < 0, f * f, 0.0), n)
                np.abs(f, out=f)
                for part, share in ((0, 1 - 1e-4 - 2.5 * room / fine), (1, 1 + 1e-4 + 2.5 * room / fine)):
                    bad[part, some] += squares * share
                    np.maximum.at(worst[part], own, f)
                    bad[part] += near
                worst[1, some] = np.maximum(worst[1, some], 1 / fine)  # of the rows beyond; next to the squares that is nothing

        whole = self._folded(np.tile(pop, (2, 1)), False, add)
        if whole is None:
            return None
        low, high = self._penalty(pop, whole, False).reshape(2, n)
        return np.where(np.isfinite(low), low * (1 - _ROOM), np.inf), np.where(np.isfinite(high), high * (1 + _ROOM), np.inf)

    def penalties(self, pop: np.ndarray, bound_gene: bool = False) -> np.ndarray:
        """The penalty of every candidate from all rows; infinite where it has none."""
        pop = np.asarray(pop, dtype=float)

        def add(fold: _Fold, heads: np.ndarray, blocks: list[np.ndarray]) -> None:
            for block in blocks:
                fold.add(block[:, :-1], block[:, -1])

        whole = self._folded(pop, bound_gene, add)
        if whole is None:
            return np.full(len(pop), np.inf)
        out = self._penalty(pop, whole, bound_gene)
        return np.where(np.isfinite(out), out, np.inf)

    @staticmethod
    def _penalty(pop: np.ndarray, fold: _Fold, bound_gene: bool) -> np.ndarray:
        worst, bad, _, short = fold.parts
        with np.errstate(divide="ignore", over="ignore"):
            return 1.0 / pop[:, 0] + short * short if bound_gene else worst + bad

    def release(self) -> None:
        self.blocks.unpersist()


def monotonic_check(increments: DataFrame, cols: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Smallest weighted increment and whether it is positive."""
    w = np.asarray(weights, dtype=float)
    w = w / np.linalg.norm(w)
    t = None
    for c, v in zip(cols, w):
        term = F.col(c) * F.lit(float(v))
        t = term if t is None else t + term
    return increments.agg(F.min(t).alias("lowest")).withColumn("monotonic", F.col("lowest") > 0)


def weight_bounds(species: Sequence[str], reactants: Sequence[str] = (), product: str | None = None,
                  custom: dict[str, tuple[float, float]] | None = None) -> list[tuple[float, float]]:
    """Search bounds: -1..1, reactants not positive, the major product not negative."""
    bounds = {s: (-1.0, 1.0) for s in species}
    for r in reactants:
        if r in bounds:
            bounds[r] = (-1.0, 0.0)
    if product in bounds:
        bounds[product] = (0.0, 1.0)
    bounds.update({s: b for s, b in (custom or {}).items() if s in bounds})
    return [bounds[s] for s in species]


class _Scored:
    """Candidates and the bounds of their penalties, which become the penalties themselves where ``settle`` is asked to.

    Given the ``scale`` of the penalties that matter, the first bounds are rough; ``sharpen`` mends them where they
    leave a decision open.
    """

    def __init__(self, packed: PackedIncrements, pop: np.ndarray, bound_gene: bool, scale: float | None = None):
        self.packed, self.pop, self.gene = packed, pop, bound_gene
        rough = None if scale is None or bound_gene else packed.rough_bounds(pop, scale)
        self.low, self.high = rough or packed.bounds(pop, bound_gene)
        self.rough = np.full(len(pop), rough is not None)
        self.known = np.zeros(len(pop), bool)

    def sharpen(self, some: np.ndarray) -> None:
        some = np.flatnonzero(some & self.rough)
        if len(some):
            low, high = self.packed.bounds(self.pop[some], self.gene)
            self.low[some], self.high[some] = np.maximum(self.low[some], low), np.minimum(self.high[some], high)
            self.rough[some] = False

    def settle(self, some: np.ndarray) -> None:
        some = np.flatnonzero(some & ~self.known)
        if len(some):
            self.low[some] = self.high[some] = self.packed.penalties(self.pop[some], self.gene)
            self.known[some], self.rough[some] = True, False

    def best(self) -> int:
        while not self.known[rivals := self.low <= self.high.min()].all():
            self.settle(rivals)
        return int(np.argmin(self.high))

    def take(self, other: _Scored) -> None:
        """Replace each candidate by that of ``other`` if its penalty is no larger."""
        doubt = (other.low <= self.high) & ~(other.high <= self.low)
        for mend in (other.sharpen, self.sharpen, other.settle, self.settle):
            mend(doubt)
            doubt &= (other.low <= self.high) & ~(other.high <= self.low)
        better = other.high <= self.low
        for mine, new in ((self.pop, other.pop), (self.low, other.low), (self.high, other.high), (self.known, other.known), (self.rough, other.rough)):
            mine[better] = new[better]

    def alike(self) -> bool:
        """Whether the penalties are finite and spread no more than the tolerance."""
        if np.isinf(self.low).any():
            return False
        for mend in (lambda: self.sharpen(self.rough), lambda: self.settle(~self.known)):
            middle, room = (self.low + self.high) / 2, (self.high - self.low).max() / 2
            if np.isfinite(room) and middle.std() - room > SEARCH_TOLERANCE * (abs(middle.mean()) + room):
                return False
            mend()
        return bool(np.isfinite(self.high).all() and self.high.std() <= SEARCH_TOLERANCE * abs(self.high.mean()))


RoundHook = Callable[[int, float, np.ndarray], None]

SEARCH_TOLERANCE = 1e-3  # spread of the penalties at which the search stops (fixed value)


def evolve_weights(increments: DataFrame | PackedIncrements, cols: Sequence[str], y: str, bounds: Sequence[tuple[float, float]],
                   popsize: int | None = None, generations: int | None = None, seed: int = 1,
                   crossover: float = 0.7, bound_gene: bool = False,
                   on_round: RoundHook | None = None) -> tuple[np.ndarray, float]:
    """Differential evolution (best/1 with exponential crossover) of a weight vector.

    ``popsize`` is the number of candidates per gene (20 per gene and number of genes by default), so a
    generation has popsize * genes candidates; by default there are up to 5 * popsize generations.
    The driver holds the population; the increments are packed once (or given as ``PackedIncrements``) and each
    generation is one Spark job of one stage over their blocks, which bounds the penalties of all trials, and another
    one for the few that the bounds do not settle.
    """
    packed = increments if isinstance(increments, PackedIncrements) else PackedIncrements(increments, cols, y)
    rng = np.random.default_rng(seed)
    lo, hi = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    n = len(bounds)
    per_gene = popsize or 20 * n
    popsize = per_gene * n
    generations = generations or 5 * per_gene
    scored = _Scored(packed, lo + rng.random((popsize, n)) * (hi - lo), bound_gene)
    for g in range(generations):
        pop, best = scored.pop, scored.pop[scored.best()]
        pick = np.array([rng.choice(popsize, 2, replace=False) for _ in range(popsize)])
        donor = best + rng.uniform(0.5, 1.0) * (pop[pick[:, 0]] - pop[pick[:, 1]])
        trial = pop.copy()
        for i in range(popsize):
            at = int(rng.integers(n))
            length = 1
            while length < n and rng.random() < crossover:
                length += 1
            genes = (at + np.arange(length)) % n
            trial[i, genes] = donor[i, genes]
        outside = (trial < lo) | (trial > hi)
        trial = np.where(outside, lo + rng.random(trial.shape) * (hi - lo), trial)
        scored.take(_Scored(packed, trial, bound_gene, float(scored.high.min())))
        if on_round:
            i = scored.best()
            on_round(g, float(scored.high[i]), pop[i])
        if scored.alike():
            break
    if packed is not increments:
        packed.release()
    i = scored.best()
    return scored.pop[i], float(scored.high[i])


def refine_weights(increments: DataFrame | PackedIncrements, cols: Sequence[str], y: str, start: Sequence[float],
                   bounds: Sequence[tuple[float, float]], rounds: int = 20, step: float = 0.1,
                   bound_gene: bool = False) -> tuple[np.ndarray, float]:
    """Local pattern search: both directions of every gene are scored in one job per round."""
    lo, hi = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    packed = increments if isinstance(increments, PackedIncrements) else PackedIncrements(increments, cols, y)
    x = np.clip(np.asarray(start, dtype=float), lo, hi)
    best = None
    for _ in range(rounds):
        moves = np.concatenate([np.eye(len(x)), -np.eye(len(x))]) * (step * (hi - lo))
        scored = _Scored(packed, np.concatenate([[x], np.clip(x + moves, lo, hi)]), bound_gene)
        i, pop = scored.best(), scored.pop
        best = float(scored.high[i])
        if i == 0:
            step /= 2
        x = pop[i]
    if packed is not increments:
        packed.release()
    return x, best


def initial_population(individuals: DataFrame, seed: int, defaults: dict[str, float],
                       learning_rate: tuple[tuple[float, float], tuple[float, float]],
                       batch: tuple[int, int], activations: int, layers: tuple[int, int],
                       widths: tuple[int, int]) -> DataFrame:
    """``(individual, genes)`` for every row of ``individuals (id)``: learning-rate genes near their defaults,
    uniform batch and activation genes, and unimodal layer widths with inactive pairs at the end. An
    individual's genes depend on its id and the seed only."""
    lmin, lmax = layers

    def u(*salt: object):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), *[F.lit(str(s)) for s in salt]), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def whole(lo: int, hi: int, *salt: object):  # lo..hi-1
        return F.lit(lo) + F.floor(u(*salt) * F.lit(hi - lo)).cast("int")

    genes = []
    for name, (a, b) in zip(("alpha_expo", "lr_decay"), learning_rate):
        genes.append(F.lit(float(defaults[name])) + F.lit(0.1 * (b - a)) * (u(name) - F.lit(0.5)))
    genes.append(whole(batch[0], batch[1] + 1, "batch").cast("double"))
    genes.append(whole(0, activations, "activation").cast("double"))
    drawn = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.lit(widths[0]) + F.floor(
        F.pmod(F.xxhash64(F.col("id"), F.lit(seed), i), F.lit(1 << 30)) / F.lit(float(1 << 30))
        * F.lit(widths[1] - widths[0])).cast("int"))
    df = (individuals.select("id").withColumn("_n", whole(lmin, lmax, "layers")).withColumn("_w", drawn)
          .withColumn("_peak", F.floor(u("peak") * F.greatest(F.col("_n") - 1, F.lit(1))).cast("int")))
    rising = F.sort_array(F.slice("_w", F.lit(1), F.col("_peak")), True)
    falling = F.sort_array(F.slice("_w", F.col("_peak") + 1, F.col("_n") - F.col("_peak")), False)
    df = df.withColumn("_w", F.concat(rising, falling))
    arch = F.slice("_w", 1, lmin)
    spare = F.transform(F.sequence(F.lit(lmin), F.lit(lmax - 1)), lambda i: F.when(
        i < F.col("_n"), F.array(F.lit(1), F.get("_w", i))).otherwise(F.array(F.lit(0), F.lit(widths[0]) + F.floor(
            F.pmod(F.xxhash64(F.col("id"), F.lit(seed), i, F.lit("spare")), F.lit(1 << 30)) / F.lit(float(1 << 30))
            * F.lit(widths[1] - widths[0])).cast("int"))))
    layered = F.concat(arch, F.flatten(spare)) if lmax > lmin else arch
    return df.select(F.col("id").alias("individual"), F.concat(
        F.array(*genes), F.transform(layered, lambda v: v.cast("double"))).alias("genes"))
