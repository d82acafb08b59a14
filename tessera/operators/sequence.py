"""Operators over ordered series.

A series may hold a large share of all rows, so no operator here puts a whole series into one task
unless its size has been checked. ``index_rows`` counts the rows of each series; when one is too large for
a task, it sorts the rows once by (series, order) and cuts that order into chunks of equal row count. Windows
then run per (series, chunk); what has to pass a chunk border (the last row, a running total) travels
in a table with one row per chunk. Only the series that a border cuts need such tables: ``whole_and_cut``
tells them from the others, of which a task holds all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.runtime import cut_lineage

CHUNK_ROWS = 4_000_000
MAX_PARTS = 20_000  # range partitions of a global sort; larger tables get larger partitions
FEW_SERIES = 500_000  # rows of a table of series that are sent to all tasks; longer ones are joined by a shuffle
_LOCAL_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


@dataclass(frozen=True)
class SeriesKey:
    """Names of the series, order and (for tables too large for one task) chunk columns.

    ``cut`` names a column that is true in the rows of the series that lie in more than one chunk, if there is one.
    """

    series: str = "series_id"
    order: str = "row_idx"
    chunk: str | None = None
    cut: str | None = None

    @property
    def part(self) -> list[str]:
        return [self.series] if self.chunk is None else [self.series, self.chunk]

    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(self.order)

    def whole(self) -> WindowSpec:
        """All rows of the series, in the order of ``rows``, so that both need one sort."""
        return Window.partitionBy(self.series).orderBy(self.order).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)


def _ranged(df: DataFrame, order: Sequence[str | Column], rows: int | None, rows_per_task: int) -> DataFrame:
    """The sorted rows, stored, with the number of their range partition and of the row inside it.

    The range bounds come from a sample, so the sorted rows are materialised before they are counted.
    """
    rows = df.count() if rows is None else rows
    parts = min(max(1, -(-rows // rows_per_task)), MAX_PARTS)
    ranged = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))))
    return cut_lineage(ranged)


def _offsets(sizes: DataFrame) -> DataFrame:
    """Rows in the range partitions before each one; ``sizes`` has at most ``MAX_PARTS`` rows."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "pos",
                 rows: int | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """Number all rows 0..n-1 in the given order without a single-partition window.

    The rows are range-partitioned and sorted, numbered inside each partition, and shifted by the
    row counts of the partitions before. ``order`` should identify a row: only full ties can make a
    range partition larger than its share.
    """
    ranged = _ranged(df, order, rows, rows_per_task)
    offsets = _offsets(ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid")).drop("_pid", "_mid", "_off"))


def _largest_series(df: DataFrame, series: str) -> int:
    return df.groupBy(series).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def index_rows(df: DataFrame, series: str, order: Sequence[str], chunk_rows: int | None = None,
               rows: int | None = None) -> tuple[DataFrame, SeriesKey]:
    """Give every row its 0-based ``row_idx`` inside its series.

    A table none of whose series has more than ``CHUNK_ROWS`` rows needs no chunks, however large it is: a
    task holds whole series. With a ``chunk_rows`` of its own, every table of more rows than that is cut.
    """
    if chunk_rows is None:
        chunk_rows, whole = CHUNK_ROWS, _largest_series(df, series) <= CHUNK_ROWS
    else:
        rows = df.count() if rows is None else rows
        whole = rows <= chunk_rows
    if whole:
        w = Window.partitionBy(series).orderBy(*order)
        return (df.withColumn("row_idx", (F.row_number().over(w) - 1).cast("long")),
                SeriesKey(series, "row_idx"))
    ranged = _ranged(df, [series, *order], rows, 1_000_000)
    # one row per series of a range partition: where its rows begin there, and in the whole order
    spans = cut_lineage(ranged.groupBy("_pid", series).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_at")))
    offsets = _offsets(spans.groupBy("_pid").agg(F.sum("_n").alias("_n")))
    at, of = F.col("_off") + F.col("_at"), Window.partitionBy(series)
    firsts = spans.join(F.broadcast(offsets), "_pid").select(
        "_pid", series, "_off", F.min(at).over(of).alias("_first"), F.max(at + F.col("_n") - 1).over(of).alias("_last"))
    chunk = lambda pos: F.floor(pos / F.lit(chunk_rows)).cast("long")
    firsts = cut_lineage(firsts.withColumn("cut_series", chunk(F.col("_first")) < chunk(F.col("_last"))).drop("_last"))
    few = firsts.count() <= FEW_SERIES  # they are stored, so they are counted cheaply
    pos = F.col("_off") + F.col("_mid")
    out = (ranged.join(F.broadcast(firsts) if few else firsts, ["_pid", series])
           .withColumns({"chunk": chunk(pos), "row_idx": pos - F.col("_first")}).drop("_pid", "_mid", "_off", "_first"))
    # the sorted rows are stored already; only a shuffle of all of them is not to be repeated
    return out if few else cut_lineage(out), SeriesKey(series, "row_idx", "chunk", "cut_series")


def whole_and_cut(df: DataFrame, key: SeriesKey) -> list[tuple[DataFrame, SeriesKey]]:
    """The rows of the series that lie in one chunk, with a key without chunks, and the rows of those that a chunk border cuts."""
    if key.chunk is None:
        return [(df, key)]
    plain = SeriesKey(key.series, key.order)
    if key.cut:
        return [(df.where(~F.col(key.cut)), plain), (cut_lineage(df.where(key.cut)), key)]
    ends = df.groupBy(key.series).agg(F.min(key.chunk).alias("_lo"), F.max(key.chunk).alias("_hi"))
    cut = cut_lineage(ends.where("_lo < _hi").select(key.series))
    cut = F.broadcast(cut) if cut.count() <= FEW_SERIES else cut
    return [(df.join(cut, key.series, "left_anti"), plain), (cut_lineage(df.join(cut, key.series, "left_semi")), key)]


# --- neighbours and running totals -------------------------------------------------------------

def _neighbour(df: DataFrame, key: SeriesKey, cols: dict[str, str], step: int) -> DataFrame:
    shift = F.lag if step < 0 else F.lead
    w = key.rows()
    local = {out: shift(F.col(src)).over(w) for src, out in cols.items()}
    if key.chunk is None:
        return df.withColumns(local)
    edge = F.max_by if step < 0 else F.min_by
    packed = F.struct(*[F.col(src).alias(out) for src, out in cols.items()])
    edges = df.groupBy(*key.part).agg(edge(packed, F.col(key.order)).alias("_edge"))
    edges = edges.select(*key.part, shift("_edge").over(
        Window.partitionBy(key.series).orderBy(key.chunk)).alias("_edge"))
    border = (F.row_number().over(w) == 1) if step < 0 else F.lead(F.lit(1)).over(w).isNull()
    joined = df.withColumns({**local, "_border": border}).join(edges, key.part)
    return joined.withColumns({
        out: F.when(F.col("_border"), F.col("_edge")[out]).otherwise(F.col(out)) for out in cols.values()
    }).drop("_edge", "_border")


def previous(df: DataFrame, key: SeriesKey, cols: dict[str, str]) -> DataFrame:
    """Add, for every ``source: name``, the value of the row before in the same series."""
    return _neighbour(df, key, cols, -1)


def following(df: DataFrame, key: SeriesKey, cols: dict[str, str]) -> DataFrame:
    """Add, for every ``source: name``, the value of the row after in the same series."""
    return _neighbour(df, key, cols, +1)


def running_sum(df: DataFrame, key: SeriesKey, col: str, out: str, total: str | None = None) -> DataFrame:
    """Running sum of ``col`` from the start of the series; ``total`` adds the sum of the series."""
    w = key.rows().rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(col).over(w)
    if key.chunk is None:
        df = df.withColumn(out, local)
        # the last running value, not a separate sum, so that both agree to the last bit
        return df if total is None else df.withColumn(total, F.max(out).over(key.whole()))
    df = cut_lineage(df)
    sums = df.groupBy(*key.part).agg(F.sum(col).alias("_sum"))
    before = Window.partitionBy(key.series).orderBy(key.chunk)
    sums = sums.select(*key.part, "_sum",
                       F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)),
                                  F.lit(0.0)).alias("_before"))
    if total is not None:
        sums = sums.withColumn("_total", F.sum("_sum").over(Window.partitionBy(key.series)))
    out_df = df.withColumn(out, local).join(sums, key.part).withColumn(out, F.col(out) + F.col("_before"))
    if total is not None:
        out_df = out_df.withColumn(total, F.greatest(F.col("_total"), F.col(out)))
    return out_df.drop("_sum", "_before", "_total")


def with_series_aggregates(df: DataFrame, key: SeriesKey, aggs: dict[str, Column]) -> DataFrame:
    """Attach whole-series aggregates to every row.

    Small tables use the window their ordered operators already shuffle for. Larger ones aggregate
    with map-side combine and join back, so that a hot series is never gathered in one task.
    """
    if key.chunk is None:
        return df.withColumns({n: a.over(key.whole()) for n, a in aggs.items()})
    stats = df.groupBy(key.series).agg(*[a.alias(n) for n, a in aggs.items()])
    # one row per chunk, so that the rows keep their partitioning and no join key is hot
    stats = df.select(*key.part).distinct().join(stats, key.series)
    return df.join(stats, key.part)


def with_ranges(df: DataFrame, key: SeriesKey, ranges: dict[str, str]) -> DataFrame:
    """Attach max - min over the series for every ``source: name``."""
    ends = {}
    for c, out in ranges.items():
        ends["_lo" + out], ends["_hi" + out] = F.min(c), F.max(c)
    df = with_series_aggregates(df, key, ends)
    return df.withColumns({out: F.col("_hi" + out) - F.col("_lo" + out) for out in ranges.values()}).drop(*ends)


def delta(df: DataFrame, key: SeriesKey, cols: Sequence[str], prefix: str = "d_") -> DataFrame:
    """Row-to-row difference of each column inside its series; NULL on the first row."""
    df = previous(df, key, {c: f"_prev_{c}" for c in cols})
    return df.withColumns({prefix + c: F.col(c) - F.col(f"_prev_{c}") for c in cols}).drop(
        *[f"_prev_{c}" for c in cols])


def _norm(terms: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [t * t for t in terms]))


def max_step(df: DataFrame, key: SeriesKey, cols: Sequence[str], out: str = "max_step") -> DataFrame:
    """Largest absolute increment over the columns; NULL on the first row."""
    df = delta(df, key, cols, "_d_")
    steps = [F.abs(F.col("_d_" + c)) for c in cols]
    return df.withColumn(out, steps[0] if len(steps) == 1 else F.greatest(*steps)).drop(
        *["_d_" + c for c in cols])


# range guards of the normalised curve length (fixed values)
ARC_RANGE_GUARD = 1e-10
ARC_TOTAL_GUARD = 1e-32
THIN_RANGE_GUARD = 1e-32


def curve_length(df: DataFrame, key: SeriesKey, cols: Sequence[str], guard: float,
                 out: str = "c", total: str = "c_total") -> DataFrame:
    """Cumulative Euclidean length of the range-normalised curve, starting from 0."""
    aggs = {}
    for c in cols:
        aggs["_lo_" + c] = F.min(c)
        aggs["_hi_" + c] = F.max(c)
    df = with_series_aggregates(df, key, aggs)
    df = df.withColumns({"_n_" + c: (F.col(c) - F.col("_lo_" + c)) /
                         (F.col("_hi_" + c) - F.col("_lo_" + c) + F.lit(guard)) for c in cols})
    df = previous(df, key, {"_n_" + c: "_p_" + c for c in cols})
    step = F.coalesce(_norm([F.col("_n_" + c) - F.col("_p_" + c) for c in cols]), F.lit(0.0))
    df = df.withColumn("_step", step).drop(
        *[p + c for c in cols for p in ("_lo_", "_hi_", "_n_", "_p_")])
    return running_sum(df, key, "_step", out, total).drop("_step")


def arc_length(df: DataFrame, key: SeriesKey, cols: Sequence[str], out: str = "s",
               total: str = "s_total") -> DataFrame:
    """Normalised arc length of each series in the space of ``cols``: 0 on its first row, 1 on its last."""
    df = curve_length(df, key, cols, ARC_RANGE_GUARD, "_c", total)
    return df.withColumn(out, F.col("_c") / (F.col(total) + F.lit(ARC_TOTAL_GUARD))).drop("_c")


def progress_vector(df: DataFrame, key: SeriesKey, cols: Sequence[str], extra: Sequence[str] = (),
                    ranges: dict[str, str] | None = None, out: str = "y",
                    prefix: str = "d_") -> DataFrame:
    """Increments of ``cols`` and the norm of the full increment vector.

    Extra columns are divided by their range over the series before they enter the norm. After
    thinning, pass ``ranges`` with columns that hold the range over the *unthinned* series.
    """
    if extra and ranges is None:
        ranges = {c: "_rng_" + c for c in extra}
        df = with_ranges(df, key, ranges)
    df = delta(df, key, cols, prefix)
    terms = [F.col(prefix + c) for c in cols]
    if extra:
        df = delta(df, key, extra, "_x_")
        terms += [F.col("_x_" + c) / (F.col(ranges[c]) + F.lit(THIN_RANGE_GUARD)) for c in extra]
    return df.withColumn(out, _norm(terms)).drop(*["_x_" + c for c in extra], *["_rng_" + c for c in extra])


# --- thinning ----------------------------------------------------------------------------------

def thin_monotone(df: DataFrame, key: SeriesKey, cols: Sequence[str], tol: float = 1e-4,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keep a subset of each series whose curve length grows by more than ``tol`` of the total.

    From the end, a row is kept when its curve length lies below that of the last kept row by more
    than the tolerance. First and last rows always stay, and the kept rows between the first row and
    the one before the first row beyond the tolerance are dropped again.
    """
    curve = curve_length(df, key, cols, THIN_RANGE_GUARD, "_c", "_ct")
    curve = curve.withColumn("_tol", F.lit(tol) * F.col("_ct"))
    if key.chunk is None:
        return _thin_small(curve, key, df.columns)
    curve = cut_lineage(curve)
    sizes = curve.groupBy(key.series).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > chunk_rows).select(key.series)
    small = _thin_small(curve.join(hot, key.series, "left_anti"), key, df.columns)
    return small.unionByName(_thin_large(curve.join(hot, key.series, "left_semi"), key, df.columns))


def _kept_rows(c: np.ndarray, tol: float) -> np.ndarray:
    """Mask of the rows of one series that thinning keeps; ``c`` does not decrease."""
    kept = np.zeros(len(c), dtype=bool)
    kept[-1] = True
    at = int(np.searchsorted(c, c[-1] - tol, side="left")) - 1
    while at > 0:
        kept[at] = True
        at = int(np.searchsorted(c, c[at] - tol, side="left")) - 1
    kept[0] = True
    beyond = int(np.searchsorted(c, tol, side="right"))
    if beyond < len(c):
        kept[1:max(beyond - 1, 1)] = False
    return kept


def _thin_small(curve: DataFrame, key: SeriesKey, keep: Sequence[str]) -> DataFrame:
    """Thinning of series that fit in a task: jumps over the sorted curve length.

    Batches of sorted rows are walked as they come, many short series at a time; only the rows of the
    series that a batch leaves unfinished are held back.
    """
    series, keep = key.series, list(keep)

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, c, tol = pdf[series].to_numpy(), pdf["_c"].to_numpy(), pdf["_tol"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        masks = [_kept_rows(c[a:b], tol[a]) for a, b in zip(starts, np.r_[starts[1:], len(ids)])]
        return pdf.loc[np.concatenate(masks), keep]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[series].to_numpy()
            tail = len(ids) - int(np.argmax(ids[::-1] != ids[-1])) if (ids != ids[-1]).any() else 0
            if tail == 0 and (not held or held[-1][series].iloc[-1] == ids[-1]):
                held.append(pdf)
                continue
            yield thin(pd.concat([*held, pdf.iloc[:tail]], ignore_index=True))
            held = [pdf.iloc[tail:]]
        if held:
            yield thin(pd.concat(held, ignore_index=True))

    sorted_rows = curve.repartition(series).sortWithinPartitions(series, key.order)
    return sorted_rows.mapInPandas(walk, curve.select(*keep).schema)


def _thin_large(curve: DataFrame, key: SeriesKey, keep: Sequence[str]) -> DataFrame:
    """Thinning of series too large for one task, by pointer doubling.

    Every row points to the row that would be kept next. The kept rows are those on the path from
    the last row, found by joining ever longer jumps; a path has at most 1/tol rows.
    """
    series, order = key.series, key.order
    points = curve.select(series, F.col(order).alias("_at"), "_c", F.lit(1).alias("_is_row"))
    asks = curve.select(series, F.col(order).alias("_at"), (F.col("_c") - F.col("_tol")).alias("_c"),
                        F.lit(0).alias("_is_row"))
    # on equal values a question sorts before the rows, which makes "below" strict
    merged = points.unionByName(asks)
    n = merged.count()
    if n == 0:
        return curve.select(*keep)
    merged = global_index(merged, [series, "_c", "_is_row", "_at"], "_pos", n)
    merged = merged.withColumn("_chunk", F.floor(F.col("_pos") / 1_000_000).cast("long"))
    row_at = F.when(F.col("_is_row") == 1, F.col("_at"))
    ends = merged.groupBy(series, "_chunk").agg(F.max(row_at).alias("_end"))
    ends = ends.select(series, "_chunk", F.max("_end").over(
        Window.partitionBy(series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_end"))
    w = Window.partitionBy(series, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    links = (merged.withColumn("_below", F.max(row_at).over(w)).where("_is_row = 0")
             .join(ends, [series, "_chunk"])
             .select(series, "_at", F.coalesce(F.greatest("_below", "_end"), F.lit(0)).alias("_to")))
    links = cut_lineage(links)
    jumps = [links]
    while jumps[-1].where("_to > 0").limit(1).count() > 0:
        last = jumps[-1]
        longer = (last.where("_to > 0").alias("a")
                  .join(last.select(series, F.col("_at").alias("_mid"), F.col("_to").alias("_far")).alias("b"),
                        (F.col(f"a.{series}") == F.col(f"b.{series}")) & (F.col("a._to") == F.col("b._mid")))
                  .select(F.col(f"a.{series}").alias(series), F.col("a._at").alias("_at"),
                          F.col("b._far").alias("_to")))
        jumps.append(cut_lineage(longer))
    marked = curve.groupBy(series).agg(F.max(order).alias("_at"))
    for jump in reversed(jumps):
        reached = marked.join(jump, [series, "_at"]).where("_to > 0").select(series, F.col("_to").alias("_at"))
        marked = cut_lineage(marked.unionByName(reached).distinct())
    beyond = curve.where(F.col("_c") > F.col("_tol")).groupBy(series).agg(F.min(order).alias("_beyond"))
    marks = marked.select(series, F.col("_at").alias(order), F.lit(True).alias("_marked"))
    rows = curve.join(marks, [series, order], "left").join(beyond, series, "left")
    cleared = (F.col(order) >= 1) & (F.col(order) < F.col("_beyond") - 1)
    kept = F.coalesce(F.col("_marked"), F.lit(False)) & ~F.coalesce(cleared, F.lit(False))
    return rows.where((F.col(order) == 0) | kept).select(*keep)


# --- series aggregates and whole-series predicates ------------------------------------------------

def series_summary(df: DataFrame, key: SeriesKey, cols: Sequence[str]) -> DataFrame:
    """First, last, min, max and range of each column per series (partial aggregation, no window)."""
    aggs: list[Column] = []
    for c in cols:
        aggs += [F.min_by(c, key.order).alias(f"{c}_first"), F.max_by(c, key.order).alias(f"{c}_last"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                 (F.max(c) - F.min(c)).alias(f"{c}_range")]
    return df.groupBy(key.series).agg(*aggs)


def value_at_extreme(df: DataFrame, by: Sequence[str], value: str, peak: str, order: Sequence[str],
                     largest: bool = True, out: str = "value_at_extreme") -> DataFrame:
    """``value`` on the row where ``peak`` is extreme; the first such row in ``order`` wins ties."""
    sign = F.col(peak) if not largest else -F.col(peak)
    pick = F.min_by(F.col(value), F.struct(sign.alias("p"), *[F.col(o) for o in order]))
    return df.groupBy(*by).agg(pick.alias(out))


def residence_time(df: DataFrame, key: SeriesKey, x: str, velocity: str,
                   out: str = "residence_time") -> DataFrame:
    """Sum over the series of the grid step divided by the velocity at its start."""
    df = following(df, key, {x: "_next_x"})
    return df.groupBy(key.series).agg(F.sum(F.try_divide(F.col("_next_x") - F.col(x), F.col(velocity))).alias(out))


AveragingMethod = str | Callable[[str], Column]


def series_average(df: DataFrame, key: SeriesKey, col: str, method: AveragingMethod,
                   constant: float | None = None, out: str | None = None) -> DataFrame:
    """Replace a column by its series average under a named method.

    ``method`` may also be a callable that maps the column name to an aggregate.
    """
    out = out or f"{col}_av"
    if method == "local":
        return df.withColumn(out, F.col(col))
    if method == "unity":
        return df.withColumn(out, F.lit(1.0))
    if method == "constant":
        return df.withColumn(out, F.lit(float(constant)))
    if callable(method):
        agg = method(col)
    else:
        agg = {
            "start_end": F.lit(0.5) * (F.min_by(col, key.order) + F.max_by(col, key.order)),
            "arithmetic": F.avg(col),
            "min_max": F.lit(0.5) * (F.min(col) + F.max(col)),
        }[method]
    stats = df.groupBy(key.series).agg(agg.alias(out))
    return df.join(stats, key.series)


def _keep_series(df: DataFrame, series: str, kept: DataFrame) -> DataFrame:
    return df.join(kept.select(series), series, "left_semi")


def having_max(df: DataFrame, series: str | SeriesKey, col: str, threshold: float) -> DataFrame:
    """Keep the series whose maximum of ``col`` reaches the threshold.

    Rows that go on to ordered operators give their key: the maximum then takes the window these shuffle and sort for.
    """
    if isinstance(series, SeriesKey):
        df = with_series_aggregates(df.where(F.col(series.series).isNotNull()), series, {"_m": F.max(col)})
        return df.where(F.col("_m") >= threshold).drop("_m")
    return _keep_series(df, series, df.groupBy(series).agg(F.max(col).alias("_m")).where(F.col("_m") >= threshold))


def having_last(df: DataFrame, key: SeriesKey, col: str, limit: float) -> DataFrame:
    """Keep the series whose value on the last row does not exceed the limit."""
    last = df.groupBy(key.series).agg(F.max_by(col, key.order).alias("_m"))
    return _keep_series(df, key.series, last.where(F.col("_m") <= limit))


def drop_degenerate(df: DataFrame, total: str = "s_total", exempt: Column | None = None) -> DataFrame:
    """Drop series of zero arc length, apart from exempt rows (for example the equilibrium kind)."""
    ok = F.col(total) != 0
    return df.where(ok if exempt is None else ok | exempt)


def zero_edges(df: DataFrame, key: SeriesKey, cols: Sequence[str]) -> DataFrame:
    """Set source columns to zero on the first and last row of each series."""
    df = with_series_aggregates(df, key, {"_first": F.min(key.order), "_last": F.max(key.order)})
    edge = (F.col(key.order) == F.col("_first")) | (F.col(key.order) == F.col("_last"))
    return df.withColumns(
        {c: F.when(edge, F.lit(0.0)).otherwise(F.col(c)) for c in cols}).drop("_first", "_last")


# share of the range of the guiding column in which table sources are zero (fixed value)
ZERO_MARGIN = 2e-2


def zero_near_extremes(df: DataFrame, series: str, guide: str, cols: Sequence[str],
                       margin: float = ZERO_MARGIN) -> DataFrame:
    """Set source columns to zero where the guide lies within ``margin`` of its range from either end."""
    ends = df.groupBy(series).agg(F.min(guide).alias("_lo"), F.max(guide).alias("_hi"))
    band = F.lit(margin) * (F.col("_hi") - F.col("_lo"))
    near = ((F.col(guide) - F.col("_lo")) < band) | ((F.col("_hi") - F.col(guide)) < band)
    return df.join(ends, series).withColumns(
        {c: F.when(near, F.lit(0.0)).otherwise(F.col(c)) for c in cols}).drop("_lo", "_hi")


def series_number(df: DataFrame, kind: str, folder: str, file: str, kinds: Sequence[str],
                  out: str = "series_no") -> DataFrame:
    """Running id of the distinct series: kinds in the given order, folders and files as strings."""
    # stored, because they are counted, sampled and sorted
    keys = cut_lineage(df.select(kind, folder, file).where(F.col(kind).isin(list(kinds))).distinct())
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    return global_index(keys.withColumn("_rank", rank), ["_rank", folder, file], out).drop("_rank")


def nodes_per_series(df: DataFrame, series: Sequence[str], out: str = "nodes") -> DataFrame:
    """Whole number of rows per series: total rows divided by the number of series."""
    per = df.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.expr("cast(sum(_n) div count(*) as bigint)").alias(out))
