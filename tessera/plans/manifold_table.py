"""Profiles to the concatenated, deduplicated and split table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import partition_filter
from tessera.operators.resample import first_row_repeat, resample, resample_random
from tessera.operators.sequence import (SeriesKey, arc_length, drop_degenerate, having_max, nodes_per_series,
                                        series_number, whole_and_cut, zero_edges, zero_near_extremes)
from tessera.operators.split import dedupe_first, integer_hash, split_exact
from tessera.runtime import cut_lineage
from tessera.sources.profiles import KINDS

_CARRY = ["kind", "folder", "file"]
BURNING_TEMPERATURE = 600.0  # a series that never gets this hot is dropped (fixed value)


@dataclass
class TableSpec:
    """Arguments of the concatenation."""

    controls: Sequence[str]
    values: Sequence[str]
    sources: Sequence[str] = ()
    kinds: Sequence[str] = KINDS
    nodes: int | None = None
    header: str = "phi_"
    lo: float = 0.0
    hi: float = float("inf")
    stride: int = 1
    ignore_bounds: bool = False
    guide: str = "Temperature"
    table_mode: bool = False
    f_train: float = 0.8
    f_test: float = 0.1
    layout: tuple[str, str, str] = ("train", "val", "test")
    derive: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.controls, *self.values, *self.sources]))


def concatenate(profiles: DataFrame, key: SeriesKey, spec: TableSpec) -> DataFrame:
    """One row per node of every kept series, with ``series_no`` and ``split``.

    Shuffles: one by series for arc length, one for resampling, one by the controlling variables for the
    deduplication. The split itself broadcasts a fixed-size table of bucket counts. In a table cut into chunks, only
    the series that a chunk border cuts go by (series, chunk).
    """
    df = profiles.where(F.col("kind").isin(list(spec.kinds)))
    # folders are strided within their kind; counter-flow files have no mixture folder
    foldered = df.where(F.col("kind") != "counterflame")
    bounds = (spec.header, spec.lo, spec.hi, spec.stride)
    if spec.ignore_bounds and "fuzzy" in spec.kinds:  # that kind always keeps its bounds
        free = partition_filter(foldered.where("kind <> 'fuzzy'"), "folder", *bounds, True, ["kind"])
        chosen = free.unionByName(partition_filter(foldered.where("kind = 'fuzzy'"), "folder", *bounds, False, ["kind"]))
    else:
        chosen = partition_filter(foldered, "folder", *bounds, spec.ignore_bounds, ["kind"])
    if "counterflame" in spec.kinds:
        chosen = chosen.unionByName(df.where(F.col("kind") == "counterflame"))
    # nodes and numbers are counted over all selected files, kept or not
    nodes = spec.nodes or nodes_per_series(chosen, [key.series]).first()[0]
    numbers = series_number(chosen, "kind", "folder", "file", spec.kinds)
    parts = [_series_nodes(rows, k, spec, nodes) for rows, k in whole_and_cut(chosen, key)]
    out = reduce(DataFrame.unionByName, parts).join(numbers, _CARRY)
    out = cut_lineage(dedupe_first(out, spec.controls, ["series_no", "node"]))
    hashed = integer_hash(["series_no", "node"], seed=7)
    out = split_exact(out, hashed, ["series_no", "node"], spec.f_train, spec.f_test, spec.layout)
    return out.select(*spec.columns, "series_no", "node", "split")


def _series_nodes(df: DataFrame, key: SeriesKey, spec: TableSpec, nodes: int) -> DataFrame:
    """The nodes of the kept series; ``df`` holds all rows of its series."""
    # whole-series predicates come first: they commute with the curve operators
    df = having_max(df, key, spec.guide, BURNING_TEMPERATURE)
    df = spec.derive(df)
    if spec.sources:
        df = (zero_near_extremes(df, key.series, spec.guide, spec.sources) if spec.table_mode
              else zero_edges(df, key, spec.sources))
    df = arc_length(df, key, spec.controls)
    cols = spec.columns
    # only what the nodes are made of is stored
    df = drop_degenerate(df, "s_total", F.col("kind") == "equilibrium")
    df = cut_lineage(df.select(*key.part, key.order, *_CARRY, "s", *cols))
    equilibrium, fuzzy = F.col("kind") == "equilibrium", F.col("kind") == "fuzzy"
    shape = [key.series, *_CARRY, "node", *cols]
    flames = resample(df.where(~equilibrium & ~fuzzy), key, "s", cols, nodes, "cosine", _CARRY)
    parts = [flames.select(*shape)]
    if "equilibrium" in spec.kinds:
        rows = df.where(equilibrium)
        got = (first_row_repeat(rows, key, nodes, spec.sources) if spec.table_mode
               else resample(rows, key, "s", cols, nodes, "uniform", _CARRY))
        parts.append(got.withColumn("node", F.col("node").cast("long")).select(*shape))
    if "fuzzy" in spec.kinds:
        hashed = F.pmod(F.xxhash64(F.col(key.series), F.col(key.order)), F.lit(1 << 32))
        got = resample_random(df.where(fuzzy), key, nodes, hashed)
        parts.append(got.withColumn("node", F.col(key.order)).select(*shape))
    return reduce(DataFrame.unionByName, parts)


def boundary_table(profiles: DataFrame, key: SeriesKey, spec: TableSpec) -> DataFrame:
    """The second concatenation: the equilibrium kind only, without bounds or prefix test."""
    from dataclasses import replace

    return concatenate(profiles, key, replace(spec, kinds=("equilibrium",), ignore_bounds=True))
