"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import checkpoint_dir, cut_lineage

PART_LINKS = 250_000


def per_process(key: str, make):
    """What ``make`` gives, once for each Python worker: models are not loaded anew by every task.

    The code of this package travels with the tasks by value, so its own globals do not outlive a task.
    """
    import sys
    import types

    held = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Return what a Python worker has freed to the system; a worker that lives on would keep its peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: compressed, read by column, and free of its lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node reaches: ``node, root`` (roots themselves left out).

    ``links`` has the columns ``a`` and ``b``. Alternating large-star and small-star steps turn every component
    into a star around its smallest node in a number of rounds that grows with the logarithm of its size.
    Minima are stored before they are joined, so that Spark can split the neighbours of a hot node.
    """
    edges = (links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = cut_lineage(edges)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before, parts = state, -(-state[0] // PART_LINKS)  # a few links need no more than a few tasks
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = cut_lineage(least.coalesce(parts))
        large = (both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b")).distinct()
        large = cut_lineage(large.coalesce(parts))
        least = cut_lineage(large.groupBy("b").agg(F.min("a").alias("m")).coalesce(parts))
        moved = large.join(least, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
        edges = (moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                 .unionByName(least.select(F.col("m").alias("a"), "b")).distinct())
        edges = cut_lineage(edges.coalesce(parts))
