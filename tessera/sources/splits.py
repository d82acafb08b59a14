"""The concatenated table and its parts, stored once and partitioned by ``split``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.profiles import require_columns


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write all parts; the full table is the union of the partitions and is not stored twice."""
    writer = df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_splits(spark: SparkSession, path: str, x_cols: Sequence[str], y_cols: Sequence[str],
                split: str | None = None, fmt: str = "parquet", single: bool = False) -> DataFrame:
    """Read one part (or all) and the wanted columns; both prune the scan.

    ``single`` rounds the data to single precision, the default width of training data.
    """
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    df = reader.format(fmt).load(path)
    names = [*x_cols, *y_cols]
    out = require_columns(df, [*names, "split"])
    if split is not None and split != "full":
        out = out.where(F.col("split") == split)
    return out.select(*[F.col(n).cast("float") if single else F.col(n) for n in names], "split")
