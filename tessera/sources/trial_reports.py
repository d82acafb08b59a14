"""Trial report files and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.trials import valid_score

# report keys -> column, type (fixed values)
REPORT_KEYS = {
    "Training time[minutes]": ("train_minutes", "double"),
    "Validation score": ("score", "double"),
    "Total neuron count": ("neurons", "int"),
    "Evaluation time[seconds]": ("eval_seconds", "double"),
    "Evaluation cost parameter": ("cost", "double"),
    "Alpha exponent": ("alpha_expo", "double"),
    "Learning rate decay": ("lr_decay", "double"),
    "Batch size exponent": ("batch_expo", "int"),
    "Decay steps": ("decay_steps", "int"),
    "Activation function index": ("activation", "int"),
    "Number of hidden layers": ("hidden_layers", "int"),
    "Architecture": ("architecture", "array<int>"),
}


def read_trial_reports(spark: SparkSession, glob: str) -> DataFrame:
    """One row per report: worker and model from the path, the keys by name; a NaN score becomes 10.

    Folders that ``glob`` names are read with all that lies below them. A pattern is resolved on the driver,
    what is in the folders is listed by tasks, so of many reports name the folders above them.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(glob).select(
        F.col("_metadata.file_path").alias("path"),
        F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("k"),
        F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("v"))
    picked = lines.groupBy("path").agg(*[
        F.max(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, (name, _) in REPORT_KEYS.items()])
    typed = []
    for name, kind in REPORT_KEYS.values():
        c = F.split(F.col(name), " +").cast(kind) if kind.startswith("array") else F.col(name).cast(kind)
        typed.append((valid_score(c) if name == "score" else c).alias(name))
    return picked.select(F.regexp_extract("path", r"Worker_(\d+)/", 1).cast("int").alias("worker"),
                         F.regexp_extract("path", r"Model_(\d+)/", 1).cast("int").alias("model"), *typed)


def append_history(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows (a generation or an epoch) to a history table."""
    writer = df.write.mode("append").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
