"""Level tables: partitioned parquet, and the text form read by flow solvers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.grid import level_counts

# first line, version and number formats of the text form; so are the section titles below (fixed values)
TITLE = "Dragon library"
VERSION = "1.1.0"
NUMBER_FORMAT = "%+.14e"
LEVEL_FORMAT = "%+.16e"
WEIGHT_FORMAT = "%+.4e * %s"


def write_level_table(nodes: DataFrame, triangles: DataFrame, hull: DataFrame, path: str, level: str = "level") -> None:
    for name, df in (("nodes", nodes), ("triangles", triangles), ("hull", hull)):
        df.write.mode("overwrite").partitionBy(level).parquet(f"{path}/{name}")


def _numbers(form: str, columns: Sequence[Column]) -> Column:
    """Numbers with tabs between, rounded from their exact binary values as C's printf does."""
    line = "\t".join([form] * len(columns))

    @F.pandas_udf("string")
    def text(*values: pd.Series) -> pd.Series:
        return pd.Series([line % row for row in zip(*[v.to_numpy(dtype=float) for v in values])], dtype=object)

    return text(*[c.cast("double") for c in columns])


def _section(n: int, df: DataFrame, level: str, order: str, line) -> DataFrame:
    """Text rows of one data section with a sort position ``(part, level, seq, order)``."""
    body = df.select(F.lit(n).alias("part"), F.col(level).cast("long").alias("lv"), F.lit(1).alias("seq"),
                     F.col(order).cast("long").alias("ord"), line.alias("value"))
    marks = df.select(level).distinct().select(F.lit(n).alias("part"), F.col(level).cast("long").alias("lv"), F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("<Level>").alias("value")),
        F.struct(F.lit(2).alias("seq"), F.lit("</Level>").alias("value")))).alias("m")).select(
        "part", "lv", "m.seq", F.lit(0).cast("long").alias("ord"), "m.value")
    return body.unionByName(marks)


def level_table_text(nodes: DataFrame, triangles: DataFrame, hull: DataFrame, levels: DataFrame,
                     variables: Sequence[str], weights: dict[str, float], level: str = "level",
                     node: str = "node", title: str = TITLE, version: str = VERSION) -> DataFrame:
    """Lines of the text form, with the columns that order them.

    ``nodes(level, node, <variables>)`` numbers nodes from 0 within a level, ``triangles(level, tri,
    a, b, c)`` and ``hull(level, seq, node)`` refer to them, ``levels(level, level_value)``.
    """
    spark = nodes.sparkSession
    counts = level_counts(nodes, triangles, hull, level)
    n_levels = levels.agg(F.count(F.lit(1)).alias("n"))

    def fixed(part: int, text: Sequence[str]) -> DataFrame:
        return spark.createDataFrame([(part, -1, 0, i, t) for i, t in enumerate(text)],
                                     "part int, lv long, seq int, ord long, value string")

    def per_level(part: int, df: DataFrame, value) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col(level).cast("long").alias("lv"), F.lit(0).alias("seq"),
                         F.lit(0).cast("long").alias("ord"), value.alias("value"))

    definition = "+".join(WEIGHT_FORMAT % (w, s) for s, w in weights.items())
    tab = _numbers(NUMBER_FORMAT, [F.col(f"`{v}`") for v in variables])
    cells = F.concat_ws("\t", *[(F.col(c) + 1).cast("string") for c in ("a", "b", "c")])
    pieces = [
        fixed(0, [title, "", "<Header>", "", "[Version]", version, "", "[Progress variable definition]", definition, "",
                  "[Number of table levels]"]),
        n_levels.select(F.lit(1).alias("part"), F.lit(-1).cast("long").alias("lv"), F.lit(0).alias("seq"),
                        F.lit(0).cast("long").alias("ord"), F.col("n").cast("string").alias("value")),
        fixed(2, ["", "[Table levels]"]), per_level(3, levels, _numbers(LEVEL_FORMAT, [F.col("level_value")])),
        fixed(4, ["", "[Number of points]"]), per_level(5, counts, F.col("nodes").cast("string")),
        fixed(6, ["", "[Number of triangles]"]), per_level(7, counts, F.col("triangles").cast("string")),
        fixed(8, ["", "[Number of hull points]"]), per_level(9, counts, F.col("hull_points").cast("string")),
        fixed(10, ["", "[Number of variables]", str(len(variables)), "", "[Variable names]",
                   *[f"{i + 1}:{v}" for i, v in enumerate(variables)], "", "</Header>", "", "<Data>"]),
        _section(11, nodes, level, node, tab),
        fixed(12, ["</Data>", "", "<Connectivity>"]),
        _section(13, triangles, level, "tri", cells),
        fixed(14, ["</Connectivity>", "", "<Hull>"]),
        _section(15, hull, level, "seq", (F.col("node") + 1).cast("string")),
        fixed(16, ["</Hull>", ""]),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


LINES_PER_FILE = 250_000


def write_level_text(lines: DataFrame, path: str, lines_per_file: int = LINES_PER_FILE) -> None:
    """Write the lines as ordered part files, as many as their number asks for; read in name order they are the whole document."""
    order = ["part", "lv", "seq", "ord"]
    parts = -(-lines.count() // lines_per_file) or 1
    (lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value")
     .write.mode("overwrite").text(path))


@dataclass(frozen=True)
class LevelTable:
    """A table that was read: ``levels (level, level_value)``, ``nodes (level, node, <variables>)``, ``triangles (level, tri, a, b, c)``, ``hull (level, seq, node)``."""

    levels: DataFrame
    nodes: DataFrame
    triangles: DataFrame
    hull: DataFrame
    variables: list[str]


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the title above them (``section``, ``mark``), the level, and their number below the title.

    Every part file is read by one task, which numbers its lines since the last title. What stands above the first
    title of a file was begun in a file before: that is settled among the titles, of which a level has six.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "run", "mark", "n", "line"]
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                run, mark, n, rows = 0, None, 0, [(0, None, -1, "")]
                for line in text.splitlines():
                    if line[:1] in "<[" and line:
                        run, mark, n = run + 1, line, 0
                        rows.append((run, mark, -1, ""))
                    elif line:
                        rows.append((run, mark, n, line))
                        n += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()),
                                                  pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names)

    lines = files.mapInArrow(number, "file string, run int, mark string, n long, line string")
    runs = lines.groupBy("file", "run").agg(F.max("mark").alias("mark"), F.sum(F.when(F.col("n") >= 0, 1).otherwise(0)).alias("held"))
    w = Window.orderBy("file", "run")
    runs = runs.withColumns({"no": F.count("mark").over(w), "mark": F.last("mark", ignorenulls=True).over(w),
                             "section": F.last(F.when(F.col("mark").rlike("^</?(Header|Data|Connectivity|Hull)>"), F.col("mark")), ignorenulls=True).over(w),
                             "opened": F.sum(F.when(F.col("mark") == "<Level>", 1).otherwise(0)).over(w)})
    before = Window.partitionBy("no").orderBy("file", "run").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("section")
    runs = runs.withColumns({"skip": F.coalesce(F.sum("held").over(before), F.lit(0)),
                             "level": (F.col("opened") - F.min(F.when(F.col("mark") == "<Level>", F.col("opened"))).over(first)).cast("int")})
    return lines.where("n >= 0").drop("mark").join(runs.drop("held", "no", "opened"), ["file", "run"]).withColumn("n", F.col("n") + F.col("skip"))


def read_level_text(spark: SparkSession, path: str) -> LevelTable:
    """Read the text form back. Ids are from 0 again."""
    lines = _numbered_lines(spark, path)
    names = lines.where("mark = '[Variable names]'").select("n", F.regexp_extract("line", r"^\d+:(.*)$", 1).alias("v")).collect()
    variables = [r["v"] for r in sorted(names)]
    levels = lines.where("mark = '[Table levels]'").select(F.col("n").cast("int").alias("level"), F.col("line").cast("double").alias("level_value"))
    cells = F.split("line", "\t")

    def body(section: str) -> DataFrame:
        return lines.where((F.col("section") == section) & (F.col("mark") == "<Level>"))

    nodes = body("<Data>").select("level", F.col("n").alias("node"), *[cells[i].cast("double").alias(v) for i, v in enumerate(variables)])
    tris = body("<Connectivity>").select("level", F.col("n").alias("tri"), *[(cells[i].cast("long") - 1).alias(c) for i, c in enumerate("abc")])
    hull = body("<Hull>").select("level", F.col("n").alias("seq"), (F.col("line").cast("long") - 1).alias("node"))
    return LevelTable(levels, nodes, tris, hull, variables)
