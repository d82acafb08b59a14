"""Exact deduplication by 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table
from tessera.runtime import cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits of content: MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts form a group; the row with the smallest (``keep="min"``) or largest id stays. Texts are
    grouped by (hash, text): the hash spreads the rows, the text in the key compares the bytes, so two
    texts of one hash stay apart. Copies meet on the map side first, so a group of any size sends one row
    a task. A group is joined back to its rows by hash alone; only where one hash holds several texts
    (a collision) are the texts themselves joined.

    A null text counts as empty. A null id stays only if its group has no other id. A row repeated with
    the same id counts each time, and every row that carries ``keep_id`` is marked as kept. Further
    columns of ``docs`` are ignored.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", hashed(F.col("text")))
    texts = rows.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"),
                                    F.sum("n").alias("n")).where("n > 1")
    groups = cut_lineage(groups)  # both sides of the join are then plain exchanges, which Spark can split
    keyed = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    if groups.where("texts > 1").isEmpty():
        joined = keyed.join(groups.drop("texts"), "h", "left")
    else:
        mixed = groups.where("texts > 1").select("h")
        joined = keyed.join(groups.drop("texts"), "h", "left").join(mixed, "h", "left_anti")
        apart = rows.join(mixed, "h", "left_semi")
        own = apart.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        apart = apart.join(cut_lineage(own), ["h", "text"])
        joined = joined.unionByName(apart.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "n"))
    size = F.coalesce("n", F.lit(1)).cast("long")
    keep_id = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One whole row of ``docs`` per distinct text (null as empty), that of the smallest or largest id.

    Rows that tie on the id are told apart by a hash of their columns, so a rerun keeps the same one.
    """
    best = {"min": F.min_by, "max": F.max_by}[keep]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c not in (id_col, text_col)], F.lit(0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.groupBy(content_hash(text).alias("_h"), text.alias("_t")).agg(
        best(whole, F.struct(F.col(id_col), F.col(text_col).isNull(), tie)).alias("_row"))
    return one.select("_row.*")


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")
