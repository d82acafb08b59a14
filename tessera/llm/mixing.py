"""Mixing sources to target weights by Poisson replication. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.registry import query, table

PIECE = 16.0  # a larger mean is the sum of draws with means of at most this, which keeps each table of sums short
REST = "(rest)"


def _class(source: str, targets: dict[str, float]) -> Column:
    """The source itself if it has a target, else one common class: as many classes as targets, plus one."""
    named = F.col(source).isin([k for k in targets if k != REST])
    return F.when(named, F.col(source)).otherwise(F.lit(REST))


def mixing_rates(docs: DataFrame, targets: dict[str, float], total: int | None = None,
                 source: str = "source") -> DataFrame:
    """One row per class: ``class, n, rate`` and the Poisson sums that the inversion looks up.

    ``rate`` is the mean number of copies, total * weight / n, where n counts all documents of the class
    and the weights of the classes present are scaled to one. At most ``len(targets) + 1`` rows.
    """
    counts = docs.groupBy(_class(source, targets).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    weights = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))])
    counts = counts.withColumn("w", F.coalesce(weights[F.col("class")], F.lit(0.0)))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    rates = counts.withColumns({"w_all": F.sum("w").over(whole), "n_all": F.sum("n").over(whole)})
    budget = F.col("n_all") if total is None else F.lit(total)
    rates = rates.withColumn("rate", F.when(F.col("w_all") > 0, budget * F.col("w") / F.col("w_all") / F.col("n")).otherwise(0.0))
    rates = rates.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
    rates = rates.withColumn("mean", F.col("rate") / F.col("pieces"))
    # sums of the distribution up to where what is left is below the resolution of a draw
    last = (F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("sums"))
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("mean") / k).alias("p"),
        F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * F.col("mean") / k)).alias("sums"))
    sums = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["sums"])
    return rates.select("class", "n", "rate", "pieces", sums.alias("sums"))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def mix_sources(docs: DataFrame, targets: dict[str, float], total: int | None = None, seed: int = 0,
                id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Each document a Poisson number of times, in a random order: its columns, ``copy``, ``mix_key``.

    A document's draw is 52 bits of MD5(seed, id, piece) / 2^52, inverted on the Poisson sums of its class:
    the number of copies is the number of sums that do not exceed the draw. Runs and retries repeat the
    same draws. Copies are dealt to tasks by ``mix_key`` (MD5 of seed, id and copy) and sorted by it, so
    the rows that a task writes are a random part of the whole in random order.

    Sources without a target, and null, share the target named "(rest)" (none: weight 0, all dropped).
    Rows that repeat an id are drawn alike. Columns named ``copy`` or ``mix_key`` are replaced. An empty
    table gives an empty result. The joined table has at most ``len(targets) + 1`` rows.
    """
    rates = mixing_rates(docs, targets, total, source).select(
        F.col("class").alias("_class"), F.col("pieces").alias("_pieces"), F.col("sums").alias("_sums"))
    rows = docs.drop("copy", "mix_key").withColumn("_class", _class(source, targets)).join(F.broadcast(rates), "_class")

    def draw(piece: Column) -> Column:
        u = F.conv(F.substring(_hash(F.lit(seed), F.col(id_col), piece), 1, 13), 16, 10).cast("double") / float(1 << 52)
        return F.size(F.filter(F.col("_sums"), lambda s: s <= u))

    copies = F.aggregate(F.sequence(F.lit(0), F.col("_pieces") - 1), F.lit(0), lambda acc, j: acc + draw(j))
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    rows = rows.withColumn("mix_key", _hash(F.lit(seed), F.col(id_col), F.col("copy")))
    rows = rows.drop("_class", "_pieces", "_sums", "_copies")
    return rows.repartition("mix_key").sortWithinPartitions("mix_key")


#: the hot source takes a tenth of the mixture, three sources twice the share of the others
TARGETS = {"src0": 0.10} | {f"src{k}": 0.08 for k in (1, 2, 3)} | {f"src{k}": 0.04 for k in range(4, 20)} | {REST: 0.02}
SEED = 17

_WEIGHTS = ", ".join(f"('{k}', {v})" for k, v in TARGETS.items())


@query("op8_mix_sources", f"""
WITH t(class, w) AS (VALUES {_WEIGHTS}),
d AS (SELECT *, CASE WHEN source IN (SELECT class FROM t WHERE class <> '{REST}') THEN source ELSE '{REST}' END AS class
      FROM documents),
c AS (SELECT class, count(*) AS n, coalesce(any_value(w), 0.0)::DOUBLE AS w FROM d LEFT JOIN t USING (class) GROUP BY class),
r AS (SELECT class, (sum(n) OVER ()) * w / (sum(w) OVER ()) / n AS rate FROM c),
p AS (SELECT class, greatest(1, ceil(rate / {PIECE}))::INT AS pieces, rate / greatest(1, ceil(rate / {PIECE})) AS mean FROM r),
s AS (SELECT class, k, sum(exp(CASE WHEN k = 0 THEN 0.0 ELSE k * ln(mean) END - mean - lgamma(k + 1.0)))
             OVER (PARTITION BY class ORDER BY k) AS upto
      FROM p, range(0, 130) AS g(k) WHERE mean > 0 AND k <= floor(mean + 12 * sqrt(mean) + 40)),
u AS (SELECT doc_id, text, lang, source, n_chars, d.class, piece,
             ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || piece::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN p USING (class), range(0, 1000) AS h(piece) WHERE piece < pieces AND mean > 0),
n AS (SELECT doc_id, text, lang, source, n_chars,
             sum((SELECT count(*) FROM s WHERE s.class = u.class AND s.upto <= u.u)) AS copies
      FROM u GROUP BY doc_id, text, lang, source, n_chars)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS mix_key
FROM n, range(1, 1000000) AS g(copy) WHERE copy <= copies
""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), TARGETS, seed=SEED)
