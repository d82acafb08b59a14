"""Exact top-k by inner product: dual-tree search over one cover tree of queries and data.

A cover tree of bounded size is fitted on a bounded sample; every row, query or not, then goes down to a leaf, and
the covering radius of each node is measured on all rows below it. For a query node with centre a and radius r and a data
node with centre b and radius s, all scores lie within r|b| + s|a| + rs of <a, b>. That bounds from below the kth
best score of every query in the node (by data nodes that hold enough rows), and from above what a data node can
offer, so node pairs are pruned before any row moves. What is left goes to blocks of queries, best bound
first; a block of queries skips every data chunk whose bound is below its worst kth score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.registry import query, table

SAMPLE = 4_096  # rows that the tree is fitted on, about, chosen by hash; all rows are indexed
LEAVES = 128  # leaves at most
QUERY_BLOCK = 512  # queries that are answered together
CHUNK = 2_048  # data rows of a leaf that travel together
SLICES = 8  # tasks that share the data of a query block


class CoverTree:
    """Levels of centres; the covering distance halves from level to level; each centre has a parent in the level above."""

    def __init__(self, sample: np.ndarray):
        root = sample[[int(np.argmin(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]] if len(sample) else np.zeros((1, sample.shape[1]))
        self.levels, self.parents = [root], [np.zeros(1, np.int64)]
        reach = float(np.sqrt(((sample - root[0]) ** 2).sum(axis=1).max(initial=0.0)))
        while reach > 1e-9:
            reach /= 2
            at, centres, parents = self.descend(sample)[0], [], []
            for node in range(len(self.levels[-1])):
                own = sample[at == node]
                centres.append(self.levels[-1][node])  # a node covers itself on the next level
                parents.append(node)
                far = ((own - centres[-1]) ** 2).sum(axis=1)
                while len(own) and far.max() > reach * reach and len(centres) <= LEAVES:
                    new = own[int(far.argmax())]
                    centres.append(new)
                    parents.append(node)
                    far = np.minimum(far, ((own - new) ** 2).sum(axis=1))
            if len(centres) > LEAVES:
                break
            self.levels.append(np.array(centres))
            self.parents.append(np.array(parents))

    def descend(self, rows: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Node of each row on a level (the last by default), and the row's distance from its centre."""
        at = np.zeros(len(rows), np.int64)
        for level in range(1, len(self.levels) if depth is None else depth + 1):
            new = np.zeros(len(rows), np.int64)
            for node in np.unique(at):
                mine, below = np.flatnonzero(at == node), np.flatnonzero(self.parents[level] == node)
                c = self.levels[level][below]
                d = (c ** 2).sum(axis=1)[None, :] - 2 * rows[mine] @ c.T
                new[mine] = below[d.argmin(axis=1)]
            at = new
        centres = self.levels[-1 if depth is None else depth]
        return at, np.sqrt(((rows - centres[at]) ** 2).sum(axis=1))


def matrix(vectors: list, dim: int) -> np.ndarray:
    """Rows of a list of lists, shorter ones filled with zeros."""
    if vectors and all(len(v) == dim for v in vectors):
        return np.array([np.asarray(v, np.float64) for v in vectors])
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number rows."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if most < 2.0 ** 53:  # exact in doubles
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k best scores of each query of a block, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.row = self.score = self.found = np.zeros(0, np.int64)
        self.worst = np.full(len(ids), np.iinfo(np.int64).min)

    def offer(self, ids: np.ndarray, rows: np.ndarray) -> None:
        s = products(self.rows, rows)
        good = (s >= self.worst[:, None]) & (ids[None, :] != self.ids[:, None])
        if rows.shape[0] > self.k:  # no row needs more than its k best of a chunk, and their ties
            cut = np.partition(np.where(good, s, np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
            good &= s >= cut[:, None]
        r, c = np.nonzero(good)
        row, score, found = np.append(self.row, r), np.append(self.score, s[r, c]), np.append(self.found, ids[c])
        by = np.lexsort((found, -score, row))
        row, score, found = row[by], score[by], found[by]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        self.row, self.score, self.found = row[keep], score[keep], found[keep]
        count = np.bincount(self.row, minlength=len(self.ids))
        last = np.cumsum(count) - 1
        full = count == self.k
        self.worst[full] = self.score[last[full]]


def top_k(rows: DataFrame, queries: str, k: int, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k rows with the largest integer inner products.

    ``rows`` has whole-number vectors (arrays of doubles); ``queries`` is an SQL condition that marks the query
    rows. Ties go to the smaller id; a query is no candidate for itself (nor are rows that repeat its id). Null
    vectors and ids take no part; shorter vectors count as filled with zeros. Fewer rows than k give all.
    """
    rows = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.expr(queries).alias("asks"))
    total, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("id", "vec").orderBy("id").collect()  # about SAMPLE rows
    tree = CoverTree(matrix([r["vec"] for r in sample], dim))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = matrix(f["vec"].tolist(), dim)
            leaf, far = tree.descend(x)
            yield pd.DataFrame({"id": f["id"], "asks": f["asks"].fillna(False), "leaf": leaf, "far": far, "bytes": [v.tobytes() for v in x]})

    placed = stored(rows.mapInPandas(place, "id long, asks boolean, leaf long, far double, bytes binary"), "placed")
    stats = {r["leaf"]: r for r in placed.groupBy("leaf").agg(  # at most LEAVES rows
        F.count(F.lit(1)).alias("n"), F.max("far").alias("r"), F.sum(F.col("asks").cast("long")).alias("nq")).collect()}
    n_queries = sum(r["nq"] for r in stats.values())
    # query nodes: the finest level that still has about a block of queries per node
    depth = max(d for d, c in enumerate(tree.levels) if d == 0 or len(c) * QUERY_BLOCK <= n_queries)
    node_of = np.arange(len(tree.levels[-1]))
    for level in range(len(tree.levels) - 1, depth, -1):
        node_of = tree.parents[level][node_of]
    leaves = np.array(sorted(stats), np.int64)
    centre, radius = tree.levels[-1][leaves], np.array([stats[i]["r"] for i in leaves]) * (1 + 1e-9) + 1e-6
    asked = np.unique(node_of[[i for i in leaves if stats[i]["nq"]]]) if n_queries else np.zeros(0, np.int64)
    work, sizes = [], []
    for node in asked:
        a = tree.levels[depth][node]
        mine = [i for i, x in enumerate(leaves) if node_of[x] == node]
        r = max(float(np.sqrt(((centre[i] - a) ** 2).sum()) + radius[i]) for i in mine)
        mid = centre @ a
        slack = r * np.sqrt((centre ** 2).sum(axis=1)) + radius * np.sqrt((a ** 2).sum()) + r * radius
        enough = np.array([stats[i]["n"] > k for i in leaves])
        floor = (mid - slack)[enough].max(initial=-np.inf)
        work += [(int(node), int(leaf), float(u)) for leaf, u in zip(leaves, mid + slack) if u >= floor]
        blocks = -(-sum(stats[leaves[i]]["nq"] for i in mine) // QUERY_BLOCK)
        sizes.append((int(node), int(blocks)))
    spark = rows.sparkSession
    work = spark.createDataFrame(work, "node long, leaf long, bound double")  # at most LEAVES ^ 2 rows
    sizes = spark.createDataFrame(sizes, "node long, blocks int")
    parents = spark.createDataFrame([(int(i), int(node_of[i]), int(-(-stats[i]["n"] // CHUNK))) for i in leaves], "leaf long, node long, parts int")

    def pack(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
        """Rows of one key, which come one after another, as arrays of at most ``most`` rows."""
        for f in frames:
            for key, g in f.groupby(["k1", "k2"], sort=False):
                for lo in range(0, len(g), most):
                    p = g.iloc[lo:lo + most]
                    yield pd.DataFrame({"k1": [key[0]], "k2": [key[1]], "ids": [p["id"].to_numpy(np.int64).tobytes()], "bytes": [b"".join(p["bytes"])]})

    packed = "k1 long, k2 long, ids binary, bytes binary"
    keyed = placed.join(F.broadcast(parents), "leaf")
    chunks = keyed.select(F.col("leaf").alias("k1"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("k2"), "id", "bytes")
    chunks = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInPandas(lambda fs: pack(fs, CHUNK), packed)
    chunks = chunks.select(F.col("k1").alias("leaf"), "ids", "bytes").withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(SLICES)))
    data = (chunks.join(F.broadcast(work), "leaf").join(F.broadcast(sizes), "node")
            .select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), "slice", "bound", "ids", "bytes"))
    asking = keyed.where("asks").join(F.broadcast(sizes), "node").select(
        F.col("node").alias("k1"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("long").alias("k2"), "id", "bytes")
    asking = asking.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInPandas(lambda fs: pack(fs, QUERY_BLOCK), packed)
    asking = asking.select(F.col("k1").alias("node"), F.col("k2").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).alias("slice"),
                           F.lit(None).cast("double").alias("bound"), "ids", "bytes")
    both = asking.unionByName(data).repartition("node", "block", "slice")
    both = both.sortWithinPartitions("node", "block", "slice", F.col("bound").desc_nulls_first())

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, blocks = None, []

        def answers() -> Iterator[pd.DataFrame]:
            for b in blocks:
                yield pd.DataFrame({"query_id": b.ids[b.row], "vec_id": b.found, "score": b.score})

        for f in frames:
            for node, block, part, bound, ids, raw in f.itertuples(index=False):
                if (node, block, part) != key:
                    yield from answers()
                    key, blocks = (node, block, part), []
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(raw, np.float64).reshape(-1, dim)
                if bound != bound:  # null: queries of the block
                    blocks.append(Best(ids, x, k))
                    continue
                for b in blocks:
                    if bound >= b.worst.min():
                        b.offer(ids, x)
        yield from answers()

    found = both.mapInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def whole_vectors(df: DataFrame, vec_col: str, factor: int = 64) -> DataFrame:
    """Components as floor(factor * x); vectors that are null or hold null, NaN or infinite components become null."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.withColumn("vec", F.when(fine, F.transform(x, lambda v: F.floor(v * factor).cast("double"))))


@query("op1_cover_tree_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op1_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(table(spark, sf_dir, "embeddings"), "embedding")
    return top_k(rows, "vec_id % 20 = 0", 20)
