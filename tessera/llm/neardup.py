"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

Two collections of M short keys are made for each document, each key from r minhashes. The keys of the M * M
tables are the pairs of one key from either collection, so 2 * M * r minhashes serve M * M tables of 2 * r
hashes each. A pair of similarity s shares a table unless all M keys of a collection differ: its chance to be
missed is below 2 * (1 - s^r)^M. With r as chosen for the threshold that is 2e-5 at s = 0.85, 4e-4 at s = 0.8
and at most MISS anywhere from the threshold on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, give_back, stored
from tessera.llm.registry import query, table
from tessera.runtime import cut_lineage

M = 12
MISS = 1e-3
BLOCK = 1 << 14  # shingles that are hashed at once
HOT = 64  # nodes of a bucket up to which the pairs that are left are made rows
NODES = 256  # nodes in a block of a larger bucket


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    Words are runs of other characters than space, tab and the line breaks up to 0x0D, with A-Z in lower
    case. A text with fewer words is one shingle, one without words has none.
    """
    import xxhash

    parts = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def hashes_per_key(percent: int) -> int:
    """The most minhashes in a short key, up to 3, that keep the chance to miss a pair at the threshold below MISS."""
    return max([r for r in (1, 2, 3) if 2 * (1 - (percent / 100) ** r) ** M <= MISS], default=1)


def half_keys(shingles: np.ndarray, r: int = 3) -> np.ndarray:
    """The 2 * M short keys of a set; a key holds its place, so keys of different places don't meet."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, (2 * M * r, 1), dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, (2 * M * r, 1), dtype=np.uint64)
    low = np.full(2 * M * r, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), BLOCK):
        low = np.minimum(low, ((shingles[i:i + BLOCK] ^ b) * a).min(axis=1))
    low = low.reshape(2 * M, r)
    keys = np.arange(2 * M, dtype=np.uint64) + np.uint64(1)
    for k in range(r):
        keys = (keys ^ low[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketches(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (size of the shingle set), ``fp`` (128 bits of the whole set) and the short ``keys``."""
    r = hashes_per_key(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, fp, keys = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(half_keys(s, r))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(keys) + 1) * 2 * M, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()),
                                              pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "n", "fp", "keys"])
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, fp binary, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * |both| >= percent * |either|."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:  # rows come sorted by a
                    last, first = a, shingle_set(ta.as_buffer().to_pybytes(), words)
                second = shingle_set(tb.as_buffer().to_pybytes(), words)
                both = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * both >= percent * (len(first) + len(second) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    second = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def confirmed_in_blocks(crowded: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different roots in crowded buckets, without a row for each pair.

    The nodes outside a bucket's largest component are compared with all of the bucket, one block of either
    in a task. A node gets one link to each root that it reaches.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_buffer().to_pybytes(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "set"])

    ids = crowded.select("id").distinct()
    whole = stored(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(sets, "id long, set binary"), "sets")
    parts = lambda c: F.ceil(F.col(c) / NODES).cast("int")
    block = lambda c: F.pmod(F.xxhash64("id"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    asks = crowded.where("root <> top").select("key", "id", "root", F.lit(0).alias("side"), block("rest").alias("x"), every("size").alias("y"))
    told = crowded.withColumn("y", block("size")).select("key", "id", "root", F.lit(1).alias("side"), every("rest").alias("x"), "y")
    rows = asks.unionByName(told).join(whole, "id").select("key", "x", "y", "side", "id", "root", "set")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, index = None, [], None
        for batch in batches:
            a, b = [], []
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for k, raw in enumerate(batch.column(6)):
                at, side, node, root = (cols[0][k], cols[1][k], cols[2][k]), cols[3][k], cols[4][k], cols[5][k]
                if at != cell:
                    cell, asking, index = at, [], None
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if side == 0:
                    asking.append((node, root, s))
                    continue
                if index is None:
                    values = np.concatenate([np.zeros(0, np.uint64), *[x[2] for x in asking]])
                    by = np.argsort(values, kind="stable")
                    owner = np.repeat(np.arange(len(asking)), [len(x[2]) for x in asking])[by]
                    index = (values[by], owner, np.array([len(x[2]) for x in asking]), np.array([x[1] for x in asking]), [set() for _ in asking])
                values, owner, size, roots, reached = index
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = hi - lo
                both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(asking))
                for i in np.flatnonzero((100 * both >= percent * (size + len(s) - both)) & (roots != root)).tolist():
                    if root not in reached[i]:
                        reached[i].add(root)
                        a.append(min(node, asking[i][0]))
                        b.append(max(node, asking[i][0]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def sharing(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Ids of the texts of which at least ``percent`` of the shingles occur in another of the texts.

    A link needs as much: what two sets have in common is a part of either.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingle_set(t.as_buffer().to_pybytes(), words) for t in part.column(1)]
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)),
                                                  pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["id", "size", "shingle"])

    rows = texts.select("id", "text").mapInArrow(run, "id long, size long, shingle long")
    often = cut_lineage(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle"))
    held = rows.join(often, "shingle", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    return held.where(F.col("c") * 100 >= F.col("size") * percent).select("id")


def _close(x: str, y: str, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def across(few: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes ``key, id, n, root, u, v, top`` of different roots that share a key of ``u`` and one of ``v``.

    A pair is made at one of its shared keys only: the smallest, as the lists come in any order.
    """
    centres = few.where("root <> top").select("key", *[F.col(x).alias("c" + x) for x in ("id", "n", "root", "u", "v")])
    pairs = few.join(stored(centres, "centres"), "key").where(
        (F.col("root") != F.col("croot")) & _close("cn", "n", percent) & F.arrays_overlap("v", "cv")
        & (F.col("key") == F.array_min(F.array_intersect("u", "cu"))))
    return pairs.select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b")).distinct()


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if their shingle sets overlap by ``percent`` or more; a component is what links
    reach, named by its smallest id, which is the one kept. Documents without words are linked with nothing
    and kept. Ids identify texts: a row repeated with its id gives a row each, all in one component. A null
    text has no words; a null id gets a null component. Further columns are ignored.

    Equal sets become one node first. Nodes that share a short key with no other node leave. In each bucket of
    a table all nodes are compared with the smallest one. Where a bucket still holds several components, nodes
    with too few shingles in common with all others there leave, and those outside the largest component are
    compared with all others, in large buckets block by block. None is left out: in the end every two nodes of
    a bucket are in one component, have been compared, or can't be linked.
    """
    sketch = stored(sketches(docs, words, percent, id_col, text_col), "sketches")
    nodes = stored(sketch.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"),
                                                          F.first("keys").alias("keys")), "nodes")
    # short keys that more than one node has
    halves = nodes.select("id", "n", F.posexplode("keys").alias("place", "key"))
    shared = cut_lineage(halves.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    held = halves.join(shared, "key", "left_semi")
    held = stored(held.groupBy("id", "n").agg(F.collect_list(F.when(F.col("place") < M, F.col("key"))).alias("u"),
                                       F.collect_list(F.when(F.col("place") >= M, F.col("key"))).alias("v")), "held")  # at most M each
    rows = held.select("id", "n", F.explode("u").alias("u"), "v").select("id", "n", "u", F.explode("v").alias("v"))
    rows = rows.select(F.xxhash64("u", "v").alias("bucket"), "id", "n")
    rows = stored(rows, "buckets")
    stars = cut_lineage(rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("size"))
                        .where("size > 1").select("bucket", F.col("c.id").alias("a"), F.col("c.n").alias("an")))
    pairs = (rows.join(stars, "bucket").where((F.col("id") > F.col("a")) & _close("an", "n", percent))
             .select("a", F.col("id").alias("b")).distinct())
    pairs = cut_lineage(pairs)
    wanted = cut_lineage(rows.join(stars.select("bucket"), "bucket", "left_semi").select("id").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = stored(texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "texts")
    links = cut_lineage(confirmed(pairs, texts, words, percent))
    roots = cut_lineage(connected_components(links))

    # nodes of the buckets that hold more than one component, and of them those that share enough to be linked at all
    spread = rows.join(stars.select("bucket"), "bucket", "left_semi").join(roots.withColumnRenamed("node", "id"), "id", "left")
    spread = spread.withColumn("root", F.coalesce("root", "id"))
    mixed = spread.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    unsure = cut_lineage(rows.join(cut_lineage(mixed.select("bucket")), "bucket", "left_semi").select("id").distinct())
    unsure = stored(held.join(unsure, "id", "left_semi").join(sharing(texts.join(unsure, "id", "left_semi"), words, percent), "id"), "unsure")
    # nodes of a table share a key of either collection: they meet by the first, and compare the second
    meet = unsure.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    meet = stored(meet.withColumn("key", F.explode("u")), "meet")
    by_root = meet.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = (by_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots"))
               .where("roots > 1").select("key", F.col("top.root").alias("top"), "size", (F.col("size") - F.col("top.c")).alias("rest")))
    largest = cut_lineage(largest)
    few = meet.join(largest.where(F.col("size") <= HOT), "key")
    more = across(few, percent)
    more = cut_lineage(more.join(pairs, ["a", "b"], "left_anti"))
    crowded = meet.join(largest.where(F.col("size") > HOT), "key").select("key", "id", "root", "top", "size", "rest")
    links = links.unionByName(confirmed(more, texts, words, percent)).unionByName(confirmed_in_blocks(crowded, texts, words, percent))
    roots = cut_lineage(connected_components(cut_lineage(links)))
    groups = nodes.select("fp", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    groups = stored(groups.select("fp", F.coalesce("root", "id").alias("root")), "groups")
    out = sketch.select("doc_id", "n", "fp").join(groups, "fp", "left")
    root = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"),
                      F.col("doc_id").eqNullSafe(root).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each component, whole."""
    gone = near_components(docs, words, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(stored(gone, "gone"), F.col(id_col) == F.col("_gone"), "left_anti")


@query("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=3, percent=85)
