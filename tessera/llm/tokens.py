"""Token ids in Parquet list columns that can be read by column, by document and by page.

The file format: Parquet (format version 2 pages) in ascending id order, part files in the same order.

| column | type | encoding |
| --- | --- | --- |
| doc_id | long | delta (dictionary off) |
| n_tokens | int | dictionary or delta, as the writer finds shorter |
| part | int | dictionary: number of the part file in the order |
| before | long | delta: ids of the documents before it in its part |
| ids | list of int | dictionary, one per row group |

Row groups and pages have fixed target sizes; the writer adds a column and an offset index to every file, so
a filter on ``doc_id`` reads only the pages it needs, and the metadata columns are read without the ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, per_process
from tessera.llm.registry import query, table
from tessera.runtime import checkpoint_dir

ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 5_000
CACHE_PIECES = 300_000  # pieces of text whose ids a worker remembers: those that it met first
SLICE_CHARS = 4 << 20  # text encoded at once

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
}


class WordEncoder:
    """Encodes texts with a Hugging Face tokenizer whose pre-tokenizer splits at white space.

    Texts of plain Latin characters are cut into the pre-tokenizer's own pieces; each distinct piece is
    encoded by the library once and its ids are reused. Any other text (or one that holds the start of a
    special token) goes to the library whole. Both ways give the library's ids.
    """

    def __init__(self, tokenizer_path: str):
        import json
        import re

        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.tok = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.last[[i for w, i in spec["model"]["vocab"].items() if suffix and w.endswith(suffix)]] = True
        self.by_word = bool(suffix)
        # the characters for which the cuts below are known to be the pre-tokenizer's; \xad and others stay out
        # and lower case is one character; \u0130 (two) stays out
        self.odd = "[^\\t\\n\\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-ɏ]|<\\|"
        # fixed values: the tokenizer's own pattern in the notation of re
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+|\n")
        self.known: dict[str, int] = {"\n": -1}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> tuple:
        """Ids of the pieces one after another, and the end of each."""
        np = self.np
        lines = [" ".join(pieces[i:i + 400]) for i in range(0, len(pieces), 400)]
        coded = self.tok.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *[np.asarray(e.ids, np.int32) for e in coded]])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):  # a piece without an end of its own
            coded = self.tok.encode_batch_fast(pieces, add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, np.int32) for e in coded])
            ends = np.cumsum([len(e.ids) for e in coded])
        return ids, ends

    def encode(self, texts: pa.Array | list[str]) -> tuple:
        """Ids of all texts one after another, and the number of ids of each."""
        import pyarrow.compute as pc

        np = self.np
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = pc.match_substring_regex(texts, self.odd) if self.by_word else pa.array(np.ones(len(texts), bool))
        held = pc.filter(texts, whole).to_pylist()
        other = dict(zip(np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist(), self.tok.encode_batch_fast(held, add_special_tokens=False)))
        # these characters are in the composed form already
        split = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(whole, "", texts)))
        chunk = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        order = chunk.indices.to_numpy().astype(np.int64)
        # the pieces of all distinct words in one go; a line end closes each word, an empty one too
        size = len(chunk.dictionary)
        lines = pa.LargeListArray.from_arrays(pa.array([0, size], pa.int64()), chunk.dictionary)
        pieces = self.cut.findall(pc.binary_join(lines, "\n")[0].as_py() + "\n") if size else []
        known, before = self.known, len(self.known)
        new = list(set(pieces).difference(known))
        ids, ends = self.learn(new)
        flat, ends = np.concatenate([self.flat, ids]), np.concatenate([self.ends, ends + len(self.flat)])
        known.update(zip(new, range(before - 1, before - 1 + len(new))))
        number = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        if len(known) <= CACHE_PIECES:
            self.flat, self.ends = flat, ends
        else:
            for p in new:
                del known[p]
        close = np.flatnonzero(number < 0)
        number = number[number >= 0]
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        spans = np.stack([begin[number], ends[number]], axis=1) if len(number) else np.zeros((0, 2), np.int64)
        # ids of each chunk one after another, then of each text
        per_chunk = np.concatenate([[0], close - np.arange(len(close))])
        piece_len = spans[:, 1] - spans[:, 0]
        piece_ids = flat[_ranges(np, spans[:, 0], piece_len)]
        piece_end = np.concatenate([[0], np.cumsum(piece_len)])
        lo, hi = piece_end[per_chunk[:-1]], piece_end[per_chunk[1:]]
        ids = piece_ids[_ranges(np, lo[order], (hi - lo)[order])]
        counts = np.zeros(len(texts), np.int64)
        word_end = np.concatenate([[0], np.cumsum((hi - lo)[order])])
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        counts[:] = word_end[ends[1:]] - word_end[ends[:-1]]
        if other:
            parts, at = [], 0
            for i, n in enumerate(counts.tolist()):
                if i in other:
                    parts.append(np.asarray(other[i].ids, np.int32))
                    counts[i] = len(parts[-1])
                else:
                    parts.append(ids[at:at + n])
                    at += n
            ids = np.concatenate(parts) if parts else ids
        return ids, counts


def _ranges(np, starts, lengths):
    """start, start + 1, ... for each start, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of positions whose sizes add up to about ``most``."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every whole text and write the ids in ascending id order.

    The rows are range-partitioned by id and sorted, so part files and the rows in them follow the ids.
    ``end_id`` is appended to each document. A null text counts as empty. Rows that repeat an id stay, next
    to each other in an order that depends on their texts; null ids come first. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tail = [] if end_id is None else [end_id]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        part, before = TaskContext.get().partitionId(), 0
        encoder = per_process(f"tokens {tokenizer_path}", lambda: WordEncoder(tokenizer_path))
        for b in batches:
            texts = b.column(1)
            for lo, hi in slices(pc.utf8_length(texts).to_pylist(), SLICE_CHARS):
                ids, counts = encoder.encode(texts.slice(lo, hi - lo))
                if tail:
                    ids = np.insert(ids, np.cumsum(counts), tail[0])
                    counts = counts + 1
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(counts, pa.int32()), pa.array(np.full(hi - lo, part), pa.int32()),
                    pa.array(before + ends[:-1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))],
                    ["doc_id", "n_tokens", "part", "before", "ids"])
                before += int(ends[-1])
            give_back()

    kind = dict(rows.dtypes)["doc_id"]
    coded = rows.mapInArrow(encode, f"doc_id {kind}, n_tokens int, part int, before long, ids array<int>")
    coded.write.options(**WRITER).mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``, the number of ids of all documents before; column pruning reads only what is used.

    Part starts are running sums over one row per part file (as many as shuffle partitions when writing).
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (rows.join(F.broadcast(starts), "part")
            .select("doc_id", (F.col("_base") + F.col("before")).cast("long").alias("start"),
                    F.col("n_tokens").cast("long").alias("n_tokens"), "ids"))


def with_crc32(rows: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """Replace the list column by the unsigned CRC-32 of its values as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != ids]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            ends = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            sums = np.array([zlib.crc32(values[4 * s:4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())], np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(sums)], [*kept, out])

    types = dict(rows.dtypes)
    return rows.select(*kept, ids).mapInArrow(crc, ", ".join([*[f"`{c}` {types[c]}" for c in kept], f"`{out}` long"]))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_crc32(read_tokens(spark, path))
