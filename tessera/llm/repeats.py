"""Removal of repeated byte strings: buckets of equal q-grams, refined by the identifiers of later q-grams.

Every byte that lies in a string of SPAN bytes which also starts anywhere else is removed. The work follows
bucket-pointer refinement of suffix sorting, on sampled offsets and spread over the cluster:

* Every offset has the identifier of its q-gram (64 bits). Of the q-grams in a window of SPAN bytes the one with the
  smallest identifier leads the window, in every place where the same bytes occur, so the windows of a text
  fall into runs with one leader each, and equal windows have equal leaders at equal distances.
* Leaders with equal q-grams form a bucket. A bucket of one leaves: none of its windows occurs elsewhere.
* Buckets are refined by the identifiers of the q-grams at later (and earlier) offsets that cover all windows of a
  run. If two leaders still agree, all their windows are repeated, and the leaders leave.
* What is left are runs at the border of a repeat. One leader per refined bucket goes with its bytes to a block of
  its first bucket, where the windows, again identified by q-grams at later offsets, are sorted. A bucket
  of many leaders takes many blocks; windows that are single in their block then meet those of other blocks,
  first by the part that a cell of windows shares, then one by one.

Identifiers are compared as 128 bits when a string counts as repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.registry import query, table
from tessera.runtime import cut_lineage

GRAM = 41  # bytes of a q-gram
BLOCK_LEADERS = 1024  # leaders of a bucket that are sorted together
CELL = 16  # neighbouring windows that are first compared by what they share
SLICE_BYTES = 1 << 19
MARGIN = 1 << 10  # bytes around a piece of a very long text that its leaders may need
_MAX = np.uint32(0xFFFFFFFF)


class Grams:
    """Identifiers of the q-grams of a buffer, under two independent hashes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
        self.bases = [int(x) * 2 + 1 for x in rng.integers(1 << 61, 1 << 62, 2)]
        self._powers(SLICE_BYTES + 4 * MARGIN)

    def _powers(self, size: int) -> None:
        self.size = size
        self.up, self.down = ([np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in bs]
                              for bs in (self.bases, [pow(b, -1, 1 << 64) for b in self.bases]))

    def load(self, buf: np.ndarray) -> None:
        self.n = len(buf)
        if self.n > self.size:
            self._powers(2 * self.n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[buf] * up[:self.n], dtype=np.uint64)])
                     for t, up in zip(self.tables, self.up)]

    def at(self, which: int, where: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return mixed((s[where + GRAM] - s[where]) * self.down[which][where])

    def every(self) -> np.ndarray:
        """The upper halves of the identifiers at all offsets, the largest number where none starts."""
        m = max(self.n - GRAM + 1, 0)
        out = np.full(self.n, _MAX)
        out[:m] = mixed((self.sums[0][GRAM:] - self.sums[0][:m]) * self.down[0][:m]) >> np.uint64(32)
        return out

    def string(self, which: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Identifier of the string of a length (GRAM at least): those of the q-grams that cover it, in order."""
        length = np.broadcast_to(length, start.shape)
        out = mixed(length.astype(np.uint64) + np.uint64(1))
        for k in range(0, int(length.max(initial=0)), GRAM):
            inside = k < length
            g = self.at(which, start[inside] + np.minimum(k, length[inside] - GRAM))
            out[inside] = mixed(out[inside] * np.uint64(0x9E3779B97F4A7C15) + g)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slide(values: np.ndarray, width: int, best, ahead: bool) -> np.ndarray:
    """Best of ``width`` neighbours from each place on (or up to it), by doubling."""
    out, span = values.copy(), 1
    while span < width:
        step = min(span, width - span)
        if ahead:
            out[:-step] = best(out[:-step], out[step:])
        else:
            out[step:] = best(out[step:], out[:-step])
        span += step
    return out


def leaders(grams: Grams, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one leader, in a buffer of texts that end at ``ends``: leader, first and last window start.

    The leader of a window is the last place of its smallest q-gram (by the upper half of the identifiers).
    """
    ids, width = grams.every(), span - GRAM + 1
    low = _slide(ids, width, np.minimum, True)
    ok = np.ones(grams.n, bool)  # windows that end inside their text
    for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        ok[max(begin, end - span + 1):end] = False
    cand = np.flatnonzero(ok_low(ids, low, ok, width))
    change = np.concatenate([[True], (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:] - 1, [grams.n - 1]])
    keep = ok[first]
    first, last = first[keep], last[keep]
    lead = _last_place(ids, cand, low[first], last + width - 1)
    split = (lead < last) | (lead > first + width - 1)  # the smallest q-gram occurs more than once: window by window
    if split.any():
        n = (last - first + 1)[split]
        one = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[split], n)
        own = _last_place(ids, cand, low[one], one + width - 1)
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (one[1:] != one[:-1] + 1)])
        at = np.flatnonzero(new)
        first = np.concatenate([first[~split], one[at]])
        last = np.concatenate([last[~split], one[np.concatenate([at[1:] - 1, [len(one) - 1]])]])
        lead = np.concatenate([lead[~split], own[at]])
    return lead, first, last


def _last_place(ids: np.ndarray, cand: np.ndarray, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The last candidate up to a place that has a value."""
    at = np.searchsorted(cand, upto, side="right") - 1
    wrong = np.flatnonzero(ids[cand[at]] != value)
    while len(wrong):
        at[wrong] -= 1
        wrong = wrong[ids[cand[at[wrong]]] != value[wrong]]
    return cand[at]


def ok_low(ids: np.ndarray, low: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Whether an id is the smallest of some window that counts."""
    return (ids != _MAX) & (_slide(np.where(ok, low, np.uint32(0)), width, np.maximum, False) == ids)


def pieces(ids: list, texts: list[bytes], span: int) -> Iterator[tuple[list, list[int], np.ndarray, np.ndarray, list]]:
    """Buffers of whole texts, or of one piece of a very long text with its surroundings.

    Gives ids, the offset of each text in the document, the buffer, its text ends, and the window starts
    (from, to) of the document that the piece answers for.
    """
    held, room = [], 0
    for i, t in zip(ids, texts):
        if len(t) < span:
            continue
        if len(t) > SLICE_BYTES:
            for s in range(0, len(t), SLICE_BYTES):
                lo, hi = max(0, s - MARGIN), min(len(t), s + SLICE_BYTES + MARGIN)
                buf = np.frombuffer(t[lo:hi], np.uint8)
                yield [i], [lo], buf, np.array([len(buf)]), [(s, s + SLICE_BYTES)]
            continue
        if room + len(t) > SLICE_BYTES and held:
            yield _joined(held)
            held, room = [], 0
        held.append((i, t))
        room += len(t)
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple:
    buf = np.frombuffer(b"".join(t for _, t in held), np.uint8)
    return [i for i, _ in held], [0] * len(held), buf, np.cumsum([len(t) for _, t in held]), [(0, len(t)) for _, t in held]


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def find_leaders(docs: DataFrame, span: int) -> DataFrame:
    """``doc, at`` (offset of the leader), ``lo, hi`` (its first and last window start), ``core`` and ``run``.

    ``core`` identifies the q-gram, ``run`` all the bytes of the run's windows together with their distances.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            for ids, offsets, buf, ends, parts in pieces(b.column(0).to_pylist(), _bytes(b.column(1)), span):
                grams.load(buf)
                lead, lo, hi = leaders(grams, ends, span)
                text = np.searchsorted(ends, lo, side="right")
                base = np.concatenate([[0], ends[:-1]])[text] - np.asarray(offsets)[text]
                if len(parts) == 1:  # a piece of a text: windows that it answers for
                    lo, hi = np.maximum(lo, parts[0][0] + base), np.minimum(hi, parts[0][1] - 1 + base)
                    keep = lo <= hi
                    lead, lo, hi, text, base = lead[keep], lo[keep], hi[keep], text[keep], base[keep]
                core = grams.at(0, lead)
                whole = grams.string(1, lo, hi - lo + span)
                whole = mixed(whole ^ mixed((lead - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.asarray(ids, np.int64)[text]), pa.array((lead - base).astype(np.int32)), pa.array((lo - base).astype(np.int32)),
                    pa.array((hi - base).astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["doc", "at", "lo", "hi", "core", "run"])

    return docs.mapInArrow(run, "doc long, at int, lo int, hi int, core long, run long")


def _window_ids(grams: Grams, f, ends: np.ndarray, span: int) -> tuple:
    """Of each window of a frame of leaders with their bytes: row, place in the row, and two identifiers."""
    count = (f["hi"] - f["lo"]).to_numpy(np.int64) + 1
    row = np.repeat(np.arange(len(f)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, start, *_identify(grams, f, ends, row, start, span, 0)


def _identify(grams: Grams, f, ends: np.ndarray, row: np.ndarray, start: np.ndarray, length: int, step: int) -> tuple:
    """Two identifiers of strings, of their leader's q-gram and of the distance to it (in cells of ``step`` windows)."""
    lead = (f["at"] - f["lo"]).to_numpy(np.int64)  # the bytes of a row start at its first window
    far = (lead[row] - start).astype(np.uint64) + np.uint64(step << 20)
    at = np.concatenate([[0], ends[:-1]])[row] + start
    core = f["core"].to_numpy()[row].view(np.uint64)
    return mixed(grams.string(0, at, length) ^ core), mixed(grams.string(1, at, length) ^ far)


def _spans(f, row: np.ndarray, start: np.ndarray, span: int):
    """Removed byte ranges (doc, first, last + 1) for repeated windows, neighbours joined."""
    import pandas as pd

    first = f["lo"].to_numpy(np.int64)[row] + start
    doc = f["doc"].to_numpy()[row]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(row) - 1]]) if len(at) else at
    return pd.DataFrame({"doc": doc[at], "first": first[at], "stop": first[last] + span})


def repeated_ranges(docs: DataFrame, span: int) -> DataFrame:
    """Byte ranges ``doc, first, stop`` that repeated strings of ``span`` bytes cover; ranges may overlap.

    ``docs`` has the columns ``doc`` and ``text``.
    """
    found = stored(find_leaders(docs, span), "found")
    cores = cut_lineage(found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("r0"), F.max("run").alias("r1"))
                        .where("n > 1").select("core", "n", (F.col("r0") == F.col("r1")).alias("even")))
    held = stored(found.join(cores, "core"), "leaders")
    whole = lambda rows: rows.select("doc", F.col("lo").alias("first"), (F.col("hi") + span).alias("stop"))
    out = whole(held.where("even"))

    mixed_rows = held.where("NOT even")
    classes = mixed_rows.groupBy("core", "run").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "at", "lo", "hi")).alias("one"), F.first("n").alias("n"))
    classes = stored(classes, "classes")
    out = out.unionByName(whole(mixed_rows.join(classes.where("c > 1").select("core", "run"), ["core", "run"], "left_semi")))

    # one leader of each class with its bytes, in blocks of its bucket
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_LEADERS)).cast("int")
    asked = classes.select("core", "one.*", (F.col("c") > 1).alias("sure"), blocks.alias("blocks"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("doc", "at"), F.col("blocks")).cast("int"))

    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("core", "at", "lo", "hi", "sure", "blocks", "block")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                lists = part.column(1)
                n = lists.value_lengths().to_numpy()
                flat = lists.flatten()
                lo, hi = flat.field(2).to_numpy(), flat.field(3).to_numpy()
                parts, at = [], 0
                for size, packed in zip(n.tolist(), part.column(2)):
                    text = unpack.decompress(packed.as_py())
                    parts += [text[x:y + span] for x, y in zip(lo[at:at + size].tolist(), hi[at:at + size].tolist())]
                    at += size
                docs_ = pa.array(np.repeat(part.column(0).to_numpy(), n))
                yield pa.RecordBatch.from_arrays([docs_, *[flat.field(i) for i in range(7)], pa.array(parts, pa.binary())],
                                                 ["doc", "core", "at", "lo", "hi", "sure", "blocks", "block", "bytes"])

    kinds = "doc long, core long, at int, lo int, hi int, sure boolean, blocks int, block int, bytes binary"
    contexts = asked.join(packed_texts(docs), "doc").select("doc", "asked", "packed").mapInArrow(cut, kinds)
    contexts = contexts.repartition("core", "block").sortWithinPartitions("core", "block")

    def resolve(frames: Iterator) -> Iterator:
        """Repeated windows of each block; of buckets of many blocks also the leaders that other blocks may need.

        Those are leaders with a window that is single in the block (which asks), and one for each window that
        is not (which only tells): ``windows`` holds 2 * window + 1 if it asks.
        """
        import pandas as pd

        grams = Grams()
        for f in _whole_blocks(frames):
            f = f.reset_index(drop=True)
            key = f["core"].to_numpy().view(np.uint64) ^ mixed(f["block"].to_numpy().astype(np.uint64))
            for lo, hi in _portions(f, key):
                g = f.iloc[lo:hi].reset_index(drop=True)
                ends = np.cumsum([len(x) for x in g["bytes"]])
                grams.load(np.frombuffer(b"".join(g["bytes"]), np.uint8))
                row, start, a, b = _window_ids(grams, g, ends, span)
                own = mixed(a ^ mixed(g["block"].to_numpy()[row].astype(np.uint64)))  # blocks of a bucket stay apart
                pair = np.stack([own, b], axis=1).view([("a", np.uint64), ("b", np.uint64)]).ravel()
                _, one, back, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                often, sure = count[back] > 1, g["sure"].to_numpy()[row]
                mine = often & ~sure
                yield _spans(g, row[mine], start[mine], span).assign(bytes=None, windows=None).reindex(columns=names)
                tells = ~often
                tells[one] = True  # one for each window of the block
                tells &= g["blocks"].to_numpy()[row] > 1
                code = (start * 2 + (~often & ~sure))[tells]
                left, first = np.unique(row[tells], return_index=True)
                h = g.iloc[left].copy()
                parts = np.split(code.astype(np.int32), first[1:]) if len(left) else []
                h["windows"] = pd.Series(parts, index=h.index, dtype=object)
                yield h.reindex(columns=names)

    names = ["doc", "first", "stop", "core", "at", "lo", "hi", "bytes", "windows"]
    found = contexts.mapInPandas(resolve, "doc long, first long, stop long, core long, at int, lo int, hi int, bytes binary, windows array<int>")
    found = stored(found, "windows")
    out = out.unionByName(found.where("first IS NOT NULL").select("doc", "first", "stop"))
    return out.unionByName(_across_blocks(found.where("first IS NULL").drop("first", "stop"), span))


def _across_blocks(left: DataFrame, span: int) -> DataFrame:
    """Repeated windows of leaders whose buckets have many blocks, by counts of identifiers."""
    def explode(frames: Iterator, cells: bool) -> Iterator:
        import pandas as pd

        grams = Grams()
        for f in frames:
            for lo in range(0, len(f), BLOCK_LEADERS):
                g = f.iloc[lo:lo + BLOCK_LEADERS].reset_index(drop=True)
                ends = np.cumsum([len(x) for x in g["bytes"]])
                grams.load(np.frombuffer(b"".join(g["bytes"]), np.uint8))
                row = np.repeat(np.arange(len(g)), [len(x) for x in g["windows"]])
                code = np.concatenate([np.zeros(0, np.int64), *g["windows"]]).astype(np.int64)
                start, asks = code >> 1, code & 1
                lead = (g["at"] - g["lo"]).to_numpy(np.int64)
                cell = (lead[row] - start) // CELL
                if cells:  # what all windows of a cell of distances have in common
                    row, cell = np.unique(np.stack([row, cell]), axis=1)
                    start, asks = lead[row] - cell * CELL, np.zeros(len(row), np.int64)
                    a, b = _identify(grams, g, ends, row, start, span - CELL + 1, CELL)
                else:  # only windows of the cells that are asked for
                    asked = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x) + i * (span + 1) for i, x in enumerate(g["cells"])]])
                    keep = np.isin(cell + row * (span + 1), asked)
                    row, start, asks, cell = row[keep], start[keep], asks[keep], cell[keep]
                    a, b = _identify(grams, g, ends, row, start, span, 0)
                yield pd.DataFrame({"doc": g["doc"].to_numpy()[row], "at": g["at"].to_numpy()[row], "cell": cell.astype(np.int32),
                                    "first": g["lo"].to_numpy(np.int64)[row] + start, "asks": asks > 0,
                                    "a": a.view(np.int64), "b": b.view(np.int64)})

    kinds = "doc long, at int, cell int, first long, asks boolean, a long, b long"
    cells = left.mapInPandas(lambda fs: explode(fs, True), kinds)
    often = cut_lineage(cells.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "b"))
    some = cells.join(often, ["a", "b"], "left_semi").groupBy("doc", "at").agg(F.collect_set("cell").alias("cells"))  # at most span / CELL
    asked = left.join(some, ["doc", "at"])
    windows = asked.mapInPandas(lambda fs: explode(fs, False), kinds)
    often = cut_lineage(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "b"))
    hit = windows.where("asks").join(often, ["a", "b"], "left_semi")
    return hit.select("doc", "first", (F.col("first") + span).alias("stop"))


def _whole_blocks(frames: Iterator) -> Iterator:
    """Frames cut so that no (core, block) lies in two of them. Rows come sorted by both."""
    import pandas as pd

    rest = None
    for f in frames:
        f = f if rest is None or not len(rest) else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        same = (f["core"] == f["core"].iat[-1]) & (f["block"] == f["block"].iat[-1])
        rest = f[same]
        if len(rest) < len(f):
            yield f[~same]
    if rest is not None and len(rest):
        yield rest


def _portions(f, key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of whole blocks that fit into a buffer."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    stop = np.append(new[1:], len(key))
    size = np.cumsum([len(x) for x in f["bytes"]])
    first = 0
    for k, s in enumerate(stop):
        nxt = stop[k + 1] if k + 1 < len(stop) else None
        base = size[first - 1] if first else 0
        if nxt is None or size[nxt - 1] - base > SLICE_BYTES:
            yield first, int(s)
            first = int(s)


def packed_texts(docs: DataFrame) -> DataFrame:
    """``doc`` and the compressed bytes of its text, for shuffles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packer.compress(t) for t in _bytes(b.column(1))], pa.binary())],
                                             ["doc", "packed"])

    return docs.select("doc", "text").mapInArrow(pack, "doc long, packed binary")


def remove_repeats(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, kept`` (bytes that are left), ``n_bytes, n_removed, n_spans``.

    A null text counts as empty. Texts of fewer than ``span`` bytes stay whole. Ids must identify rows: a row
    repeated with its id counts as a second document with the same text, so all of both is removed from
    ``span`` bytes on. Rows with a null id are left out. Further columns are ignored.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    ranges = repeated_ranges(rows, span).groupBy("doc").agg(F.collect_list(F.struct("first", "stop")).alias("ranges"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            kept, sizes, removed, spans = [], [], [], []
            lists = b.column(2)
            flat, bounds = lists.values, lists.offsets.to_numpy()
            first, stop = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            for k, packed in enumerate(b.column(1)):
                text = unpack.decompress(packed.as_py())
                mark = np.zeros(len(text) + 1, np.int32)
                if valid[k]:
                    lo, hi = bounds[k], bounds[k + 1]
                    np.add.at(mark, first[lo:hi], 1)
                    np.add.at(mark, stop[lo:hi], -1)
                gone = np.cumsum(mark)[:-1] > 0
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                sizes.append(len(text))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                                             ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    both = packed_texts(rows).join(ranges, "doc", "left").select("doc", "packed", "ranges")
    return both.mapInArrow(remove, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


@query("op4_repeated_strings")
def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
