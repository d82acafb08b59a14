"""Runs of repeating words: every maximal stretch that repeats its first words, and texts without the repeats.

The texts of a slice become one sequence of word numbers in which every text is closed by a number that occurs
once, so nothing reaches over the end of a text.

* Harmonic grid: for every period p, words p apart are compared at the grid points 0, p, 2p, ... only, which
  adds up to a harmonic sum. A stretch of period p that is e periods long holds e grid points in a row that
  carry the same word. One pair in so many of such a row goes on, so no stretch is missed.
* Difference-cover extension: how far the sequence agrees with itself from both points of a pair on, and how
  far back. Only suffixes at positions of a difference cover modulo 13 are sorted (by blocks of 13 words, then
  by doubling). Any two positions reach sorted ones within a few steps: those words are compared, and the rest
  is a range minimum over the common prefixes of neighbours in the sorted order, kept in a sparse table. The
  sequence read backwards has a table of its own. Both are built from texts that hold a pair only.

Of the periods found for a stretch the smallest stays; the others are its multiples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back
from tessera.llm.registry import query, table
from tessera.llm.tokens import _ranges, slices

SLICE_BYTES = 4 << 20  # text handled at once; a longer text is handled alone
MODULUS, COVER = 13, (0, 1, 3, 9)  # fixed values: every difference modulo 13 lies between two of them


class Extensions:
    """Lengths of the common parts that begin at two positions of a sequence.

    ``seq`` holds numbers of at least 0; its last number occurs nowhere else.
    """

    def __init__(self, seq):
        import numpy as np

        self.np, self.n = np, len(seq)
        n, v = self.n, MODULUS
        self.seq = np.concatenate([seq, np.zeros(2 * v, seq.dtype)])
        inside = np.zeros(v, bool)
        inside[list(COVER)] = True
        # steps from positions of residue a, b = a + d to two sorted ones
        self.steps = np.array([[min((c - a) % v for c in COVER if inside[(c + d) % v]) for d in range(v)] for a in range(v)])
        sample = np.flatnonzero(inside[np.arange(n) % v])
        ranked = self.ranked_blocks(sample)
        levels, span = [ranked], v
        while int(levels[-1].max()) < len(sample):
            last = levels[-1]
            levels.append(self.numbered(sample, [last[sample].astype(np.int64) * (len(sample) + 1) + last[np.minimum(sample + span, n)]]))
            span *= 2
        self.rank = levels[-1]
        order = np.empty(len(sample), np.int64)
        order[self.rank[sample] - 1] = sample
        self.table = self.minima(self.shared(order, levels))

    def numbered(self, sample, keys):
        """Numbers from 1 for the positions ``sample`` in the order of their keys (equal keys: one number); else 0."""
        np = self.np
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(sample), bool)
        new[:1] = True
        for key in keys:
            k = key[order]
            new[1:] |= k[1:] != k[:-1]
        out = np.zeros(self.n + 1, np.int32)
        out[sample[order]] = np.cumsum(new)
        return out

    def ranked_blocks(self, sample):
        """The order of the blocks of MODULUS words, several words packed into one number."""
        np = self.np
        bits = max(int(self.seq.max()).bit_length(), 1)
        per, keys = max(1, 62 // bits), []
        for first in range(0, MODULUS, per):
            key = np.zeros(len(sample), np.int64)
            for t in range(first, min(first + per, MODULUS)):
                key = (key << bits) | self.seq[sample + t]
            keys.append(key)
        return self.numbered(sample, keys)

    def shared(self, order, levels):
        """Common prefix of every sorted suffix and the next one: by halving blocks, then word by word."""
        np = self.np
        a, b = order[:-1], order[1:]
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][a + length] == levels[k][b + length]
            length += same * (MODULUS << k)
        alive = np.ones(len(a), bool)
        for _ in range(MODULUS):
            alive &= self.seq[a + length] == self.seq[b + length]
            length += alive
        return length

    def minima(self, lcp):
        """Sparse table: row j holds the minimum over 2^j neighbours."""
        np = self.np
        rows = max(len(lcp), 1).bit_length()
        out = np.zeros((rows, max(len(lcp), 1)), np.int32)
        out[0, :len(lcp)] = lcp
        for j in range(1, rows):
            half, size = 1 << (j - 1), len(lcp) - (1 << j) + 1
            out[j, :size] = np.minimum(out[j - 1, :size], out[j - 1, half:half + size])
        return out

    def common(self, i, j):
        """How many words from ``i`` on equal those from ``j`` on (i and j differ)."""
        np, v = self.np, MODULUS
        steps = self.steps[i % v, (j - i) % v]
        length, alive = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for t in range(int(steps.max(initial=0))):
            alive &= (t >= steps) | (self.seq[i + t] == self.seq[j + t])
            length += alive & (t < steps)
        at = np.flatnonzero(alive)
        a, b = self.rank[i[at] + steps[at]] - 1, self.rank[j[at] + steps[at]] - 1
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        row = np.frexp((hi - lo).astype(np.float64))[1] - 1
        length[at] += np.minimum(self.table[row, lo], self.table[row, hi - (1 << row)])
        return length


def grid_pairs(np, seq, reach, least: int, exponent: int):
    """Positions i and periods p whose words i and i + p may lie in a run; ``reach[p - 1]`` ends the texts long enough for p."""
    found = []
    for p, limit in enumerate(reach, 1):
        grid = seq[:limit:p]
        same = grid[1:] == grid[:-1]
        row = max(exponent, least // p) - 1  # pairs in a row that every run has
        if len(same) < row:
            continue
        held = same[:len(same) - row + 1]
        for k in range(1, row):
            held = held & same[k:len(same) - row + 1 + k]
        first = np.flatnonzero(held)
        if not len(first):
            continue
        gap = np.flatnonzero(np.diff(first) > 1)
        begin, end = first[np.concatenate([[0], gap + 1])], first[np.concatenate([gap, [len(first) - 1]])] + row
        count = -(-(end - begin) // row)
        at = np.repeat(begin, count) + row * _ranges(np, np.zeros(len(count), np.int64), count)
        found.append((at * p, np.full(len(at), p)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(texts: list, least: int = 6, exponent: int = 4) -> tuple:
    """The runs of every text (an array of word numbers from 0): text, start, length and period, in this order."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], np.int64)
    by_size = np.argsort(-sizes, kind="stable")  # long ones first: those that can hold a period are a prefix
    top = 1 + max((int(t.max()) for t in texts if len(t)), default=0)

    def joined(chosen):
        """The chosen texts one after another, a number of its own before each and at the end."""
        n = sizes[chosen]
        begin = np.cumsum(n + 1) - n
        seq = np.empty(int(n.sum()) + len(chosen) + 1, np.int64)
        seq[np.concatenate([begin - 1, [len(seq) - 1]])] = top + np.arange(len(chosen) + 1)
        for b, k in zip(begin.tolist(), chosen.tolist()):
            seq[b:b + sizes[k]] = texts[k]
        return seq, begin

    nothing = np.zeros(0, np.int64)
    if not len(texts):
        return nothing, nothing, nothing, nothing
    seq, begin = joined(by_size)
    ends = begin + sizes[by_size]
    periods = np.arange(1, int(sizes.max()) // exponent + 1)
    enough = np.searchsorted(-sizes[by_size], -np.maximum(least, exponent * periods), side="right")
    reach = ends[np.maximum(enough, 1) - 1][enough > 0]
    small = seq.astype(np.int32) if top + len(texts) < 1 << 31 else seq
    i, p = grid_pairs(np, small, reach.tolist(), least, exponent)
    if not len(i):
        return nothing, nothing, nothing, nothing
    place = np.searchsorted(begin, i, side="right") - 1
    held, own = np.unique(place, return_inverse=True)
    i = i - begin[place]
    seq, begin = joined(by_size[held])
    i = i + begin[own]
    after = Extensions(seq).common(i, i + p)
    back = Extensions(seq[::-1].copy()).common(len(seq) - i, len(seq) - i - p)
    start, length = i - back, back + p + after
    real = np.flatnonzero(length >= np.maximum(least, exponent * p))
    start, length, p, own = start[real], length[real], p[real], own[real]
    order = np.lexsort((p, length, start))
    start, length, p, own = start[order], length[order], p[order], own[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p, own = start[new], length[new], p[new], own[new]
    text = by_size[held[own]]
    order = np.lexsort((p, start, text))
    return text[order], (start - begin[own])[order], length[order], p[order]


Rewrite = Callable[[object, list], list]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4,
              rewrite: Rewrite | None = None) -> DataFrame:
    """Per document ``doc_id, n_words, runs, collapsed``.

    Words are what spaces and the control characters 9 to 13 separate. A run is a stretch of words, at least
    ``least`` words and ``exponent`` times its smallest period long, that neither neighbour extends; ``runs``
    lists them by start and period (word numbers from 0). ``collapsed`` joins by one space the words that no run
    repeats: of a run, the words of its first period stay unless another run drops them. ``rewrite(id, words)``
    may replace the words (bytes) of a document first.

    Null and empty texts have no words. Null and repeated ids keep a row each; further columns are ignored; an
    empty table gives an empty table. A text is handled whole, however long.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in slices(sizes, SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                split = [(t or b"").split() for t in part.column(1).to_pylist()]
                if rewrite is not None:
                    split = [rewrite(k, words) for k, words in zip(part.column(0).to_pylist(), split)]
                yield pa.RecordBatch.from_arrays([part.column(0), *found(split)], ["doc_id", "n_words", "runs", "collapsed"])
            give_back()

    def found(split: list) -> list:
        from itertools import chain

        import numpy as np

        number = dict.fromkeys(chain.from_iterable(split))
        number.update(zip(number, range(len(number))))
        texts = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split]
        text, start, length, period = runs_of(texts, least, exponent)
        offsets = np.searchsorted(text, np.arange(len(split) + 1))
        kept = [b" ".join(words) for words in split]
        for k in np.unique(text).tolist():
            own = slice(offsets[k], offsets[k + 1])
            marks = np.zeros(len(split[k]) + 1, np.int64)
            np.add.at(marks, (start + period)[own], 1)
            np.add.at(marks, (start + length)[own], -1)
            kept[k] = b" ".join([w for w, drop in zip(split[k], np.cumsum(marks[:-1]).tolist()) if not drop])
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        return [pa.array([len(words) for words in split], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
                pa.array(kept, pa.binary()).cast(pa.string())]

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list) -> list:
    """The words of a document as the query takes them: the end of some documents repeats a part of itself."""
    import zlib

    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def run_digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period) and hashes of runs and kept words."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                       F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(find_runs(table(spark, sf_dir, "documents"), rewrite=planted))
