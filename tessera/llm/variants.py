"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

Two words are near if one code point inserted, deleted or replaced makes one of the other. Of a word and a near
word that is not longer, the halves of the first are looked at: the edit touches one of them, so the other half
occurs unchanged at the same end of the near word. The search follows that in a bidirectional FM-index of the
vocabulary, in which a delimiter stands before, between and after the words:

* first half exact: from a delimiter through the first half to the right, then on across the second half with
  exactly one edit, up to a delimiter;
* second half exact: the same from the end of the word to the left.

The index holds the Burrows-Wheeler transforms of the text and of its reverse as wavelet matrices. A search
state is an interval of suffix ranks in both; a step in either direction narrows one and moves the other. The
words are indexed in order, so the rank of the suffix that a search ends in is the number of the word found.

The vocabulary is not gathered in one index. Words that share an exact half (and so can be near by it) share a
key, and keys are dealt to shards of bounded size, each with an index of its own. A key with more than ``group``
words is split: the part where the edit may lie is halved again, with one key for either half unchanged, and so
on, until few words share a key. That ends at the latest where one code point is open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back
from tessera.llm.registry import query, table
from tessera.llm.tokens import _ranges, slices
from tessera.runtime import cut_lineage

SLICE_BYTES = 1 << 20  # text whose words are held at once
HELD_WORDS = 60_000  # distinct words a task counts before it hands them on
SHARD_CHARS = 1 << 17  # code points of the words in one index, on average
GROUP = 1 << 12  # words that may share a key
ASKED = 1 << 11  # words searched for at once
END, GAP = 0, 1  # symbols of the text's end and of the delimiter; the others are code points in order


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 6, count: int = 5,
                alter: Callable[[object, list], list] | None = None) -> DataFrame:
    """``word, n`` of the words of at least ``chars`` code points and ``count`` occurrences in all texts.

    Words are maximal runs of the letters A-Z, a-z and the code points U+00C0 to U+00FF, with A-Z lower-cased.
    ``alter(id, words)`` may replace the words (bytes) of a document. Tasks count first, so a frequent word
    crosses the shuffle once a task. Null texts have no words; repeated rows count each time.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        import pyarrow.compute as pc

        words = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+").findall  # \xc3 begins U+00C0 to U+00FF in UTF-8
        seen: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            long = [w for w in seen if len(w) - w.count(b"\xc3") >= chars]
            out = pa.RecordBatch.from_arrays([pa.array(long, pa.binary()).cast(pa.string()), pa.array([seen[w] for w in long], pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in slices(sizes, SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        found = words(text.lower())  # of bytes: A-Z only
                        seen.update(found if alter is None else alter(k, found))
                if len(seen) > HELD_WORDS:
                    yield handed_on()
            give_back()
        yield handed_on()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Wavelet:
    """A sequence of small numbers as a wavelet matrix: ranks of a symbol and of all smaller ones at any place."""

    def __init__(self, seq, symbols: int):
        import numpy as np

        self.np, self.levels = np, max((symbols - 1).bit_length(), 1)
        self.ones, self.zeros = [], []
        counts = np.bincount(seq, minlength=symbols)
        self.smaller = np.cumsum(counts) - counts
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        counts = np.bincount(seq, minlength=symbols)
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        self.first = np.zeros(symbols, np.int64)  # where a symbol begins in the last order
        self.first[seq[first]] = first

    def narrow(self, lo, size, symbol):
        """Start and size of the interval of suffixes that ``symbol`` precedes, and how many smaller symbols precede others."""
        np = self.np
        hi, less = lo + size, np.zeros(len(lo), np.int64)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            less += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return self.smaller[symbol] + lo - self.first[symbol], hi - lo, less

    def narrow_all(self, lo, size):
        """The same for every symbol that occurs: the position it came from, symbol, start, size and smaller ones."""
        np = self.np
        hi, own = lo + size, np.arange(len(lo))
        less, symbol = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            left, right = (hi - b) > (lo - a), b > a
            less = np.concatenate([less[left], (less + (hi - b) - (lo - a))[right]])
            symbol = np.concatenate([2 * symbol[left], 2 * symbol[right] + 1])
            own = np.concatenate([own[left], own[right]])
            lo, hi = np.concatenate([(lo - a)[left], (zeros + a)[right]]), np.concatenate([(hi - b)[left], (zeros + b)[right]])
        return own, symbol, self.smaller[symbol] + lo - self.first[symbol], hi - lo, less


class WordIndex:
    """A bidirectional FM-index of distinct words in code-point order."""

    def __init__(self, words: list[str]):
        import numpy as np

        self.np = np
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.full(len(points) + len(words) + 2, GAP, np.int64)
        text[_ranges(np, np.cumsum(lengths + 1) - lengths, lengths)] = np.searchsorted(self.alphabet, points) + 2
        text[-1] = END
        self.size, symbols = len(text), len(self.alphabet) + 2
        # what precedes the suffixes of the text, and what follows its prefixes
        self.left = Wavelet(self.transform(text), symbols)
        self.right = Wavelet(self.transform(np.concatenate([text[-2::-1], [END]])), symbols)

    def transform(self, text):
        """The Burrows-Wheeler transform: suffixes are ranked by ever longer beginnings."""
        np, n = self.np, len(text)
        rank, step = text, 1
        while True:
            key = rank * (n + 1)
            key[:n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return text[order - 1]
            step *= 2

    def symbols(self, words: list[str]):
        """Symbols of all words one after another (-1: not in the alphabet), and the start of each word."""
        np = self.np
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points if len(self.alphabet) else np.zeros(len(points), bool)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return np.where(known, at + 2, -1), np.cumsum(lengths) - lengths, lengths

    def near(self, words: list[str], head, tail):
        """Pairs (place in ``words``, number of an indexed word) one edit apart, the second not longer.

        The first ``head`` and the last ``tail`` code points of a word have to be the same in both.
        """
        np = self.np
        flat, start, length = self.symbols(words)
        found = []
        for rightwards in (True, False):
            chosen = np.flatnonzero((head > 0) | (tail == 0) if rightwards else (head == 0) & (tail > 0))
            if len(chosen):
                exact, rest = (head, tail) if rightwards else (tail, head)
                found.append(self.walk(flat, start, length, exact, length - rest, chosen, rightwards))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def walk(self, flat, start, length, opens, closes, chosen, rightwards: bool):
        """All searches in one direction, one symbol a step; the edit lies at steps from ``opens`` to before ``closes``."""
        np = self.np
        lead = self.right if rightwards else self.left
        count = len(chosen)
        # a: start of the interval in the index that is narrowed, b: in the other one
        word, edited = chosen, np.zeros(count, bool)
        a, size, less = lead.narrow(np.zeros(count, np.int64), np.full(count, self.size), np.full(count, GAP))
        b, step, hits = less, 0, []

        def symbol(w, t):
            return flat[start[w] + t if rightwards else start[w] + length[w] - 1 - t]

        while len(word):
            over = (length[word] == step) & edited
            if over.any():
                last, n, less = lead.narrow(a[over], size[over], np.full(int(over.sum()), GAP))
                rank = b[over] + less if rightwards else last
                hits.append((word[over][n > 0], rank[n > 0] - 2))
            on = (length[word] > step) & (edited | (step < closes[word]))
            word, a, b, size, edited = word[on], a[on], b[on], size[on], edited[on]
            if not len(word):
                break
            own = symbol(word, step)
            parts = []
            same = np.flatnonzero(own >= 0)
            na, n, less = lead.narrow(a[same], size[same], own[same])
            parts.append((word[same], na, b[same] + less, n, edited[same]))
            free = np.flatnonzero(~edited & (step >= opens[word]))
            if len(free):
                # left out of the shorter word; of equal neighbours only the first
                twice = (step > opens[word[free]]) & (own[free] == symbol(word[free], max(step - 1, 0)))
                gone = free[~twice]
                parts.append((word[gone], a[gone], b[gone], size[gone], np.ones(len(gone), bool)))
                at, other, na, n, less = lead.narrow_all(a[free], size[free])
                real = (other > GAP) & (other != own[free[at]])
                at = free[at[real]]
                parts.append((word[at], na[real], b[at] + less[real], n[real], np.ones(len(at), bool)))
            word, a, b, size, edited = (np.concatenate(x) for x in zip(*parts))
            left = size > 0
            word, a, b, size, edited = word[left], a[left], b[left], size[left], edited[left]
            step += 1
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def keyed(rows: DataFrame) -> DataFrame:
    """The key of (length, number of first and last code points that are shared, those code points)."""
    return rows.withColumn("key", F.xxhash64("m", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)")))


def near_words(words: DataFrame, word_col: str = "word", shard_chars: int = SHARD_CHARS, group: int = GROUP) -> DataFrame:
    """All pairs ``word, near`` of distinct words one edit apart, in both orders, each once.

    Null words take no part and repeated ones count once. Further columns are ignored.
    """
    words = cut_lineage(words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct())
    # a word asks among words of its length m and of m - 1, by either half
    lengths = F.array(F.struct(F.length("word").alias("m"), F.lit(True).alias("asks")),
                      F.struct((F.length("word") + 1).alias("m"), F.lit(False).alias("asks")))
    rows = words.select("word", F.inline(lengths)).where("m > 0")
    half = F.expr("m div 2").cast("int")
    halves = F.array(F.struct(half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("m") - half).alias("tail")))
    rows, ready = keyed(rows.select("word", "m", "asks", F.inline(halves))), []
    while True:
        keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max("asks").alias("asked"), F.min(F.expr("m - head - tail")).alias("open"))
        keys = cut_lineage(keys.where("held > 1 AND asked"))  # a key with one word has nothing to find
        split = (F.col("held") > group) & (F.col("open") > 1)
        ready.append(rows.join(keys.where(~split).select("key"), "key", "left_semi"))
        crowded = keys.where(split).select("key")
        if crowded.isEmpty():
            break
        halves = F.expr("""array(named_struct('head', head + (m - head - tail) div 2, 'tail', tail),
                                 named_struct('head', head, 'tail', tail + (m - head - tail) - (m - head - tail) div 2))""")
        more = rows.join(crowded, "key", "left_semi").withColumn("open", F.expr("m - head - tail"))
        rows = more.select("word", "m", "asks", F.inline(halves)).select("word", "m", "asks", F.col("head").cast("int"), F.col("tail").cast("int"))
        rows = cut_lineage(keyed(rows))
    asked = ready[0]
    for more in ready[1:]:
        asked = asked.unionByName(more)
    asked = cut_lineage(asked.select("key", "word", "asks", "head", "tail"))
    size = asked.agg(F.sum(F.length("word") + F.lit(1))).first()[0] or 0
    shards = -(-size // shard_chars) or 1
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)))

    def search(rows: pa.Table) -> pa.Table:
        import numpy as np

        held = sorted(set(rows["word"].to_pylist()))  # in code-point order
        index = WordIndex(held)
        ask = rows.filter(rows["asks"]).select(["word", "head", "tail"])
        parts = []
        for lo in range(0, ask.num_rows, ASKED):
            part = ask.slice(lo, ASKED)
            own = part["word"].to_pylist()
            place, number = index.near(own, part["head"].to_numpy().astype(np.int64), part["tail"].to_numpy().astype(np.int64))
            x, y = pa.array(own, pa.string()).take(pa.array(place)), pa.array(held, pa.string()).take(pa.array(number))
            parts += [pa.table({"word": x, "near": y}), pa.table({"word": y, "near": x})]
        give_back()
        return pa.concat_tables(parts) if parts else pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string())})

    return asked.groupBy("shard").applyInArrow(search, "word string, near string").distinct()


def spelling_forms(counted: DataFrame, ratio: int = 5, shard_chars: int = SHARD_CHARS, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every counted word (``word, n``, words distinct).

    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if that is at least
    ``ratio`` (above 1) times the word's own, else null; ``root`` is where following the forms ends.
    """
    if ratio <= 1:
        raise ValueError("a form has to be more frequent than the word, or forms could run in circles")
    counted = cut_lineage(counted.select("word", "n"))  # read by several joins
    pairs = near_words(counted, "word", shard_chars, group)
    other = counted.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(other, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    rows = counted.join(best, "word", "left")
    leads = F.coalesce(-F.col("best.col1") >= ratio * F.col("n"), F.lit(False))
    rows = cut_lineage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"),
                                   F.when(leads, -F.col("best.col1")).alias("form_n")))
    # counts grow from form to form, so chains are short; their length halves in every round
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = cut_lineage(roots)
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(ahead, "root", "left_semi").isEmpty():
            break
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return (rows.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def planted(doc_id: int | None, words: list) -> list:
    """The words of a document as the query takes them: one in 199 lacks a code point."""
    import zlib

    if doc_id is None:
        return words
    seed = zlib.crc32(b"%d:" % doc_id)
    for i, w in enumerate(words):
        h = zlib.crc32(w, seed)
        if not h % 199:
            text = w.decode()
            at = h % len(text)
            words[i] = (text[:at] + text[at + 1:]).encode()
    return words


def _crc_table() -> list[int]:
    """CRC-32 of every half byte, from the polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


# words with crc32 taken over half bytes, low one first; pairs by what is left when a code point is taken out
SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS c, hex(encode(doc_id::VARCHAR || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
hashed AS (
  SELECT w, c, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(0, length(x)), lambda i: (strpos('0123456789ABCDEF', x[(i + 2 - 2 * (i % 2))::INT]) - 1)::BIGINT)),
    lambda h, v: xor(h >> 4, list_extract({_crc_table()}::BIGINT[], (xor(h, v) & 15) + 1)))) AS h
  FROM counted),
written AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
shorter AS (SELECT DISTINCT c.word, w.word AS near FROM cuts c JOIN words w ON w.word = c.rest),
pairs AS (
  SELECT word, near FROM shorter UNION ALL SELECT near, word FROM shorter
  UNION ALL SELECT a.word, b.word FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
ranked AS (
  SELECT p.word, w.word AS near, w.n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, w.word) AS k, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN words w ON w.word = p.near),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
ways AS (SELECT word, word AS root FROM formed UNION ALL SELECT y.word, f.form FROM ways y JOIN formed f ON f.word = y.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways y ON y.word = f.word JOIN formed e ON e.word = y.root AND e.form IS NULL
"""


@query("op12_spelling_variants", SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(count_words(table(spark, sf_dir, "documents"), alter=planted))
