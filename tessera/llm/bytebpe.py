"""Byte-level BPE encoding by a two-tier lookup, and decoding.

Texts are cut into pre-tokens by a pattern. The distinct pre-tokens of a slice of texts go to the first tier
together: a minimal perfect hash over the byte strings of the vocabulary gives each of them one slot, and the
bytes stored at that slot say whether the pre-token is a word of the vocabulary. What misses goes to the
second tier: its bytes form a linked list, and a heap of neighbours yields the pair of lowest rank, leftmost
first, until no pair has a rank. Both tiers together give the ids of the tiktoken library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back, per_process
from tessera.llm.registry import query, table
from tessera.llm.tokens import _ranges, slices

SLICE_CHARS = 2 << 20  # text encoded at once
KNOWN = 200_000  # pre-tokens whose ids a worker remembers: those that it met first
KNOWN_CHARS = 48  # longer ones are not remembered, which bounds the memory in bytes
SPARSE = 2  # slots for each key and level while the hash is built
MULTIPLIER, SEED = 0x9E3779B97F4A7C15, 0x632BE59BD9B4E019


def _mixed(np, h):
    """The bits of 64-bit numbers stirred, so that any part of them can choose a slot."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class MinimalHash:
    """A minimal perfect hash of distinct byte strings: key -> its own number below the number of keys.

    Keys are dealt level by level. A slot of a level that exactly one key chooses belongs to it; the keys of
    all other slots go on to the next level. The number of a key is the number of taken slots before its own.
    Arrays hold all strings one after another (``flat``), with the place and the length of each.
    """

    def __init__(self, keys: list[bytes]):
        import numpy as np

        self.np = np
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        self.longest = int(lengths.max(initial=0))
        self.powers = np.full(self.longest + 1, MULTIPLIER, np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers)
        flat = np.frombuffer(b"".join(keys), np.uint8)
        h = self.hashes(flat, np.cumsum(lengths) - lengths, lengths)
        if len(np.unique(h)) < len(keys):
            raise ValueError("two keys have the same 64-bit hash; change MULTIPLIER")
        self.taken, self.before, self.levels, numbers = [], [], [], np.zeros(len(keys), np.int64)
        left, done = np.arange(len(keys)), 0
        while len(left):
            size = SPARSE * len(left) + 1
            slot = self.slot(h[left], len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            before = done + np.cumsum(alone) - alone
            self.levels.append(size)
            self.taken.append(alone)
            self.before.append(before)
            own = alone[slot]
            numbers[left[own]] = before[slot[own]]
            done, left = done + int(alone.sum()), left[~own]
        order = np.argsort(numbers)  # number -> key
        self.key_of = order
        self.length = lengths[order]
        self.start = (np.cumsum(lengths) - lengths)[order]
        self.flat = flat

    def hashes(self, flat, starts, lengths):
        """A 64-bit hash of every string (none longer than the longest key)."""
        np = self.np
        if not len(starts):
            return np.zeros(0, np.uint64)
        at = _ranges(np, np.zeros(len(lengths), np.int64), lengths)
        value = (flat[_ranges(np, starts, lengths)].astype(np.uint64) + np.uint64(1)) * self.powers[at]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        ends = np.cumsum(lengths)
        return _mixed(np, total[ends] - total[ends - lengths])

    def slot(self, h, level: int, size: int):
        np = self.np
        salt = np.uint64((SEED * (2 * level + 1)) % (1 << 64))
        return (_mixed(np, h ^ salt) % np.uint64(size)).astype(np.int64)

    def find(self, flat, starts, lengths):
        """The position among the keys of every string, -1 for strings that are no key."""
        np = self.np
        found = np.full(len(starts), -1, np.int64)
        left = np.flatnonzero((lengths <= self.longest) & (lengths > 0))
        h = self.hashes(flat, starts[left], lengths[left])
        for level, size in enumerate(self.levels):
            slot = self.slot(h, level, size)
            hit = self.taken[level][slot]
            found[left[hit]] = self.before[level][slot[hit]]
            left, h = left[~hit], h[~hit]
        # any other string was given a number too: the bytes decide
        some = np.flatnonzero(found >= 0)
        number = found[some]
        same = self.length[number] == lengths[some]
        found[some[~same]] = -1
        some, number = some[same], number[same]
        if len(some):
            n = lengths[some]
            equal = flat[_ranges(np, starts[some], n)] == self.flat[_ranges(np, self.start[number], n)]
            whole = np.logical_and.reduceat(equal, np.cumsum(n) - n)
            found[some] = np.where(whole, self.key_of[number], -1)
        return found


class ByteEncoder:
    """Encodes and decodes texts by the ranks of a tiktoken file."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64
        import re

        import numpy as np
        import regex

        self.np = np
        with open(ranks_path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        keys = list(self.ranks)
        self.rank_of = np.fromiter(self.ranks.values(), np.int64, len(keys))
        self.table = MinimalHash(keys)
        self.longest = self.table.longest
        self.bytes_of = dict(zip(self.ranks.values(), keys))
        self.pattern, self.cut = pattern, regex.compile(pattern)
        self.beyond, self.unsure = re.compile("[\u0378-\U0010ffff]"), _unassigned()  # all characters below are assigned
        self.stand_in: dict[int, int] = {}
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text as the library cuts it.

        Characters that the interpreter's Unicode tables leave unassigned may be letters or digits by the
        pattern's own tables and none by the library's, or the other way round. The library is asked for the
        class of each, and an assigned character of that class stands in while the text is cut.
        """
        odd = self.unsure.findall("".join(set(text))) if self.beyond.search(text) else []
        if not odd:
            return self.cut.findall(text)
        for c in odd:
            if ord(c) not in self.stand_in:
                self.stand_in[ord(c)] = ord(self.like(c))
        spans = [m.span() for m in self.cut.finditer(text.translate(self.stand_in))]
        return [text[a:b] for a, b in spans]

    def like(self, char: str) -> str:
        """A letter, digit or sign: what the library takes ``char`` for."""
        import tiktoken

        ranks = {bytes([i]): i for i in range(256)}
        for probe in "a1!":
            ranks[(probe + char).encode()] = len(ranks)
        lib = tiktoken.Encoding("classes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return next((p for p in "a1!" if len(lib.encode_ordinary(p + char)) == 1), char)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a string that is no word of the vocabulary: a heap over its linked bytes."""
        from heapq import heapify, heappop, heappush

        n, get, longest = len(raw), self.ranks.get, self.longest
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it belongs to another
        prev = list(range(-1, n))
        heap = [(r, a, a + 2) for a in range(n - 1) if (r := get(raw[a:a + 2])) is not None]
        heapify(heap)
        while heap:
            _, a, c = heappop(heap)
            b = end[a]
            if not b or b == n or end[b] != c:  # a neighbour was merged meanwhile
                continue
            end[a], end[b] = c, 0
            if c < n:
                prev[c] = a
                d = end[c]
                if d - a <= longest and (s := get(raw[a:d])) is not None:
                    heappush(heap, (s, a, d))
            p = prev[a]
            if p >= 0 and c - p <= longest and (s := get(raw[p:c])) is not None:
                heappush(heap, (s, p, c))
        ids, a = [], 0
        while a < n:
            ids.append(get(raw[a:end[a]]))
            a = end[a]
        return ids

    def learn(self, words: list[str]) -> tuple:
        """Ids of distinct pre-tokens one after another, and the end of each."""
        np = self.np
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        found = self.table.find(flat, np.cumsum(lengths) - lengths, lengths)
        missed = np.flatnonzero(found < 0).tolist()
        merged = [self.merge(raw[i]) for i in missed]
        counts = np.ones(len(raw), np.int64)
        counts[missed] = [len(m) for m in merged]
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        hit = found >= 0
        ids[(ends - counts)[hit]] = self.rank_of[found[hit]]
        if missed:
            ids[_ranges(np, (ends - counts)[missed], counts[missed])] = np.concatenate([np.asarray(m, np.int32) for m in merged])
        return ids, ends

    def encode(self, texts: list[str]) -> tuple:
        """Ids of all texts one after another, and the number of ids of each."""
        from itertools import chain

        np, known = self.np, self.known
        split = list(map(self.split, texts))
        words = list(chain.from_iterable(split))
        new = [w for w in dict.fromkeys(words) if w not in known]
        held, room = len(known), KNOWN - len(known)
        # those that will be remembered first
        short = [w for w in new if len(w) <= KNOWN_CHARS][:room]
        if len(short) < len(new):
            others = set(short)
            new = short + [w for w in new if w not in others]
        ids, ends = self.learn(new)
        flat, ends = np.concatenate([self.flat, ids]), np.concatenate([self.ends, ends + len(self.flat)])
        known.update(zip(new, range(held, held + len(new))))
        order = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in new[len(short):]:
            del known[w]
        if short:
            self.ends = ends[:held + len(short)].copy()
            self.flat = flat[:self.ends[-1]].copy()
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        lengths = (ends - starts)[order]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum([len(ws) for ws in split]).astype(np.int64)
        counts = upto[last] - upto[np.concatenate([[0], last[:-1]])] if len(texts) else last
        return flat[_ranges(np, starts[order], lengths)], counts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _unassigned():
    """A pattern of the characters without a class in the interpreter's Unicode tables."""
    import re
    import unicodedata

    free = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    runs: list[list[int]] = []
    for c in free:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")


def _slices_of(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of about SLICE_CHARS bytes, each with its texts (null: empty); only one run is held as strings."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in slices(sizes, SLICE_CHARS):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every whole text (null and empty: no ids) as a list column.

    A column of the name of ``out`` is replaced; all others, and repeated rows, stay as they are. An empty table
    gives an empty table.
    """
    names = [c for c in docs.columns if c != out]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = per_process(f"bytes {ranks_path} {pattern}", lambda: ByteEncoder(ranks_path, pattern))
        for b in batches:
            for lo, hi, texts in _slices_of(b.column(at)):
                ids, counts = coder.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, lists], [*names, out])
            give_back()

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in names], f"`{out}` array<int>"]))


def decode_bpe(coded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of a list of ids (null: null) as a binary column; a column of the name of ``out`` is replaced."""
    names = [c for c in coded.columns if c != out]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        coder = per_process(f"bytes {ranks_path} {pattern}", lambda: ByteEncoder(ranks_path, pattern))
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(at)), 0).to_pylist()
            for lo, hi in slices(sizes, SLICE_CHARS // 4):
                part = b.slice(lo, hi - lo)
                raw = [None if ids is None else coder.decode(ids) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*names, out])
            give_back()

    types = {f.name: f.dataType.simpleString() for f in coded.schema.fields}
    return coded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in names], f"`{out}` binary"]))


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of its ids, and hashes of the ids and of the bytes decoded from them.

    Encoding and decoding run on the same slice, so neither ids nor decoded texts leave the worker. Null texts
    count as empty; null and repeated ids keep a row each; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        coder = per_process(f"bytes {ranks_path} {pattern}", lambda: ByteEncoder(ranks_path, pattern))
        for b in batches:
            for lo, hi, texts in _slices_of(b.column(1)):
                ids, counts = coder.encode(texts)
                del texts
                ends, coded, decoded = np.cumsum(counts).tolist(), [], []
                for first, last in zip([0, *ends], ends):
                    own = ids[first:last]
                    coded.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(own.tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
