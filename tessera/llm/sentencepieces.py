"""SentencePiece encoding by a forward pass over a trie of the distinct marked words, and decoding.

Spaces become the mark U+2581, one is put before the text, and the text is cut before every run of marks:
no piece reaches over such a cut, so each marked word is encoded alone. The distinct words of a slice of
texts are sorted, which lays their trie out depth-first: going from one word to the next keeps the forward
states of the common prefix and continues from there.

The forward state of a prefix is the last piece of its best path. The model at hand ranks merges, so a path
counts as best if the merges lead to it, and that can be seen piece by piece: a sequence of pieces is what the
merges give if every two neighbours are (nothing merges across the border between them before both are
complete). The state of a prefix is then the one piece that ends there and is allowed after the state where
the piece starts. Tests hold the ids against the sentencepiece library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back, per_process
from tessera.llm.registry import query, table
from tessera.llm.tokens import _ranges, slices

MARK = "▁"
SLICE_CHARS = 1 << 20  # text whose words share a trie
PAIRS = 150_000  # neighbours that a worker remembers before it starts anew
WORDS = 100_000  # words whose ids a worker remembers: those that it met first
FIRM = -1e8  # pieces scored below have equal scores and merge from left to right


class PieceModel:
    """The pieces of a BPE model with byte fallback, as SentencePiece stores it."""

    def __init__(self, path: str):
        import re

        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark after another character; words can't be cut at marks")
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.trees: dict[str, tuple[bool, list, list]] = {}
        self.allowed: dict[str, bool] = {}
        self.backward: dict = {}  # trie of the pieces from their ends; "" leads to the piece
        for piece in self.ids:
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece

    def merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short string by its merges, best score first, and the parts of the last merge."""
        parts, last, score = list(word), None, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def tree(self, piece: str) -> tuple[bool, list, list]:
        """Whether merges lead to the piece, and what stands at its left and right edge over time.

        An edge is a list of (part, score of the merge that ends it), the piece itself first.
        """
        known = self.trees.get(piece)
        if known is None:
            parts, last = self.merge(piece)
            left, right = [(piece, float("-inf"))], [(piece, float("-inf"))]
            if len(parts) == 1 and last is not None:
                own = self.score[piece]
                left += [(p, own if k == 0 else s) for k, (p, s) in enumerate(self.tree(last[0])[1])]
                right += [(p, own if k == 0 else s) for k, (p, s) in enumerate(self.tree(last[1])[2])]
            known = self.trees[piece] = (len(parts) == 1, left, right)
        return known

    def made(self, part: str) -> float:
        """The score of the merge that makes a part; single characters are there from the start."""
        return float("inf") if len(part) == 1 else self.score[part]

    def follows(self, first: str, second: str) -> bool:
        """Whether the merges of both strings put together leave them apart."""
        if not (self.tree(first)[0] and self.tree(second)[0]):
            return False
        score, made = self.score, self.made
        if min(score.get(first, 0), score.get(second, 0)) < FIRM or MARK in second:
            return self.merge(first + second)[0] == [first, second]
        for a, a_ends in self.tree(first)[2]:
            for b, b_ends in self.tree(second)[1]:
                s = score.get(a + b)
                # both stand at once, and their merge comes before the merge that would end either
                if s is not None and s > a_ends and s >= b_ends and made(a) > b_ends and made(b) > a_ends:
                    return False
        return True

    def words(self, words: list[str]) -> tuple:
        """Ids of sorted distinct words one after another, and the end of each."""
        import numpy as np

        ids, ends, known, root = [], [], self.ids, self.backward
        if len(self.allowed) > PAIRS:
            self.allowed = {}
        allowed, follows, reached = self.allowed, self.follows, self.tree
        path, before = [""], ""  # path[i]: the last piece of the first i characters
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            for i in range(shared, len(word)):
                node, piece, j = root, None, i
                while node is not None and j >= 0:  # pieces that end here, shortest first
                    c = word[j]
                    node = node.get(c)
                    if node is None:
                        break
                    end = node.get("")
                    if end is not None:
                        if j == 0:
                            if reached(end)[0]:
                                piece = end
                            break
                        pair = path[j] + "\0" + end
                        ok = allowed.get(pair)
                        if ok is None:
                            ok = follows(path[j], end)
                            allowed[pair] = ok
                        if ok:
                            piece = end
                            break
                    j -= 1
                path.append(piece or word[i])
            i, back = len(word), []
            while i:
                piece = path[i]
                i -= len(piece)
                back.append(piece)
            for piece in reversed(back):
                one = known.get(piece)
                if one is not None:
                    ids.append(one)
                else:
                    ids.extend([self.byte_ids[x] for x in piece.encode()])
            ends.append(len(ids))
            before = word
        return np.array(ids, np.int32), np.array(ends, np.int64)

    def encode(self, texts: list[str]) -> tuple:
        """Ids of all texts one after another, and the number of ids of each."""
        from itertools import chain

        import numpy as np

        cut = self.cut.findall
        split = [cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        every = dict.fromkeys(words)
        known = self.known
        new = sorted(w for w in every if w not in known)
        ids, ends = self.words(new)
        flat, ends = np.concatenate([self.flat, ids]), np.concatenate([self.ends, ends + len(self.flat)])
        own = dict(zip(new, range(len(known), len(known) + len(new))))
        if len(known) + len(new) <= WORDS:
            known.update(own)
            self.flat, self.ends, own = flat, ends, known
        every = {w: known[w] if w in known else own[w] for w in every}
        order = np.fromiter(map(every.__getitem__, words), np.int64, len(words))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        lengths = (ends - starts)[order]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum([len(ws) for ws in split]).astype(np.int64)
        counts = upto[last] - upto[np.concatenate([[0], last[:-1]])] if len(texts) else last
        return flat[_ranges(np, starts[order], lengths)], counts

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the piece ids of every whole text (null and empty: no ids) as a list column.

    A column of the name of ``out`` is replaced; all others, and repeated rows, stay as they are.
    """
    names = [c for c in docs.columns if c != out]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = per_process(f"pieces {model_path}", lambda: PieceModel(model_path))
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in slices([len(t) for t in texts], SLICE_CHARS):
                ids, counts = model.encode(texts[lo:hi])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                                                 [*names, out])
            give_back()

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in names], f"`{out}` array<int>"]))


def decode_pieces(coded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of a list of piece ids (null: null). A column of the name of ``out`` is replaced."""
    names = [c for c in coded.columns if c != out]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_process(f"pieces {model_path}", lambda: PieceModel(model_path))
        for b in batches:
            for lo in range(0, max(b.num_rows, 1), 256):
                part = b.slice(lo, 256)
                lists = part.column(at)
                ends, flat = lists.offsets.to_pylist(), lists.values.to_numpy()
                texts = [model.decode(flat[x:y].tolist()) if known else None for x, y, known in zip(ends, ends[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, out])
            give_back()

    types = {f.name: f.dataType.simpleString() for f in coded.schema.fields}
    return coded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in names], f"`{out}` string"]))


def encode_checked(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids", same: str = "same") -> DataFrame:
    """The piece ids of every whole text instead of the text, and whether they decode to it.

    Encoding and decoding run on the same slice in one worker, so no text is handed on and none is held twice.
    All other columns and repeated rows stay; columns of the names ``out`` and ``same`` are replaced.
    """
    names = [c for c in docs.columns if c not in (text_col, out, same)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        model = per_process(f"pieces {model_path}", lambda: PieceModel(model_path))
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(len(names))), 0).to_pylist()
            for lo, hi in slices(sizes, SLICE_CHARS):
                part = b.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(len(names)).to_pylist()]
                ids, counts = model.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                equal = [model.decode(ids[x:y].tolist()) == t.replace(MARK, " ") for t, x, y in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(equal)], [*names, out, same])
            give_back()

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*[F.col(f"`{c}`") for c in [*names, text_col]]).mapInArrow(
        run, ", ".join([*[f"`{c}` {types[c]}" for c in names], f"`{out}` array<int>", f"`{same}` boolean"]))


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number and hash of its ids, hash of the text decoded from them, whether it is the input."""
    both = decode_pieces(encode_pieces(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model_path), model_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                       F.sha2("decoded", 256).alias("text_sha256"), (F.col("decoded") == F.translate("text", MARK, " ")).alias("same"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
