"""Packing by the dot-product heuristic of vector bin packing.

Examples have three sizes: tokens, segments and loss-bearing tokens, and a sequence has a limit on each.
A sequence is filled by the waiting example whose sizes have the largest dot product with what
is left of the limits. Each task packs its own rows through a window of waiting examples, so nothing
is shuffled and memory is bounded; sequence ids carry the task's number.

Documents may be cut: whole sequences are cut off first, and a gap that no waiting piece fits is
filled by cutting one. What is left when a task ends is cut into pieces whose lengths are
powers of two, which need no padding.

A null or empty text is its end token alone. Conversations with null counts count as 0 tokens; an example
beyond a limit is placed alone, and `fits` is false for it. Repeated rows are packed as often as they occur;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import batch
from .token_counts import BYTES

#: Waiting examples of a task; more of them leave less padding and take more memory.
WINDOW = 1024


def byte_bpe(path: str) -> tiktoken.Encoding:
    """An encoder of the byte-level BPE in a tokenizers file. It merges by ids, so they must rank as the file's merges do, else the file is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"][a + b] for a, b in merges]
    if any(a >= b for a, b in zip(ids, ids[1:])):
        raise ValueError(f"{path}: ids do not rank as merges do")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(BYTES[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    #: Fixed value: the splitting pattern of byte-level BPE.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: White space beyond so many characters is encoded as the one piece that the pattern makes of it, since the matcher's stack holds about a million of them.
LONG_SPACE = 1 << 16
_LONG_SPACES = regex.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}+")


def encode(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text of any kind. Of a long run of white space before something else, the last character belongs to what follows."""
    if len(text) < LONG_SPACE or not (runs := [m.span() for m in _LONG_SPACES.finditer(text)]):
        return encoder.encode(text, allowed_special="all")
    out, at = [], 0
    for start, end in runs:
        stop = end if end == len(text) else end - 1
        out += encoder.encode(text[at:start], allowed_special="all")
        out += encoder._encode_single_piece(text[start:stop])
        at = stop
    return out + encoder.encode(text[at:], allowed_special="all")


class Bins:
    """Waiting sizes, and the choice among them."""

    def __init__(self, limits: tuple[int, ...], window: int = WINDOW):
        self.limits = np.array(limits, np.int64)
        self.sizes = np.zeros((window, len(limits)), np.int64)
        self.scaled = np.zeros((window, len(limits)))
        self.items: list = [None] * window
        self.free = list(range(window - 1, -1, -1))
        self.used = np.zeros(window, bool)

    def add(self, sizes: tuple[int, ...], item: object) -> None:
        k = self.free.pop()
        self.sizes[k], self.scaled[k], self.items[k], self.used[k] = sizes, np.array(sizes) / self.limits, item, True

    def take(self, k: int) -> object:
        self.used[k] = False
        self.sizes[k] = 0
        self.free.append(k)
        item, self.items[k] = self.items[k], None
        return item

    def best(self, left: np.ndarray) -> int:
        """The waiting example that fits with the largest dot product, -1 if none fits."""
        fits = self.used & (self.sizes <= left).all(1)
        if not fits.any():
            return -1
        # added column by column, so that ties are the same everywhere
        product = sum(self.scaled[:, d] * room for d, room in enumerate(left / self.limits))
        return int(np.argmax(np.where(fits, product, -1.0)))

    def longest(self) -> int:
        return int(np.argmax(np.where(self.used, self.sizes[:, 0], -1)))


def _sequences() -> Iterator[int]:
    k = TaskContext.get().partitionId() << 33
    while True:
        yield k
        k += 1


class DocumentPacker:
    """Pieces of token ids to rows of (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, segments: int, least: int, window: int = WINDOW):
        self.length, self.least = length, least
        self.bins, self.ids, self.rows = Bins((length, segments, length), window), _sequences(), []

    def _put(self, piece: tuple, sequence: int, offset: int) -> int:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
        return offset + len(ids)

    def document(self, doc: object, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for start in range(0, whole, self.length):
            self._put((doc, start, ids[start : start + self.length], len(ids)), next(self.ids), 0)
        if whole < len(ids):
            self._wait((doc, whole, ids[whole:].copy(), len(ids)))
        if not self.bins.free:
            while self.bins.used.sum() > len(self.bins.items) // 2:
                self._sequence()

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2])
        self.bins.add((n, 1, n), piece)

    def _cut(self, piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)

    def _sequence(self) -> None:
        sequence, offset, left = next(self.ids), 0, self.bins.limits.copy()
        while self.bins.used.any() and left.min() > 0:
            k = self.bins.best(left)
            if k >= 0:
                piece, n = self.bins.items[k], self.bins.sizes[k, 0]
                self.bins.take(k)
            else:
                n, k = int(left[0]), self.bins.longest()
                if n < self.least or self.bins.sizes[k, 0] - n < self.least:
                    break
                piece, rest = self._cut(self.bins.take(k), n)
                self._wait(rest)
            offset = self._put(piece, sequence, offset)
            left -= np.array([n, 1, n])

    def finish(self) -> None:
        """Whole sequences as long as there are tokens for one; the rest in lengths that need no padding."""
        while self.bins.sizes[:, 0].sum() >= self.length:
            self._sequence()
        todo = [self.bins.take(k) for k in np.flatnonzero(self.bins.used)]
        total = sum(len(p[2]) for p in todo)
        while todo:
            room = 1 << (total.bit_length() - 1)
            total -= room
            sequence, offset = next(self.ids), 0
            while room:
                piece = todo.pop()
                if len(piece[2]) > room:
                    piece, rest = self._cut(piece, room)
                    todo.append(rest)
                offset, room = self._put(piece, sequence, offset), room - len(piece[2])


_encoders: dict[str, tiktoken.Encoding] = {}

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end: int = 1, segments: int = 1 << 20, least: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece; path: the tokenizers file on every executor; least: a gap is not filled by, nor leaves, a shorter piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = byte_bpe(path)
        encoder, packer, ended = _encoders[path], DocumentPacker(length, segments, least), np.array([end], np.uint16 if end < 1 << 16 else np.uint32)

        def rows() -> pa.RecordBatch:
            names = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            columns = list(zip(*packer.rows)) or [[]] * len(names)
            packer.rows = []
            return batch(**{n: pa.array(c, kinds if n == "id" else pa.int64()) for n, c in zip(names, columns)})

        kinds = None
        for b in batches:
            kinds = b.column(0).type
            for doc, text in zip(b.column(0), b.column(1)):
                ids = encode(encoder, text.as_py() or "")
                packer.document(doc.as_py(), np.array([*ids, end], ended.dtype))
                if len(packer.rows) >= 4096:
                    yield rows()
        if kinds is not None:
            packer.finish()
            yield rows()

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, {PIECES}").withColumnRenamed("id", id_col)


def conversation_sizes(turns: DataFrame, path: str, end: int = 1, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """A row for each conversation: id_col, tokens (of all turns, an end token each), segments (turns) and loss (tokens of the turns of the role learned).

    A null text is its end token alone; a null role is not learned; turns with a null id are one conversation. Sums are formed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = byte_bpe(path)
        encoder = _encoders[path]
        for b in batches:
            n = np.array([len(encode(encoder, x.as_py() or "")) + (end is not None) for x in b.column(2)], np.int64)
            mine = np.array([x.as_py() == learned for x in b.column(1)], bool)
            yield batch(id=b.column(0), tokens=pa.array(n), loss=pa.array(np.where(mine, n, 0)))

    base = turns.select(F.col(id_col).alias("id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    counted = base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, tokens long, loss long")
    return counted.groupBy(F.col("id").alias(id_col)).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss").alias("loss"))


def pack_examples(examples: DataFrame, limits: tuple[int, int, int], id_col: str, tokens: str, segments: str, loss: str) -> DataFrame:
    """Instruction examples, which are not cut: id_col, tokens, segments, loss, sequence_id, fits; a null size is 0. limits: on tokens, segments and loss-bearing tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, ids, out, kind = Bins(limits), _sequences(), [], None

        def sequence() -> None:
            k, left = next(ids), bins.limits.copy()
            while (i := bins.best(left)) >= 0:
                left = left - bins.sizes[i]
                out.append((*bins.take(i), k, True))

        def rows() -> pa.RecordBatch:
            done = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, (kind, *[pa.int64()] * 4, pa.bool_()))]
            out.clear()
            return batch(**dict(zip(("id", "tokens", "segments", "loss", "sequence_id", "fits"), done)))

        for b in batches:
            kind = b.column(0).type
            for i, *sizes in zip(*(c.to_pylist() for c in b.columns)):
                sizes = tuple(x or 0 for x in sizes)
                if any(x > y for x, y in zip(sizes, limits)):
                    out.append((i, *sizes, next(ids), False))
                    continue
                bins.add(sizes, (i, *sizes))
                if not bins.free:
                    while bins.used.sum() > len(bins.items) // 2:
                        sequence()
            yield rows()
        if kind is not None:
            while bins.used.any():
                sequence()
            yield rows()

    base = examples.select(F.col(id_col).alias("id"), *(F.col(c).cast("long").alias(n) for c, n in ((tokens, "tokens"), (segments, "segments"), (loss, "loss"))))
    placed = base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, tokens long, segments long, loss long, sequence_id long, fits boolean")
    names = (id_col, tokens, segments, loss, "sequence_id", "fits")
    return placed.toDF(*names)
