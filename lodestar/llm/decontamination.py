"""Benchmark passages in documents by Wu-Manber search over words.

Windows of consecutive item words are the patterns. For patterns of one length, a shift table
tells from a block of two words how far the search may move on, since the block ends no pattern
nearer; where the shift is zero, a bucket of patterns with that suffix block is compared. Many stretches of text
are searched side by side. Hashed words that agree are confirmed by comparing the words themselves.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null or empty texts have no words,
and items without words no window. Repeated items and item ids count once; a null item id is ignored. The items
are a stated query set: they are handled in blocks of at most about BLOCK windows or BLOCK_BYTES of text. A task holds one block at a
time, and searches up to HELD bytes of documents for it before it takes the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch
from .textbytes import ALNUM, LOWER, chunks, hashes_of, mix, words

BLOCK, BLOCK_BYTES = 1 << 19, 4 << 20
#: Bytes of documents for each of which several blocks are compiled once.
HELD = 32 << 20
#: Entries of a shift table.
TABLE = 1 << 16
#: Words of the stretches that are searched side by side.
STRETCH = 256


def _block(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of size words that ends at each position."""
    return hashes[at] if size == 1 else mix(hashes[at] + hashes[at - 1] * np.uint64(3))


class Patterns:
    """Patterns of one length: the shift of each block, buckets by suffix block, and the patterns."""

    def __init__(self, length: int, hashes: np.ndarray):
        """hashes: a row of word hashes for each pattern."""
        self.length, self.block = length, min(2, length)
        self.shift = np.full(TABLE, length - self.block + 1, np.int64)
        for end in range(self.block - 1, length):
            slot = self._slot(self._ends(hashes, end))
            self.shift[slot] = np.minimum(self.shift[slot], length - 1 - end)
        suffix = self._ends(hashes, length - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, self.hashes = suffix[self.order], hashes[self.order]

    def _ends(self, hashes: np.ndarray, end: int) -> np.ndarray:
        return hashes[:, end] if self.block == 1 else mix(hashes[:, end] + hashes[:, end - 1] * np.uint64(3))

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block & np.uint64(TABLE - 1)).astype(np.int64)

    def search(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of the places of the texts that agree by hash; first: where each text's words begin."""
        starts, ends, m = first[:-1], first[1:], self.length
        n = np.maximum(0, -(-(ends - starts - m + 1) // STRETCH))
        if not n.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(n)), n)
        lane = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = starts[which] + lane * STRETCH + m - 1
        stop = np.minimum(at + STRETCH, ends[which])
        found = []
        while len(at):
            block = _block(text, at, self.block)
            shift = self.shift[self._slot(block)]
            hit = shift == 0
            if hit.any():
                places, blocks = at[hit], block[hit]
                lo, hi = np.searchsorted(self.suffix, blocks), np.searchsorted(self.suffix, blocks, "right")
                k = hi - lo
                places, pattern = np.repeat(places, k), np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
                same = np.ones(len(places), bool)
                for j in range(m):
                    same &= text[places - m + 1 + j] == self.hashes[pattern, j]
                found.append((places[same] - m + 1, self.order[pattern[same]]))
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def item_windows(texts: list[tuple[object, str | None]], size: int) -> dict[int, dict[tuple[bytes, ...], set[str]]]:
    """By length, the windows of all items and the ids of the items that have them; an item without id has windows, but no id to name."""
    out: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in texts:
        if not text:
            continue
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        s, e, _ = words(data, np.array([0, len(data)]), ALNUM)
        own = [data[a:b].tobytes() for a, b in zip(s, e)]
        m = min(size, len(own))
        for i in range(len(own) - m + 1 if own else 0):
            out.setdefault(m, {}).setdefault(tuple(own[i : i + m]), set()).update(() if item is None else (str(item),))
    return out


def _compile(windows: dict[int, dict[tuple[bytes, ...], set[str]]]) -> list[tuple[Patterns, list, list]]:
    out = []
    for m, found in sorted(windows.items()):
        flat = b"".join(w for p in found for w in p)
        ends = np.cumsum([len(w) for p in found for w in p])
        data = np.frombuffer(flat, np.uint8)
        hashes = hashes_of(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))
        out.append((Patterns(m, hashes.reshape(len(found), m)), list(found), [sorted(x) for x in found.values()]))
    return out


def blocks(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> list:
    """Broadcasts of at most about BLOCK windows each, read item by item."""
    sc, out, held, n, size_of = benchmark.sparkSession.sparkContext, [], [], 0, 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((row["i"], row["t"]))
        n += len(row["t"] or "") // 2 + 1
        size_of += len(row["t"] or "")
        if n >= BLOCK or size_of >= BLOCK_BYTES:
            out.append(sc.broadcast(item_windows(held, size)))
            held, n, size_of = [], 0, 0
    if held:
        out.append(sc.broadcast(item_windows(held, size)))
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every row of docs: id_col, n_words, n_hit, items (ids of items with occurring windows, sorted as strings)."""
    shared = blocks(benchmark, size, item_col, item_text)
    compiled: dict[int, list] = {}

    def patterns(k: int) -> list:
        if k not in compiled:
            compiled.clear()
            compiled[k] = _compile(shared[k].value)
            if len(shared) > 1:  # else blocks would stay in the worker's memory one after the other
                vars(shared[k]).pop("_value", None)
        return compiled[k]

    def search(part: tuple, k: int, hit: np.ndarray, by_doc: list[set[str]]) -> None:
        data, s, e, first, hashes = part
        for p, known, ids in patterns(k):
            for at, which in zip(*(x.tolist() for x in p.search(hashes, first))):
                if all(data[s[at + j] : e[at + j]].tobytes() == w for j, w in enumerate(known[which])):
                    hit[at] += 1
                    hit[at + p.length] -= 1
                    by_doc[int(np.searchsorted(first, at, "right")) - 1].update(ids[which])

    def found(column: pa.Array) -> tuple[list[int], list[int], list[list[str]]]:
        n_words, n_hit, items, parts = [], [], [], []

        def flush() -> None:
            hits = [(np.zeros(len(p[1]) + 1, np.int64), [set() for _ in range(len(p[3]) - 1)]) for p in parts]
            for k in range(len(shared)):
                for part, (hit, by_doc) in zip(parts, hits):
                    search(part, k, hit, by_doc)
            for (_, _, _, first, _), (hit, by_doc) in zip(parts, hits):
                covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
                n_words.extend(np.diff(first).tolist())
                n_hit.extend((covered[first[1:]] - covered[first[:-1]]).tolist())
                items.extend(sorted(x) for x in by_doc)
            parts.clear()

        for _, _, data, offsets in chunks(column):
            data = LOWER[data]
            s, e, first = words(data, offsets, ALNUM)
            parts.append((data, s, e, first, hashes_of(data, s, e)))
            # one block needs no waiting
            if len(shared) == 1 or sum(len(p[0]) for p in parts) >= HELD:
                flush()
        flush()
        return n_words, n_hit, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, items = found(b.column(1))
            yield batch(id=b.column(0), n_words=pa.array(n_words, pa.int64()), n_hit=pa.array(n_hit, pa.int64()), items=pa.array(items, pa.list_(pa.string())))

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>").withColumnRenamed("id", id_col)


def items_digest(items: str) -> F.Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
