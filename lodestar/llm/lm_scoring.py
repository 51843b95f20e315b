"""Log10 probability of texts under an interpolated trigram model of the training documents.

A cell is the documents of a task that make about CELL_BYTES of text. It asks for its distinct words, word pairs and triples, with their training
counts, and sends them to the shards of their first words. A shard sums the counts, builds an Elias-Fano trie of its words, their
successors and the successors of those, maps it into memory, and answers every cell from it with a byte or two for each thing asked.
The cells then score their documents:

    p1(w) = (c(w) + 1) / (N + V + 1)
    p2(w | u) = a(u, w) + b(u) * p1(w)
    p3(w | t, u) = a(t, u, w) + b(t, u) * p2(w | u)

where a is the discounted relative frequency, quantised downwards to 254 steps of 9 decades, and b what the a of a context leave. The first word of a text
has p2 after a mark of the beginning.

A word that begins more than SHARD_TOKENS pairs is split: its successors go to several shards by their hash, each of which gets its whole count and
answers with its part of the mass. Such words are found by counts of each task's frequent ones, at most 65,536 of them.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, followed by one end, which counts as a token. A null or empty text
is the end alone. A null id is never held out. Repeated rows count as often as they occur; extra columns are ignored; an empty table gives an empty
result, and without training rows N and V are 0. Words are told apart by 64 bits of hash, successors within their context by 40, those of a pair by 32.
docs is read three times and must come in the same rows for each partition, as a scan of files does; if a cell's documents have changed, the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .ngram_trie import VALUES, NgramTrie
from .textbytes import NOT_SPACE, chunks, mix, word_hashes

#: Not hashes of words, but for a chance of one in 2 ** 64.
BEGIN, END = np.uint64(0xB5297A4D68E31DA4), np.uint64(0x1B56C4E962E99D27)
CELL_BYTES = 8 << 20
SHARD_BYTES = 6 << 20
#: Pairs that one context may have in a shard, about, and the least share of all for a word to be split.
SHARD_TOKENS, LEAST_SHARE = 1 << 20, 1 / 65536
_SPLIT = np.uint64(0x9E3779B97F4A7C15)

REQUEST = "cell long, shard long, words binary, splits binary, counts binary, fan binary, low binary, high binary, pairs binary, fan3 binary, last binary, triples binary"
REPLY = "cell long, shard long, counts binary, mass binary, codes binary, weights binary, codes3 binary, tokens long, types long"


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts one after the other, and how many each has."""
    tokens, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in chunks(texts):
        hashes, first = word_hashes(data, offsets, NOT_SPACE)
        tokens.append(np.insert(hashes, first[1:], END))
        lengths.append(np.diff(first) + 1)
    return np.concatenate(tokens), np.concatenate(lengths)


class Cell:
    """The tokens of some documents and what they ask of the model, in an order that does not depend on that of the documents."""

    def __init__(self, texts: pa.Array, train: np.ndarray, hot: dict[str, np.ndarray], shards: int):
        token, self.lengths = tokens_of(texts)
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.begins = np.cumsum(self.lengths) - self.lengths
        words, at = np.unique(np.append(token, BEGIN), return_inverse=True)
        self.word, begin, n = at[:-1], at[-1], len(words)
        self.before = np.concatenate([[begin], self.word[:-1]])
        self.before[self.begins] = begin
        weight = train[self.document]
        counts = np.bincount(self.word, weight, n)
        counts[begin] = train.sum()
        # entries: a word, or a part of a split word's successors
        splits = np.ones(n, np.int64)
        place = np.minimum(np.searchsorted(words, hot["words"]), n - 1)
        mine = words[place] == hot["words"]
        splits[place[mine]] = hot["splits"][mine]
        self.first = np.cumsum(splits) - splits
        self.of = np.repeat(np.arange(n), splits)
        split = (np.arange(len(self.of)) - self.first[self.of]).astype(np.uint64)
        shard = (mix(words[self.of] + split * _SPLIT) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        self.rank = np.empty_like(order)
        self.rank[order] = np.arange(len(order))
        self.shard, self.words, self.splits, self.counts = shard[order], words[self.of][order], split[order].astype(np.uint16), counts[self.of][order].astype(np.uint32)
        spread = (mix(words) >> np.uint64(8)).astype(np.int64)
        entry = self.rank[self.first[self.before] + spread[self.word] % splits[self.before]]
        pairs, self.pair = np.unique(entry * n + self.word, return_inverse=True)
        self.pair_entry, successor = pairs // n, mix(words[pairs % n]) >> np.uint64(24)
        self.low, self.high = successor.astype(np.uint32), (successor >> np.uint64(32)).astype(np.uint8)
        self.pair_counts = np.bincount(self.pair, weight, len(pairs)).astype(np.uint32)
        inner = np.ones(len(token), bool)
        inner[self.begins] = False
        self.inner = np.flatnonzero(inner)
        triples, self.triple = np.unique(self.pair[self.inner - 1] * n + self.word[self.inner], return_inverse=True)
        self.triple_pair, self.last = triples // n, (mix(words[triples % n]) >> np.uint64(24)).astype(np.uint32)
        self.triple_counts = np.bincount(self.triple, weight[self.inner], len(triples)).astype(np.uint32)

    def requests(self, cell: int) -> pa.RecordBatch:
        """A row for each shard. Counts of a cell fit 32 bits, since a cell is one document or CELL_BYTES."""
        full, first = np.unique(self.shard, return_index=True)
        edges = [*first.tolist(), len(self.shard)]
        pair_edges = np.searchsorted(self.pair_entry, edges).tolist()
        triple_edges = np.searchsorted(self.triple_pair, pair_edges).tolist()
        cut = lambda x, e: pa.array([x[a:z].tobytes() for a, z in zip(e, e[1:])], pa.binary())
        fan = np.bincount(self.pair_entry, minlength=len(self.words)).astype(np.uint32)
        fan3 = np.bincount(self.triple_pair, minlength=len(self.low)).astype(np.uint32)
        columns = {"cell": pa.array([cell] * len(full), pa.int64()), "shard": pa.array(full, pa.int64())}
        columns |= {"words": cut(self.words, edges), "splits": cut(self.splits, edges), "counts": cut(self.counts, edges), "fan": cut(fan, edges)}
        columns |= {"low": cut(self.low, pair_edges), "high": cut(self.high, pair_edges), "pairs": cut(self.pair_counts, pair_edges), "fan3": cut(fan3, pair_edges)}
        columns |= {"last": cut(self.last, triple_edges), "triples": cut(self.triple_counts, triple_edges)}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def answer(requests: pa.Table, least: int, discount: float) -> pa.Table:
    """The shard's trie from all requests, and what it tells each cell."""

    def load(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        values = [x.as_buffer() for x in requests.column(name)]
        sizes = np.array([v.size for v in values]) // np.dtype(kind).itemsize
        return np.frombuffer(b"".join(values), kind), np.concatenate([[0], np.cumsum(sizes)])

    words, edges = load("words", np.uint64)
    splits, fan = load("splits", np.uint16)[0], load("fan", np.uint32)[0].astype(np.int64)
    keys = words + splits.astype(np.uint64) * _SPLIT
    contexts, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, load("counts", np.uint32)[0], len(contexts)).astype(np.int64)
    low, pair_edges = load("low", np.uint32)
    word = low.astype(np.uint64) | (load("high", np.uint8)[0].astype(np.uint64) << np.uint64(32))
    fan3 = load("fan3", np.uint32)[0].astype(np.int64)
    last, triple_edges = load("last", np.uint32)

    def merged(of: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where each goes, and of what is distinct: the place of its context, the successor, and the sum of counts."""
        names, number = np.unique(successors, return_inverse=True)
        both, where = np.unique(of * max(1, len(names)) + number, return_inverse=True)
        return where, (both // max(1, len(names)), names[both % max(1, len(names))], np.bincount(where, counts, len(both)).astype(np.int64))

    where, pairs = merged(np.repeat(at, fan), word, load("pairs", np.uint32)[0])
    where3, triples = merged(np.repeat(where, fan3), last.astype(np.uint64), load("triples", np.uint32)[0])
    trie = NgramTrie.mapped(NgramTrie.build(contexts, total, pairs, triples, least, discount))
    # what several cells ask is looked up once, in the trie's own order
    rank = trie.context(contexts)
    many = lambda of, n: np.bincount(of, minlength=n)
    code, weight, code3 = trie.query(rank, many(pairs[0], len(contexts)), pairs[1], many(triples[0], len(pairs[0])), triples[1])
    rank, code, weight, code3 = rank[at], code[where], weight[where], code3[where3]
    whole = np.zeros(len(contexts), bool)
    whole[at[(splits == 0) & (words != BEGIN)]] = True
    cut = lambda x, e: pa.array([x[a:z].tobytes() for a, z in zip(e.tolist(), e[1:].tolist())], pa.binary())
    n = len(edges) - 1
    told = {"counts": cut(trie.counts[rank], edges), "mass": cut(trie.mass[rank], edges), "codes": cut(code, pair_edges), "weights": cut(weight, pair_edges), "codes3": cut(code3, triple_edges)}
    sums = {"tokens": int(total[whole].sum()), "types": int((total[whole] > 0).sum())}
    return pa.table({"cell": requests.column("cell"), "shard": requests.column("shard"), **told, **{k: pa.array([v] * n, pa.int64()) for k, v in sums.items()}})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The documents of a task, dealt into cells in the order in which they come."""
    cell, held, size = TaskContext.get().partitionId() << 33, [], 0
    for b in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, ends = 0, np.cumsum(lengths)
        while begin < b.num_rows:
            base = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, base + CELL_BYTES - size, "right"))
            if end == begin and not held:
                end = begin + 1
            if end > begin:
                held.append(b.slice(begin, end - begin))
                size += int(ends[end - 1] - base)
            if end < b.num_rows or size >= CELL_BYTES:
                yield cell, pa.Table.from_batches(held)
                cell, held, size = cell + 1, [], 0
            begin = end
    if held:
        yield cell, pa.Table.from_batches(held)


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _frequent(base: DataFrame, tokens: int) -> dict[str, np.ndarray]:
    """The words with more than SHARD_TOKENS pairs and LEAST_SHARE of all, and into how many parts each is split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _cells(batches):
            token, lengths = tokens_of(t.column("text").cast(pa.large_string()).combine_chunks())
            words, n = np.unique(token, return_counts=True)
            words, n = np.append(words, BEGIN), np.append(n, len(lengths))
            often = n >= len(token) * max(LEAST_SHARE, SHARD_TOKENS / max(1, tokens)) / 2
            yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["word", "n"])

    counted = base.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > max(SHARD_TOKENS, tokens * LEAST_SHARE)).orderBy(F.desc("n")).limit(int(1 / LEAST_SHARE)).toPandas()
    words, order = np.unique(rows["word"].to_numpy(np.int64).view(np.uint64), return_index=True)
    return {"words": words, "splits": np.minimum(-(-rows["n"].to_numpy(np.int64)[order] // SHARD_TOKENS), 65535)}


def score(docs: DataFrame, held_out: Column, least: int = 1, discount: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; held_out: rows not to learn from; least: of pairs and triples in the trie."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, size // SHARD_BYTES)
    # a token has about six bytes
    hot = base.sparkSession.sparkContext.broadcast(_frequent(base, size // 6))
    kind = base.schema["id"].dataType.simpleString()

    def cell_of(t: pa.Table) -> Cell:
        train = ~t.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        return Cell(t.column("text").cast(pa.large_string()).combine_chunks(), train.astype(float), hot.value, shards)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, t in _cells(batches):
            yield cell_of(t).requests(cell)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, t in _cells(batches):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([_packed(t)], pa.binary())], names=["cell", "packed"])

    replies = materialize(base.mapInArrow(ask, REQUEST).groupBy("shard").applyInArrow(lambda t: answer(t, least, discount), REPLY))
    sums = replies.groupBy("shard").agg(F.max("tokens").alias("tokens"), F.max("types").alias("types")).agg(F.sum("tokens"), F.sum("types")).first()
    n, v = sums[0] or 0, sums[1] or 0

    def tell(packed: pa.Table, replies: pa.Table) -> pa.Table:
        t = pa.ipc.open_stream(packed.column("packed")[0].as_py()).read_all()
        cell, replies = cell_of(t), replies.sort_by("shard")
        load = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in replies.column(name)), kind)
        counts, mass, codes, weights, codes3 = load("counts", np.int64), load("mass", np.float32), load("codes", np.uint8), load("weights", np.uint8), load("codes3", np.uint8)
        if (len(counts), len(codes), len(codes3)) != (len(cell.words), len(cell.low), len(cell.last)):
            raise ValueError("a cell's documents are not those it asked for; materialize the documents before scoring")
        left = np.maximum(1 - np.bincount(cell.of, mass[cell.rank].astype(float)), 1e-8)
        counts = counts[cell.rank[cell.first]].astype(float)
        unigram = ((counts + 1) / (n + v + 1))[cell.word]
        p = VALUES[codes][cell.pair] + left[cell.before] * unigram
        known_pair = VALUES[weights][cell.pair[cell.inner - 1]]
        q = p.copy()
        q[cell.inner] = VALUES[codes3][cell.triple] + known_pair * p[cell.inner]
        rows = len(cell.lengths)
        sums = lambda x: np.bincount(cell.document, x, rows)
        known = sums((counts > 0)[cell.word].astype(float)).astype(np.int64)
        return pa.table({"id": t.column("id"), "held_out": t.column("held_out"), "n_tokens": cell.lengths.astype(np.int64), "n_known": known, "train_tokens": np.full(rows, n, np.int64), "base_score": sums(np.log10(unigram)), "score": sums(np.log10(q))})

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return base.mapInArrow(pack, "cell long, packed binary").groupBy("cell").cogroup(replies.groupBy("cell")).applyInArrow(tell, schema).withColumnRenamed("id", id_col)
