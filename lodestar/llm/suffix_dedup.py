"""Removes every byte that lies in a string of `least` bytes which also starts earlier in the corpus.

Equal strings of `least` bytes have the same anchor: the ANCHOR bytes with the smallest hash in them. The bytes
around an anchor that such strings can reach are its context. So documents are cut into anchors with
hashes of their contexts, and only these are shuffled, the first of each context in a batch:

- a later anchor with a context that occurred before is covered with its whole context
- strings of `least` bytes around equal anchors reach so far to the left or so far to the right that one of SPLITS spans around the
  anchor is equal too; an anchor whose spans all occur in one context only needs nothing more
- the first anchors of different contexts that share a span fetch those contexts. In each group of them, the
  suffixes are ordered, and breadth-first backward extension on the Burrows-Wheeler transform separates
  suffix intervals by increasing common prefix; what is together after least - 1 levels shares `least` bytes.

Earlier means a smaller id, or the same document and an earlier start; null ids come last. Rows that repeat an id with
the same text are one document, and all get its result; with other texts, they are ordered by a hash. Null texts are empty and have no
bytes. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_BYTES, batch, by_arrow, dealt, materialize, packed
from .textbytes import chunks, column_bytes, mix, prefix_hash, span_hash

ANCHOR = 24
#: Spans around an anchor of which equal strings of the wanted length share one.
SPLITS = 8
#: Bytes of text for one shard of anchors, and of contexts whose suffixes are ordered at once.
SHARD_BYTES, GROUP_BYTES = 16 << 20, 1 << 17


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def before_anchor(reach: int) -> list[tuple[int, int]]:
    """For each split, the least and most bytes before the anchor at which its strings begin."""
    edges = [(reach + 1) * k // SPLITS for k in range(SPLITS + 1)]
    return [(a, max(a, b - 1)) for a, b in zip(edges, edges[1:])]


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of every anchor: its text, place, context's start and end (in data), the hashes of its bytes, of its context and (n x SPLITS) of its spans."""
    n, reach = len(data), least - ANCHOR
    if n < least:
        return *(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)), np.zeros((0, SPLITS), np.uint16)
    h = prefix_hash(data)
    places = np.arange(n - ANCHOR + 1)
    own = span_hash(h, places, places + ANCHOR)
    low = np.uint64((1 << n.bit_length()) - 1)
    first = sliding_min((mix(own) & ~low) | places.astype(np.uint64), reach + 1)
    valid = np.ones(len(first), bool)
    for a, b in zip(np.maximum(offsets[1:] - least + 1, offsets[:-1]).tolist(), offsets[1:].tolist()):
        valid[a:b] = False
    at = np.unique((first[valid] & low).astype(np.int64))
    doc = np.searchsorted(offsets, at, "right") - 1
    start, end = np.maximum(offsets[doc], at - reach), np.minimum(offsets[doc + 1], at + ANCHOR + reach)
    left, right = span_hash(h, start, at), span_hash(h, at + ANCHOR, end)
    around = mix(left + np.uint64(3) * right + (at - start).astype(np.uint64) * np.uint64(1009) + (end - at).astype(np.uint64))
    spans = np.zeros((len(at), SPLITS), np.uint16)
    for k, (a, b) in enumerate(before_anchor(reach)):
        lo, hi = at - a, at + ANCHOR + reach - b
        fits = (lo >= offsets[doc]) & (hi <= offsets[doc + 1])
        spans[:, k] = np.where(fits, span_hash(h, np.where(fits, lo, at), np.where(fits, hi, at)), mix(at.astype(np.uint64) ^ own[at])) >> np.uint64(48)
    return doc, at, start, end, own[at], around, spans


def merged(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each id, in order."""
    if not len(ids):
        return ids, start, end
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    base = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    begins = new.copy()
    begins[1:] |= (start + base)[1:] > reach[:-1]
    first = np.flatnonzero(begins)
    last = np.concatenate([first[1:] - 1, [len(ids) - 1]])
    return ids[first], start[first], reach[last] - base[last]


def common_prefixes(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and the number of each suffix's interval; suffixes in one interval share `least` symbols."""
    n = len(symbols)
    # seven symbols of nine bits first, then doubling
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(6, np.int64)])
    rank, done = np.zeros(n, np.int64), 7
    for k in range(7):
        rank = (rank << 9) | padded[k : k + n]
    rank = np.unique(rank, return_inverse=True)[1]
    while done < least:
        shifted = np.zeros(n, np.int64)
        shifted[: max(0, n - done)] = rank[done:] + 1
        rank = np.unique(rank * (n + 1) + shifted, return_inverse=True)[1]
        done *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # the transform: the symbol before each suffix, and where the suffix with that symbol stands
    transform, back = symbols[order - 1].astype(np.int64), place[order - 1]
    apart = np.ones(n + 1, bool)
    apart[1:n] = symbols[order[1:]] != symbols[order[:-1]]
    new = np.flatnonzero(apart[:n])[1:]
    for _ in range(least - 1):
        # intervals that new edges part into pieces: all pieces but the widest are extended by each of their symbols
        edges = np.flatnonzero(apart)
        at = np.searchsorted(edges, new)
        parted, old = np.zeros(len(edges), bool), np.ones(len(edges), bool)
        parted[at] = parted[at - 1] = True
        old[at] = False
        piece = np.flatnonzero(parted)
        start, width = edges[piece], edges[piece + 1] - edges[piece]
        whole = np.cumsum(old[piece]) - 1
        by_width = np.lexsort((width, whole))
        widest = by_width[np.append(np.flatnonzero(np.diff(whole[by_width])), len(by_width) - 1)]
        before = np.arange(len(piece)) < widest[whole]
        narrow = np.ones(len(piece), bool)
        narrow[widest] = False
        start, width, before = start[narrow], width[narrow], before[narrow]
        which = np.repeat(np.arange(len(width)), width)
        p = np.repeat(start - (np.cumsum(width) - width), width) + np.arange(len(which))
        # of each symbol's places, the one next to the widest piece's side: the greatest before it, the least after it
        side = before[which]
        key = (which << 9) | transform[p]
        by = np.argsort(key * n + np.where(side, n - 1 - back[p], back[p]))
        key = key[by]
        by = by[np.concatenate([[True], key[1:] != key[:-1]])] if len(by) else by
        new = back[p[by]] + side[by]
        new = np.sort(new[~apart[new]])
        if not len(new):
            break
        apart[new] = True
        new = new[np.concatenate([[True], new[1:] != new[:-1]])]
    apart = apart[:n]
    return order, np.cumsum(apart)


def later_windows(contexts: list[np.ndarray], ids: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of the strings of `least` bytes in the contexts that occur in an earlier place of them."""
    sizes = np.array([len(c) for c in contexts])
    symbols = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    for b, c in zip(begin, contexts):
        symbols[b : b + len(c)] = c.astype(np.int64) + 1
    which = np.repeat(np.arange(len(sizes)), sizes + 1)
    within = np.arange(len(symbols)) - begin[which]
    order, interval = common_prefixes(symbols, least)
    whole = within[order] + least <= sizes[which[order]]
    order, interval = order[whole], interval[whole]
    doc, at = ids[which[order]], starts[which[order]] + within[order]
    by = np.lexsort((at, doc, interval))
    interval, doc, at = interval[by], doc[by], at[by]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], interval[1:] != interval[:-1]]), np.arange(len(by)), 0))
    later = (doc != doc[first]) | (at != at[first])
    return doc[later], at[later]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (id, text, key): key orders documents and is the id itself if no id repeats or is null."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if base.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return base.withColumn("key", F.col("id"))
    hashed = base.withColumn("h", F.xxhash64("text"))
    keys = materialize(hashed.select("id", "h").distinct().orderBy(F.col("id").asc_nulls_last(), "h").withColumn("key", F.monotonically_increasing_id()))
    same = hashed["id"].eqNullSafe(keys["id"]) & (hashed["h"] == keys["h"])
    return hashed.join(keys, same).select(hashed["id"], "text", "key")


def remove_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row."""
    base = _numbered(docs, id_col, text_col)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(32, size // SHARD_BYTES)
    mark = lambda ids, start, end: dealt((mix(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int64), id=ids, start=start.astype(np.int32), end=end.astype(np.int32))
    names = ("id", "start", "end", "own", "around", "at", "spans")

    def shaped(b: pa.RecordBatch, marks: bool) -> pa.RecordBatch:
        """One shape for anchors and marks; shards of marks are below zero."""
        shard = pa.array(-1 - b.column(0).to_numpy()) if marks else b.column(0)
        have = dict(zip(b.schema.names, b.columns))
        return batch(shard=shard, **{k: have.get(k, pa.array([b""] * b.num_rows, pa.binary())) for k in names})

    def firsts(own, around, ids, at):
        """Of each context the first place, in order of bytes and context, and all places that are later."""
        order = np.lexsort((at, ids, around, own))
        own, around = own[order], around[order]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (around[1:] != around[:-1])])
        to = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        return order[first], order[(ids[order] != ids[to]) | (at[order] != at[to])]

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts, keys = [], b.column(0).to_numpy()
        for lo, _, data, offsets in chunks(b.column(1)):
            doc, at, start, end, own, around, spans = anchors(data, offsets, least)
            parts.append((keys[lo + doc], at - offsets[doc], start - offsets[doc], end - offsets[doc], own, around, spans))
        if not parts:
            return
        ids, at, start, end, own, around, spans = (np.concatenate(x) for x in zip(*parts))
        if not len(ids):
            return
        o, again = firsts(own, around, ids, at)
        if len(again):
            yield shaped(mark(*merged(ids[again], start[again], end[again])), True)
        yield shaped(dealt((mix(own[o]) % np.uint64(shards)).astype(np.int64), id=ids[o], start=start[o].astype(np.int32), end=end[o].astype(np.int32), own=own[o], around=around[o], at=at[o].astype(np.int32), spans=spans[o]), False)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Marks of repeated contexts; with `own`, contexts to fetch."""
        shard = int(pdf["shard"].iloc[0])
        ids, start, end = packed(pdf["id"], np.int64), packed(pdf["start"], np.int32).copy(), packed(pdf["end"], np.int32).copy()
        if shard < 0:
            ids, start, end = merged(ids, start, end)
            return pd.DataFrame([(-1 - shard, ids.tobytes(), start.astype(np.int32).tobytes(), end.astype(np.int32).tobytes(), None)], columns=["shard", "id", "start", "end", "own"])
        own, around, at = packed(pdf["own"], np.uint64), packed(pdf["around"], np.uint64), packed(pdf["at"], np.int32)
        kept, again = firsts(own, around, ids, at)
        spans, shared = packed(pdf["spans"], np.uint16).reshape(-1, SPLITS)[kept], np.zeros((len(kept), SPLITS), bool)
        for k in range(SPLITS):
            by = np.lexsort((spans[:, k], own[kept]))
            same = np.flatnonzero((own[kept][by[1:]] == own[kept][by[:-1]]) & (spans[by[1:], k] == spans[by[:-1], k]))
            shared[by[same], k] = shared[by[same + 1], k] = True
        rows = mark(*merged(ids[again], start[again], end[again])).to_pandas()
        rows["own"] = None
        any_ = shared.any(1)
        fetch, shared = kept[any_], shared[any_]
        # only as far around the anchor as strings of the shared splits reach
        least_before, most_before = np.array(before_anchor(least - ANCHOR)).reshape(-1, 2).T
        start[fetch] = np.maximum(start[fetch], at[fetch] - most_before[SPLITS - 1 - np.argmax(shared[:, ::-1], 1)])
        end[fetch] = np.minimum(end[fetch], at[fetch] + least - least_before[np.argmax(shared, 1)])
        wanted = dealt((mix(ids[fetch].view(np.uint64)) % np.uint64(shards)).astype(np.int64), id=ids[fetch], start=start[fetch], end=end[fetch], own=own[fetch]).to_pandas()
        return pd.concat([rows, wanted], ignore_index=True)

    shape = "shard long, id binary, start binary, end binary, own binary"
    settled = materialize(by_arrow(base.select("key", "text"), cut, "shard long, id binary, start binary, end binary, own binary, around binary, at binary, spans binary").groupBy("shard").applyInPandas(settle, shape))

    def of_documents(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row for each document with its ranges; of marks, merged."""
        ids, start, end = packed(pdf["id"], np.int64), packed(pdf["start"], np.int32), packed(pdf["end"], np.int32)
        if pdf["own"].iloc[0] is None:
            ids, start, end = merged(ids, start, end)
            own = np.zeros(len(ids), np.uint64)
        else:
            order = np.lexsort((start, ids))
            ids, start, end, own = ids[order], start[order], end[order], packed(pdf["own"], np.uint64)[order]
        names, first = np.unique(ids, return_index=True)
        cut_up = lambda x, kind: [p.astype(kind).tobytes() for p in np.split(x, first[1:])] if len(names) else []
        return pd.DataFrame({"key": names, "start": cut_up(start, np.int32), "end": cut_up(end, np.int32), "own": cut_up(own, np.uint64)})

    def with_ranges(marks: DataFrame) -> DataFrame:
        ranges = materialize(marks.groupBy("shard").applyInPandas(of_documents, "key long, start binary, end binary, own binary"))
        bytes_ = ranges.agg(F.sum(F.length("start") * 4 + 64)).first()[0] or 0
        return F.broadcast(ranges) if bytes_ <= BROADCAST_BYTES else ranges

    def fetch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, start, end, own, texts, lengths, keys = [], [], [], [], [], [], b.column(0).to_numpy()
        data, offsets = column_bytes(b.column(1))
        for k in range(b.num_rows):
            s, e = (np.frombuffer(b.column(c)[k].as_py(), np.int32).astype(np.int64) for c in (2, 3))
            ids.append(np.full(len(s), keys[k]))
            start.append(s)
            end.append(e)
            own.append(np.frombuffer(b.column(4)[k].as_py(), np.uint64))
            texts += [data[offsets[k] + i : offsets[k] + j].tobytes() for i, j in zip(s.tolist(), e.tolist())]
        if texts:
            own = np.concatenate(own)
            shard = (mix(own) % np.uint64(shards)).astype(np.int64)
            yield batch(shard=pa.array(shard), id=pa.array(np.concatenate(ids)), start=pa.array(np.concatenate(start)), own=pa.array(own.view(np.int64)), bytes=pa.array(texts, pa.binary()))

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("own", kind="stable")
        own, ids, start, texts = pdf["own"].to_numpy(), pdf["id"].to_numpy(), pdf["start"].to_numpy(), pdf["bytes"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found, lo = [], 0
        while lo < len(edges) - 1:
            hi = lo + 1
            while hi < len(edges) - 1 and sizes[edges[hi + 1]] - sizes[edges[lo]] <= GROUP_BYTES:
                hi += 1
            a, z = edges[lo], edges[hi]
            doc, at = later_windows([np.frombuffer(t, np.uint8) for t in texts[a:z]], ids[a:z], start[a:z], least)
            found.append(merged(doc, at, at + least))
            lo = hi
        rows = mark(*merged(*(np.concatenate(x) for x in zip(*found)))).to_pandas()
        rows["own"] = None
        return rows[["shard", "id", "start", "end", "own"]]

    contexts = base.select("key", "text").join(with_ranges(settled.where("own is not null")), "key").select("key", "text", "start", "end", "own")
    expanded = by_arrow(contexts, fetch, "shard long, id long, start long, own long, bytes binary").groupBy("shard").applyInPandas(expand, shape)
    marks = with_ranges(settled.where("own is null").unionByName(expanded))

    def keep(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = column_bytes(b.column(1))
        removed, spans, digests, rest = [], [], [], []
        for k in range(b.num_rows):
            text, s, e = data[offsets[k] : offsets[k + 1]].tobytes(), b.column(2)[k].as_py(), b.column(3)[k].as_py()
            s, e = (np.frombuffer(x or b"", np.int32).tolist() for x in (s, e))
            left = b"".join(text[i:j] for i, j in zip([0, *e], [*s, len(text)]))
            removed.append(len(text) - len(left))
            spans.append(len(s))
            digests.append(hashlib.sha256(left).hexdigest())
            rest.append(left)
        yield batch(id=b.column(0), n_bytes=pa.array(np.diff(offsets), pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept_sha256=pa.array(digests), kept=pa.array(rest, pa.binary()))

    done = by_arrow(base.join(marks, "key", "left").select("id", "text", "start", "end"), keep, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumnRenamed("id", id_col)
