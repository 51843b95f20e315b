"""Exact duplicates: counting quotient filters per partition, merged by sorted remainders, then byte verification.

Each partition counts the 64-bit fingerprints of its texts in counting quotient filters, one for
each range of quotients. Filters of the same range merge without loss, since a fingerprint is
given back by its quotient and remainder. Only texts whose fingerprint counts above one are then
grouped by their bytes; no other text is moved.

Texts are equal when they are identical after deleting every character of `[\\x20\\x09-\\x0D]`.
A null text counts as empty; all empty texts are equal. The longest original text stays, then the
smallest id (null ids last). Rows that repeat both id and length of the row that stays are kept too, as
nothing tells them apart. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, materialize, small

SPACES = r"[\x20\x09-\x0D]+"


@dataclass
class CountingQuotientFilter:
    """Fingerprints of `bits` bits with counts: the quotient (high part) by two bit maps, remainders in order.

    occupied[q] tells that quotient q has remainders; run_end[i] that slot i is the last of its quotient."""

    quotient_bits: int
    bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int, bits: int) -> CountingQuotientFilter:
        """fingerprints: distinct and sorted, each below 2 ** bits."""
        shift = np.uint64(bits - quotient_bits)
        quotients = (fingerprints >> shift).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        run_end = np.ones(len(quotients), bool)
        run_end[:-1] = quotients[1:] != quotients[:-1]
        return cls(quotient_bits, bits, occupied, run_end, fingerprints & ((np.uint64(1) << shift) - np.uint64(1)), counts.astype(np.int64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts."""
        runs = np.cumsum(self.run_end) - self.run_end
        quotients = np.flatnonzero(self.occupied)[runs].astype(np.uint64)
        return (quotients << np.uint64(self.bits - self.quotient_bits)) | self.remainders, self.counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        parts = [f.entries() for f in filters]
        fingerprints, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([p[1] for p in parts]), len(fingerprints))
        return cls.build(fingerprints, counts, filters[0].quotient_bits, filters[0].bits)

    def dumps(self) -> bytes:
        head = np.array([self.quotient_bits, self.bits, len(self.remainders)], np.int64)
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_end), self.remainders, self.counts))

    @classmethod
    def loads(cls, data: bytes) -> CountingQuotientFilter:
        q, bits, n = np.frombuffer(data, np.int64, 3).tolist()
        at = 24
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, (1 << q) + 7 >> 3, at), count=1 << q).astype(bool)
        at += (1 << q) + 7 >> 3
        run_end = np.unpackbits(np.frombuffer(data, np.uint8, n + 7 >> 3, at), count=n).astype(bool)
        at += n + 7 >> 3
        return cls(q, bits, occupied, run_end, np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n))


def repeated_fingerprints(fingerprints: DataFrame, rows: int, slice_rows: int = 1 << 19) -> DataFrame:
    """Of a frame with one long column, the values that occur more than once, as column fp.

    slice_rows: about how many rows of the whole frame one merged filter stands for."""
    slice_bits = max(6, int(np.ceil(np.log2(max(1, rows / slice_rows)))))
    bits = 64 - slice_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        slices, edges = np.unique(values >> np.uint64(bits), return_index=True)
        low = values & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))
        for k, a, b in zip(slices, edges, [*edges[1:], len(values)]):
            q = max(1, int(b - a).bit_length())
            # one size of quotient in each slice of a partition; merging needs a common one
            yield batch(slice=pa.array([int(k)], pa.int64()), filter=pa.array([CountingQuotientFilter.build(low[a:b], counts[a:b], min(q, 16), bits).dumps()], pa.binary()))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        filters = [CountingQuotientFilter.loads(x) for x in pdf["filter"]]
        q = max(f.quotient_bits for f in filters)
        filters = [f if f.quotient_bits == q else CountingQuotientFilter.build(*f.entries(), q, bits) for f in filters]
        values, counts = CountingQuotientFilter.merge(filters).entries()
        again = values[counts > 1] | (np.uint64(pdf["slice"].iloc[0]) << np.uint64(bits))
        return pd.DataFrame({"fp": again.view(np.int64)})

    return fingerprints.mapInArrow(count, "slice long, filter binary").groupBy("slice").applyInPandas(merge, "fp long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, "")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), norm.alias("norm"))
    rows = materialize(base.select("id", "n", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha")))
    again = materialize(repeated_fingerprints(rows.select("fp"), rows.count()))
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id")
    groups = (
        base.withColumn("fp", F.xxhash64("norm"))
        .join(small(again, 16), "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
        .where("group_size > 1")
        .select("fp", F.sha2("norm", 256).alias("sha"), "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_n"))
    )
    groups = materialize(groups)
    alone = F.col("group_size").isNull()
    return rows.join(small(groups, 160), ["fp", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
