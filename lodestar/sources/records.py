"""Files of 27-byte records: three little-endian doubles and three bytes of colour, without a header."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import POINT, RECORD_BYTES
from ..operators.batches import running_starts
from ..storage import materialize, small

RECORD = np.dtype([("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1")])


def decode(content: bytes) -> np.ndarray:
    if len(content) % RECORD_BYTES:
        raise ValueError(f"{len(content)} bytes are no whole number of {RECORD_BYTES}-byte records")
    return np.frombuffer(content, RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Points in the order of file names and records. The files are small (a node's or the recent points); each is read whole by a task."""
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("path", F.floor(F.col("length") / RECORD_BYTES).cast("long").alias("n"))
    first = materialize(running_starts(sizes, "path", "n", "first").select("path", "first"))
    placed = files.join(small(first, 160), "path").select("first", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = decode(content.as_py())
                columns = [pa.array(np.arange(first, first + len(rows))), *(pa.array(rows[c].astype("f8" if c in "xyz" else "i4")) for c in RECORD.names)]
                yield pa.RecordBatch.from_arrays(columns, ["seq", *RECORD.names])

    return placed.mapInArrow(run, POINT)
