"""Points as flat 27-byte records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.records import RECORD
from . import files


def encode(rows: pd.DataFrame) -> bytes:
    out = np.zeros(len(rows), RECORD)
    for c in RECORD.names:
        out[c] = rows[c].to_numpy()
    return out.tobytes()


def write_records(points: DataFrame, folder: str) -> DataFrame:
    """Points in order of seq as files of a partition each, whose names sort in that order; lazily: file and points of what was written."""
    ordered = points.repartitionByRange("seq").sortWithinPartitions("seq").select("seq", *RECORD.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        filesystem, base = files.resolve(folder)
        filesystem.create_dir(base, recursive=True)
        for k, b in enumerate(batches):
            if len(b):
                name = f"records-{TaskContext.get().partitionId():06d}-{k:06d}.bin"
                files.write(filesystem, f"{base}/{name}", encode(b))
                yield pd.DataFrame({"file": [name], "points": [len(b)]})

    return ordered.mapInPandas(run, "file string, points long")
