"""Assignment of a stream with keyed state: what is owned stays with the tasks that settle points, and no stored row is read again.

The key is a cell, since cells of a level part those of the level above and points of different cells never meet below. The state of a key is a map from the path of a node
to its owned cells, eight bytes each, of which a batch reads and writes only the nodes that its points walk through. State is RocksDB's, kept by Spark with the stream's
checkpoint: a restart, or a lost executor, finds that of the last committed batch.

With split = 0 the key is a cell of the root, and one shuffle settles a batch. A survey that is small in its world lies in few such cells; then `split` gives the level of the
keys, and there are two steps. The levels above it go first, by cells of the root, and only for contenders: each task keeps the points that would win there among its own,
since fewer competitors never send a point deeper. All others pass that step, dealt evenly. The second step settles the levels from `split` on by cells of that level.

Where rounding puts a point into a cell that is no part of the one above, `nested` is false; `ingest.append` then lets the stored rows decide, for this batch and all later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions import cube
from ..model import CELL_COLUMNS, CUBE_COLUMNS, POINT_COLUMNS, LodOptions
from ..operators import lod as rule
from ..sinks.store import Store
from .ingest import OBSERVED, append

SETTLED = f"{rule.ACCEPTED}, nested boolean, inside boolean"
COLUMNS = [c.split()[0] for c in SETTLED.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Begins the keys of rows that only pass.
PASSING = "~"


class OwnedState:
    """The owned cells of one key, by node, as `settle` asks for them."""

    def __init__(self, state, grid: int):
        self.state, self.side, self.known = state, grid + 1, {}

    def _of(self, path: str) -> np.ndarray:
        if path not in self.known:
            found = self.state.getValue((path,))
            self.known[path] = np.frombuffer(found[0], "<i8") if found else np.zeros(0, "<i8")
        return self.known[path]

    def at(self, depth: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cells = [self._of(path) for path in names]
        code = np.concatenate([np.zeros(0, np.int64), *cells])
        node = np.repeat(np.arange(len(names)), [len(c) for c in cells])
        return node, np.stack([code // self.side**2, code // self.side % self.side, code % self.side], 1)

    def add(self, paths: np.ndarray, cells: np.ndarray) -> None:
        cells = cells.astype(np.int64)
        code = (cells[:, 0] * self.side + cells[:, 1]) * self.side + cells[:, 2]
        names, node = np.unique(paths.astype(str), return_inverse=True)
        order = np.argsort(node, kind="stable")
        for path, new in zip(names.tolist(), np.split(code[order], np.cumsum(np.bincount(node))[:-1])):
            self.known[path] = np.union1d(self._of(path), new)
            self.state.updateValue((path,), (self.known[path].astype("<i8").tobytes(),))


class Settling(StatefulProcessor):
    """The rule for the points of one key, from level `first` through `last`, next to what earlier batches own there."""

    def __init__(self, options: LodOptions, first: int, last: int):
        self.options, self.first, self.last = options, first, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("owned", "path string", "cells binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith(PASSING):
            for pdf in rows:
                yield pdf[COLUMNS]
            return
        pdf = pd.concat([p[COLUMNS] for p in rows], ignore_index=True)
        owned = OwnedState(self.cells, self.options.grid)
        found = rule.settle(*rule._arrays(pdf), self.first, self.last, self.options.grid, owned)
        won = found.depth >= 0
        if won.any():
            owned.add(found.path[won], found.cell[won])
        yield _with(pdf, found)

    def close(self) -> None:
        pass


def _with(pdf: pd.DataFrame, found: rule.Settled) -> pd.DataFrame:
    cells = {c: found.cell[:, k] for k, c in enumerate(CELL_COLUMNS)}
    cubes = {c: found.cubes[:, k] for k, c in enumerate(CUBE_COLUMNS)}
    return pdf.assign(path=found.path, depth=found.depth, **cells, **cubes, nested=pdf["nested"].to_numpy(bool) & found.nested)[COLUMNS]


def _passing(spark: SparkSession) -> Column:
    return F.concat(F.lit(PASSING), F.pmod(F.xxhash64("seq"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _unit() -> Column:
    return F.concat_ws("/", "path", *CELL_COLUMNS)


def _step(rows: DataFrame, key: Column, options: LodOptions, first: int, last: int) -> DataFrame:
    return rows.withColumn("unit", key).groupBy("unit").transformWithStateInPandas(Settling(options, first, last), SETTLED, "append", "none")


def _contenders(rows: DataFrame, options: LodOptions, split: int) -> DataFrame:
    """rows with `contends`: whether a point may be accepted above `split`. The others come with the node and the cell that they have in the last of these levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contends = np.zeros(len(pdf), bool)
            inside = np.flatnonzero(pdf["inside"].to_numpy(bool))
            if len(inside):
                part = pdf.iloc[inside]
                found = rule.settle(*rule._arrays(part), 0, split - 1, options.grid)
                contends[inside] = found.depth >= 0
                lost = part.index[found.depth < 0]
                pdf.loc[lost, COLUMNS] = _with(part, found).loc[lost]
            yield pdf.assign(contends=contends, depth=np.int32(-1))

    return rows.mapInPandas(run, f"{SETTLED}, contends boolean")


def settle_stream(points: DataFrame, options: LodOptions, split: int = 0) -> DataFrame:
    """SETTLED for each point of a stream (model.POINT, seq unique, not null and rising from batch to batch): depth is -1 where no level took it, or where it is not inside the world.

    A coordinate outside that is NaN comes out as null. Of one key, the points of one micro-batch meet in one task, so the source's limits and `split` bound it."""
    if not 0 <= split <= options.max_depth:
        raise ValueError("split must be a level of the hierarchy")
    spark = points.sparkSession
    inside = F.coalesce(cube.inside_world(options.world), F.lit(False))
    rows = points.select(*POINT_COLUMNS, F.lit("").alias("path"), F.lit(-1).alias("depth"), *(c.alias(k) for k, c in cube.world_columns(options.world).items()), F.lit(True).alias("nested"), inside.alias("inside"))
    cells = {k: F.when(F.col("inside"), c).otherwise(F.lit(0)) for k, c in cube.cell(options.grid).items()}
    rows = rows.withColumns(cells).select(*COLUMNS)
    if not split:
        return _step(rows, F.when(F.col("inside"), _unit()).otherwise(_passing(spark)), options, 0, options.max_depth)
    upper = _step(_contenders(rows, options, split), F.when(F.col("contends"), _unit()).otherwise(_passing(spark)), options, 0, split - 1)
    on = F.col("inside") & (F.col("depth") < 0)
    moved = {"path": F.concat("path", cube.octant().cast("string")), **cube.child_of_point()}
    others = [c for c in COLUMNS if c not in moved and c not in CELL_COLUMNS]
    lower = upper.select(*others, on.alias("on"), *(F.col(c).alias(f"above_{c}") for c in CELL_COLUMNS), *(F.when(on, c).otherwise(F.col(k)).alias(k) for k, c in moved.items()))
    lower = lower.withColumns({k: F.when(F.col("on"), c).otherwise(F.col(f"above_{k}")) for k, c in cube.cell(options.grid).items()})
    lower = lower.withColumn("nested", F.col("nested") & F.when(F.col("on"), ~rule.outside_cell_above(options.grid)).otherwise(F.lit(True)))
    return _step(lower.select(*COLUMNS, "on"), F.when(F.col("on"), _unit()).otherwise(_passing(spark)), options, split, options.max_depth)


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application for streams with keyed state, to read the stream with. The number of partitions of the state stays that of the stream's first start."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if partitions is not None:
        own.conf.set("spark.sql.shuffle.partitions", partitions)
    return own


def ingest_keyed(stream: DataFrame, store: Store, options: LodOptions, checkpoint: str, split: int = 0, keep_recent: int = 300_000, compact_every: int | None = 64) -> DataStreamWriter:
    """A writer to start, as `ingest` gives one, for a stream of points that was read with a `state_session`. The store is this stream's alone, from its first batch on.

    A batch that Spark replays finds the state before it and is committed in the place of its old run."""

    def take(rows: DataFrame, batch: int) -> None:
        append(rows, batch, store, options, keep_recent, compact_every, keyed=True)

    seen = stream.observe(OBSERVED, F.count(F.lit(1)).alias("points"))
    return settle_stream(seen, options, split).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
