"""Incremental assignment: each micro-batch takes what earlier ones left free, so any split of a stream gives the batch result.

A cell that a committed batch owns stays its own; in the other cells the first new point wins. seq must exceed that of all earlier batches, else the batch fails.
The rule itself takes the stored rows as owners of cells (`operators/lod`): those near the batch meet its points in one shuffle by cells of the root. What a batch
materializes goes when it is done. A batch that Spark replays gets a new run in the place of its old one and reads only earlier ones, so it counts once.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from ..model import POINT_COLUMNS, LodOptions
from ..operators import lod as rule
from ..operators.batches import recent
from ..sinks.store import Store
from ..sources.text import points_of_batch, stream_lines
from ..storage import beside, scratch


def append(points: DataFrame, batch: int, store: Store, options: LodOptions, keep_recent: int = 300_000, compact_every: int | None = None, keyed: bool = False) -> None:
    """Assign one micro-batch and commit it, with the most recent points of all batches so far.

    The points are kept in memory and on disk until the commit; what is lost with an executor is read once more. The task that settles points writes them where they stay.
    keyed: the points come settled by `streaming.keyed`. That is committed as it is, unless a point's cells are no parts of those above or nodes of the store were replaced:
    then, and for all later batches, the stored rows decide."""
    rows = (points if keyed else points.select(*POINT_COLUMNS)).persist()
    own = rows.select(*POINT_COLUMNS)
    try:
        with scratch(points.sparkSession):
            strange = F.count_if(~F.col("nested")) if keyed else F.lit(0)
            seen = rows.agg(strange.alias("strange"), F.count(F.lit(1)).alias("points"), F.min("seq").alias("first"), F.max("seq").alias("last"), *rule.bounds_of_world(options)).first()
            n, first, last = seen["points"], seen["first"], seen["last"]
            before = store.last_seq(batch)
            if n and before is not None and first <= before:
                raise ValueError(f"batch {batch} has seq {first}, but earlier batches reach {before}")
            draft = store.draft(batch)
            latest = beside.submit(draft.put, "recent", _latest(own, n, first, last, store, batch, keep_recent))
            apart = store.apart(batch) and not seen["strange"]
            if keyed and apart and not store.edited(batch):
                outside = rows.where("not inside").select("seq", F.lit(rule.OUT_OF_BOUNDS).alias("reason"), F.lit("").alias("path"))
                found = rule.of_settled(draft.settled(rows.where("inside").drop("inside")), [outside])
            else:
                found = rule.assign(own, options, stored=store.accepted(before=batch) if store.batches_before(batch) else None, apart=apart, bounds=seen, hold=draft.settled)
            latest.result()
            draft.commit(replace(found, apart=found.apart and apart), n, last if n else before)
            if compact_every and len(store.batches_since_base()) > compact_every:
                store.compact()
    finally:
        rows.unpersist()


def _latest(own: DataFrame, n: int, first: int | None, last: int | None, store: Store, batch: int, keep: int) -> DataFrame:
    """The `keep` points with the largest seq of all batches so far. Those of a batch come after all earlier ones."""
    if n >= keep and n and last - first + 1 == n:
        return own.where(F.col("seq") > last - keep)
    if n >= keep:
        return recent(own, keep)
    return recent(store.recent(batch), keep - n).unionByName(own)


def append_grouped(points: DataFrame, batch: int, store: Store, options: LodOptions, every: int, keep_recent: int = 300_000, compact_every: int | None = None) -> bool:
    """Take a micro-batch into the log of pending points; once at least `every` points are pending, which is looked at when a batch ends, commit all of them as this batch.

    A batch that comes again replaces its own points in the log, or does nothing if it was committed. Returns whether it committed."""
    if (last := store.last_batch()) is not None and batch <= last:
        return False
    pending = store.put_pending(points.select(*POINT_COLUMNS), batch)
    if sum(pending.values()) < every:
        return False
    flush(store, options, keep_recent, compact_every)
    return True


def flush(store: Store, options: LodOptions, keep_recent: int = 300_000, compact_every: int | None = None) -> None:
    """Commit what is pending, if anything is."""
    pending = store.pending()
    if pending:
        append(store.pending_points(), max(pending), store, options, keep_recent, compact_every)
        store.drop_pending(max(pending))


def progress(store: Store) -> DataFrame:
    """A row for each commit: points, accepted, dropped and nodes so far, and points a second since the commit before. The root counts as a node from the start."""
    w = W.orderBy("batch_id")
    so_far = [F.sum(c).over(w).alias(c) for c in ("points", "accepted", "dropped")]
    # a row for each batch, so that one task may hold them
    seconds = F.col("written").cast("double") - F.lag("written").over(w).cast("double")
    return store.commits().select("batch_id", *so_far, (F.sum("new_nodes").over(w) + 1).alias("nodes"), "written", (F.col("points") / F.nullif(seconds, F.lit(0.0))).alias("points_per_second"))


#: Of the metrics that a stream gives while it runs.
OBSERVED = "lodestar"


class ProgressLog(StreamingQueryListener):
    """Writes how far a stream got, as it goes, to the store: a row when a micro-batch ends, if `least_ms` have passed since the row before, and one at the end.

    Points are counted where the stream reads them, by an observation, so no job runs for it; nodes are those of the store's commits. A listener outlives its query; remove it from the session's streams."""

    def __init__(self, store: Store, least_ms: int = 500):
        self.store, self.least, self.points, self.batch = store, least_ms / 1000, 0, -1
        self.began, self.wrote, self.pending, self.ended = time.monotonic(), float("-inf"), None, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(OBSERVED)
        if seen is None or event.progress.batchId <= self.batch:
            return
        self.points, self.batch = self.points + seen["points"], event.progress.batchId
        elapsed = time.monotonic() - self.began
        self.pending = {"batch_id": self.batch, "points": self.points, "elapsed_ms": int(1000 * elapsed), "points_per_second": self.points / max(elapsed, 1e-3)}
        if time.monotonic() - self.wrote >= self.least:
            self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write()
        self.ended.set()

    def wait(self, seconds: float = 60.0) -> None:
        """Until the last row is written; events come a little after the query's end."""
        self.ended.wait(seconds)

    def _write(self) -> None:
        if self.pending is not None:
            self.store.put_progress(self.pending)
            self.pending, self.wrote = None, time.monotonic()


def ingest(stream: DataFrame, store: Store, options: LodOptions, checkpoint: str, keep_recent: int = 300_000, compact_every: int | None = 64, every: int | None = None, points_of: Callable[[DataFrame, int | None], DataFrame] | None = None) -> DataStreamWriter:
    """A writer to start with the trigger of one's choice, such as availableNow. The source's own limits, such as maxFilesPerTrigger, set how many points a micro-batch has.

    Each micro-batch is a commit, or with `every`, those of at least so many points (`flush` commits the rest when the stream has ended). points_of: makes points of a micro-batch that
    isn't points yet, all with a seq above the one given, as `sources.text.points_of_batch` does."""

    def take(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()  # so that the source is read, and counted, once
        try:
            with scratch(rows.sparkSession):
                points = rows
                if points_of is not None:
                    after = [s for s in (store.last_seq(batch), store.pending_seq(batch)) if s is not None]
                    points = points_of(rows, max(after, default=None))
                if every is None:
                    append(points, batch, store, options, keep_recent, compact_every)
                else:
                    append_grouped(points, batch, store, options, every, keep_recent, compact_every)
        finally:
            rows.unpersist()

    return stream.observe(OBSERVED, F.count(F.lit(1)).alias("points")).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)


def ingest_text(spark: SparkSession, folder: str, store: Store, options: LodOptions, checkpoint: str, header: bool = True, files_per_trigger: int | None = None, origin: tuple[float, float] | None = None, **more) -> DataStreamWriter:
    """Text files of points as they appear in a folder, Cartesian or, with an origin, geodetic; their hierarchy is that of one read of the files in the order of their arrival."""
    return ingest(stream_lines(spark, folder, header, files_per_trigger), store, options, checkpoint, points_of=lambda lines, after: points_of_batch(lines, after, origin=origin), **more)
