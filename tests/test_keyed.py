"""Streams with keyed state against the walk of each point, restarts, replaced nodes and cells that are not apart."""

import numpy as np
import pytest
from lodestar.model import POINT, LodOptions, World
from lodestar.operators import lod
from lodestar.sinks.store import Store
from lodestar.streaming import keyed
from pyspark.sql import functions as F

from .test_lod import CASES, points, walk


def put(frame, folder, low, high):
    """A file of points, which is a micro-batch."""
    frame.where(F.col("seq").between(low, high - 1)).repartition(3).sortWithinPartitions(F.rand(1)).coalesce(1).write.mode("append").parquet(folder)


def run(own, folder, store, options, **more):
    stream = own.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keyed.ingest_keyed(stream, store, options, f"{folder}/checkpoint", **more).trigger(availableNow=True).start().awaitTermination()


def owned(store):
    return {r["seq"]: (r["path"], (r["cx"], r["cy"], r["cz"])) for r in store.accepted().collect()}


@pytest.fixture
def calls(monkeypatch):
    """How often stored rows decided."""
    met, assign = [], lod.assign
    monkeypatch.setattr(lod, "assign", lambda *a, **k: met.append(1) or assign(*a, **k))
    return met


@pytest.mark.parametrize("name, split", [("clusters far from a wide world's middle", 17), ("duplicates", 0), ("edges and outside", 5)])
def test_keyed(spark, tmp_path, calls, name, split):
    """Three micro-batches, the last after a restart, give the walk's result, and no stored row is read for it."""
    rows, options = CASES[name]
    rows = np.asarray(rows)
    frame, own, step = points(spark, rows), keyed.state_session(spark, 2), -(-len(rows) // 3)
    store = Store(spark, str(tmp_path / "s"))
    for k in range(3):
        put(frame, str(tmp_path / "in"), step * k, step * (k + 1))
        if k:
            run(own, str(tmp_path), store, options, split=split)
    want = walk(rows, options)
    assert owned(store) == {k: v for k, v in want.items() if v} and not calls and store.batches() == [0, 1, 2]
    lost = {r["seq"]: r["reason"] for r in store.dropped().collect()}
    assert lost == {k: "max_depth" if k in want else "out_of_bounds" for k in range(len(rows)) if not want.get(k)}


def test_keyed_not_apart(spark, tmp_path, calls):
    rows, options = CASES["edges by rounding"]
    rows = rows[:240]
    frame, store = points(spark, rows), Store(spark, str(tmp_path / "s"))
    for k in range(2):
        put(frame, str(tmp_path / "in"), 120 * k, 120 * (k + 1))
    run(keyed.state_session(spark, 2), str(tmp_path), store, options, split=1)
    assert owned(store) == {k: v for k, v in walk(rows, options).items() if v} and calls and not store.apart()


def test_keyed_replaced(spark, tmp_path, calls):
    """After a replacement the store says what is owned, also once compaction has folded it in."""
    options, own, store = LodOptions(World(0, 0, 0, 128), 8, 6), keyed.state_session(spark, 2), Store(spark, str(tmp_path / "s"))
    frame = points(spark, np.repeat(np.random.default_rng(2).uniform(0, 100, (40, 3)), 3, axis=0)[np.arange(120).reshape(40, 3).T.ravel()])
    put(frame, str(tmp_path / "in"), 0, 40)
    run(own, str(tmp_path), store, options)
    before = owned(store)
    store.replace(store.node_points("").limit(0), spark.createDataFrame([("",)], "path string"))
    store.compact()
    for k in (1, 2):
        put(frame, str(tmp_path / "in"), 40 * k, 40 * (k + 1))
        run(own, str(tmp_path), store, options)
        store.compact()
    root = {v for v in before.values() if not v[0]}
    assert len(calls) == 2 and store.edited() and root <= {v for k, v in owned(store).items() if 40 <= k < 80}
    with pytest.raises(ValueError):
        keyed.settle_stream(frame, options, 7)
