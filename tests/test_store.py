"""The store's runs and manifests, assignment next to stored points, and streams."""

import numpy as np
import pytest
from lodestar.model import LodOptions, World
from lodestar.operators import lod, nodes
from lodestar.sinks.store import Store
from lodestar.sources.text import read_cartesian
from lodestar.streaming import ingest
from pyspark.sql import functions as F

from .test_lod import CASES, points, walk

OPTIONS = LodOptions(World(0, 0, 0, 128), 8, 6)
KEY = ("seq", "path", "depth", "cx", "cy", "cz")


def rows_of(frame):
    return sorted(map(tuple, frame.select(*KEY).collect()))


@pytest.fixture
def filled(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    frame = points(spark, np.random.default_rng(7).uniform(0, 100, (600, 3)))
    for k in range(3):
        ingest.append(frame.where(f"seq >= {200 * k} and seq < {200 * (k + 1)}"), k, store, OPTIONS)
    return store, frame


def test_frames_survive_compaction(spark, filled):
    store, frame = filled
    whole = rows_of(lod.assign(frame, OPTIONS).accepted)
    before, node = store.accepted(), store.node_points("0")
    store.compact()
    ingest.append(frame.where("seq >= 400"), 2, store, OPTIONS)  # a replay retires its old run too
    assert rows_of(before) == whole == rows_of(store.accepted()) and node.count() == store.node_points("0").count()
    assert store.vacuum(3600) == [] and rows_of(before) == whole
    gone = store.vacuum(0)
    assert len(gone) == 3 and rows_of(store.accepted()) == whole and store.vacuum(0) == []
    with pytest.raises(Exception):  # noqa: B017
        before.collect()
    assert store.batches() == [0, 1, 2] and store.base() == 1


def test_two_writers(spark, filled):
    store, frame = filled
    first, second = store.draft(3), store.draft(3)
    found = lod.assign(frame.where("seq < 0"), OPTIONS)
    for draft in (first, second):
        draft.put("recent", frame.select("seq", "x", "y", "z", "r", "g", "b"))
    first.commit(found, 0)
    with pytest.raises(FileExistsError):
        second.commit(found, 0)
    assert store.manifest().version == 4


def test_lookup_reads_little(spark, tmp_path):
    """Of a compacted store, a node's points come from the pages that may have them."""
    store = Store(spark, str(tmp_path / "s"))
    frame = points(spark, np.random.default_rng(8).uniform(0, 128, (60_000, 3)))
    for k in range(3):
        ingest.append(frame.where(f"seq >= {25_000 * k} and seq < {25_000 * (k + 1)}"), k, store, LodOptions(World(0, 0, 0, 128), 4, 8))
    store.compact()
    ingest.append(frame.where("seq < 0"), 3, store, LodOptions(World(0, 0, 0, 128), 4, 8))
    store.compact()
    deep = store.accepted().where("depth = 4").agg(F.min("path")).first()[0]
    found = store.node_points(deep)
    n = len(found.collect())

    def scans(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        kids = plan.children()
        inner = [s for k in range(kids.size()) for s in scans(kids.apply(k))]
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            inner += scans(plan.plan())
        return inner + ([plan] if "FileSourceScan" in plan.getClass().getSimpleName() else [])

    read = sum(s.metrics().apply("numOutputRows").value() for s in scans(found._jdf.queryExecution().executedPlan()))
    assert 0 < n <= read < 60_000 / 4


@pytest.mark.parametrize("kernel_rows", [1 << 16, 16])
@pytest.mark.parametrize("name", sorted(CASES))
def test_next_to_stored(spark, name, kernel_rows):
    """Assigned in three parts, each next to what the others own, by every way of running."""
    rows, options = CASES[name]
    rows = np.asarray(rows)[:240]
    frame, kept, apart = points(spark, rows), None, True
    for k in range(3):
        part = frame.where(f"seq >= {80 * k} and seq < {80 * (k + 1)}")
        found = lod.assign(part, options, kernel_rows, kept, apart)
        apart = apart and found.apart
        done = spark.createDataFrame(found.accepted.collect(), lod.ACCEPTED)
        kept = done if kept is None else kept.unionByName(done)
    want = walk(rows, options)
    assert {r["seq"]: (r["path"], (r["cx"], r["cy"], r["cz"])) for r in kept.collect()} == {k: v for k, v in want.items() if v}


def test_equal_points(spark):
    """A long run takes no more rounds than the others, and only its first points have places."""
    options = LodOptions(World(0, 0, 0, 128), 8, 30)
    base = points(spark, np.random.default_rng(9).uniform(0, 128, (500, 3)))
    many = spark.range(1000, 21_000).select(F.col("id").alias("seq"), *(F.lit(v).alias(c) for c, v in zip("xyz", (3.5, 4.5, 5.5))), *(F.lit(1).alias(c) for c in "rgb"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("equal", "equal")
    found = lod.assign(base.unionByName(many), options, kernel_rows=4096)
    accepted = found.accepted.where("seq >= 1000").collect()
    jobs = len(tracker.getJobIdsForGroup("equal"))
    spark.sparkContext.setJobGroup("", "")
    assert 20 <= len(accepted) <= 31
    assert sorted(r["seq"] for r in accepted) == list(range(1000, 1000 + len(accepted)))
    assert found.accepted.count() + found.dropped.count() == 20_500 and jobs < 60
    paths = {r["path"] for r in found.dropped.collect()}
    assert paths == {lod.deepest_path([3.5, 4.5, 5.5], options)}


def test_replaced_nodes(spark, filled):
    store, _ = filled
    node = sorted(r["path"] for r in store.node_counts().where("depth = 1").collect())[0]
    old = store.node_points(node).collect()
    snapshot = store.accepted()
    store.replace(store.node_points(node).where(f"seq = {old[0]['seq']}"))
    assert [r["seq"] for r in store.node_points(node).collect()] == [old[0]["seq"]] and snapshot.count() == store.accepted().count() + len(old) - 1
    store.replace(store.accepted().where("false"), spark.createDataFrame([(node,), ("77777",)], "path string"))
    assert store.node_points(node).count() == 0 and store.node_counts().where(F.col("path") == node).count() == 0
    assert nodes.from_counts(store.node_counts(), OPTIONS).agg(F.sum("point_count")).first()[0] == store.accepted().count()
    store.replace(spark.createDataFrame(old, store.accepted().schema))
    assert store.node_points(node).count() == len(old)
    store.compact()
    store.vacuum(0)
    assert store.node_points(node).count() == len(old) and store.accepted().count() == snapshot_size(store)


def snapshot_size(store):
    return store.node_counts().agg(F.sum("n")).first()[0]


def test_pending(spark, tmp_path):
    """Batches wait for 150 points; one that comes again counts once, before its commit and after it."""
    store, frame = Store(spark, str(tmp_path / "s")), points(spark, np.random.default_rng(5).uniform(0, 100, (400, 3)))
    part = lambda k: frame.where(f"seq >= {100 * k} and seq < {100 * (k + 1)}")
    assert [ingest.append_grouped(part(k), k, store, OPTIONS, 150) for k in (0, 0, 1, 1, 0, 2, 2)] == [False, False, True, False, False, False, False]
    assert store.batches() == [1] and list(store.pending()) == [2] and store.pending_seq(3) == 299
    ingest.flush(store, OPTIONS)
    ingest.flush(store, OPTIONS)
    assert store.batches() == [1, 2] and not store.pending() and store.accepted().count() + store.dropped().count() == 300
    assert rows_of(store.accepted()) == rows_of(lod.assign(frame.where("seq < 300"), OPTIONS).accepted)


def test_text_stream_restarts(spark, tmp_path):
    """Files that appear later, between runs of the stream, give what one read of all files gives."""
    source, rng = tmp_path / "in", np.random.default_rng(6)
    source.mkdir()
    store = Store(spark, str(tmp_path / "s"))
    for k in range(3):
        lines = "".join(f"{x!r} {y!r} {z!r} 1 2 {k}\n" for x, y, z in rng.uniform(0, 100, (100, 3)).tolist())
        (source / f"{k}.txt").write_text("easting northing depth r g b\n\n" + lines)
        ingest.ingest_text(spark, str(source), store, OPTIONS, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    whole = lod.assign(read_cartesian(spark, str(source)), OPTIONS).accepted
    columns = ("x", "y", "z", "b", "path", "depth")
    assert sorted(map(tuple, store.accepted().select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    (source / "3.txt").write_text("h\n1 2 3 4\n")
    with pytest.raises(Exception, match="3.txt"):
        ingest.ingest_text(spark, str(source), store, OPTIONS, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert store.batches() == [0, 1, 2]
