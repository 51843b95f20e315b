"""The rule against a walk of one point at a time, and the facts of nodes, sources, sinks, streams and the server."""

import json
import re
import threading
import urllib.error
import urllib.request

import numpy as np
import pyarrow as pa
import pytest
from lodestar import storage
from lodestar.functions import geo, ids
from lodestar.functions.clock import clock_at
from lodestar.model import POINT, GeoReference, LodOptions, World
from lodestar.operators import batches, lod, nodes
from lodestar.plans import queries
from lodestar.sinks import files, pnts, records, tileset
from lodestar.sinks.store import Store
from lodestar.sources import records as record_source
from lodestar.sources import text
from lodestar.sources.survey import Survey, read_survey
from lodestar.streaming import ingest, serve
from pyspark.sql import functions as F


def points(spark, rows):
    return spark.createDataFrame([(k, *map(float, p), k % 256, 2, 3) for k, p in enumerate(rows)], POINT)


def walk(rows, options):
    """seq to (path, cell), by visiting nodes from the root down; None: dropped at the deepest; absent: out of bounds."""
    taken, out = set(), {}
    for seq, p in enumerate(rows):
        m, size, path = [options.world.x, options.world.y, options.world.z], options.world.size, ""
        if not all(lo <= v < lo + size for v, lo in zip(p, m)):
            continue
        while True:
            cell = tuple(int((v - lo) / (size / options.grid)) for v, lo in zip(p, m))
            if (path, cell) not in taken:
                taken.add((path, cell))
                out[seq] = (path, cell)
                break
            if len(path) == options.max_depth:
                out[seq] = None
                break
            upper = [v >= lo + size / 2 for v, lo in zip(p, m)]
            m, size = [lo + size / 2 if u else lo for lo, u in zip(m, upper)], size / 2
            path += str(sum(1 << k for k, u in enumerate(upper) if u))
    return out


def found(result):
    got = {r["seq"]: (r["path"], (r["cx"], r["cy"], r["cz"])) for r in result.accepted.collect()}
    lost = {r["seq"]: r["reason"] for r in result.dropped.collect()}
    return got, lost


RNG = np.random.default_rng(7)
CASES = {
    "uniform": (RNG.uniform(0, 400, (600, 3)), LodOptions(World(-500, -500, -500, 1000), 8, 60)),
    "clusters far from a wide world's middle": (np.concatenate([RNG.uniform(0, 50, (300, 3)) + [2e6, 8e5, 3e5], RNG.uniform(0, 20, (200, 3)) + [2.001e6, 8e5, 3e5]]), LodOptions(grid=8)),
    "duplicates": (np.repeat([[0.4, 0.4, 0.4]], 50, axis=0), LodOptions(World(-0.5, -0.5, -0.5, 1.0), 4, 12)),
    "edges by rounding": (np.array([np.nextafter(e, e + d) for e in np.arange(1, 22) * 0.7 / 21 + 0.1 for d in (-1, 0, 1)])[RNG.integers(0, 63, (900, 3))], LodOptions(World(0.1, 0.1, 0.1, 0.7), 3, 9)),
    "edges and outside": (np.array([[0, 0, 0], [100, 0, 0], [99.999, 50, 50], [50, 50, 50], [-0.1, 1, 1], [float("nan"), 1, 1], [25, 25, 25], [25, 25, 25]]), LodOptions(World(0, 0, 0, 100), 4, 5)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("kernel_rows", [1 << 16, 40])
def test_rule(spark, name, kernel_rows):
    rows, options = CASES[name]
    got, lost = found(lod.assign(points(spark, rows), options, kernel_rows))
    want = walk(rows, options)
    assert got == {k: v for k, v in want.items() if v}
    assert lost == {k: "max_depth" if k in want else "out_of_bounds" for k in range(len(rows)) if not want.get(k)}


def test_cells_not_apart(spark, monkeypatch):
    """Where rounding parts a cell from the one above, whole nodes take the place of cells."""
    rows, options = CASES["edges by rounding"]
    met = []
    monkeypatch.setattr(lod, "_apart", lambda done: met.append(1) or True)
    got, lost = found(lod.assign(points(spark, rows[:200]), options))
    want = walk(rows[:200], options)
    assert met and got == {k: v for k, v in want.items() if v} and len(lost) == len(rows[:200]) - len(got)


def test_recent(spark, monkeypatch):
    """The latest are found by counts as by sorting, wherever the numbers lie."""
    monkeypatch.setattr(batches, "TOP_ROWS", 5)
    for numbers in (range(0, 4000, 3), [*range(50), *range(10**15, 10**15 + 9)], [-5, 7], []):
        frame = spark.createDataFrame([(k,) for k in numbers], "seq long")
        for n in (6, 40, 900):
            assert [r["seq"] for r in batches.recent(frame, n).collect()] == sorted(numbers)[-n:]


def test_scratch(spark, tmp_path):
    """A batch leaves nothing behind in the shared folder, and a seq that is not above earlier ones fails it; compaction changes no row."""
    from lodestar.storage import checkpoint_dir

    options, store = LodOptions(World(0, 0, 0, 128), 8, 6), Store(spark, str(tmp_path / "s"))
    frame = points(spark, np.random.default_rng(3).uniform(0, 100, (300, 3)))
    filesystem = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    ls = lambda: {f.getPath().getName() for f in filesystem.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(filesystem)}
    ingest.append(frame.where("seq < 100"), 0, store, options)
    before = ls()
    ingest.append(frame.where("seq between 100 and 199"), 1, store, options)
    assert ls() == before
    with pytest.raises(ValueError):
        ingest.append(frame.where("seq between 150 and 250"), 2, store, options)
    ingest.append(frame.where("seq >= 200"), 2, store, options, compact_every=1)
    assert ls() == before and store.base() == 1 and store.batches_since_base() == [2]
    ingest.append(frame.where("seq >= 200"), 2, store, options)
    whole = lod.assign(frame, options)
    assert sorted(map(tuple, store.accepted().select("seq", "path").collect())) == sorted(map(tuple, whole.accepted.select("seq", "path").collect()))
    assert [(r["points"], r["accepted"] + r["dropped"]) for r in ingest.progress(store).orderBy("batch_id").collect()] == [(100, 100), (200, 200), (300, 300)]
    assert {r["seq"] for r in store.recent().collect()} == set(range(300))


def test_empty(spark):
    options = LodOptions(World(0, 0, 0, 8), 4, 3)
    result = lod.assign(spark.createDataFrame([(1, None, 1.0, 1.0, 0, 0, 0)], POINT), options)
    assert found(result) == ({}, {1: "out_of_bounds"})
    stats = nodes.node_stats(result.accepted, options).collect()
    assert [(r["path"], r["point_count"], r["is_leaf"]) for r in stats] == [("", 0, True)]
    with pytest.raises(ValueError):
        LodOptions(grid=0)


def tree(spark, rows):
    """Nodes by hand: path, points, whether a leaf."""
    return spark.createDataFrame([(p, p[:-1] if p else None, len(p), 0.0, 0.0, 0.0, 64 / 2 ** len(p), n, leaf) for p, n, leaf in rows], nodes.NODE)


@pytest.mark.parametrize(
    "rows,root",
    [
        ([("", 5, True)], ""),
        ([("", 1, False), ("0", 10, True), ("5", 10, True), ("3", 0, True)], ""),
        ([("", 1, False), ("0", 1, False), ("00", 1, False), ("000", 1, False), ("0001", 10, True), ("0006", 10, True), ("1", 0, True)], "000"),
        ([("", 1, False), ("4", 3, False), ("42", 10, True), ("47", 10, True)], "4"),
        ([("", 1, False), ("1", 1, False), ("11", 1, True)], "11"),
    ],
)
def test_logical_root(spark, rows, root):
    frame = tree(spark, rows)
    assert nodes.logical_root(frame).first()["path"] == root
    assert {r["path"] for r in nodes.emitted(frame, nodes.logical_root(frame)).collect()} == {p for p, n, leaf in rows if p.startswith(root) and (n or not leaf)}


def test_ids(spark):
    rng = np.random.default_rng(3)
    paths = ["", *("".join(map(str, rng.integers(0, 8, d))) for d in range(1, 61))]
    assert [ids.path_of_id(ids.id_of_path(p)) for p in paths] == paths
    assert ids.id_of_path("3") == 4 and ids.id_of_path("31") == 34
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    wide = {r[0]: r[1] for r in frame.select("path", ids.node_id(F.col("path"), 60)).collect()}
    short = {r[0]: r[1] for r in frame.where("length(path) <= 20").select("path", ids.node_id(F.col("path"), 20)).collect()}
    assert wide == {p: str(ids.id_of_path(p)) for p in paths} and all(wide[p] == i for p, i in short.items())
    with pytest.raises(ValueError):
        ids.path_of_id(-1)


def test_pnts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 100):
        xyz, rgb = rng.uniform(0, 100, (n, 3)) + [1e6, 5e5, 2e5], rng.integers(0, 256, (n, 3))
        content = pnts.encode((1e6, 5e5, 2e5, 100.0), xyz, rgb)
        spec, places, colours = pnts.decode(content)
        assert len(content) % 8 == 0 and spec["POINTS_LENGTH"] == n and spec["RTC_CENTER"] == [1000050.0, 500050.0, 200050.0]
        assert np.abs(places - xyz).max(initial=0) < 1e-3 and (colours == rgb).all()


def test_ecef(spark):
    assert np.allclose(geo.reference_matrix(GeoReference(0, 0))[12:15], [6378137, 0, 0], atol=1e-3)
    m = np.array(geo.reference_matrix(GeoReference(56, 10, 1000))).reshape(4, 4)[:, :3]
    assert np.allclose(m[:3] @ m[:3].T, np.eye(3)) and m[2] @ m[3] / np.linalg.norm(m[3]) > 0.999
    column = spark.range(1).select(geo.ecef_matrix(F.lit(56.0), F.lit(10.0), F.lit(1000.0)).alias("m")).first()["m"]
    assert np.allclose(column, geo.reference_matrix(GeoReference(56, 10, 1000)))


def test_export(spark, tmp_path):
    options = LodOptions(grid=16, max_depth=40)
    rng = np.random.default_rng(42)
    rows = np.concatenate([rng.uniform(0, 1, (400, 3)) * [20, 20, 5] + [x, 7e5, 1.5e5] for x in (1e6, 1.0005e6)])
    result = lod.assign(points(spark, rows), options)
    stats = tileset.export(result, options, str(tmp_path), reference=GeoReference(56, 10))
    top = json.loads((tmp_path / "tileset.json").read_text())
    assert top["root"]["refine"] == "ADD" and len(top["root"]["transform"]) == 16 and top["asset"] == {"version": "1.0"}
    seen, shown = 0, 0

    def visit(document, error):
        nonlocal seen, shown
        tile = document["root"]
        assert tile["geometricError"] <= error and len(tile["boundingVolume"]["box"]) == 12
        spec, _, _ = pnts.decode((tmp_path / tile["content"]["uri"]).read_bytes())
        seen, shown = seen + 1, shown + spec["POINTS_LENGTH"]
        for child in tile.get("children", []):
            assert "children" not in child and "refine" not in child
            visit(json.loads((tmp_path / child["content"]["uri"]).read_text()), tile["geometricError"])

    visit(top, float("inf"))
    root = nodes.logical_root(nodes.node_stats(result.accepted, options))
    assert seen == stats.tiles == stats.documents + 1 and len(top["root"]["children"]) >= 2
    assert shown + nodes.trimmed_points(result.accepted, root).count() == len(rows)
    with pytest.raises(ValueError):
        tileset.documents(nodes.node_stats(result.accepted, options), options, "SOME")


def test_text(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("easting northing depth r g b\n\n1.5 2 -3 1 2 3 0 0 1\n   \n4\t5  6 255 0 7\n")
    got = text.read_cartesian(spark, str(path)).orderBy("seq").collect()
    assert [tuple(r)[1:] for r in got] == [(1.5, 2.0, -3.0, 1, 2, 3), (4.0, 5.0, 6.0, 255, 0, 7)]
    many = tmp_path / "many"
    many.mkdir()
    for f in range(3):
        (many / f"{f}.txt").write_text("h\n" + "".join(f"{f} {k} 0 1 2 3\n" for k in range(500)))
    got = text.read_cartesian(spark, str(many)).orderBy("seq").select("x", "y").collect()
    assert [tuple(r) for r in got] == [(f, k) for f in range(3) for k in range(500)]
    for k, name in enumerate(("a b.txt", "c%20d.txt", "é#x.txt")):
        (many / name).write_text(f"h\n{k} 9 9 1 2 3\n")
    assert text.read_cartesian(spark, str(many)).count() == 1503
    rows = batches.in_batches(text.read_cartesian(spark, str(path)).select("seq"), 1, "seq").collect()
    assert sorted((r["number"], r["batch"]) for r in rows) == [(0, 0), (1, 1)]
    for bad in ("1 2 3 4", "1 2 3 256 0 0", "1,000 2 3 4 5 6"):
        path.write_text(f"h\n{bad}\n")
        with pytest.raises(Exception):  # noqa: B017
            text.read_cartesian(spark, str(path)).collect()
    path.write_text("10 0 5 1 2 3\n10 1 6 1 2 3\n")
    places, origin = text.read_geodetic(spark, str(path))
    y = sorted(r["y"] for r in places.collect())
    assert abs(y[1] - y[0] - 111320) < 1e-6 and tuple(origin.first()) == (10.0, 0.5)
    path.write_text("\n")
    with pytest.raises(Exception):  # noqa: B017
        text.read_geodetic(spark, str(path))[1].collect()


def test_survey(spark):
    survey = Survey(20, 2, 5, 3)
    rows = read_survey(spark, survey).orderBy("seq").collect()
    assert (survey.samples, survey.sweeps, survey.run_lines) == (3, 11, 4) and len(rows) == survey.points
    want = [((10 - i if line % 2 else i) * 2.0, line * 5.0 + j * 2.0) for line in range(4) for i in range(11) for j in range(3)]
    assert [(r["x"], r["y"]) for r in rows] == want and all(abs(r["z"]) <= 13.5 and 0 <= r["r"] <= 255 for r in rows)
    with pytest.raises(ValueError):
        Survey(0, 1, 1)


def test_records_and_clock(spark, tmp_path):
    frame = points(spark, np.random.default_rng(1).uniform(-5, 5, (1000, 3)))
    assert records.write_records(frame, str(tmp_path / "r")).agg(F.sum("points")).first()[0] == 1000
    again = record_source.read_records(spark, str(tmp_path / "r")).orderBy("seq").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in frame.orderBy("seq").collect()]
    with pytest.raises(ValueError):
        record_source.decode(b"x" * 28)
    import datetime

    clock = clock_at(spark, 0, 0, 30, datetime.datetime(2024, 1, 1, 11, 11, 11)).collect()
    assert len(clock) == 6 * 10 + 2 * 2 and {r["z"] for r in clock} == {30.0} and max(r["y"] for r in clock) == 240.0


def test_batches_on_new_ground(spark, tmp_path, monkeypatch):
    """Batches that overlap in space a little, hardly or wholly give what one batch gives."""
    options = LodOptions(World(0, 0, 0, 128), 8, 6)
    rng = np.random.default_rng(12)
    rows = np.concatenate([rng.uniform(low, low + 50, (250, 3)) for low in (0, 40, 70, 0)] + [[[200, 0, 0]]])
    frame = points(spark, rows)
    whole = sorted(map(tuple, lod.assign(frame, options).accepted.select("seq", "path", "cx", "cy", "cz").collect()))
    store = Store(spark, str(tmp_path / "s"))
    for k in range(5):
        ingest.append(frame.where(f"seq >= {250 * k} and seq < {250 * (k + 1)}"), k, store, options)
    assert sorted(map(tuple, store.accepted().select("seq", "path", "cx", "cy", "cz").collect())) == whole
    assert store.dropped().where("reason = 'out_of_bounds'").count() == 1


def test_batches_that_meet_by_rounding(spark, tmp_path):
    """Points next to edges of cells, in many batches."""
    rows, options = CASES["edges by rounding"]
    frame, store = points(spark, rows[:240]), Store(spark, str(tmp_path / "s"))
    for k in range(3):
        ingest.append(frame.where(f"seq >= {80 * k} and seq < {80 * (k + 1)}"), k, store, options)
    want = walk(rows[:240], options)
    assert {r["seq"]: (r["path"], (r["cx"], r["cy"], r["cz"])) for r in store.accepted().collect()} == {k: v for k, v in want.items() if v}


def test_stream_and_server(spark, tmp_path):
    options = LodOptions(World(0, 0, 0, 128), 8, 6)
    rows = np.random.default_rng(11).uniform(0, 100, (900, 3))
    frame, source = points(spark, rows), str(tmp_path / "in")
    for k in range(3):
        frame.where(f"seq >= {300 * k} and seq < {300 * (k + 1)}").coalesce(1).write.mode("append").parquet(source)
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.ingest(stream, store, options, str(tmp_path / "ck"), 100).trigger(availableNow=True).start().awaitTermination()
    whole = lod.assign(frame, options)
    key = ["seq", "path", "cx", "cy", "cz"]
    assert store.batches() == [0, 1, 2] and sorted(map(tuple, store.accepted().select(*key).collect())) == sorted(map(tuple, whole.accepted.select(*key).collect()))
    ingest.append(frame.where("seq >= 600"), 2, store, options, 100)  # a replay counts once
    assert store.accepted().count() == whole.accepted.count() and {r["seq"] for r in store.recent().collect()} == set(range(800, 900))

    http = serve.server(serve.TileService(store, options, GeoReference(56, 10)))
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def get(path, method="GET", **headers):
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}{path}", method=method, headers=headers)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read(), r.headers
        except urllib.error.HTTPError as e:
            return e.code, b"", e.headers

    try:
        top = json.loads(get("/tileset.json")[1])
        child = json.loads(get(top["root"]["children"][0]["content"]["uri"])[1])
        assert "transform" in top["root"] and "transform" not in child["root"]
        status, body, headers = get(child["root"]["content"]["uri"])
        assert status == 200 and pnts.decode(body)[0]["POINTS_LENGTH"] > 0 and headers["Access-Control-Allow-Origin"] == "*"
        assert get(child["root"]["content"]["uri"], **{"If-None-Match": headers["ETag"]})[0] == 304
        assert get("/content/0.pnts", "HEAD")[:2] == (200, b"") and get("/content/99999999.pnts")[0] == 404 and get("/tileset/node/x.json")[0] == 400
        latest = record_source.decode(get("/recent-points.bin")[1])
        assert len(latest) > 100 and np.allclose(latest["x"][:100], rows[800:, 0]) and get("/")[0] == 200
    finally:
        http.shutdown()


def test_tasks_of_small_units(spark, monkeypatch):
    """How many tasks there are depends on the rows, not on how few of them a cell may have."""
    seen, finish = [], lod.finish

    def watched(live, depth, options, tasks, *more):
        seen.append((depth, tasks))
        return finish(live, depth, options, tasks, *more)

    monkeypatch.setattr(lod, "finish", watched)
    rows = spark.range(4000).select(F.col("id").alias("seq"), *((F.col("id") * k % 1009 / 8.0).alias(a) for k, a in zip((7, 31, 57), "xyz")), *(F.lit(1).alias(c) for c in "rgb"))
    world = LodOptions(World(0.0, 0.0, 0.0, 128.0), 8, 12)
    plain = lod.assign(rows, world).accepted.select("seq", "path").collect()
    looped = lod.assign(rows, world, kernel_rows=2).accepted.select("seq", "path").collect()
    assert sorted(plain) == sorted(looped)
    assert max(depth for depth, _ in seen) > 0 and {tasks for _, tasks in seen} == {spark.sparkContext.defaultParallelism}


def test_whole_units():
    """Held rows end with a unit; none is parted or lost, whatever the batches."""
    unit = [0] * 5 + [1] * 40 + [2] + [3] * 9 + [4] * 2
    table = pa.table({"cx": unit, "cy": [0] * len(unit), "n": range(len(unit))})
    for size in (1, 3, 16, 100):
        parts = list(lod.whole_units(iter(table.to_batches(size)), ("cx", "cy"), 8))
        assert pa.concat_tables(parts).to_pydict() == table.to_pydict()
        ends = [set(p["cx"].to_pylist()) for p in parts]
        assert all(not a & b for a, b in zip(ends, ends[1:])) and all(len(p) >= 8 for p in parts[:-1])
    assert list(lod.whole_units(iter([]), ("cx", "cy"), 8)) == []


def test_files_are_read_by_name(spark, sf_dir):
    """No listing of written files passes the driver: what is read back comes from names that the tasks which wrote them gave."""
    for query, kind in ((queries.exported_documents, ".json"), (queries.tile_points, ".pnts")):
        found = query(spark, sf_dir)
        assert not any(kind in name for name in found.inputFiles()) and found.count()


def test_tiles_over_batches(spark, tmp_path, monkeypatch):
    """A tile whose points come in many batches of rows, next to tiny ones, is one whole file with its points in order of seq; export names all documents that it wrote."""
    rows = [(5 + (k * 37 % 97) / 100, 5.0, 5.0) for k in range(300)] + [(k % 90 + 0.5, 60.0, 70.0) for k in range(40)]
    world = LodOptions(World(0.0, 0.0, 0.0, 128.0), 64, 3)
    result = lod.assign(points(spark, rows), world)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        written = pnts.write_tiles(result.accepted, str(tmp_path / "tiles")).collect()
        back = pnts.read_tiles(spark.createDataFrame(written).select("file"), str(tmp_path / "tiles")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for r in result.accepted.orderBy("seq").collect():
        expected.setdefault(f"{ids.id_of_path(r['path'])}.pnts", []).append((r["x"], r["r"]))
    assert {r["file"]: r["points"] for r in written} == {k: len(v) for k, v in expected.items()} and max(map(len, expected.values())) > 14
    for name, wanted in expected.items():
        spec, xyz, rgb = pnts.decode((tmp_path / "tiles" / name).read_bytes())
        assert spec["POINTS_LENGTH"] == len(wanted) and np.allclose(xyz[:, 0], [x for x, _ in wanted], atol=1e-3) and rgb[:, 0].tolist() == [r for _, r in wanted]
    assert sorted((r["tile"], r["points"]) for r in back) == sorted((k, len(v)) for k, v in expected.items() for _ in v)
    stats = tileset.export(result, world, str(tmp_path / "out"), trim=False)
    assert sorted(r["file"] for r in stats.written.collect()) == sorted(p.name for p in (tmp_path / "out").glob("*.json")) and stats.written.count() == stats.documents + 1


def test_drafts_apart(tmp_path):
    """A folder that many tasks write to gets finished names only; drafts have a folder of their own, which goes even if the task fails."""
    filesystem, base = files.resolve(str(tmp_path))
    seen = set()
    with pytest.raises(TypeError), files.writer(filesystem, base) as put:
        for k in range(3):
            put(f"{k}.json", b"{}")
            seen |= {p.name for p in tmp_path.iterdir() if p.is_file()}
        put("3.json", None)
    files.write(filesystem, f"{base}/2.json", b"[]")
    assert seen == {"0.json", "1.json", "2.json"} == {p.name for p in tmp_path.iterdir()} and (tmp_path / "2.json").read_bytes() == b"[]"


def test_units_by_number(spark, monkeypatch):
    """Units are sorted by one number each, which Spark does without comparing rows; those that share a number don't disturb each other, with owners or without."""
    rows, options = CASES["uniform"]
    live = lod.with_cells(lod.at_root(points(spark, rows), options), options.grid)
    plan = lod.finish(live, 0, options, 4, ("path", "cx", "cy", "cz"))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Sort \[(\w+)#\d+L ASC NULLS FIRST\], false", plan) == ["unit"]
    monkeypatch.setattr(lod, "_unit_number", lambda unit: F.lit(7).cast("long").alias("unit"))
    frame, want = points(spark, rows), {k: v for k, v in walk(rows, options).items() if v}
    first = lod.assign(frame.where("seq < 250"), options)
    later = lod.assign(frame.where("seq >= 250"), options, stored=first.accepted)
    assert found(first)[0] | found(later)[0] == want == found(lod.assign(frame, options, kernel_rows=40))[0]


def test_level_takes_two_steps(spark, monkeypatch):
    """A level of the loop writes its cells and its marked points and nothing else; small cells of all levels, with their owners, are finished together."""
    rows, options = CASES["uniform"]
    frame, want = points(spark, rows), {k: v for k, v in walk(rows, options).items() if v}
    wrote, ends, write, finish = [], [], lod.materialize, lod.finish
    monkeypatch.setattr(lod, "materialize", lambda df: wrote.append(df.columns) or write(df))
    monkeypatch.setattr(lod, "finish", lambda live, depth, *more: ends.append(depth) or finish(live, depth, *more))
    result = lod._by_units(lod.at_root(frame, options), 0, options, 2, ("path", "cx", "cy", "cz"))
    assert {r["seq"]: (r["path"], (r["cx"], r["cy"], r["cz"])) for part in result[0] for r in part.collect()} == want
    assert len(ends) == 1 and ends[0] >= 3 and len(wrote) <= 2 * (ends[0] + 1) + 1
    first = lod.assign(frame.where("seq < 250"), options, kernel_rows=2)
    ends.clear()
    later = lod.assign(frame.where("seq >= 250"), options, kernel_rows=2, stored=first.accepted)
    assert len(ends) == 1 and found(first)[0] | found(later)[0] == want


def test_marks_that_are_not_sent(spark, monkeypatch):
    """Where too many cells are large to send them all, hot ones are sent and the others meet their points in a shuffle; the result is the same."""
    rows, options = CASES["uniform"]
    want = {k: v for k, v in walk(rows, options).items() if v}
    monkeypatch.setattr(lod, "BROADCAST_BYTES", 200)
    for hot in (1 << 16, 8):
        monkeypatch.setattr(lod, "KERNEL_ROWS", hot)
        assert found(lod.assign(points(spark, rows), options, kernel_rows=2))[0] == want


def test_levels_of_one_file(spark, monkeypatch):
    """A level has the tasks that its rows are worth, though the source has only one."""
    rows, options = CASES["uniform"][0], LodOptions(World(0, 0, 0, 512), 8, 20)
    seen, take = [], lod._by_units
    monkeypatch.setattr(lod, "_by_units", lambda live, *more: seen.append(live.select(F.spark_partition_id().alias("k")).distinct().count()) or take(live, *more))
    assert found(lod.assign(points(spark, rows).coalesce(1), options, kernel_rows=2))[0] == {k: v for k, v in walk(rows, options).items() if v}
    assert seen == [spark.sparkContext.defaultParallelism]


def test_rows_without_workers(spark, sf_dir):
    """Frames of a few rows are the JVM's: their plans, and those of dense numbers and of a store without runs, have no rows from Python."""
    frame = storage.local_rows(spark, [("1", 2, None), ("0", 3, 1.5)], "path string, n int, x double")
    empty = storage.local_rows(spark, [], POINT)
    assert frame.schema.simpleString() == "struct<path:string,n:int,x:double>" and [tuple(r) for r in frame.collect()] == [("1", 2, None), ("0", 3, 1.5)]
    assert empty.collect() == [] and empty.schema.simpleString() == points(spark, [(1, 2, 3)]).schema.simpleString()
    numbered = batches.dense_numbers(spark.range(20).withColumnRenamed("id", "seq"), "seq")
    for df in (frame, empty, numbered, Store(spark, "/tmp/none-such").accepted()):
        assert "Scan ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_are_held():
    """A task settles some thousand rows at a time, however many its share has."""
    unit = np.repeat(np.arange(4000), 20)
    parts = list(lod.whole_units(iter(pa.table({"unit": unit}).to_batches(10_000)), ("unit",), lod.HELD_ROWS))
    assert sum(len(p) for p in parts) == len(unit) and max(len(p) for p in parts) <= 20_000


def test_numbers_of_files_without_workers(spark):
    """Where the rows of each file of a micro-batch begin is known without a Python worker."""
    sizes = spark.range(9).select(F.col("id").cast("string").alias("file"), (F.col("id") + 1).alias("splits"))
    starts = batches.running_starts(sizes, "file", "splits", "ordinal")
    assert "Scan ExistingRDD" not in starts._jdf.queryExecution().executedPlan().toString()
    assert [r["ordinal"] for r in starts.orderBy("file").collect()] == [k * (k + 1) // 2 for k in range(9)]


def test_equal_points_in_few_steps(spark, monkeypatch):
    """A run of equal points among others is cut, and each level after that writes twice."""
    rows = np.concatenate([CASES["uniform"][0][:300] / 4, np.repeat([[40.25, 41.5, 42.75]], 300, axis=0)])
    options, wrote, ends, write, finish = LodOptions(World(0, 0, 0, 128), 8, 12), [], [], lod.materialize, lod.finish
    monkeypatch.setattr(lod, "materialize", lambda df: wrote.append(df.columns) or write(df))
    monkeypatch.setattr(lod, "finish", lambda live, depth, *more: ends.append(depth) or finish(live, depth, *more))
    got, lost = found(lod.assign(points(spark, rows), options, kernel_rows=4))
    want = walk(rows, options)
    assert got == {k: v for k, v in want.items() if v} and set(lost) == {k for k in want if not want[k]}
    assert len(ends) <= 1 and len(wrote) <= 5 + 2 * (options.max_depth + 1) + 1


def test_past_owned_cells(spark, monkeypatch):
    """Where stored points make cells large and own them, new points pass these without a level that is settled and written; where a large cell is free, the levels are taken."""
    rows, options = 128 * np.random.default_rng(3).uniform(0, 1, (480, 3)) ** 1.5, LodOptions(World(0, 0, 0, 128), 2, 12)
    frame, want = points(spark, rows), {k: v for k, v in walk(rows, options).items() if v}
    looped, take = [], lod._by_units
    monkeypatch.setattr(lod, "_by_units", lambda *more: looped.append(1) or take(*more))
    seen = []
    for cut, kernel_rows in ((400, 60), (3, 60)):
        first = lod.assign(frame.where(f"seq < {cut}"), options)
        stored = lod.materialize(first.accepted)
        looped.clear()
        later = lod.assign(frame.where(f"seq >= {cut}"), options, kernel_rows=kernel_rows, stored=stored)
        got, lost = found(later)
        assert found(first)[0] | got == want and set(lost) | set(found(first)[1]) == set(range(len(rows))) - set(want)
        seen.append((len(looped), later.settled is not None))
    assert seen == [(0, True), (1, False)]
