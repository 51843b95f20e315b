"""The registered queries: each takes a session and a folder of tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cube, geo, surface, vessel
from ..functions.clock import clock_points
from ..functions.ids import etag, node_id, node_path
from ..model import POINT, LodOptions, World
from ..operators import batches, lod, nodes
from ..sinks import files, pnts, records
from ..sinks.store import Store
from ..sinks.tileset import documents, export
from ..sources.records import read_records
from ..sources.survey import Survey, read_survey
from ..sources.tables import embedding_points, event_points, table
from ..sources.text import centroid, parse_lines, project, read_cartesian, read_geodetic
from ..storage import checkpoint_dir, local_rows, materialize
from ..streaming import ingest, keyed

#: Of the event points.
EVENTS = LodOptions(World(0.0, 0.0, 0.0, 128.0), grid=8, max_depth=12)
SHALLOW = LodOptions(EVENTS.world, grid=8, max_depth=3)
#: A world that leaves most events out.
CORNER = World(10.0, 10.0, 10.0, 40.0)
EMBEDDINGS = LodOptions(World(-1.0, -1.0, -1.0, 2.0), grid=4, max_depth=20)
#: Far larger than the data, which lies away from its middle: many levels hold a single node.
WIDE = LodOptions(World(-1_000_000.0, -1_000_000.0, -1_000_000.0, 2_097_152.0), grid=8, max_depth=40)
SURVEY = Survey(400.0, 2.0, 100.0, 4)


def _events(spark: SparkSession, sf_dir: str, options: LodOptions = EVENTS) -> lod.Lod:
    return lod.assign(event_points(spark, sf_dir), options)


def _folder(spark: SparkSession) -> str:
    """A new one in the shared folder, for queries that write files and read them back; the session's clean-up takes it."""
    return f"{checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


def _nodes(spark: SparkSession, sf_dir: str, options: LodOptions = EVENTS) -> DataFrame:
    """Written once, since most queries read nodes twice."""
    return materialize(nodes.node_stats(_events(spark, sf_dir, options).accepted, options))


def lod_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).accepted.select("seq", "depth", "path", "cx", "cy", "cz")


def lod_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.level_histogram(_events(spark, sf_dir).accepted)


def lod_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, SHALLOW).dropped.select("seq", "reason", "path")


def lod_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = LodOptions(CORNER, 8, 2)
    return _events(spark, sf_dir, options).dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def lod_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.assign(embedding_points(spark, sf_dir), EMBEDDINGS).accepted.select("seq", "depth", "path")


def lod_wide_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.assign(event_points(spark, sf_dir), WIDE).accepted.select("seq", "depth", "path")


def lod_level_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With so few rows to a task that most cells take the level loop."""
    return lod.assign(event_points(spark, sf_dir), EVENTS, kernel_rows=8).accepted.select("seq", "depth", "path", "cx", "cy", "cz")


def lod_first_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels that all points share, without a single task for their candidates, then cells."""
    return lod.assign(event_points(spark, sf_dir), WIDE, kernel_rows=64).accepted.select("seq", "depth", "path")


def lod_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(spark, sf_dir, SHALLOW)
    return nodes.summary(found.accepted, found.dropped, SHALLOW)


def lod_bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_points(spark, sf_dir).where(cube.inside_world(CORNER)).select("seq", "x", "y", "z")


def _first_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.at_root(event_points(spark, sf_dir), EVENTS)


def octant_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _first_node(spark, sf_dir)
    return root.select("seq", cube.octant().alias("octant"), *(c.alias(f"child_{k}") for k, c in cube.child_of_point().items()))


def cell_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.with_cells(_first_node(spark, sf_dir), EVENTS.grid).select("seq", "cx", "cy", "cz")


def occupied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the second half whose root cell a point of the first half owns."""
    rows = lod.with_cells(_first_node(spark, sf_dir), EVENTS.grid)
    return rows.where("seq % 2 = 1").join(lod.first_of_cells(rows.where("seq % 2 = 0")).select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi").select("seq")


def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("path", "parent_path", "depth", "mx", "my", "mz", "sz", "point_count", "is_leaf", cube.cell_size(EVENTS.grid).alias("geometric_error"))


def node_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nodes(spark, sf_dir)
    return found.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("children"), F.sum("point_count").alias("child_points"))


def node_children_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.children(_nodes(spark, sf_dir)).select(F.col("parent_path").alias("path"), F.array_join("children", ",").alias("children"))


def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where("is_leaf").select("path", "depth", "point_count")


def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk that visits parents first, numbered."""
    return batches.dense_numbers(_nodes(spark, sf_dir).select("path"), "path", name="visit").select("path", "visit")


def node_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes above and at the first deepest one."""
    found = _nodes(spark, sf_dir)
    deepest = found.agg(F.min_by("path", F.struct(-F.col("depth"), F.col("path"))).alias("path"))
    return nodes.ancestors_of(found, deepest).select("path", "depth", "point_count")


def leaf_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every leaf, the nodes from the root to it."""
    found = _nodes(spark, sf_dir)
    return nodes.ancestors_of(found, found.where("is_leaf")).select("of", "path", "point_count")


def subtree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.subtree_totals(_nodes(spark, sf_dir)).select("path", "point_count", "subtree_points", "subtree_nodes", "deepest")


def lod_equal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all points at one place, where tasks are so small that the run of equal points is cut."""
    same = lambda c, v: F.when(F.col("seq") % 3 == 0, F.lit(v)).otherwise(F.col(c)).alias(c)
    points = event_points(spark, sf_dir).select("seq", same("x", 40.25), same("y", 41.5), same("z", 42.75), "r", "g", "b")
    found = lod.assign(points, EVENTS, kernel_rows=1024)
    kept = found.accepted.select("seq", F.lit("accepted").alias("state"), "path")
    return kept.unionByName(found.dropped.select("seq", F.col("reason").alias("state"), "path"))


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("path", node_id(F.col("path"), EVENTS.max_depth).alias("id"))


def node_etags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("path", etag(node_id(F.col("path"), EVENTS.max_depth), F.col("point_count")).alias("etag"))


def logical_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.logical_root(_nodes(spark, sf_dir, WIDE))


def emitted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nodes(spark, sf_dir, WIDE)
    return nodes.emitted(found, nodes.logical_root(found)).select("path", "point_count")


def trimmed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _events(spark, sf_dir, WIDE).accepted
    return nodes.trimmed_points(accepted, nodes.logical_root(nodes.node_stats(accepted, WIDE))).select("seq", "depth", "path")


def tile_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("path", cube.box().alias("box")).select("path", *(F.col("box")[k].alias(f"b{k}") for k in range(12)))


def tile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document says about its node and its children, read back from the JSON."""
    shape = "root struct<boundingVolume:struct<box:array<double>>,geometricError:double,content:struct<uri:string>,refine:string,children:array<struct<content:struct<uri:string>>>>"
    found = documents(_nodes(spark, sf_dir), EVENTS).withColumn("d", F.from_json("document", shape))
    return found.select("path", "file", F.col("d.root.content.uri").alias("content"), F.col("d.root.refine").alias("refine"), F.col("d.root.geometricError").alias("geometric_error"), F.coalesce(F.array_join("d.root.children.content.uri", ","), F.lit("")).alias("children"))


def rtc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).accepted.select("seq", *(F.round(c.cast("double"), 4).alias(k) for k, c in cube.rtc_offsets().items()))


def tile_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each tile's binary part, padding included."""
    body = F.col("point_count") * 15
    return _nodes(spark, sf_dir).select("path", (body + cube.padding(body)).cast("long").alias("body_bytes"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places, a survey's size apart."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.cast("long").alias("seq"), (10 + (key % 101) / 1000).alias("lon"), (55 + (key % 89) / 1000).alias("lat"), F.col("c_acctbal").alias("z"), *(F.lit(n).alias(c) for c, n in zip("rgb", (1, 2, 3))))


def geodetic_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid(_places(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("lon0", "lat0")))


def enu_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir)
    return project(rows, centroid(rows)).select("seq", *(F.round(c, 4).alias(c) for c in "xyz"))


def _rounded(matrix: Column) -> list[Column]:
    return [F.round(matrix[k], 3 if k in (12, 13, 14) else 6).alias(f"m{k}") for k in range(16)]


def ecef_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("seq", geo.ecef_matrix(F.col("lat"), F.col("lon"), F.col("z")).alias("m")).select("seq", *_rounded(F.col("m")))


def ecef_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = geo.ecef_matrix(F.lit(55.0), F.lit(10.0), F.lit(0.0))
    return event_points(spark, sf_dir).withColumn("m", matrix).select("seq", *(F.round(c, 3).alias(k) for k, c in geo.to_ecef(F.col("m")).items()))


def wave_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_survey(spark, SURVEY).select("seq", "x", "y", F.round("z", 6).alias("z"))


def elevation_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a ramp that reaches over both ends and stays off the steps."""
    ramp = spark.range(-200, 201).select(F.col("id"), (F.col("id") * 0.0773 + 0.0131).alias("z"))
    return ramp.select("id", *(c.alias(k) for k, c in surface.elevation_colour(F.col("z")).items()))


def hex_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919 % 16777216).cast("long")), 6, "0")).alias("hex"))
    return rows.select("p_partkey", *(c.alias(k) for k, c in surface.hex_colour(F.col("hex")).items()))


def survey_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_survey(spark, SURVEY).groupBy(SURVEY.batch(F.col("seq")).alias("batch")).agg(F.count(F.lit(1)).alias("points"))


def recent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.recent(event_points(spark, sf_dir), 3000)


def recent_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.recent_centroid(recent_points(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in "xyz"))


def recent_with_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest points, then those of a clock at their centroid: kind tells them apart."""
    latest = batches.recent(event_points(spark, sf_dir), 500)
    clock = clock_points(batches.recent_centroid(latest), F.lit("2024-01-01 12:34:56").cast("timestamp"))
    both = latest.select(F.lit("point").alias("kind"), F.col("seq").alias("n"), "x", "y", "z", "r", "g", "b").unionByName(clock.withColumn("kind", F.lit("clock")))
    return both.select("kind", "n", *(F.round(c, 6).alias(c) for c in "xyz"), "r", "g", "b")


def clock_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a fixed time, at a fixed place."""
    place = spark.range(1).select(*(F.lit(v).alias(c) for c, v in zip("xyz", (1000.0, 2000.0, 30.0))))
    return clock_points(place, F.lit("2024-01-01 09:41:27").cast("timestamp")).select("n", "x", "y", "z")


def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches.in_batches(table(spark, sf_dir, "orders").select("o_orderkey"), 2500, "o_orderkey")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made from the orders, with blank ones between, read as points."""
    key = F.col("o_orderkey")
    line = F.concat_ws("  ", F.lit(" "), key.cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("-1.5"), (key % 256).cast("string"), F.lit("7"), F.lit("255"), F.lit("0 0 1"))
    lines = table(spark, sf_dir, "orders").select(F.lit("orders").alias("file"), key.alias("seq"), F.when(key % 7 == 0, F.lit("   ")).otherwise(line).alias("value"))
    return parse_lines(lines)


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(key.alias("vessel"), *((key * n).cast("double").alias(c) for c, n in zip(("x", "y", "z", "roll", "pitch", "heading"), (10, 20, 1, 3, -2, 15))), *(F.lit(v).alias(c) for c, v in zip(("length", "width", "height"), (30.0, 8.0, 4.0))))


def vessel_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vessel.corners(_poses(spark, sf_dir)).select("vessel", "corner", *(F.round(F.col("point")[c], 6).alias(c) for c in "xyz"))


def vessel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of every line of every vessel's box."""
    lines = vessel.edges(_poses(spark, sf_dir)).select("vessel", "name", F.posexplode("points").alias("k", "point"))
    return lines.select("vessel", "name", "k", *(F.round(F.col("point")[c], 6).alias(c) for c in "xyz"))


def _stored(spark: SparkSession, sf_dir: str, parts: int = 1, **options) -> Store:
    """The events, taken in so many batches by order of arrival."""
    store, points = Store(spark, _folder(spark)), event_points(spark, sf_dir)
    low, high = points.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // parts + 1
    for k in range(parts):
        ingest.append(points.where(F.col("seq").between(low + k * step, low + (k + 1) * step - 1)), k, store, EVENTS, 700, **options)
    return store


def stored_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of one node, read from a store."""
    return _stored(spark, sf_dir).node_points("0").select("seq", "x", "y", "z", "r", "g", "b")


def lod_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, of which the first two become a base."""
    return _stored(spark, sf_dir, 3, compact_every=1).accepted().select("seq", "depth", "path", "cx", "cy", "cz")


def lod_many_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven batches, compacted now and then."""
    return _stored(spark, sf_dir, 7, compact_every=3).accepted().select("seq", "depth", "path", "cx", "cy", "cz")


def nodes_by_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a store, by what each commit added to their counts."""
    store = _stored(spark, sf_dir, 3, compact_every=1)
    return nodes.from_counts(store.node_counts(), EVENTS).select("path", "parent_path", "depth", "point_count", "is_leaf")


def _replaced(spark: SparkSession, sf_dir: str) -> Store:
    """A store whose node 0 got a new set twice, and whose node 1 was emptied; the older replacement is part of the base."""
    store = _stored(spark, sf_dir, 2)
    store.replace(store.node_points("0").where("seq % 2 = 0"), local_rows(spark, [("1",)], "path string"))
    store.replace(store.node_points("0").where("seq % 4 = 0"))
    return store


def replaced_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir).accepted().select("seq", "depth", "path")


def replaced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of nodes after replacements and a compaction."""
    store = _replaced(spark, sf_dir)
    store.compact()
    return store.node_counts().select("path", "depth", F.col("n").alias("points"))


def stored_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store says of the points that no level took or that lie outside the world, over two batches."""
    options, store, points = LodOptions(CORNER, 8, 2), Store(spark, _folder(spark)), event_points(spark, sf_dir)
    for k in range(2):
        ingest.append(points.where(f"seq % 100 {'<' if k == 0 else '>='} 50").withColumn("seq", F.col("seq") + F.lit(k * 10**9)), k, store, options, 100)
    return store.dropped().groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.progress(_stored(spark, sf_dir, 2)).select("batch_id", "points", "accepted", "dropped", "nodes")


def commit_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine micro-batches, the commits of which wait for 3,000 points, the last ones for the end."""
    store, points = Store(spark, _folder(spark)), event_points(spark, sf_dir)
    low, high = points.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // 9 + 1
    for k in range(9):
        ingest.append_grouped(points.where(F.col("seq").between(low + k * step, low + (k + 1) * step - 1)), k, store, EVENTS, 3000, 700)
    ingest.flush(store, EVENTS, 700)
    return store.commits().select("batch_id", "points", "accepted")


def _text_stream(spark: SparkSession, sf_dir: str) -> Store:
    """Events as text files that appear one after the other in a folder, taken in by a stream, with its progress."""
    folder, points = _folder(spark), event_points(spark, sf_dir)
    low, high = points.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // 3 + 1
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyzrgb")).alias("easting northing depth r g b")
    for k in range(3):
        part = points.where(F.col("seq").between(low + k * step, low + (k + 1) * step - 1)).coalesce(1).sortWithinPartitions("seq")
        part.select(line).write.mode("append").option("header", True).option("quote", "").csv(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    log = ingest.ProgressLog(store, 0)
    spark.streams.addListener(log)
    try:
        ingest.ingest_text(spark, f"{folder}/in", store, EVENTS, f"{folder}/checkpoint", files_per_trigger=1, keep_recent=700).trigger(availableNow=True).start().awaitTermination()
        log.wait()
    finally:
        spark.streams.removeListener(log)
    return store


def text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_stream(spark, sf_dir).accepted().select("x", "y", "z", "r", "g", "b", "depth", "path")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points so far at the end of each micro-batch, as the listener heard of them."""
    return _text_stream(spark, sf_dir).progress().select("batch_id", "points")


def keyed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as three micro-batches of a stream whose state knows what is owned, by cells of the second level."""
    folder, points = _folder(spark), event_points(spark, sf_dir)
    low, high = points.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // 3 + 1
    for k in range(3):
        points.where(F.col("seq").between(low + k * step, low + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    own, store = keyed.state_session(spark, spark.sparkContext.defaultParallelism), Store(spark, f"{folder}/store")
    stream = own.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keyed.ingest_keyed(stream, store, EVENTS, f"{folder}/checkpoint", split=2, keep_recent=700).trigger(availableNow=True).start().awaitTermination()
    return store.accepted().select("seq", "depth", "path", "cx", "cy", "cz")


def stored_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest points of all batches."""
    return _stored(spark, sf_dir, 2).recent().select("seq", "x", "y", "z", "r", "g", "b")


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through files of binary records and back."""
    folder = _folder(spark)
    records.write_records(event_points(spark, sf_dir), folder).agg(F.count(F.lit(1))).first()
    return read_records(spark, folder).select("x", "y", "z", "r", "g", "b")


def tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through tile files and back: which tile each is in, and where."""
    folder = _folder(spark)
    written = materialize(pnts.write_tiles(_events(spark, sf_dir).accepted, folder).select("file"))
    found = pnts.read_tiles(written, folder)
    return found.select("tile", "points", *(F.round(c, 3).alias(c) for c in "xyz"), "r", "g", "b")


def exported_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export wrote, the numbers as they stand in its text."""
    folder = _folder(spark)
    written = export(_events(spark, sf_dir), EVENTS, folder).written
    texts = files.read(written, folder).select("file", F.col("content").cast("string").alias("value"))
    return texts.select("file", F.regexp_extract("value", r'"geometricError":\s*([^,}]+)', 1).alias("error_text"), F.regexp_count("value", F.lit(r"tileset_node_[0-9]+\.json")).cast("long").alias("children"))


def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles and nested documents an export says it wrote."""
    found = export(_events(spark, sf_dir, WIDE), WIDE, _folder(spark))
    return spark.range(1).select(F.lit(found.tiles).cast("long").alias("tiles"), F.lit(found.documents).cast("long").alias("documents"))


def node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From ids back to paths."""
    return node_ids(spark, sf_dir).select("id", node_path(F.col("id"), EVENTS.max_depth).alias("path"))


def text_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of text files with a header each, read as points."""
    folder, key = _folder(spark), F.col("o_orderkey")
    line = F.concat_ws(" ", key.cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("-1.5"), (key % 256).cast("string"), F.lit("7"), F.lit("255"))
    lines = table(spark, sf_dir, "orders").select(F.when(key % 7 == 0, F.concat(line, F.lit(" 0 0 1"))).otherwise(line).alias("easting northing depth r g b"))
    lines.repartition(3).write.option("header", True).option("quote", "").csv(folder)
    return read_cartesian(spark, folder).select("x", "y", "z", "r", "g", "b")


def text_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of longitude, latitude and height, read as points around their centroid."""
    folder = _folder(spark)
    _places(spark, sf_dir).select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("lon", "lat", "z", "r", "g", "b"))).alias("value")).write.text(folder)
    points, _ = read_geodetic(spark, folder)
    return points.select(*(F.round(c, 4).alias(c) for c in "xyz"), "r", "g", "b")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lod_accept, lod_level_histogram, lod_dropped, lod_drop_counts, lod_embeddings, lod_wide_world, lod_summary, lod_bounds_filter, octant_of_point, cell_of_point, occupied_cells,
        node_stats, node_children, node_children_list, leaf_nodes, node_order, node_ancestors, node_ids, node_etags, logical_root, emitted_nodes, trimmed_points, tile_box, tile_documents,
        rtc_offsets, tile_bytes, geodetic_centroid, enu_project, ecef_matrix, ecef_points, wave_surface, elevation_colour, hex_colour, survey_batches, recent_points, recent_centroid,
        recent_with_clock, clock_digits, batch_numbers, text_parse, vessel_corners, stored_node,
        lod_level_loop, lod_first_levels, lod_incremental, ingest_progress, stored_recent, record_files, tile_points, exported_documents, export_stats, node_paths, leaf_ancestors, subtree_totals, lod_equal_points, lod_many_batches, nodes_by_deltas, replaced_node, replaced_counts, stored_dropped, commit_cadence, text_stream, keyed_stream, stream_progress, text_cartesian, text_geodetic, vessel_edges,
    )
}
