"""3D Tiles documents. Each node but the root has a document of its own, to which its parent points, so that a client loads only what it looks at."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import cube, ids
from ..functions.geo import reference_matrix
from ..model import GeoReference, LodOptions
from ..operators import nodes as node_operators
from ..operators.lod import Lod
from ..storage import materialize
from . import files, pnts

ADD, REPLACE = "ADD", "REPLACE"


def documents(nodes: DataFrame, options: LodOptions, refine: str = ADD, live: bool = False) -> DataFrame:
    """path, id, file and document (JSON text) of every non-empty node and of the root; live: names are those of the server's routes.

    A document has the node's own tile and, for each child, a tile that points to the child's document."""
    if refine not in (ADD, REPLACE):
        raise ValueError("refine is ADD or REPLACE")
    content, nested = (ids.content_url, ids.nested_url) if live else (lambda i: F.concat(F.lit("content/"), ids.content_name(i)), ids.nested_name)
    node = ids.node_id(F.col("path"), options.max_depth)
    shown = nodes.where(~node_operators.is_empty() | (F.col("path") == "")).withColumn("id", node)
    tile = lambda uri, *more: F.struct(F.struct(cube.box().alias("box")).alias("boundingVolume"), cube.cell_size(options.grid).alias("geometricError"), F.struct(uri.alias("uri")).alias("content"), *more)
    pointers = shown.where(F.col("parent_path").isNotNull() & ~node_operators.is_empty()).select(F.col("parent_path").alias("path"), F.struct(F.col("path").alias("order"), tile(nested(F.col("id"))).alias("tile")).alias("child"))
    gathered = pointers.groupBy("path").agg(F.transform(F.sort_array(F.collect_list("child")), lambda c: c["tile"]).alias("children"))
    whole = shown.join(gathered, "path", "left")
    root = tile(content(F.col("id")), F.lit(refine).alias("refine"), F.col("children"))
    document = F.struct(F.struct(F.lit("1.0").alias("version")).alias("asset"), cube.cell_size(options.grid).alias("geometricError"), root.alias("root"))
    return whole.select("path", "id", nested(F.col("id")).alias("file"), F.to_json(document).alias("document"))


def with_transform(document: str, reference: GeoReference | None) -> str:
    """The document with the matrix from local to Earth-centred coordinates at its root."""
    if reference is None:
        return document
    value = json.loads(document)
    value["root"]["transform"] = reference_matrix(reference)
    return json.dumps(value)


def _write_documents(rows: DataFrame, folder: str) -> DataFrame:
    """Lazily: the names of what was written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with files.writer(*files.resolve(folder)) as put:
            for b in batches:
                for name, text in zip(b["file"], b["document"]):
                    put(name, text.encode())
                yield b[["file"]]

    return rows.select("file", "document").mapInPandas(run, "file string")


@dataclass(frozen=True)
class ExportStats:
    walk_ms: int
    content_ms: int
    metadata_ms: int
    tiles: int
    documents: int
    #: file: the names of all documents in the folder, the top one's too.
    written: DataFrame


def export(lod: Lod, options: LodOptions, folder: str, refine: str = ADD, reference: GeoReference | None = None, name: str = "tileset.json", trim: bool = True) -> ExportStats:
    """Write content first, then the nested documents, and the top document last, so that no link is ever dead.

    trim: begin at the logical root; the points of the nodes above it are then in no tile."""
    spark = lod.accepted.sparkSession
    clock = [time.monotonic()]
    lap = lambda: clock.append(time.monotonic()) or int(1000 * (clock[-1] - clock[-2]))
    all_nodes = materialize(node_operators.node_stats(lod.accepted, options))
    start = node_operators.logical_root(all_nodes).first()["path"] if trim else ""
    shown = node_operators.subtree(all_nodes, start)
    texts = materialize(documents(shown, options, refine))
    walk = lap()
    filesystem, base = files.resolve(folder)
    filesystem.create_dir(f"{base}/content", recursive=True)
    tiles = pnts.write_tiles(node_operators.subtree(lod.accepted, start), f"{folder.rstrip('/')}/content").agg(F.count("*")).first()[0]
    top = texts.where(F.col("path") == start).first()
    root = shown.where(F.col("path") == start).first()
    if not root["point_count"]:  # a root that nothing reached still has its tile
        files.write(filesystem, f"{base}/content/{top['id']}.pnts", pnts.encode((root["mx"], root["my"], root["mz"], root["sz"]), [], []))
        tiles += 1
    content = lap()
    written = materialize(_write_documents(texts.where(F.col("path") != start), folder))
    nested = written.count()
    files.write(filesystem, f"{base}/{name}", with_transform(top["document"], reference).encode())
    written = written.unionByName(spark.range(1).select(F.lit(name).alias("file")))
    return ExportStats(walk, content, lap(), tiles, nested, written)
