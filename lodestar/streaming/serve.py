"""A small HTTP front over the committed part of a store.

GET and HEAD:
    /                         a banner
    /tileset.json             the document of the logical root, with the matrix of the reference
    /tileset/node/{id}.json   the document of any node
    /content/{id}.pnts        a node's points; the ETag is its id and the count of what is served
    /recent-points.bin        the latest points, then a clock, as flat records
"""

from __future__ import annotations

import re
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from ..functions.clock import clock_at
from ..functions.ids import id_of_path, path_of_id
from ..model import CUBE_COLUMNS, POINT_COLUMNS, GeoReference, LodOptions
from ..operators import nodes as node_operators
from ..operators.batches import recent_centroid
from ..sinks import pnts, records
from ..sinks.store import Store
from ..sinks.tileset import documents, with_transform
from ..storage import checkpoint_dir, hadoop


class TileService:
    """Answers from the last committed batch; a lookup reads the folders of one depth and a few rows of nodes."""

    def __init__(self, store: Store, options: LodOptions, reference: GeoReference | None = None):
        self.store, self.options, self.reference = store, options, reference
        self._lock, self._version, self._nodes, self._root = threading.Lock(), None, None, ""
        #: Folders of the nodes, and of those before.
        self._at = self._before = None

    def _refresh(self) -> None:
        """The nodes as of the last commit: sums over what commits added to their counts, so no points are read. Requests under way keep the nodes before."""
        with self._lock:
            version = self.store.manifest().version
            if version != self._version:
                spark, old = self.store.spark, self._at
                self._at = f"{checkpoint_dir(spark)}/served-{uuid.uuid4().hex}"
                node_operators.from_counts(self.store.node_counts(), self.options).sortWithinPartitions("path").write.parquet(self._at)
                filesystem, place = hadoop(spark, self._at)
                filesystem.deleteOnExit(place)
                nodes = spark.read.schema(node_operators.NODE).parquet(self._at)
                self._root, self._nodes, self._version = node_operators.logical_root(nodes).first()["path"], nodes, version
                if self._before is not None:
                    hadoop(spark, self._before)[0].delete(hadoop(spark, self._before)[1], True)
                self._before = old

    def _document(self, path: str) -> str | None:
        near = self._nodes.where((F.col("path") == path) | (F.col("parent_path") == path))
        row = documents(near, self.options, live=True).where(F.col("path") == path).first()
        return row["document"] if row else None

    def tileset(self) -> str:
        self._refresh()
        return with_transform(self._document(self._root), self.reference)

    def node(self, path: str) -> str | None:
        self._refresh()
        return self._document(path)

    def tag(self, path: str) -> tuple[str, tuple] | None:
        self._refresh()
        row = self._nodes.where(F.col("path") == path).first()
        return row and (f'"{id_of_path(path)}-{row["point_count"]}"', tuple(row[c] for c in CUBE_COLUMNS))

    def content(self, path: str, cube: tuple) -> bytes:
        rows = self.store.node_points(path).select(*POINT_COLUMNS).toPandas()
        return pnts.encode(cube, rows[["x", "y", "z"]].to_numpy(), rows[["r", "g", "b"]].to_numpy())

    def recent(self) -> bytes:
        points = self.store.recent()
        at = recent_centroid(points).first()
        written = self.store.commits().agg(F.max("written")).first()[0]
        rows = points.orderBy("seq").toPandas()
        clock = b"" if written is None else records.encode(clock_at(self.store.spark, at["x"], at["y"], at["z"], written).orderBy("n").toPandas())
        return records.encode(rows) + clock


class Handler(BaseHTTPRequestHandler):
    service: TileService

    def log_message(self, *args: object) -> None:
        pass

    def _reply(self, status: int, body: bytes = b"", kind: str = "text/plain; charset=utf-8", **headers: str) -> None:
        self.send_response(status)
        self.send_header("Access-Control-Allow-Origin", "*")
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        if status != 304:
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_GET(self) -> None:
        path, head, fresh = self.path.partition("?")[0], self.command == "HEAD", {"Cache_Control": "no-store"}
        if path == "/":
            return self._reply(200, b"Live point tiles: see /tileset.json")
        if path == "/tileset.json":
            return self._reply(200, b"" if head else self.service.tileset().encode(), "application/json", **fresh)
        if path == "/recent-points.bin":
            return self._reply(200, b"" if head else self.service.recent(), "application/octet-stream", **fresh)
        route = re.fullmatch(r"/tileset/node/([^/]+)\.json|/content/([^/]+)\.pnts", path)
        if not route:
            return self._reply(404)
        if not re.fullmatch(r"[0-9]+", route[1] or route[2]):
            return self._reply(400)
        node = path_of_id(int(route[1] or route[2]))
        if len(node) > self.service.options.max_depth or (found := self.service.tag(node)) is None:
            return self._reply(404)
        if route[1]:
            return self._reply(200, b"" if head else self.service.node(node).encode(), "application/json", **fresh)
        tag, cube = found
        headers = {"Cache_Control": "no-cache", "ETag": tag}
        if self.headers.get("If-None-Match") == tag:
            return self._reply(304, **headers)
        return self._reply(200, b"" if head else self.service.content(node, cube), "application/octet-stream", **headers)

    do_HEAD = do_GET


def server(service: TileService, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Ready to serve_forever(); port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), type("BoundHandler", (Handler,), {"service": service}))
