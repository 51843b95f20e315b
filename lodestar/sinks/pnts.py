"""Binary point tiles: a 28-byte head, a padded JSON table, positions relative to the tile's centre, then colours."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.ids import id_of_path
from ..model import CUBE_COLUMNS
from . import files

#: Fixed values of the format.
MAGIC, VERSION, HEAD, ALIGN = b"pnts", 1, 28, 8


def encode(cube: tuple[float, float, float, float], xyz: np.ndarray, rgb: np.ndarray) -> bytes:
    """cube: least corner and size; xyz: n x 3 numbers; rgb: n x 3 bytes."""
    centre = [float(v) + float(cube[3]) / 2 for v in cube[:3]]
    positions = (np.asarray(xyz, float).reshape(-1, 3) - centre).astype("<f4").tobytes()
    colours = np.asarray(rgb).reshape(-1, 3).astype("u1").tobytes()
    spec = {"POINTS_LENGTH": len(colours) // 3, "RTC_CENTER": centre, "POSITION": {"byteOffset": 0}, "RGB": {"byteOffset": len(positions)}}
    table = json.dumps(spec, separators=(",", ":")).encode()
    table += b" " * (-(HEAD + len(table)) % ALIGN)
    body = positions + colours
    body += b"\0" * (-len(body) % ALIGN)
    return struct.pack("<4s6I", MAGIC, VERSION, HEAD + len(table) + len(body), len(table), len(body), 0, 0) + table + body


def decode(content: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """The JSON table, positions (as absolute doubles) and colours of what encode gives."""
    magic, version, length, table, _, _, _ = struct.unpack_from("<4s6I", content)
    if magic != MAGIC or version != VERSION or length != len(content):
        raise ValueError("not a point tile")
    spec = json.loads(content[HEAD : HEAD + table])
    n, at = spec["POINTS_LENGTH"], HEAD + table
    xyz = np.frombuffer(content, "<f4", 3 * n, at + spec["POSITION"]["byteOffset"]).reshape(-1, 3).astype(float) + spec["RTC_CENTER"]
    return spec, xyz, np.frombuffer(content, "u1", 3 * n, at + spec["RGB"]["byteOffset"]).reshape(-1, 3)


TILE = "path string, file string, points long, bytes long"


def write_tiles(accepted: DataFrame, folder: str) -> DataFrame:
    """A file for each node under folder, points in order of seq; lazily: TILE rows of what was written.

    Rows are sorted by node within a task, and a node has at most (cells + 1) ** 3 points, which are held one node at a time."""
    names = accepted.select("seq", "x", "y", "z", "r", "g", "b", "path", *CUBE_COLUMNS)
    ordered = names.repartition("path").sortWithinPartitions("path", "seq").drop("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with files.writer(*files.resolve(folder)) as put:
            yield from tiles(batches, put)

    def tiles(batches: Iterator[pa.RecordBatch], put: Callable[[str, bytes], None]) -> Iterator[pa.RecordBatch]:
        def tile(path: str, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[str, str, int, int]:
            cubes, xyz, rgb = (np.concatenate(p) for p in zip(*parts))
            file = f"{id_of_path(path)}.pnts"
            content = encode(tuple(cubes[0]), xyz, rgb)
            put(file, content)
            return path, file, len(xyz), len(content)

        last, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            paths = b["path"].to_numpy(zero_copy_only=False)
            columns = [np.stack([b[c].to_numpy() for c in names], 1) for names in (CUBE_COLUMNS, ("x", "y", "z"), ("r", "g", "b"))]
            starts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
            out = []
            for start, end in zip(starts, starts[1:]):
                if held and paths[start] != last:
                    out.append(tile(last, held))
                    held = []
                last = paths[start]
                held.append(tuple(c[start:end] for c in columns))
            held[-1] = tuple(c.copy() for c in held[-1])  # so that no more of the batch is held on
            if out:
                yield _tile_rows(out)
        if held:
            yield _tile_rows([tile(last, held)])

    return ordered.mapInArrow(run, TILE)


def _tile_rows(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "file", "points", "bytes"])


def read_tiles(written: DataFrame, folder: str) -> DataFrame:
    """A row for each point of the tiles that written (file) names: x, y, z, its tile, the points that this says it has, and r, g, b."""
    schema = pa.schema([*((c, pa.float64()) for c in "xyz"), ("tile", pa.string()), ("points", pa.int64()), *((c, pa.int32()) for c in "rgb")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(content) for content in b["content"].to_pylist()]
            n = [len(xyz) for _, xyz, _ in found]
            if not sum(n):
                continue
            xyz, rgb = (np.concatenate([f[k] for f in found]) for k in (1, 2))
            tiles, points = (np.repeat(np.array(v, kind), n) for v, kind in ((b["file"].to_pylist(), object), ([spec["POINTS_LENGTH"] for spec, _, _ in found], np.int64)))
            columns = [*(xyz[:, k] for k in range(3)), tiles, points, *(rgb[:, k].astype(np.int32) for k in range(3))]
            yield from pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema).to_batches(1 << 16)

    return files.read(written, folder).mapInArrow(run, "x double, y double, z double, tile string, points long, r int, g int, b int")
