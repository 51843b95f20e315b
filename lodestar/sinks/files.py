"""Files that executors write: to any place that a URI names, else to a folder that all of them mount."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame

#: Files of one batch that goes back to Spark.
BATCH_FILES = 1 << 10


def resolve(path: str) -> tuple[afs.FileSystem, str]:
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return afs.FileSystem.from_uri(path)
    return afs.LocalFileSystem(), path


def write(filesystem: afs.FileSystem, path: str, content: bytes) -> None:
    """One file, written as those of `writer` are."""
    folder, name = path.rsplit("/", 1)
    with writer(filesystem, folder) as put:
        put(name, content)


@contextmanager
def writer(filesystem: afs.FileSystem, folder: str) -> Iterator[Callable[[str, bytes], None]]:
    """put(name, content) for a task that writes many files: all or nothing on a store whose renames replace, so that a task that runs twice leaves whole files.

    Drafts have a folder of their own, which goes at the end. A folder takes one change at a time, whoever makes it, so the one that all tasks write to gets only the finished names."""
    drafts = f"{folder}/.drafts-{uuid.uuid4().hex}"

    def put(name: str, content: bytes) -> None:
        with filesystem.open_output_stream(f"{drafts}/draft") as f:
            f.write(content)
        filesystem.move(f"{drafts}/draft", f"{folder}/{name}")

    filesystem.create_dir(drafts, recursive=True)
    try:
        yield put
    finally:
        filesystem.delete_dir(drafts)


def read(names: DataFrame, folder: str) -> DataFrame:
    """file and content (bytes) of the files under folder that names (file) has, opened by name in the tasks.

    Nobody lists the folder: a listing of Spark's passes every file through the driver and plans a few of them to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = resolve(folder)
        for b in batches:
            for start in range(0, b.num_rows, BATCH_FILES):
                part = b["file"].slice(start, BATCH_FILES)
                contents = []
                for name in part.to_pylist():
                    with filesystem.open_input_stream(f"{base}/{name}") as f:
                        contents.append(f.read())
                yield pa.RecordBatch.from_arrays([part, pa.array(contents, pa.binary())], names=["file", "content"])

    return names.select("file").mapInArrow(run, "file string, content binary")
