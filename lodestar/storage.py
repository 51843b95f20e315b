"""Shared storage between jobs, and broadcasts behind a check of size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: A table of at most this many bytes may be sent to every executor.
BROADCAST_BYTES = 48 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/lodestar")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: For jobs side by side. Threads stay, since each has a connection to the JVM.
beside = ThreadPoolExecutor(4, "lodestar")

#: The folder of the scratch block that we are in.
_scratch: ContextVar[str | None] = ContextVar("_scratch", default=None)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is materialized within goes when the block ends, so a long-lived session keeps nothing of it."""
    path = f"{checkpoint_dir(spark)}/lod-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        filesystem, place = hadoop(spark, path)
        filesystem.delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back; a lost executor loses nothing."""
    spark, within = df.sparkSession, _scratch.get()
    path = f"{within or checkpoint_dir(spark)}/lod-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not within:
        filesystem, place = hadoop(spark, path)
        filesystem.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a frame that the JVM holds. createDataFrame deals tuples to Python workers, of which each executor would then have a second set beside that of the Arrow functions."""
    fields = StructType.fromDDL(schema).fields
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    table = pa.table({f.name: pa.array([r[k] for r in rows]) for k, f in enumerate(fields)})
    return spark.createDataFrame(table).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows, at row_bytes each, fit in most bytes; else df as it is, which shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
