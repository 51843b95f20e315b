"""What the operators of this subpackage share: tables, Arrow helpers, components; storage is the package's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import BROADCAST_BYTES, materialize, small

__all__ = ["BROADCAST_BYTES", "batch", "by_arrow", "components", "dealt", "materialize", "named", "packed", "small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def by_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def dealt(shard: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each shard that occurs, with the packed values of each array that go to it, in their order."""
    order = np.argsort(shard, kind="stable")
    full, first = np.unique(shard[order], return_index=True)
    edges = [*first.tolist(), len(shard)]
    columns = {"shard": pa.array(full, pa.int64())}
    for name, values in arrays.items():
        values = values[order]
        columns[name] = pa.array([values[a:z].tobytes() for a, z in zip(edges, edges[1:])], pa.binary())
    return batch(**columns)


def packed(column: pd.Series, kind: type) -> np.ndarray:
    """The values of packed arrays, one array after the other."""
    return np.frombuffer(b"".join(column), kind)


def components(edges: DataFrame) -> DataFrame:
    """Of a frame of pairs (a, b) of longs: v and the smallest vertex of its component, for every vertex with a link.

    Each round contracts every vertex into its neighbour with the smallest hash, so paths shrink in proportion."""
    left = materialize(edges.where("a <> b").select("a", "b").distinct())
    vertices = left.select(F.col("a").alias("v")).union(left.select("b")).distinct()
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        to = materialize(best.select(F.col("a").alias("v"), F.least("best", rank("a"))["to"].alias("to")))
        rounds.append(to)
        one = left.join(to, left["a"] == to["v"]).select(F.col("to").alias("a"), "b")
        left = materialize(one.join(to, one["b"] == to["v"]).select("a", F.col("to").alias("b")).where("a <> b").distinct())
    roots = vertices.select("v", F.col("v").alias("root"))
    for k, to in enumerate(rounds):
        step = to.select(F.col("v").alias("root"), F.col("to").alias("next"))
        roots = roots.join(step, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
        if k % 6 == 5:
            roots = materialize(roots)
    roots = materialize(roots)
    least = roots.groupBy("root").agg(F.min("v").alias("component"))
    return materialize(roots.join(least, "root").select("v", "component"))
