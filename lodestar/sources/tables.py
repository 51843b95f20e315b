"""Tables whose columns can serve as points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, in order of their ids, in a world of min 0 and size 128."""
    mod = lambda c, n: F.col(c) % n
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        mod("user_id", 97).cast("double").alias("x"),
        mod("user_id", 89).cast("double").alias("y"),
        (F.abs("value") % 100).alias("z"),
        *(mod("event_id", n).cast("int").alias(c) for c, n in zip("rgb", (251, 241, 239))),
    )


def embedding_points(spark: SparkSession, sf_dir: str, vector: str = "embedding") -> DataFrame:
    """The first three components of the embeddings, in a world of min -1 and size 2."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("long").alias("seq"), *(F.col(vector)[k].cast("double").alias(c) for k, c in enumerate("xyz")), *(F.lit(128).alias(c) for c in "rgb"))
