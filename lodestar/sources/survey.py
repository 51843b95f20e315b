"""A synthetic survey: a vessel sweeps a wavy sea floor in parallel run lines, every second one in the opposite direction."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.surface import elevation, elevation_colour


@dataclass(frozen=True)
class Survey:
    """area: edge of the square; spacing: between samples and between sweeps; swath: width of a run line. Metres."""

    area: float
    spacing: float
    swath: float
    sweeps_per_batch: int = 1

    def __post_init__(self) -> None:
        if not (self.area > 0 and self.spacing > 0 and self.swath > 0 and self.sweeps_per_batch >= 1):
            raise ValueError("area, spacing and swath must be positive, sweeps_per_batch at least 1")

    @property
    def samples(self) -> int:
        """Of a sweep."""
        return int(self.swath / self.spacing) + 1

    @property
    def sweeps(self) -> int:
        """Of a run line."""
        return int(self.area / self.spacing) + 1

    @property
    def run_lines(self) -> int:
        return math.ceil(self.area / self.swath)

    @property
    def points(self) -> int:
        return self.samples * self.sweeps * self.run_lines

    def batch(self, seq: Column) -> Column:
        """The number of the batch that a point comes in."""
        return F.floor(F.floor(seq / self.samples) / self.sweeps_per_batch).cast("long")


def read_survey(spark: SparkSession, survey: Survey, partitions: int | None = None) -> DataFrame:
    """The survey's points, made in parallel: seq alone tells run line, sweep and sample."""
    rows = spark.range(0, survey.points, 1, partitions) if partitions else spark.range(survey.points)
    n = F.lit(survey.samples)
    sweep = F.expr(f"id div {survey.samples}")
    line, along = F.expr(f"(id div {survey.samples}) div {survey.sweeps}"), sweep % survey.sweeps
    along = F.when(line % 2 == 1, survey.sweeps - 1 - along).otherwise(along)
    places = rows.select(F.col("id").alias("seq"), (along * survey.spacing).alias("x"), (line * survey.swath + (F.col("id") % n) * survey.spacing).alias("y"))
    high = places.withColumn("z", elevation(F.col("x"), F.col("y")))
    return high.select("seq", "x", "y", "z", *(c.alias(k) for k, c in elevation_colour(F.col("z")).items()))
