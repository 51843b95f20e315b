"""Dense numbers, batches, and the most recent points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import local_rows, materialize, small


def dense_numbers(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with 0, 1, 2, ... in order: rows are sorted by range, and each range begins where the counts of those before it end.

    Only one count for each range is gathered."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(ranged.withColumn("_range", F.shiftright("_row", 33)))
    counts = sorted(map(tuple, rows.groupBy("_range").count().collect()))
    starts, at = [], 0
    for k, n in counts:
        starts.append((k, at))
        at += n
    first = small(local_rows(df.sparkSession, starts, "_range long, _first long"), 16)
    number = F.col("_first") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(first, "_range").select(*df.columns, number.alias(name))


def running_starts(df: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """df with the sum of size over the rows before each in order, whose values are distinct: as dense_numbers, a total for each range is gathered."""
    rows = materialize(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    starts, at = [], 0
    for k, n in sorted(map(tuple, rows.groupBy("_range").agg(F.sum(size)).collect())):
        starts.append((k, at))
        at += n
    first = small(local_rows(df.sparkSession, starts, "_range int, _first long"), 16)
    before = F.coalesce(F.sum(size).over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(first, "_range").select(*df.columns, (F.col("_first") + before).alias(name))


def batch_number(number: Column, size: int) -> Column:
    """Of dense numbers from 0: batches of size rows, the last one short."""
    return F.floor(number / size).cast("long")


def in_batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    return dense_numbers(df, *order).withColumn("batch", batch_number(F.col("number"), size))


#: A top of so many rows is one task's.
TOP_ROWS = 10_000
#: Ranges that one pass over the numbers tells apart.
RANGES = 1024


def cut_off(numbers: DataFrame, name: str, n: int) -> int | None:
    """The n-th largest of distinct integers, None if there are not so many. Each pass counts ranges and goes on in one of them."""
    low, high, count = numbers.agg(F.min(name), F.max(name), F.count(name)).first()
    if count < n:
        return None
    while low < high:
        width = (high - low) // RANGES + 1
        within = numbers.where(F.col(name).between(low, high)).select(((F.col(name) - low) / width).cast("long").alias("k"), name)
        counts = within.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min(name).alias("low"), F.max(name).alias("high")).orderBy(F.desc("k")).collect()
        for r in counts:
            if r["m"] >= n:
                low, high = r["low"], r["high"]
                break
            n -= r["m"]
    return low


def recent(points: DataFrame, n: int = 300_000) -> DataFrame:
    """The n points with the largest seq, oldest first. Of many, the least seq is found by counts, so that no task holds them."""
    if n <= TOP_ROWS:
        return points.orderBy(F.desc("seq")).limit(n).orderBy("seq")
    least = cut_off(points.select("seq"), "seq", n)
    return (points if least is None else points.where(F.col("seq") >= least)).orderBy("seq")


def recent_centroid(points: DataFrame, lift: float = 30.0) -> DataFrame:
    """One row: the mean place of the points, raised by lift; the origin, raised, if there are none."""
    return points.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("x", "y", "z"))).withColumn("z", F.col("z") + lift)
