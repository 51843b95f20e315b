"""Text files of points: `easting northing depth red green blue ...` or `lon lat height red green blue ...`.

Fields are separated by white space, fields from the seventh on are ignored, blank lines are skipped. A line of fewer than six fields, a number
that can't be read (digit groups such as 1,000 included) or a colour outside 0 to 255 fails the query, with the file and the line's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geo import east_north
from ..operators.batches import running_starts
from ..storage import materialize, small

#: Rows of a partition take this many low bits of seq, splits of files the rest.
ROW_BITS = 33


def _bytes(text: str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    number = text.strip().lower().removesuffix("b")
    return int(float(number[:-1]) * (1 << units[number[-1]])) if number[-1] in units else int(number)


def _lines(reader, path: str | list[str], header: bool) -> DataFrame:
    """value of every line, with the file, where its split of the file begins, and the file's size."""
    lines = reader.option("header", header).option("sep", "\x01").option("quote", "").option("escape", "").option("maxCharsPerColumn", -1).schema("value string").csv(path)
    # names as Spark lists them, which writes them in one way
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")


def _numbered(read: DataFrame, files: DataFrame, first: int = 0) -> DataFrame:
    """file, seq and value of lines in order of file names and places: of a static frame of _lines, of which files (file, size) lists the files.

    A split of a file has an ordinal, from `first` on, since splits begin at least `step` bytes apart, and rows of a split keep their order within a task."""
    spark = read.sparkSession
    step = min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    listed = files.select("file", (F.floor(F.col("size") / step) + 1).cast("long").alias("splits"))
    places = small(materialize(running_starts(listed, "file", "splits", "ordinal").select("file", "ordinal")), 160)
    split = F.lit(first) + F.col("ordinal") + F.floor(F.col("start") / step).cast("long")
    seq = F.shiftleft(split, ROW_BITS) + F.col("row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return read.withColumn("row", F.monotonically_increasing_id()).join(places, "file").where(F.trim("value") != "").select("file", seq.alias("seq"), "value")


def numbered_lines(spark: SparkSession, path: str | list[str], header: bool) -> DataFrame:
    """file, seq and value of every line that isn't blank, without the first line of each file if header. seq is computed in the scan itself."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return _numbered(_lines(spark.read, path, header), files)


def stream_lines(spark: SparkSession, folder: str, header: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the lines of text files as they appear in a folder. Spark's own file source reads them, so any file system will do, and its log knows which were read.

    `points_of_batch` makes points of a micro-batch."""
    reader = spark.readStream if files_per_trigger is None else spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return _lines(reader, folder, header)


def points_of_batch(lines: DataFrame, after: int | None, names: tuple[str, str, str] = ("x", "y", "z"), origin: tuple[float, float] | None = None) -> DataFrame:
    """Points of a micro-batch of stream_lines, in order of file names and places, all with a seq above `after`; a batch that comes again has the same ones.

    origin: of geodetic files, the longitude and latitude around which to project; a stream has no centroid before it ends. What can't be parsed fails the batch, with its file and text."""
    first = 0 if after is None else (after >> ROW_BITS) + 1
    files = lines.groupBy("file").agg(F.max("size").alias("size"))
    rows = parse_lines(_numbered(lines, files, first), names if origin is None else ("lon", "lat", "z"))
    if origin is None:
        return rows
    return project(rows, rows.sparkSession.range(1).select(F.lit(float(origin[0])).alias("lon0"), F.lit(float(origin[1])).alias("lat0")))


def _checked(value: Column, file: Column) -> Column:
    fields = F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+")
    return F.when(F.size(fields) < 6, F.raise_error(F.concat(file, F.lit(": a line of fewer than six fields: "), value)).cast("array<string>")).otherwise(fields)


def _byte(field: Column) -> Column:
    value = field.cast("int")
    return F.when((value < 0) | (value > 255), F.raise_error(F.concat(F.lit("a colour outside 0 to 255: "), field)).cast("int")).otherwise(value)


def parse_lines(lines: DataFrame, names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Of a frame with file, seq and value: the points, the first three fields under the names given."""
    split = lines.where(F.trim("value") != "").select("seq", _checked(F.col("value"), F.col("file")).alias("f"))
    return split.select("seq", *(F.col("f")[k].cast("double").alias(n) for k, n in enumerate(names)), *(_byte(F.col("f")[3 + k]).alias(c) for k, c in enumerate("rgb")))


def read_cartesian(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Points of files that each have one header line, which is skipped unread."""
    return parse_lines(numbered_lines(spark, path, True))


def centroid(rows: DataFrame) -> DataFrame:
    """lon0 and lat0: the means of lon and lat, in one row. Without rows the query fails."""
    mean = rows.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    return mean.select(*(F.coalesce(c, F.raise_error(F.lit("the file has no data rows")).cast("double")).alias(c) for c in mean.columns))


def project(rows: DataFrame, origin: DataFrame) -> DataFrame:
    """Rows of seq lon lat z r g b as points around the one row of origin."""
    x, y = east_north(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    return rows.crossJoin(F.broadcast(origin)).select("seq", x.alias("x"), y.alias("y"), "z", "r", "g", "b")


def read_geodetic(spark: SparkSession, path: str | list[str], header: bool = False) -> tuple[DataFrame, DataFrame]:
    """The points around their centroid, and the centroid (lon0, lat0)."""
    rows = parse_lines(numbered_lines(spark, path, header), ("lon", "lat", "z"))
    origin = centroid(rows)
    return project(rows, origin), origin
