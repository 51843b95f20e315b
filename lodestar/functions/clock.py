"""A time of day as points, to be seen among the others."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Metres of a dot, columns and rows of a glyph, the colour, and the dots of each glyph from its top row down.
DOT, COLUMNS, ROWS, COLOUR = 40.0, 5, 7, (255, 0, 255)
FONT = {
    "0": ".###. #...# #..## #.#.# ##..# #...# .###.",
    "1": "..#.. .##.. ..#.. ..#.. ..#.. ..#.. .###.",
    "2": ".###. #...# ....# ...#. ..#.. .#... #####",
    "3": ".###. #...# ....# ..##. ....# #...# .###.",
    "4": "...#. ..##. .#.#. #..#. ##### ...#. ...#.",
    "5": "##### #.... ####. ....# ....# #...# .###.",
    "6": "..##. .#... #.... ####. #...# #...# .###.",
    "7": "##### ....# ...#. ..#.. .#... .#... .#...",
    "8": ".###. #...# #...# .###. #...# #...# .###.",
    "9": ".###. #...# #...# .#### ....# ...#. .##..",
    ":": "..... ..#.. ..... ..... ..... ..#.. .....",
}


def clock_points(at: DataFrame, time: Column) -> DataFrame:
    """For each row of at (columns x, y, z: the lower left), the points of its time as HH:mm:ss, in order of n."""
    font = F.create_map(*(F.lit(v) for k, dots in FONT.items() for v in (k, dots.replace(" ", ""))))
    text = F.date_format(time, "HH:mm:ss")
    glyphs = at.select("x", "y", "z", F.posexplode(F.split(text, "")).alias("d", "glyph"))
    dots = glyphs.select("*", F.posexplode(F.split(font[F.col("glyph")], "")).alias("k", "dot")).where("dot = '#'")
    column, row = F.col("k") % COLUMNS, F.floor(F.col("k") / COLUMNS)
    return dots.select(
        (F.col("d") * COLUMNS * ROWS + F.col("k")).cast("long").alias("n"),
        (F.col("x") + F.col("d") * (COLUMNS + 1) * DOT + column * DOT).alias("x"),
        (F.col("y") + (ROWS - 1 - row) * DOT).alias("y"),
        "z",
        *(F.lit(v).alias(c) for c, v in zip("rgb", COLOUR)),
    )


def clock_at(spark: SparkSession, x: float, y: float, z: float, time: datetime.datetime) -> DataFrame:
    text = time.strftime("%Y-%m-%d %H:%M:%S")
    place = spark.range(1).select(*(F.lit(float(v)).alias(c) for c, v in zip("xyz", (x, y, z))), F.lit(text).alias("t"))
    return clock_points(place, F.to_timestamp("t"))
