"""The pose of a vessel: body axes (forward, starboard, down) to east, north, up, and the corners and edges of its box.

Columns of a pose: x y z (centre), roll pitch heading (degrees), length width height (metres).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def body_to_enu(forward: Column, starboard: Column, down: Column) -> dict[str, Column]:
    """Rotate by roll about the forward axis, then pitch, then heading."""
    (sr, cr), (sp, cp), (sh, ch) = ((F.sin(F.radians(F.col(c))), F.cos(F.radians(F.col(c)))) for c in ("roll", "pitch", "heading"))
    # roll and pitch in the vertical planes, then heading in the horizontal one
    side, below = starboard * cr - down * sr, starboard * sr + down * cr
    ahead, sunk = forward * cp + below * sp, below * cp - forward * sp
    return {"east": ahead * sh + side * ch, "north": ahead * ch - side * sh, "up": -sunk}


def _corner(signs: tuple[int, int, int]) -> Column:
    moved = body_to_enu(*(F.col(c) / 2 * F.lit(float(s)) for c, s in zip(("length", "width", "height"), signs)))
    return F.struct(*((F.col(a) + moved[m]).alias(a) for a, m in (("x", "east"), ("y", "north"), ("z", "up"))))


#: Signs along forward, starboard and down: the deck's corners from the port bow around, then the keel's.
CORNERS = tuple((f, s, d) for d in (-1, 1) for f, s in ((1, -1), (1, 1), (-1, 1), (-1, -1)))
#: Closed loops and lines over the corners' numbers.
EDGES = {"deck": (0, 1, 2, 3, 0), "keel": (4, 5, 6, 7, 4), "post0": (0, 4), "post1": (1, 5), "post2": (2, 6), "post3": (3, 7), "bow": (0, 1, 5, 4, 0)}


def corners(poses: DataFrame) -> DataFrame:
    """The pose's columns, corner (0 to 7), and its point."""
    return poses.select("*", F.posexplode(F.array(*map(_corner, CORNERS))).alias("corner", "point"))


def edges(poses: DataFrame) -> DataFrame:
    """The pose's columns, the name of a line and its points; `ahead` leads from the centre out past the bow."""
    where = [_corner(c) for c in CORNERS]
    lines = [F.struct(F.lit(name).alias("name"), F.array(*(where[k] for k in path)).alias("points")) for name, path in EDGES.items()]
    ahead = F.struct(F.lit("ahead").alias("name"), F.array(_corner((0, 0, 0)), _corner((2, 0, 0))).alias("points"))
    return poses.select("*", F.inline(F.array(*lines, ahead)))
