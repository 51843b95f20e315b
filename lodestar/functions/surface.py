"""The synthetic sea floor and its colours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Amplitude, and frequencies along x and y, of each wave.
WAVES = ((8.0, 0.004, 0.002), (4.0, 0.011, -0.017), (1.5, 0.031, 0.037))
#: The elevations' range is plus or minus this; red, green and blue from low to high.
RANGE = 13.5
STOPS = ((0.10, 0.20, 0.80), (0.10, 0.70, 0.30), (0.90, 0.80, 0.10), (0.80, 0.10, 0.10))


def elevation(x: Column, y: Column) -> Column:
    first, *rest = (F.lit(a) * F.sin(x * fx + y * fy) for a, fx, fy in WAVES)
    return sum(rest, first)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def elevation_colour(z: Column) -> dict[str, Column]:
    """r, g and b of an elevation: linear between the stops, cut to whole bytes."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z + RANGE) / (2 * RANGE))) * (len(STOPS) - 1)
    stop = F.least(F.floor(scaled).cast("int"), F.lit(len(STOPS) - 2))

    def channel(k: int) -> Column:
        values = F.array(*(F.lit(s[k]) for s in STOPS))
        return F.floor(lerp(values[stop], values[stop + 1], scaled - stop) * 255).cast("int")

    return {"r": channel(0), "g": channel(1), "b": channel(2)}


def hex_colour(text: Column) -> dict[str, Column]:
    """r, g and b of `rrggbb`; null for anything else."""
    good = F.when(text.rlike("^[0-9a-fA-F]{6}$"), text)
    return {c: F.conv(F.substring(good, 1 + 2 * k, 2), 16, 10).cast("int") for k, c in enumerate("rgb")}
