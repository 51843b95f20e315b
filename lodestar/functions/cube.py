"""Cubes, octants and cells, as expressions over the columns x y z (a point) and mx my mz sz (a node's cube).

Cubes are half-open. A child's cube comes from its parent's by one halving and one addition, so these
expressions are applied level by level and never in closed form: floating-point results must be equal on every path.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..model import World

AXES = ("x", "y", "z")


def world_columns(world: World) -> dict[str, Column]:
    return {f"m{a}": F.lit(float(getattr(world, a))) for a in AXES} | {"sz": F.lit(float(world.size))}


def inside_world(world: World) -> Column:
    """min <= p < min + size on every axis, with literals, so that it reaches a Parquet scan. NaN and null are outside."""
    return F.expr(" AND ".join(f"{a} >= {float(getattr(world, a))!r}D AND {a} < {float(getattr(world, a) + world.size)!r}D" for a in AXES))


def inside_cube() -> Column:
    tests = [(F.col(a) >= F.col(f"m{a}")) & (F.col(a) < F.col(f"m{a}") + F.col("sz")) for a in AXES]
    return tests[0] & tests[1] & tests[2]


def _upper(axis: str) -> Column:
    return F.col(axis) >= F.col(f"m{axis}") + F.col("sz") / 2


def octant() -> Column:
    """Bit 0 for x, 1 for y, 2 for z: set in the upper half."""
    return sum((F.when(_upper(a), 1 << k).otherwise(0) for k, a in enumerate(AXES)), F.lit(0)).cast("int")


def child_of_point() -> dict[str, Column]:
    """The cube of the child that the point lies in."""
    return {f"m{a}": F.when(_upper(a), F.col(f"m{a}") + F.col("sz") / 2).otherwise(F.col(f"m{a}")) for a in AXES} | {"sz": F.col("sz") / 2}


def child_of_octant(number: Column) -> dict[str, Column]:
    """The cube of a numbered child."""
    bit = lambda k: F.getbit(number, F.lit(k)) == 1
    return {f"m{a}": F.when(bit(k), F.col(f"m{a}") + F.col("sz") / 2).otherwise(F.col(f"m{a}")) for k, a in enumerate(AXES)} | {"sz": F.col("sz") / 2}


def cell_size(grid: int) -> Column:
    """The spacing of a node's points, which is also its geometric error; leaves have one too."""
    return F.col("sz") / F.lit(float(grid))


def cell(grid: int) -> dict[str, Column]:
    return {f"c{a}": F.expr(f"CAST(floor(({a} - m{a}) / (sz / {float(grid)!r}D)) AS int)") for a in AXES}


def centre() -> dict[str, Column]:
    return {f"centre_{a}": F.col(f"m{a}") + F.col("sz") / 2 for a in AXES}


def box() -> Column:
    """Centre and three half axes: twelve numbers."""
    half, zero = F.col("sz") / 2, F.lit(0.0)
    return F.array(*centre().values(), half, zero, zero, zero, half, zero, zero, zero, half)


def rtc_offsets() -> dict[str, Column]:
    """Single-precision offsets from the centre of the cube."""
    return {f"d{a}": (F.col(a) - (F.col(f"m{a}") + F.col("sz") / 2)).cast("float") for a in AXES}


def padding(length: Column, to: int = 8) -> Column:
    """Bytes from length to the next multiple."""
    return F.pmod(-length, F.lit(to))
