"""Options, schemas and small value types that the rest of the package shares."""

from __future__ import annotations

from dataclasses import dataclass, field

#: A point. seq is the order of arrival: unique, and larger for whatever came later.
POINT = "seq long, x double, y double, z double, r int, g int, b int"
POINT_COLUMNS = ("seq", "x", "y", "z", "r", "g", "b")
#: The cube of a node: its least corner and the length of its edges.
CUBE_COLUMNS = ("mx", "my", "mz", "sz")
CELL_COLUMNS = ("cx", "cy", "cz")

#: Bytes of a stored point: three little-endian doubles and three bytes.
RECORD_BYTES = 27


@dataclass(frozen=True)
class World:
    """The cube of the root node."""

    x: float = -10_000_000.0
    y: float = -10_000_000.0
    z: float = -10_000_000.0
    size: float = 20_000_000.0


@dataclass(frozen=True)
class LodOptions:
    """grid: cells along an edge of a node; max_depth: the deepest level, beyond which points are dropped."""

    world: World = field(default_factory=World)
    grid: int = 64
    max_depth: int = 60

    def __post_init__(self) -> None:
        if self.grid < 1 or self.max_depth < 0 or not self.world.size > 0:
            raise ValueError("grid must be at least 1, max_depth at least 0, and the world's size positive")


@dataclass(frozen=True)
class GeoReference:
    """Where the local origin lies: degrees and metres above the WGS84 ellipsoid."""

    latitude: float
    longitude: float
    height: float = 0.0
