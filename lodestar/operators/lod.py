"""The level-of-detail rule: every point belongs to the first node, from the root down, whose cell for it is free.

As a query, level by level: among the points that reach a cell of a node, the one with the smallest seq is accepted, and the others
go on to the node's child that they lie in. What is left after the deepest level is dropped.

How it is run: the cells of a level part those of the level above, since nodes halve and every node has as many cells. So points
compete only with points of the same cell, now and at all deeper levels, and cells can be settled apart from each other.

1. Cells of at most `kernel_rows` points, in nearly all data sets all cells of the root, are finished at once, of whatever level they are: one shuffle by cell,
   and each task takes its cells through all levels below.
2. If a cell has more, levels at which all points still lie in one node, of which a small data set in a large world has many, are done in
   one pass. Each task keeps the points that its own points alone would accept there: fewer competitors never send a point deeper, so
   these contain everything accepted, and they are few. The rule over them gives the true choice.
3. The points of cells with more than `kernel_rows` points take one level: one aggregate, partial counts first, gives the size and the smallest seq of each cell, one join marks
   the points by it, and what is left goes on with 3. Cells that are hot are sent to all tasks, so no task ever holds one. Small cells wait for 1 until no cell is large.

Of points at the same place only the first max_depth + 1 can ever be accepted, since each level takes one of them at most. Where cells are too large for one task, longer
runs of equal points are found by counts and cut first, so that a million equal points take no more rounds than one.

Points can be assigned next to stored ones (`stored`), which own their cells already. Stored rows take part as owners: they meet the new points of their cell in the same task, in the same
shuffle, and what they own is a set of cells of each level that nobody else can have. Only rows of cells that the new points touch are read on. Where stored rows make a cell too large for
one task, they mostly own that cell as well: then nobody wins it, its points are moved on by an expression, and only levels below are settled, in one task each and without 3.

Rounding can put a point next to a cell's edge into a cell that is no part of the one above. Tasks look for such points; if there is one,
the work is done again with whole nodes in the place of cells, which needs no such property; `apart` tells which it was.

Every step writes its rows to the shared checkpoint folder, so a lost executor costs only its own tasks. Points are read more than once, so their source must give the same rows each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F

from ..functions import cube
from ..model import CELL_COLUMNS, CUBE_COLUMNS, POINT_COLUMNS, LodOptions
from ..storage import BROADCAST_BYTES, local_rows, materialize, small

#: Points of one cell that a single task may finish.
KERNEL_ROWS = 1 << 16
#: Rows that a task settles at once, if its units are smaller than that: few, as each core of an executor has a Python worker that keeps what it once took.
HELD_ROWS = 1 << 13
#: Rows of a task that takes a level.
LEVEL_ROWS = 1 << 18
#: Stored cells of the levels that all points share that may be sent to every task.
SENT_OWNERS = 1 << 18
#: Levels that points pass without a write, where stored points own the cells of all large units; each parts a unit in eight.
PASSED_LEVELS = 4
ACCEPTED = "seq long, x double, y double, z double, r int, g int, b int, path string, depth int, cx int, cy int, cz int, mx double, my double, mz double, sz double"
DROPPED = "seq long, reason string, path string"
OUT_OF_BOUNDS, MAX_DEPTH = "out_of_bounds", "max_depth"
#: What an owner, a stored point, owns: a node, its depth and a cell.
OWN_COLUMNS = ("own_path", "own_depth", "ox", "oy", "oz")
#: A point, the node that it is at, and its cell there.
AT_NODES = (*POINT_COLUMNS, "path", *CUBE_COLUMNS, *CELL_COLUMNS)


@dataclass(frozen=True)
class Lod:
    """accepted: points with the node and cell that they own. dropped: seq, reason, and the path where the walk ended. apart: whether all cells of these points are parts of those above."""

    accepted: DataFrame
    dropped: DataFrame
    apart: bool = True
    #: All points in the world as one frame, where one step settled them: ACCEPTED, with depth -1 for those dropped.
    settled: DataFrame | None = None


@dataclass
class Owned:
    """Cells that stored points own: the path and depth of their nodes, and the cells (n x 3)."""

    path: np.ndarray
    depth: np.ndarray
    cell: np.ndarray

    def at(self, depth: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What is owned in these nodes of a depth: positions among the names, and cells."""
        here = np.flatnonzero(self.depth == depth)
        place = {name: k for k, name in enumerate(names)}
        at = np.array([place.get(path, -1) for path in self.path[here].tolist()], np.int64)
        return at[at >= 0], self.cell[here][at >= 0]


@dataclass
class Settled:
    """For each point: the depth that accepted it (-1: none), the path of its last node, its cell there and that node's cube, and whether all its cells are parts of those above."""

    depth: np.ndarray
    path: np.ndarray
    cell: np.ndarray
    cubes: np.ndarray
    nested: np.ndarray


def settle(seq: np.ndarray, points: np.ndarray, paths: np.ndarray, cubes: np.ndarray, first: int, last: int, grid: int, owned: Owned | None = None) -> Settled:
    """The rule for points (n x 3) at nodes of depth `first` with these paths and cubes (n x 4), through depth `last`, where nobody gets what is owned (anything with `at`).

    All points of a level are handled at once; one stands before another in its cell by seq."""
    n = len(seq)
    out = Settled(np.full(n, -1, np.int32), np.empty(n, object), np.zeros((n, 3), np.int32), np.zeros((n, 4)), np.ones(n, bool))
    node, found = pd.factorize(paths)
    names = found.astype(str) if n else np.zeros(0, str)
    at = np.zeros(len(names), np.int64)
    at[node] = np.arange(n)
    own = cubes[at] if n else np.zeros((0, 4))
    alive = np.argsort(seq, kind="stable")
    node = node[alive]
    side = np.int64(grid + 1)  # rounding may give a point at a cube's upper edge the number of cells
    above = upper = None
    for depth in range(first, last + 1):
        if not len(alive):
            break
        p, c = points[alive], own[node]
        cell = np.floor((p - c[:, :3]) / (c[:, 3:] / grid)).astype(np.int64)
        if above is not None:
            out.nested[alive] &= ((cell + upper * grid) >> 1 == above).all(1)
        code = _code(node, cell, side)
        _, winner = np.unique(code, return_index=True)
        won = np.zeros(len(alive), bool)
        won[winner] = True
        if owned is not None:
            won &= ~np.isin(code, _code(*owned.at(depth, names.tolist()), side))
        end = won if depth < last else np.ones(len(alive), bool)
        done = alive[end]
        out.depth[alive[won]] = depth
        out.path[done], out.cell[done], out.cubes[done] = names.astype(object)[node[end]], cell[end], c[end]
        alive, node, p, c, above = alive[~end], node[~end], p[~end], c[~end], cell[~end]
        if not len(alive):
            break
        upper = p >= c[:, :3] + c[:, 3:] / 2
        octant = upper @ np.array([1, 2, 4])
        child = np.concatenate([np.where(upper, c[:, :3] + c[:, 3:] / 2, c[:, :3]), c[:, 3:] / 2], axis=1)
        key, at, inner = np.unique(node * 8 + octant, return_index=True, return_inverse=True)
        names = np.array([f"{names[k // 8]}{k % 8}" for k in key.tolist()])
        node, own = inner, child[at]
    return out


def _code(node: np.ndarray, cell: np.ndarray, side: np.int64) -> np.ndarray:
    return ((node * side + cell[:, 0]) * side + cell[:, 1]) * side + cell[:, 2]


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    columns = lambda names: pdf[list(names)].to_numpy(float)
    return pdf["seq"].to_numpy(), columns(cube.AXES), pdf["path"].to_numpy(object), columns(CUBE_COLUMNS)


def finish(live: DataFrame, depth: int, options: LodOptions, tasks: int, unit: tuple[str, ...] = ("path",), owners: DataFrame | None = None) -> DataFrame:
    """All remaining levels for points whose units are small: ACCEPTED columns and `nested`, with depth -1 where the deepest level accepted none.

    Units, with their owners, are dealt to tasks in one shuffle and sorted there, so that a task settles some whole units at a time and holds no others. At depth 0 no node needs to be sent;
    else the paths say at which level a unit begins, and levels may differ.
    One number stands for a unit, by which Spark sorts without a look at the rows; units of the same number are settled together, which changes nothing."""
    both, sent = owners is not None, () if depth == 0 else ("path", *CUBE_COLUMNS)
    world = [float(v) for v in (options.world.x, options.world.y, options.world.z, options.world.size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches, ("unit",), HELD_ROWS):
            levels = pc.binary_length(rows["path"]) if sent else None
            for level in [0] if levels is None else sorted(pc.unique(levels).to_pylist()):
                yield from settled(rows if levels is None else rows.filter(pc.equal(levels, level)), level)

    def settled(rows: pa.Table, level: int) -> Iterator[pa.RecordBatch]:
        owned = None
        if both:
            own = pc.greater_equal(rows["own_depth"], 0)
            stored, rows = rows.filter(own), rows.filter(pc.invert(own))
            owned = Owned(_column(stored, "own_path"), _column(stored, "own_depth"), _columns(stored, OWN_COLUMNS[2:], np.int64))
        n = rows.num_rows
        paths = _column(rows, "path") if sent else np.full(n, "", object)
        cubes = _columns(rows, CUBE_COLUMNS, float) if sent else np.tile(world, (n, 1))
        found = settle(_column(rows, "seq"), _columns(rows, cube.AXES, float), paths, cubes, level, options.max_depth, options.grid, owned)
        columns = {c: rows[c].combine_chunks() for c in POINT_COLUMNS}
        columns |= {"path": pa.array(found.path, pa.string()), "depth": pa.array(found.depth)} | {c: pa.array(found.cell[:, k]) for k, c in enumerate(CELL_COLUMNS)}
        columns |= {c: pa.array(found.cubes[:, k]) for k, c in enumerate(CUBE_COLUMNS)} | {"nested": pa.array(found.nested)}
        yield from pa.table(columns).to_batches(1 << 16)

    rows = live.select(*POINT_COLUMNS, *sent, _unit_number(unit))
    if both:
        nothing = [F.lit("").alias("own_path"), F.lit(-1).alias("own_depth"), *(F.lit(0).alias(c) for c in OWN_COLUMNS[2:])]
        place = [F.lit(0).cast(live.schema[c].dataType).alias(c) for c in POINT_COLUMNS]
        rows = rows.select("*", *nothing).unionByName(owners.select(*place, *sent, _unit_number(unit), *OWN_COLUMNS))
    return rows.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(run, f"{ACCEPTED}, nested boolean")


def _unit_number(unit: tuple[str, ...]) -> Column:
    """Of a hash, below the level, so that units of a level lie together."""
    return (F.shiftleft(F.length("path").cast("long"), 56) + F.shiftrightunsigned(F.xxhash64(*unit), 8)).alias("unit")


def whole_units(batches: Iterator[pa.RecordBatch], unit: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Of batches sorted by unit, tables of whole units, cut at the first new unit after `least` rows."""
    held, n = [], 0
    for b in batches:
        if n >= least and b.num_rows:
            last = held[-1].slice(held[-1].num_rows - 1)
            differ = [pc.not_equal(b[c], last[c][0]) for c in unit]
            ends = [k for k in (pc.index(d, True).as_py() for d in differ) if k >= 0]
            if ends:
                end = min(ends)
                yield pa.Table.from_batches([*held, b.slice(0, end)])
                held, n, b = [], 0, b.slice(end)
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _tasks(spark: SparkSession, rows: int) -> int:
    """For so many rows in small units; by what a task may hold, however small the units are."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // KERNEL_ROWS))


def _spread(live: DataFrame, rows: int) -> DataFrame:
    """live, written by as many tasks as it is worth, however few files or row groups the source has; the levels are read as they were written."""
    return materialize(live.repartition(max(live.sparkSession.sparkContext.defaultParallelism, -(-rows // LEVEL_ROWS)), "seq"))


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy()


def _columns(rows: pa.Table, names: tuple[str, ...], kind: type) -> np.ndarray:
    return np.stack([_column(rows, c).astype(kind) for c in names], 1)


def with_cells(live: DataFrame, grid: int) -> DataFrame:
    return live.withColumns(cube.cell(grid))


def first_of_cells(live: DataFrame) -> DataFrame:
    """seq of the first point of each cell. Partial aggregates come before the shuffle, so one cell may hold most points."""
    return live.groupBy("path", *CELL_COLUMNS).agg(F.min("seq").alias("seq"))


def flagged(live: DataFrame, winners: DataFrame) -> DataFrame:
    """live with `won`, by a join on seq alone, which no hot node or cell can skew."""
    won = small(materialize(winners.select("seq")), 12).withColumn("won", F.lit(True))
    return live.join(won, "seq", "left").withColumn("won", F.coalesce("won", F.lit(False)))


def next_level(live: DataFrame, *more: Column) -> DataFrame:
    """The points at the children that they lie in."""
    moved = {"path": F.concat("path", cube.octant().cast("string")), **cube.child_of_point()}
    return live.select(*POINT_COLUMNS, *(c.alias(k) for k, c in moved.items()), *more)


def owners_at_root(stored: DataFrame, options: LodOptions) -> DataFrame:
    """Stored rows as owners, their walk at the root."""
    own = [F.col(c).alias(o) for c, o in zip(("path", "depth", *CELL_COLUMNS), OWN_COLUMNS)]
    return stored.select(*cube.AXES, *own, F.lit("").alias("path"), *(c.alias(k) for k, c in cube.world_columns(options.world).items()))


def owners_below(owners: DataFrame, depth: int) -> DataFrame:
    """Those that own nothing at this depth, one level on."""
    moved = {"path": F.concat("path", cube.octant().cast("string")), **cube.child_of_point()}
    return owners.where(F.col("own_depth") > depth).select(*cube.AXES, *OWN_COLUMNS, *(c.alias(k) for k, c in moved.items()))


def owned_cells(owners: DataFrame, depth: int) -> DataFrame:
    """path and cell of what is owned at a depth."""
    return owners.where(F.col("own_depth") == depth).select(F.col("own_path").alias("path"), *(F.col(o).alias(c) for c, o in zip(CELL_COLUMNS, OWN_COLUMNS[2:])))


def outside_cell_above(grid: int) -> Column:
    """Whether a point's cell is no part of its cell of the level above, above_<cell>."""
    octant = F.right("path", F.lit(1)).cast("int")
    inside = [F.shiftright(F.col(c) + F.shiftright(octant, k).bitwiseAND(F.lit(1)) * grid, 1) == F.col(f"above_{c}") for k, c in enumerate(CELL_COLUMNS)]
    return ~(inside[0] & inside[1] & inside[2])


def at_root(points: DataFrame, options: LodOptions) -> DataFrame:
    return points.select(*POINT_COLUMNS, F.lit("").alias("path"), *(c.alias(k) for k, c in cube.world_columns(options.world).items()))


def _accepted(rows: DataFrame, depth: int | Column) -> DataFrame:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return rows.select(*POINT_COLUMNS, "path", depth.cast("int").alias("depth"), *CELL_COLUMNS, *CUBE_COLUMNS)


def _dropped(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select("seq", F.lit(reason).alias("reason"), "path")


def of_settled(done: DataFrame, dropped: list[DataFrame]) -> Lod:
    """The result from settled points (ACCEPTED, with depth -1 where no level took one) and those dropped before."""
    return Lod(_accepted(done.where("depth >= 0"), F.col("depth")), _union([*dropped, _dropped(done.where("depth < 0"), MAX_DEPTH)], done.sparkSession, DROPPED), True, done)


def common_levels(bounds: Row, options: LodOptions) -> tuple[str, list[float]]:
    """The deepest path of which all points between the bounds are part, at most max_depth long, and its cube."""
    path, (x, y, z, size) = "", (float(v) for v in (options.world.x, options.world.y, options.world.z, options.world.size))
    low, m = [bounds[f"lo_{a}"] for a in cube.AXES], [x, y, z]
    high = [bounds[f"hi_{a}"] for a in cube.AXES]
    while len(path) < options.max_depth:
        upper = [v >= c + size / 2 for v, c in zip(low, m)]
        if upper != [v >= c + size / 2 for v, c in zip(high, m)]:
            break
        m, size = [c + size / 2 if u else c for c, u in zip(m, upper)], size / 2
        path += str(sum(1 << k for k, u in enumerate(upper) if u))
    return path, [*m, size]


def _free(firsts: DataFrame, owners: DataFrame | None, depth: int) -> DataFrame:
    """The first points of cells that nobody owns."""
    if owners is None:
        return firsts
    key = ["path", *CELL_COLUMNS]
    return firsts.join(small(materialize(owned_cells(owners, depth)), depth + 76), key, "left_anti")


def _first_levels(live: DataFrame, path: str, end: list[float], options: LodOptions, kernel_rows: int, owners: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None, bool] | None:
    """What the levels above `path`, which holds all points, accept; the rest, moved there; the owners there; and whether the points' cells of these levels are parts of those above.

    None if too much is owned in these levels to be sent to every task."""
    last, spark, owned, above = len(path) - 1, live.sparkSession, None, None
    if owners is not None:
        above = materialize(owners.where((F.col("own_depth") <= last) & (F.col("own_path") == F.substring(F.lit(path), F.lit(1), F.col("own_depth")))))
        if above.count() > SENT_OWNERS:
            return None
        rows = above.select(*OWN_COLUMNS).toPandas()
        owned = spark.sparkContext.broadcast(Owned(rows["own_path"].to_numpy(object), rows["own_depth"].to_numpy(), rows[["ox", "oy", "oz"]].to_numpy(np.int64)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = b.to_pandas().assign(nested=True)
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            found = settle(*_arrays(held), 0, last + 1, options.grid, owned and owned.value)
            strange = held[~found.nested]
            if len(strange):
                yield pa.RecordBatch.from_pandas(strange.assign(nested=False), preserve_index=False)
            held = held[(found.depth >= 0) & (found.depth <= last) & found.nested]
        if held is not None and len(held):
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    left = materialize(live.mapInArrow(candidates, live.withColumn("nested", F.lit(True)).schema))
    if not left.where("not nested").isEmpty():
        return live, live, owners, False
    left = left.drop("nested")
    upper = replace(options, max_depth=last)
    if left.count() <= kernel_rows:
        there = None if above is None else with_cells(above, options.grid).withColumn("path", F.lit(""))
        accepted = materialize(_accepted(finish(left, 0, upper, 1, ("path",), there).where("depth >= 0"), F.col("depth")))
    else:
        taken = []
        for depth in range(len(path)):
            cells = with_cells(left, options.grid)
            rows = materialize(flagged(cells, _free(first_of_cells(cells), above, depth)))
            taken.append(_accepted(rows.where("won"), depth))
            left = next_level(rows.where("not won"))
        accepted = materialize(_union(taken, spark, ACCEPTED))
    cubes = [F.lit(v).alias(c) for c, v in zip(CUBE_COLUMNS, end)]
    rest = live.join(small(accepted.select("seq"), 12), "seq", "left_anti").select(*POINT_COLUMNS, F.lit(path).alias("path"), *cubes)
    if owners is not None:
        owners = owners.where((F.col("own_depth") > last) & F.col("own_path").startswith(path)).select(*cube.AXES, *OWN_COLUMNS, F.lit(path).alias("path"), *cubes)
    return accepted, materialize(rest), owners, True


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    if not parts:
        return local_rows(spark, [], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _apart(done: DataFrame) -> bool:
    """Whether no point was met whose cells are no parts of those above."""
    return done.where("not nested").isEmpty()


def _sizes(cells: DataFrame, owners: DataFrame | None, unit: tuple[str, ...], *more: Column) -> DataFrame:
    """Of each unit: n points, `rows` with its owners, more aggregates over the points, and with owners whether its cell is `owned`."""
    if owners is None:
        return cells.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("rows"), *more)
    # null columns stand for owners, which no aggregate but the count of rows sees
    nulls = [F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in cells.columns if c not in unit]
    owned = (F.col("own_path") == F.col("path")) & (F.col("ox") == F.col("cx")) & (F.col("oy") == F.col("cy")) & (F.col("oz") == F.col("cz"))
    both = cells.withColumn("owned", F.lit(False)).unionByName(owners.select(*unit, *nulls, owned.alias("owned")))
    return both.groupBy(*unit).agg(F.count("seq").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("owned").alias("owned"), *more)


def _past_owned(cells: DataFrame, held: DataFrame, sizes: DataFrame, options: LodOptions, kernel_rows: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Points and owners with those of large units, whose cells are all owned, at the levels below where units are small: both, the owners only of units that have points, and how many rows.

    Nobody wins an owned cell, so nothing is settled or written on the way but the sizes of units. None if a large unit's cell is free, units stay large, or a cell is no part of the one above."""
    unit, large = ["path", *CELL_COLUMNS], F.col("rows") > kernel_rows
    cells, sizes = cells.select(*AT_NODES), sizes.withColumn("strange", F.lit(0))
    for depth in range(min(PASSED_LEVELS, options.max_depth) + 1):
        sizes = sizes.where("n > 0")
        units, rows, odd, n, free = sizes.agg(F.count(F.lit(1)), F.sum("rows"), F.sum("strange"), F.count_if(large), F.count_if(large & ~F.col("owned"))).first()
        if odd or free or n * (depth + 92) > BROADCAST_BYTES:
            return None
        if not n:
            keys = sizes.select(*unit)
            return cells, held.join(F.broadcast(keys) if units * (depth + 76) <= BROADCAST_BYTES else keys, unit, "left_semi"), rows
        marks = F.broadcast(sizes.where(large).select(*unit, F.lit(True).alias("large")))
        points = _moved(cells.join(marks, unit, "left").select(*AT_NODES, F.lit(False).alias("won"), F.coalesce("large", F.lit(False)).alias("left")), options.grid)
        owners = held.join(marks, unit, "left").where(F.col("large").isNull() | (F.col("own_depth") > depth))
        moved = {"path": F.concat("path", cube.octant().cast("string")), **cube.child_of_point()}
        held = with_cells(owners.select(*cube.AXES, *OWN_COLUMNS, *(F.when(F.col("large"), c).otherwise(F.col(k)).alias(k) for k, c in moved.items())), options.grid)
        sizes = materialize(_sizes(points.select(*AT_NODES, "strange"), held, tuple(unit), F.count_if("strange").alias("strange")))
        cells = points.select(*AT_NODES)
    return None


def _thinned(live: DataFrame, options: LodOptions) -> tuple[DataFrame, DataFrame | None]:
    """live without the points that come after max_depth + 1 others at their place, and those as dropped.

    Equal points are counted, partial counts first; the limit of a run is a partial top of each task before anything is sent."""
    most, place = options.max_depth + 1, list(cube.AXES)
    runs = materialize(live.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*place))
    if runs.isEmpty():
        return live, None
    runs = small(runs, 24)
    first = live.join(runs, place, "left_semi").select(*place, "seq").withColumn("k", F.row_number().over(W.partitionBy(*place).orderBy("seq"))).where(F.col("k") <= most)
    ends = small(materialize(first.groupBy(*place).agg(F.max("seq").alias("end"))), 32)
    ended = live.join(ends, place, "left")
    late = F.col("seq") > F.col("end")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            if len(pdf):
                places, at = np.unique(pdf[place].to_numpy(float), axis=0, return_inverse=True)
                paths = np.array([deepest_path(p, options) for p in places.tolist()], object)
                yield pa.RecordBatch.from_arrays([pa.array(pdf["seq"]), pa.array(paths[at.ravel()], pa.string())], names=["seq", "path"])

    dropped = ended.where(late).select("seq", *place).mapInArrow(walked, "seq long, path string").select("seq", F.lit(MAX_DEPTH).alias("reason"), "path")
    return materialize(ended.where(late.isNull() | ~late).select(*live.columns)), materialize(dropped)


def deepest_path(point: list[float], options: LodOptions) -> str:
    """The node of the deepest level that a point of the world lies in."""
    path, m, size = "", [float(options.world.x), float(options.world.y), float(options.world.z)], float(options.world.size)
    for _ in range(options.max_depth):
        upper = [v >= c + size / 2 for v, c in zip(point, m)]
        m, size = [c + size / 2 if u else c for c, u in zip(m, upper)], size / 2
        path += str(sum(1 << k for k, u in enumerate(upper) if u))
    return path


def _marked(cells: DataFrame, marks: DataFrame, n: int, hot: int, depth: int) -> DataFrame:
    """cells with the `first` point and `large` of the n cells that marks have. Marks that are too many to be sent meet the points in a shuffle by cell, which hot cells take no part in."""
    key = ["path", *CELL_COLUMNS]
    found = marks.select(*key, "first", F.lit(True).alias("large"))
    if n * (depth + 92) <= BROADCAST_BYTES:
        return cells.join(F.broadcast(found), key, "left")
    if not hot:
        return cells.join(found, key, "left")
    few = F.broadcast(marks.where(F.col("rows") > KERNEL_ROWS).select(*key, "first", F.lit(True).alias("large")))
    return cells.join(few, key).unionByName(cells.join(few, key, "left_anti").join(found, key, "left"))


def _moved(marked: DataFrame, grid: int) -> DataFrame:
    """Points that are `left` at the children that they lie in, with their cells there and whether these are no parts of the cells above; the others stay as they are."""
    moved = {"path": F.concat("path", cube.octant().cast("string")), **cube.child_of_point()}
    there = [F.when(F.col("left"), c).otherwise(F.col(k)).alias(k) for k, c in moved.items()]
    below = with_cells(marked.select(*POINT_COLUMNS, *there, "won", "left", *(F.col(c).alias(f"above_{c}") for c in CELL_COLUMNS)), grid)
    return below.select(*AT_NODES, "won", "left", F.when(F.col("left"), outside_cell_above(grid)).otherwise(F.lit(False)).alias("strange"))


def _by_units(live: DataFrame, depth: int, options: LodOptions, kernel_rows: int, unit: tuple[str, ...], owners: DataFrame | None = None) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Steps 1 and 3 from a depth on: accepted and dropped; None if units of cells turn out not to be apart.

    A level takes one aggregate, whose rows are the cells, and one pass that marks the points. Units that are small wait, each at its level, and are finished together."""
    spark, accepted, dropped, rest, near, waiting = live.sparkSession, [], [], [], [], 0
    key, large = ["path", *CELL_COLUMNS], F.col("rows") > kernel_rows
    cells = with_cells(live, options.grid).withColumn("strange", F.lit(False))
    while True:
        held = None if owners is None else with_cells(owners, options.grid)
        firsts = materialize(_sizes(cells, held, tuple(key), F.count_if("strange").alias("strange"), F.min("seq").alias("first")))
        sizes = firsts if len(unit) > 1 else firsts.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("n", "rows", "strange")))
        sizes = sizes.where("n > 0")
        full = sizes.agg(F.sum("rows"), F.sum("strange"), F.count_if(large), F.sum(F.when(large, F.col("rows"))), F.count_if(F.col("rows") > KERNEL_ROWS)).first()
        total, odd, n, in_large, hot = (v or 0 for v in full)
        if not total:
            break
        if len(unit) > 1 and odd:
            return None
        waiting += total - in_large
        if not n:
            rest.append(cells.select(*AT_NODES))
            near.append(held)
            break
        marks = firsts.where("n > 0")
        if len(unit) > 1:
            marks = marks.where(large)
        else:
            marks = materialize(marks.join(small(materialize(sizes.where(large).select("path")), depth + 60), "path", "left_semi"))
            n, hot = marks.count(), marks.where(F.col("rows") > KERNEL_ROWS).count()
        if held is not None:
            small_units = small(materialize(sizes.where(~large).select(*unit)), depth + 76)
            big_units = small(materialize(sizes.where(large).select(*unit)), depth + 76)
            near.append(held.join(small_units, list(unit), "left_semi"))
            far = materialize(held.join(big_units, list(unit), "left_semi"))
            taken = owned_cells(far, depth).distinct().withColumn("taken", F.lit(True))
            marks = materialize(marks.join(taken, key, "left").withColumn("first", F.when(F.col("taken").isNull(), F.col("first"))).drop("taken"))
        marked = _marked(cells, marks, n, hot, depth).withColumns({"large": F.coalesce("large", F.lit(False)), "won": F.coalesce(F.col("seq") == F.col("first"), F.lit(False))})
        marked = marked.select(*AT_NODES, "won", (F.col("large") & ~F.col("won")).alias("left"))
        rows = materialize(marked if depth == options.max_depth else _moved(marked, options.grid))
        accepted.append(_accepted(rows.where("won"), depth))
        if total > in_large:
            rest.append(rows.where("not won and not left").select(*AT_NODES))
        if depth == options.max_depth:
            dropped.append(_dropped(rows.where("left"), MAX_DEPTH))
            break
        owners = None if held is None else materialize(owners_below(far, depth))
        cells, depth = rows.where("left").drop("won", "left"), depth + 1
    if rest:
        owned = None if owners is None else _union(near, spark, "")
        done = materialize(finish(_union(rest, spark, ""), depth, options, _tasks(spark, waiting), unit, owned))
        if len(unit) > 1 and not _apart(done):
            return None
        accepted.append(_accepted(done.where("depth >= 0"), F.col("depth")))
        dropped.append(_dropped(done.where("depth < 0"), MAX_DEPTH))
    return accepted, dropped


def _touched(stored: DataFrame, seen: Row, options: LodOptions) -> DataFrame:
    """Stored rows near the new points: their cells of the root lie between those of the points' bounds. With literals, so that files and row groups that lie elsewhere aren't read."""
    size = options.world.size / options.grid
    for a in cube.AXES:
        low = getattr(options.world, a)
        cells = [np.floor((seen[f"{end}_{a}"] - low) / size) for end in ("lo", "hi")]
        # a cell more on either side, as rounding may move an edge
        stored = stored.where((F.col(a) >= float(low + (cells[0] - 1) * size)) & (F.col(a) <= float(low + (cells[1] + 2) * size)))
    return stored


def bounds_of_world(options: LodOptions) -> list[Column]:
    """Aggregates over points: n of those in the world, and where they begin and end."""
    inside = F.coalesce(cube.inside_world(options.world), F.lit(False))
    ends = [f(F.when(inside, F.col(a))).alias(f"{n}_{a}") for a in cube.AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return [F.count_if(inside).alias("n"), *ends]


def assign(points: DataFrame, options: LodOptions | None = None, kernel_rows: int = KERNEL_ROWS, stored: DataFrame | None = None, apart: bool = True, bounds: Row | None = None, hold: Callable[[DataFrame], DataFrame] = materialize) -> Lod:
    """Assign every point to a node.

    points: the columns of model.POINT, seq unique and not null; further columns are ignored. Points outside the world, or
    with a null or NaN coordinate, are dropped. stored: accepted rows that came before all points and keep their cells; apart: what their results said of them.
    bounds: bounds_of_world, where it is known. hold: what keeps a frame that is read several times. kernel_rows changes how the work is done, never its result."""
    options, spark = options or LodOptions(), points.sparkSession
    inside = F.coalesce(cube.inside_world(options.world), F.lit(False))
    outside = points.where(~inside).select("seq", F.lit(OUT_OF_BOUNDS).alias("reason"), F.lit("").alias("path"))
    live = at_root(points.where(cube.inside_world(options.world)), options)
    ends = [f(a).alias(f"{n}_{a}") for a in cube.AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]
    again = [f(f"{n}_{a}").alias(f"{n}_{a}") for a in cube.AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]
    full = lambda c: F.when(F.col("n") > 0, F.col(c))
    total = [F.sum("n").alias("n"), F.sum(full("rows")).alias("rows"), F.sum("rows").alias("all_rows"), F.max(full("rows")).alias("most"), F.count_if(F.col("n") > 0).alias("units"), *again]
    nothing = lambda: Lod(_union([], spark, ACCEPTED), _union([outside], spark, DROPPED), True)
    unit, owners = ("path", *CELL_COLUMNS), None
    if stored is not None:
        bounds = bounds or points.agg(*bounds_of_world(options)).first()
        if not bounds["n"]:
            return nothing()
        owners = owners_at_root(_touched(stored, bounds, options) if apart else stored, options)
        unit = unit if apart else ("path",)
    dropped, written = [outside], False
    for attempt in range(2):
        cells = with_cells(live, options.grid)
        held = None if owners is None else with_cells(owners, options.grid)
        sizes = _sizes(cells, held, ("path", *CELL_COLUMNS), *ends)
        sizes = sizes if held is None else materialize(sizes)
        seen = sizes.agg(*total).first()
        if not seen["n"]:
            return nothing()
        if seen["most"] <= kernel_rows and len(unit) > 1:
            tasks = _tasks(spark, seen["rows"])
            if held is not None and seen["all_rows"] > 2 * seen["rows"]:
                keys = sizes.where("n > 0").select(*unit)
                held = held.join(F.broadcast(keys) if seen["units"] * 76 <= BROADCAST_BYTES else keys, list(unit), "left_semi")
            done = hold(finish(cells, 0, options, tasks, unit, held))
            if _apart(done):
                return of_settled(done, dropped)
            unit, owners = ("path",), None if stored is None else owners_at_root(stored, options)
        elif owners is not None and len(unit) > 1 and not attempt and (there := _past_owned(cells, held, sizes, options, kernel_rows)) is not None:
            below, near, rows = there
            done = hold(finish(below, 1, options, _tasks(spark, rows), unit, near))
            if _apart(done):
                return of_settled(done, dropped)
            unit, owners = ("path",), owners_at_root(stored, options)
            break
        if attempt or seen["most"] <= kernel_rows:
            break
        live, written = _spread(live, seen["n"]), True
        live, surplus = _thinned(live, options)
        if surplus is None:
            break
        dropped.append(surplus)
    live = live if written else _spread(live, seen["n"])
    path, end = common_levels(seen, options)
    first = None
    if path and seen["n"] > kernel_rows and len(unit) > 1:
        first = _first_levels(live, path, end, options, kernel_rows, owners)
    if first is not None and first[3]:
        upper, below, owners_there, _ = first
        found = _by_units(below, len(path), options, kernel_rows, unit, owners_there)
        if found is not None:
            return Lod(_union([upper, *found[0]], spark, ACCEPTED), _union(dropped + found[1], spark, DROPPED))
    elif first is None and len(unit) > 1:
        found = _by_units(live, 0, options, kernel_rows, unit, owners)
        if found is not None:
            return Lod(_union(found[0], spark, ACCEPTED), _union(dropped + found[1], spark, DROPPED))
    found = _by_units(live, 0, options, kernel_rows, ("path",), None if stored is None else owners_at_root(stored, options))
    return Lod(_union(found[0], spark, ACCEPTED), _union(dropped + found[1], spark, DROPPED), False)
