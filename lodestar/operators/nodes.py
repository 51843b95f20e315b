"""Nodes of the hierarchy, derived from the accepted points: counts, leaves, children, and the root worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cube
from ..functions.ids import parent_path
from ..model import CUBE_COLUMNS, LodOptions

NODE = "path string, parent_path string, depth int, mx double, my double, mz double, sz double, point_count long, is_leaf boolean"


def node_stats(accepted: DataFrame, options: LodOptions) -> DataFrame:
    """A row for each node. The root is one even if it accepted nothing; any other node accepted a point."""
    return from_counts(accepted.select("path", "depth", *CUBE_COLUMNS, F.lit(1).cast("long").alias("n")), options)


def from_counts(counts: DataFrame, options: LodOptions) -> DataFrame:
    """The same of parts of counts, such as those that each commit of a store adds: path, depth, cube and n."""
    root = counts.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(0).alias("depth"), *(c.alias(k) for k, c in cube.world_columns(options.world).items()), F.lit(0).cast("long").alias("n"))
    # the cube is a function of the path
    counted = counts.select("path", "depth", *CUBE_COLUMNS, "n").unionByName(root).groupBy("path", "depth", *CUBE_COLUMNS).agg(F.sum("n").alias("point_count"))
    counted = counted.where("point_count > 0 or depth = 0")
    parents = counted.where("depth > 0").select(parent_path(F.col("path")).alias("path")).distinct().withColumn("inner", F.lit(True))
    found = counted.join(parents, "path", "left")
    return found.select("path", parent_path(F.col("path")).alias("parent_path"), "depth", *CUBE_COLUMNS, "point_count", F.col("inner").isNull().alias("is_leaf"))


def is_empty() -> Column:
    """A leaf without points."""
    return F.col("is_leaf") & (F.col("point_count") == 0)


def children(nodes: DataFrame) -> DataFrame:
    """parent_path and the paths of its non-empty children in order of octants."""
    inner = nodes.where(F.col("parent_path").isNotNull() & ~is_empty())
    return inner.groupBy("parent_path").agg(F.sort_array(F.collect_list("path")).alias("children"))


def common_prefix(low: Column, high: Column) -> Column:
    """Of two strings."""
    lengths = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)))
    same = F.filter(lengths, lambda k: F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k))
    return F.substring(low, F.lit(1), F.array_max(same))


def logical_root(nodes: DataFrame) -> DataFrame:
    """One row: the path of the node that a walk from the root reaches while there is exactly one non-empty child.

    It is the longest common prefix of the non-empty nodes without a non-empty child, and of those the first and last in order suffice."""
    full = nodes.where(~is_empty())
    parents = full.where(F.col("parent_path").isNotNull()).select(F.col("parent_path").alias("path")).distinct()
    ends = full.join(parents, "path", "left_anti").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    return ends.select(F.coalesce(common_prefix(F.col("low"), F.col("high")), F.lit("")).alias("path"))


def emitted(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """The nodes that an export from the logical root shows."""
    start = F.broadcast(root.select(F.col("path").alias("root_path")))
    return nodes.join(start, F.col("path").startswith(F.col("root_path"))).where(~is_empty()).drop("root_path")


def trimmed_points(accepted: DataFrame, root: DataFrame) -> DataFrame:
    """Accepted points that belong to the nodes above the logical root, which an export leaves out."""
    start = F.broadcast(root.select(F.col("path").alias("root_path")))
    return accepted.join(start, ~F.col("path").startswith(F.col("root_path"))).drop("root_path")


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path").startswith(path))


def ancestors(nodes: DataFrame, path: str) -> DataFrame:
    """From the root to the node itself: a lookup of known keys."""
    return nodes.where(F.col("path").isin([path[:k] for k in range(len(path) + 1)]))


def prefixes(path: Column) -> Column:
    """The paths from the root to a node, itself included."""
    return F.transform(F.sequence(F.lit(0), F.length(path)), lambda k: F.substring(path, F.lit(1), k))


def ancestors_of(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each path of wanted, the rows of the nodes above it and of itself, as columns of nodes beside `of`: paths are spread into their prefixes, which are keys of a join."""
    above = wanted.select(F.col("path").alias("of"), F.explode(prefixes(F.col("path"))).alias("path"))
    return above.join(nodes, "path").select("of", *nodes.columns)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """path, point_count, and of the subtree below and with each node: points, nodes and the deepest level.

    Every node adds itself to each of its ancestors; partial sums come before the shuffle, so the root gets a row from each task and not one from each node."""
    spread = nodes.select(F.explode(prefixes(F.col("path"))).alias("path"), F.col("path").alias("of"), "point_count", "depth")
    own = F.sum(F.when(F.col("of") == F.col("path"), F.col("point_count")))
    return spread.groupBy("path").agg(own.alias("point_count"), F.sum("point_count").alias("subtree_points"), F.count(F.lit(1)).alias("subtree_nodes"), F.max("depth").alias("deepest")).where("point_count is not null")


def level_histogram(accepted: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """depth and how many points each level accepted."""
    return accepted.groupBy("depth").agg(F.count(F.lit(1)).alias("accepted"))


def summary(accepted: DataFrame, dropped: DataFrame, options: LodOptions) -> DataFrame:
    """One row: points read, accepted and dropped for each reason, and nodes. Dropped points count as read."""
    reason = lambda name: F.count_if(F.col("reason") == name)
    lost = dropped.agg(F.count(F.lit(1)).alias("dropped"), reason("out_of_bounds").alias("out_of_bounds"), reason("max_depth").alias("max_depth"))
    by_node = accepted.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    kept = by_node.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), (F.count(F.lit(1)) + 1 - F.count_if(F.col("path") == "")).alias("nodes"))
    return kept.crossJoin(F.broadcast(lost)).select((F.col("accepted") + F.col("dropped")).alias("points"), "*")
