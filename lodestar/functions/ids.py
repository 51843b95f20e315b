"""Node ids and names. A node's key is its path: the octants from the root, the root itself being the empty string.

Paths sort in the order of a walk that visits parents before children, and an ancestor is a prefix. Ids appear in names only:
the root is 0, and octant o of node i is 8 i + o + 1, so an id at depth 60 has 55 digits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: The deepest level whose ids fit a long.
LONG_DEPTH = 20


def id_of_path(path: str) -> int:
    return (int(path, 8) if path else 0) + (8 ** len(path) - 1) // 7


def path_of_id(node: int) -> str:
    """The inverse. A negative id is no node."""
    if node < 0:
        raise ValueError("ids of nodes are not negative")
    digits = []
    while node:
        node, octant = divmod(node - 1, 8)
        digits.append(str(octant))
    return "".join(reversed(digits))


@F.pandas_udf(StringType())
def _wide_id(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else str(id_of_path(p)))


@F.pandas_udf(StringType())
def _wide_path(node: pd.Series) -> pd.Series:
    return node.map(lambda i: None if i is None else path_of_id(int(i)))


def node_id(path: Column, max_depth: int) -> Column:
    """The id as text; computed in the JVM where the deepest level allows longs, else with Python's integers over Arrow batches."""
    if max_depth > LONG_DEPTH:
        return _wide_id(path)
    first = F.element_at(F.array(*(F.lit((8**d - 1) // 7) for d in range(LONG_DEPTH + 1))), F.length(path) + 1)
    return (F.coalesce(F.conv(F.nullif(path, F.lit("")), 8, 10).cast("long"), F.lit(0)) + first).cast("string")


def node_path(node: Column, max_depth: int) -> Column:
    """The path of an id as text, computed where node_id is. Null for what is no id."""
    if max_depth > LONG_DEPTH:
        return _wide_path(node)
    number = node.try_cast("long")
    # the levels whose first id is not above it, but for the root's
    depth = F.size(F.filter(F.array(*(F.lit((8**d - 1) // 7) for d in range(1, LONG_DEPTH + 1))), lambda first: first <= number))
    first = F.element_at(F.array(*(F.lit((8**d - 1) // 7) for d in range(LONG_DEPTH + 1))), depth + 1)
    return F.when(number == 0, "").when(number > 0, F.lpad(F.conv((number - first).cast("string"), 10, 8), depth, "0"))


def parent_path(path: Column) -> Column:
    """Null for the root."""
    return F.when(F.length(path) > 0, F.substring(path, F.lit(1), F.length(path) - 1))


def content_name(node: Column) -> Column:
    return F.concat(node, F.lit(".pnts"))


def nested_name(node: Column) -> Column:
    return F.concat(F.lit("tileset_node_"), node, F.lit(".json"))


def content_url(node: Column) -> Column:
    return F.concat(F.lit("/content/"), node, F.lit(".pnts"))


def nested_url(node: Column) -> Column:
    return F.concat(F.lit("/tileset/node/"), node, F.lit(".json"))


def etag(node: Column, version: Column) -> Column:
    """In quotes: the id and what changes whenever the node's points do."""
    return F.concat(F.lit('"'), node, F.lit("-"), version.cast("string"), F.lit('"'))
