"""The registered queries in DuckDB's SQL. All numbers are written here once more, so that a wrong one in the library shows."""

from __future__ import annotations

from ..model import LodOptions, World
from ..sources.survey import Survey

EVENTS = LodOptions(World(0.0, 0.0, 0.0, 128.0), grid=8, max_depth=12)
SHALLOW = LodOptions(World(0.0, 0.0, 0.0, 128.0), grid=8, max_depth=3)
CORNER = World(10.0, 10.0, 10.0, 40.0)
EMBEDDINGS = LodOptions(World(-1.0, -1.0, -1.0, 2.0), grid=4, max_depth=20)
WIDE = LodOptions(World(-1_000_000.0, -1_000_000.0, -1_000_000.0, 2_097_152.0), grid=8, max_depth=40)
SURVEY = Survey(400.0, 2.0, 100.0, 4)
#: Fixed values.
METRES_PER_DEGREE = 111_320.0
SEMI_MAJOR_AXIS, ECCENTRICITY_2 = 6_378_137.0, 0.0066943799901413165
WAVES = ((8.0, 0.004, 0.002), (4.0, 0.011, -0.017), (1.5, 0.031, 0.037))
RANGE = 13.5
STOPS = ((0.10, 0.20, 0.80), (0.10, 0.70, 0.30), (0.90, 0.80, 0.10), (0.80, 0.10, 0.10))
DOT, COLUMNS, ROWS = 40.0, 5, 7
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
#: Lines of a vessel's box over its corners' numbers.
LINES = {"deck": (0, 1, 2, 3, 0), "keel": (4, 5, 6, 7, 4), "post0": (0, 4), "post1": (1, 5), "post2": (2, 6), "post3": (3, 7), "bow": (0, 1, 5, 4, 0)}

POINTS = """
pts AS (SELECT event_id AS seq, (user_id % 97)::DOUBLE AS x, (user_id % 89)::DOUBLE AS y, abs(value) % 100 AS z,
               (event_id % 251)::INT AS r, (event_id % 241)::INT AS g, (event_id % 239)::INT AS b FROM events)
"""
VECTORS = "pts AS (SELECT vec_id AS seq, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


#: A third of the points at one place.
EQUAL = """
pts AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 40.25::DOUBLE ELSE (user_id % 97)::DOUBLE END AS x, CASE WHEN event_id % 3 = 0 THEN 41.5::DOUBLE ELSE (user_id % 89)::DOUBLE END AS y,
               CASE WHEN event_id % 3 = 0 THEN 42.75::DOUBLE ELSE abs(value) % 100 END AS z FROM events)
"""


def _number(v: float) -> str:
    return f"({float(v)!r})::DOUBLE"


def _levels(options: LodOptions, points: str = POINTS) -> str:
    """Common tables: pts, lv (a row for each point at each level that it reaches; rn = 1 is accepted) and acc."""
    w, g, inside = options.world, options.grid, []
    for a in "xyz":
        low = getattr(w, a)
        inside.append(f"{a} >= {_number(low)} AND {a} < {_number(low + w.size)}")
    cell = ", ".join(f"floor(({a} - m{a}) / (sz / {g}))" for a in "xyz")
    upper = {a: f"{a} >= m{a} + sz / 2" for a in "xyz"}
    octant = " + ".join(f"CASE WHEN {upper[a]} THEN {1 << k} ELSE 0 END" for k, a in enumerate("xyz"))
    moved = ", ".join(f"CASE WHEN {upper[a]} THEN m{a} + sz / 2 ELSE m{a} END AS m{a}" for a in "xyz")
    rank = f"row_number() OVER (PARTITION BY path, {cell} ORDER BY seq) AS rn"
    return f"""WITH RECURSIVE {points},
lv AS (
  SELECT *, {rank} FROM (SELECT seq, x, y, z, 0 AS d, '' AS path, {_number(w.x)} AS mx, {_number(w.y)} AS my, {_number(w.z)} AS mz, {_number(w.size)} AS sz FROM pts WHERE {' AND '.join(inside)})
  UNION ALL
  SELECT *, {rank} FROM (SELECT seq, x, y, z, d + 1 AS d, path || ({octant})::VARCHAR AS path, {moved}, sz / 2 AS sz FROM lv WHERE rn > 1 AND d < {options.max_depth})
),
acc AS (SELECT *, {', '.join(f'floor(({a} - m{a}) / (sz / {g}))::INT AS c{a}' for a in 'xyz')} FROM lv WHERE rn = 1)"""


def _node_tables(options: LodOptions) -> str:
    w = options.world
    return f"""{_levels(options)},
nd AS (SELECT path, CASE WHEN length(path) > 0 THEN left(path, length(path) - 1) END AS parent_path, d AS depth, mx, my, mz, sz, sum(n)::BIGINT AS point_count
       FROM (SELECT path, d, mx, my, mz, sz, 1 AS n FROM acc UNION ALL SELECT '', 0, {_number(w.x)}, {_number(w.y)}, {_number(w.z)}, {_number(w.size)}, 0)
       GROUP BY ALL),
nodes AS (SELECT *, path NOT IN (SELECT parent_path FROM nd WHERE parent_path IS NOT NULL) AS is_leaf FROM nd)"""


#: The descent itself, one node at a time: the next node while there is exactly one child.
_ROOT = f"""{_node_tables(WIDE)},
one AS (SELECT parent_path, min(path) AS path FROM nodes WHERE parent_path IS NOT NULL GROUP BY parent_path HAVING count(*) = 1),
walk AS (SELECT '' AS path UNION ALL SELECT one.path FROM walk JOIN one ON one.parent_path = walk.path),
top AS (SELECT arg_max(path, length(path)) AS path FROM walk)"""

_ID = "(CASE WHEN path = '' THEN 0 ELSE list_reduce(list_transform(string_split(path, ''), lambda c: c::BIGINT), lambda a, c: a * 8 + c) END + (8 ** length(path) - 1) // 7)::BIGINT::VARCHAR"
_HALF = ("mx + sz / 2", "my + sz / 2", "mz + sz / 2")
_PLACES = "pl AS (SELECT c_custkey AS seq, 10 + (c_custkey % 101) / 1000 AS lon, 55 + (c_custkey % 89) / 1000 AS lat, c_acctbal AS z FROM customer), c AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM pl)"


def _matrix(lat: str, lon: str, height: str) -> list[str]:
    sp, cp, sl, cl = (f"{f}(radians({v}))" for v, f in ((lat, "sin"), (lat, "cos"), (lon, "sin"), (lon, "cos")))
    n = f"({SEMI_MAJOR_AXIS!r}::DOUBLE / sqrt(1 - {ECCENTRICITY_2!r}::DOUBLE * {sp} * {sp}))"
    z, one = "0::DOUBLE", "1::DOUBLE"
    return [f"-{sl}", cl, z, z, f"-{sp} * {cl}", f"-{sp} * {sl}", cp, z, f"{cp} * {cl}", f"{cp} * {sl}", sp, z, f"({n} + {height}) * {cp} * {cl}", f"({n} + {height}) * {cp} * {sl}", f"({n} * {1 - ECCENTRICITY_2!r}::DOUBLE + {height}) * {sp}", one]


def _colour(k: int) -> str:
    steps = [f"WHEN least(floor(s), {len(STOPS) - 2}) = {i} THEN {a[k]!r}::DOUBLE + ({b[k]!r}::DOUBLE - {a[k]!r}::DOUBLE) * (s - {i})" for i, (a, b) in enumerate(zip(STOPS, STOPS[1:]))]
    return f"floor((CASE {' '.join(steps)} END) * 255)::INT AS {'rgb'[k]}"


def _wave(x: str, y: str) -> str:
    return " + ".join(f"{a!r}::DOUBLE * sin({x} * {fx!r}::DOUBLE + {y} * ({fy!r})::DOUBLE)" for a, fx, fy in WAVES)


def _survey() -> str:
    n, m = SURVEY.samples, SURVEY.sweeps
    along = f"((seq // {n}) % {m})"
    line = f"(seq // {n * m})"
    return f"sv AS (SELECT seq, (CASE WHEN {line} % 2 = 1 THEN {m - 1} - {along} ELSE {along} END * {SURVEY.spacing!r}::DOUBLE) AS x, ({line} * {SURVEY.swath!r}::DOUBLE + (seq % {n}) * {SURVEY.spacing!r}::DOUBLE) AS y FROM (SELECT unnest(range({SURVEY.points})) AS seq))"


def _clock(text: str, x: str, y: str) -> str:
    """n, x and y of a time's dots."""
    dots = [(d, k) for d, c in enumerate(text) for k, dot in enumerate(FONT[c].replace(" ", "")) if dot == "#"]
    values = ", ".join(f"({d * COLUMNS * ROWS + k}, {d * (COLUMNS + 1) + k % COLUMNS}, {ROWS - 1 - k // COLUMNS})" for d, k in dots)
    return f"SELECT n::BIGINT AS n, {x} + right_ * {DOT!r}::DOUBLE AS x, {y} + up_ * {DOT!r}::DOUBLE AS y FROM (VALUES {values}) AS dots(n, right_, up_)"


def _corner(f: int, s: int, d: int) -> str:
    (sr, cr), (sp, cp), (sh, ch) = ((f"sin(radians({c}))", f"cos(radians({c}))") for c in ("roll", "pitch", "heading"))
    a, b, c = f"({15 * f}::DOUBLE)", f"({4 * s}::DOUBLE)", f"({2 * d}::DOUBLE)"
    north = f"{ch} * {cp} * {a} + ({ch} * {sp} * {sr} - {sh} * {cr}) * {b} + ({ch} * {sp} * {cr} + {sh} * {sr}) * {c}"
    east = f"{sh} * {cp} * {a} + ({sh} * {sp} * {sr} + {ch} * {cr}) * {b} + ({sh} * {sp} * {cr} - {ch} * {sr}) * {c}"
    up = f"{sp} * {a} - {cp} * {sr} * {b} - {cp} * {cr} * {c}"
    return f"round(x + {east}, 6) AS x, round(y + {north}, 6) AS y, round(z + {up}, 6) AS z"


def _corners() -> str:
    signs = [(f, s, d) for d in (-1, 1) for f, s in ((1, -1), (1, 1), (-1, 1), (-1, -1))]
    return " UNION ALL ".join(f"SELECT vessel, {k} AS corner, {_corner(*c)} FROM p" for k, c in enumerate(signs))


def _lines() -> str:
    """The corners' rows again for each line that passes them, and a line from the centre ahead."""
    passed = ", ".join(f"('{name}', {k}, {c})" for name, path in LINES.items() for k, c in enumerate(path))
    boxes = f"SELECT vessel, name, k, x, y, z FROM ({_corners()}) AS boxes JOIN (VALUES {passed}) AS passed(name, k, corner) USING (corner)"
    return f"{boxes} UNION ALL SELECT vessel, 'ahead', 0, {_corner(0, 0, 0)} FROM p UNION ALL SELECT vessel, 'ahead', 1, {_corner(2, 0, 0)} FROM p"


def _inside(low: float, size: float) -> str:
    return " AND ".join(f"{a} >= {low!r} AND {a} < {low + size!r}" for a in "xyz")


#: Rows and the part of the range of seq that they lie in.
_PARTS = "parts AS (SELECT seq, (seq - (SELECT min(seq) FROM pts)) // (((SELECT max(seq) FROM pts) - (SELECT min(seq) FROM pts)) // {k} + 1) AS batch_id FROM pts)"
_CORNER_OPTIONS = LodOptions(CORNER, 8, 2)
_LATEST = "SELECT * FROM pts ORDER BY seq DESC LIMIT"
_ROOT_CELLS = ", ".join(f"floor({a} / 16)::INT AS c{a}" for a in "xyz")

ORACLE_SQL: dict[str, str] = {
    "lod_accept": f"{_levels(EVENTS)} SELECT seq, d AS depth, path, cx, cy, cz FROM acc",
    "lod_level_histogram": f"{_levels(EVENTS)} SELECT d AS depth, count(*) AS accepted FROM acc GROUP BY d",
    "lod_dropped": f"{_levels(SHALLOW)} SELECT seq, 'max_depth' AS reason, path FROM lv WHERE rn > 1 AND d = {SHALLOW.max_depth}",
    "lod_drop_counts": f"{_levels(_CORNER_OPTIONS)} SELECT 'max_depth' AS reason, count(*) AS n FROM lv WHERE rn > 1 AND d = 2 HAVING count(*) > 0 UNION ALL SELECT 'out_of_bounds', count(*) FROM pts WHERE NOT ({_inside(CORNER.x, CORNER.size)}) HAVING count(*) > 0",
    "lod_embeddings": f"{_levels(EMBEDDINGS, VECTORS)} SELECT seq, d AS depth, path FROM acc",
    "lod_wide_world": f"{_levels(WIDE)} SELECT seq, d AS depth, path FROM acc",
    "lod_summary": f"{_levels(SHALLOW)} SELECT (SELECT count(*) FROM pts) AS points, (SELECT count(*) FROM acc) AS accepted, (SELECT count(DISTINCT path) FROM (SELECT path FROM acc UNION ALL SELECT '')) AS nodes, (SELECT count(*) FROM pts) - (SELECT count(*) FROM acc) AS dropped, (SELECT count(*) FROM pts WHERE NOT ({_inside(0.0, 128.0)})) AS out_of_bounds, (SELECT count(*) FROM lv WHERE rn > 1 AND d = {SHALLOW.max_depth}) AS max_depth",
    "lod_bounds_filter": f"WITH {POINTS} SELECT seq, x, y, z FROM pts WHERE {_inside(CORNER.x, CORNER.size)}",
    "octant_of_point": f"WITH {POINTS} SELECT seq, (CASE WHEN x >= 64 THEN 1 ELSE 0 END + CASE WHEN y >= 64 THEN 2 ELSE 0 END + CASE WHEN z >= 64 THEN 4 ELSE 0 END)::INT AS octant, {', '.join(f'CASE WHEN {a} >= 64 THEN 64.0::DOUBLE ELSE 0.0::DOUBLE END AS child_m{a}' for a in 'xyz')}, 64.0::DOUBLE AS child_sz FROM pts",
    "cell_of_point": f"WITH {POINTS} SELECT seq, {_ROOT_CELLS} FROM pts",
    "occupied_cells": f"WITH {POINTS}, k AS (SELECT seq, {_ROOT_CELLS} FROM pts) SELECT seq FROM k WHERE seq % 2 = 1 AND (cx, cy, cz) IN (SELECT (cx, cy, cz) FROM k WHERE seq % 2 = 0)",
    "node_stats": f"{_node_tables(EVENTS)} SELECT *, sz / {EVENTS.grid} AS geometric_error FROM nodes",
    "node_children": f"{_node_tables(EVENTS)} SELECT p.path, count(*) AS children, sum(c.point_count)::BIGINT AS child_points FROM nodes p JOIN nodes c ON c.parent_path = p.path GROUP BY p.path",
    "node_children_list": f"{_node_tables(EVENTS)} SELECT parent_path AS path, string_agg(path, ',' ORDER BY path) AS children FROM nodes WHERE parent_path IS NOT NULL AND NOT (is_leaf AND point_count = 0) GROUP BY parent_path",
    "leaf_nodes": f"{_node_tables(EVENTS)} SELECT path, depth, point_count FROM nodes WHERE is_leaf",
    "node_order": f"{_node_tables(EVENTS)} SELECT path, row_number() OVER (ORDER BY path) - 1 AS visit FROM nodes",
    "node_ancestors": f"{_node_tables(EVENTS)} SELECT path, depth, point_count FROM nodes WHERE starts_with((SELECT path FROM nodes ORDER BY depth DESC, path LIMIT 1), path)",
    "node_ids": f"{_node_tables(EVENTS)} SELECT path, {_ID} AS id FROM nodes",
    "node_etags": f"{_node_tables(EVENTS)} SELECT path, '\"' || {_ID} || '-' || point_count || '\"' AS etag FROM nodes",
    "logical_root": f"{_ROOT} SELECT path FROM top",
    "emitted_nodes": f"{_ROOT} SELECT nodes.path, point_count FROM nodes, top WHERE starts_with(nodes.path, top.path) AND NOT (is_leaf AND point_count = 0)",
    "trimmed_points": f"{_ROOT} SELECT seq, d AS depth, acc.path FROM acc, top WHERE NOT starts_with(acc.path, top.path)",
    "tile_box": f"{_node_tables(EVENTS)} SELECT path, {', '.join(f'({e})::DOUBLE AS b{k}' for k, e in enumerate([*_HALF, 'sz / 2', '0', '0', '0', 'sz / 2', '0', '0', '0', 'sz / 2']))} FROM nodes",
    "tile_documents": f"{_node_tables(EVENTS)}, named AS (SELECT *, {_ID} AS id FROM nodes) SELECT path, 'tileset_node_' || id || '.json' AS file, 'content/' || id || '.pnts' AS content, 'ADD' AS refine, sz / {EVENTS.grid} AS geometric_error, coalesce((SELECT string_agg('tileset_node_' || c.id || '.json', ',' ORDER BY c.path) FROM named c WHERE c.parent_path = named.path), '') AS children FROM named",
    "rtc_offsets": f"{_levels(EVENTS)} SELECT seq, {', '.join(f'round(({a} - (m{a} + sz / 2))::FLOAT::DOUBLE, 4) AS d{a}' for a in 'xyz')} FROM acc",
    "tile_bytes": f"{_node_tables(EVENTS)} SELECT path, ((point_count * 15 + 7) // 8 * 8)::BIGINT AS body_bytes FROM nodes",
    "geodetic_centroid": f"WITH {_PLACES} SELECT round(lon0, 6) AS lon0, round(lat0, 6) AS lat0 FROM c",
    "enu_project": f"WITH {_PLACES} SELECT seq, round((lon - lon0) * {METRES_PER_DEGREE!r}::DOUBLE * cos(radians(lat0)), 4) AS x, round((lat - lat0) * {METRES_PER_DEGREE!r}::DOUBLE, 4) AS y, round(z, 4) AS z FROM pl, c",
    "ecef_matrix": f"WITH {_PLACES} SELECT seq, {', '.join(f'round({e}, {3 if k in (12, 13, 14) else 6}) AS m{k}' for k, e in enumerate(_matrix('lat', 'lon', 'z')))} FROM pl",
    "ecef_points": f"WITH {POINTS} SELECT seq, {', '.join(f'round({m[0]} * x + {m[1]} * y + {m[2]} * z + {m[3]}, 3) AS ecef_{a}' for a, m in zip('xyz', ([_matrix('55.0::DOUBLE', '10.0::DOUBLE', '0')[4 * k + r] for k in range(4)] for r in range(3))))} FROM pts",
    "wave_surface": f"WITH {_survey()} SELECT seq, x, y, round({_wave('x', 'y')}, 6) AS z FROM sv",
    "elevation_colour": f"WITH ramp AS (SELECT id, id * 0.0773::DOUBLE + 0.0131::DOUBLE AS z FROM (SELECT unnest(range(-200, 201)) AS id)), sc AS (SELECT id, greatest(0, least(1, (z + {RANGE!r}::DOUBLE) / {2 * RANGE!r}::DOUBLE)) * {len(STOPS) - 1} AS s FROM ramp) SELECT id, {', '.join(map(_colour, range(3)))} FROM sc",
    "hex_colour": "SELECT p_partkey, ((p_partkey * 7919 % 16777216) // 65536)::INT AS r, ((p_partkey * 7919 % 65536) // 256)::INT AS g, (p_partkey * 7919 % 256)::INT AS b FROM part",
    "survey_batches": f"SELECT (seq // {SURVEY.samples}) // {SURVEY.sweeps_per_batch} AS batch, count(*) AS points FROM (SELECT unnest(range({SURVEY.points})) AS seq) GROUP BY 1",
    "recent_points": f"WITH {POINTS} {_LATEST} 3000",
    "recent_centroid": f"WITH {POINTS}, n AS ({_LATEST} 3000) SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z) + 30, 6) AS z FROM n",
    "recent_with_clock": f"WITH {POINTS}, n AS ({_LATEST} 500), o AS (SELECT avg(x) AS ox, avg(y) AS oy, avg(z) + 30 AS oz FROM n), k AS ({_clock('12:34:56', '0', '0')}) SELECT 'point' AS kind, seq AS n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, r, g, b FROM n UNION ALL SELECT 'clock', n, round(ox + x, 6), round(oy + y, 6), round(oz, 6), 255, 0, 255 FROM k, o",
    "clock_digits": f"SELECT *, 30.0::DOUBLE AS z FROM ({_clock('09:41:27', '1000.0::DOUBLE', '2000.0::DOUBLE')})",
    "batch_numbers": "SELECT batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2500 AS batch FROM orders) GROUP BY batch",
    "text_parse": "SELECT o_orderkey AS seq, o_orderkey::DOUBLE AS x, o_totalprice::DECIMAL(18,2)::DOUBLE AS y, -1.5::DOUBLE AS z, (o_orderkey % 256)::INT AS r, 7 AS g, 255 AS b FROM orders WHERE o_orderkey % 7 <> 0",
    "vessel_corners": f"WITH p AS (SELECT n_nationkey AS vessel, {', '.join(f'(n_nationkey * {n})::DOUBLE AS {c}' for c, n in zip(('x', 'y', 'z', 'roll', 'pitch', 'heading'), (10, 20, 1, 3, -2, 15)))} FROM nation) {_corners()}",
    "vessel_edges": f"WITH p AS (SELECT n_nationkey AS vessel, {', '.join(f'(n_nationkey * {n})::DOUBLE AS {c}' for c, n in zip(('x', 'y', 'z', 'roll', 'pitch', 'heading'), (10, 20, 1, 3, -2, 15)))} FROM nation) {_lines()}",
    "lod_level_loop": f"{_levels(EVENTS)} SELECT seq, d AS depth, path, cx, cy, cz FROM acc",
    "lod_first_levels": f"{_levels(WIDE)} SELECT seq, d AS depth, path FROM acc",
    "lod_incremental": f"{_levels(EVENTS)} SELECT seq, d AS depth, path, cx, cy, cz FROM acc",
    "ingest_progress": f"{_levels(EVENTS)}, {_PARTS.format(k=2)}, n AS (SELECT batch_id, count(*) AS points, count(*) FILTER (seq IN (SELECT seq FROM acc)) AS accepted FROM parts GROUP BY batch_id), born AS (SELECT batch_id, count(*) AS nodes FROM (SELECT path, min(batch_id) AS batch_id FROM acc JOIN parts USING (seq) WHERE path <> '' GROUP BY path) GROUP BY batch_id) SELECT batch_id::BIGINT AS batch_id, (sum(points) OVER w)::BIGINT AS points, (sum(accepted) OVER w)::BIGINT AS accepted, (sum(points - accepted) OVER w)::BIGINT AS dropped, (sum(coalesce(nodes, 0)) OVER w + 1)::BIGINT AS nodes FROM n LEFT JOIN born USING (batch_id) WINDOW w AS (ORDER BY batch_id)",
    "commit_cadence": f"{_levels(EVENTS)}, {_PARTS.format(k=9)}, n AS (SELECT batch_id, count(*) AS points, count(*) FILTER (seq IN (SELECT seq FROM acc)) AS accepted FROM parts GROUP BY batch_id), run AS (SELECT 0::BIGINT AS batch_id, points AS waits, points >= 3000 AS commits, 0 AS grp FROM n WHERE batch_id = 0 UNION ALL SELECT n.batch_id, CASE WHEN run.commits THEN n.points ELSE run.waits + n.points END, CASE WHEN run.commits THEN n.points ELSE run.waits + n.points END >= 3000, run.grp + run.commits::INT FROM run JOIN n ON n.batch_id = run.batch_id + 1) SELECT max(batch_id)::BIGINT AS batch_id, sum(points)::BIGINT AS points, sum(accepted)::BIGINT AS accepted FROM run JOIN n USING (batch_id) GROUP BY grp",
    "text_stream": f"{_levels(EVENTS)} SELECT acc.x, acc.y, acc.z, pts.r, pts.g, pts.b, acc.d AS depth, acc.path FROM acc JOIN pts USING (seq)",
    "keyed_stream": f"{_levels(EVENTS)} SELECT seq, d AS depth, path, cx, cy, cz FROM acc",
    "stream_progress": f"WITH {POINTS}, {_PARTS.format(k=3)} SELECT batch_id::BIGINT AS batch_id, (sum(count(*)) OVER (ORDER BY batch_id))::BIGINT AS points FROM parts GROUP BY batch_id",
    "stored_recent": f"WITH {POINTS} {_LATEST} 700",
    "record_files": f"WITH {POINTS} SELECT x, y, z, r, g, b FROM pts",
    "tile_points": f"{_node_tables(EVENTS)}, named AS (SELECT path, point_count, {_ID} || '.pnts' AS tile FROM nodes) SELECT tile, point_count AS points, round(acc.x, 3) AS x, round(acc.y, 3) AS y, round(acc.z, 3) AS z, r, g, b FROM acc JOIN named USING (path) JOIN pts USING (seq)",
    "exported_documents": f"{_node_tables(EVENTS)}, named AS (SELECT *, CASE WHEN path = '' THEN 'tileset.json' ELSE 'tileset_node_' || {_ID} || '.json' END AS file FROM nodes) SELECT file, (sz / {EVENTS.grid})::VARCHAR AS error_text, (SELECT count(*) FROM nodes c WHERE c.parent_path = named.path) AS children FROM named",
    "export_stats": f"{_ROOT} SELECT count(*) AS tiles, count(*) - 1 AS documents FROM nodes, top WHERE starts_with(nodes.path, top.path)",
    "node_paths": f"{_node_tables(EVENTS)} SELECT {_ID} AS id, path FROM nodes",
    "text_cartesian": "SELECT o_orderkey::DOUBLE AS x, o_totalprice::DECIMAL(18,2)::DOUBLE AS y, -1.5::DOUBLE AS z, (o_orderkey % 256)::INT AS r, 7 AS g, 255 AS b FROM orders",
    "text_geodetic": f"WITH {_PLACES} SELECT round((lon - lon0) * {METRES_PER_DEGREE!r}::DOUBLE * cos(radians(lat0)), 4) AS x, round((lat - lat0) * {METRES_PER_DEGREE!r}::DOUBLE, 4) AS y, round(z, 4) AS z, 1 AS r, 2 AS g, 3 AS b FROM pl, c",
    "leaf_ancestors": f"{_node_tables(EVENTS)} SELECT leaf.path AS of, n.path, n.point_count FROM nodes leaf JOIN nodes n ON starts_with(leaf.path, n.path) WHERE leaf.is_leaf",
    "subtree_totals": f"{_node_tables(EVENTS)} SELECT n.path, n.point_count, sum(b.point_count)::BIGINT AS subtree_points, count(*) AS subtree_nodes, max(b.depth) AS deepest FROM nodes n JOIN nodes b ON starts_with(b.path, n.path) GROUP BY n.path, n.point_count",
    "lod_equal_points": f"{_levels(EVENTS, EQUAL)} SELECT seq, 'accepted' AS state, path FROM acc UNION ALL SELECT seq, 'max_depth', path FROM lv WHERE rn > 1 AND d = {EVENTS.max_depth} UNION ALL SELECT seq, 'out_of_bounds', '' FROM pts WHERE NOT ({_inside(0.0, 128.0)})",
    "lod_many_batches": f"{_levels(EVENTS)} SELECT seq, d AS depth, path, cx, cy, cz FROM acc",
    "nodes_by_deltas": f"{_node_tables(EVENTS)} SELECT path, parent_path, depth, point_count, is_leaf FROM nodes",
    "replaced_node": f"{_levels(EVENTS)} SELECT seq, d AS depth, path FROM acc WHERE path <> '1' AND (path <> '0' OR seq % 4 = 0)",
    "replaced_counts": f"{_levels(EVENTS)} SELECT path, d AS depth, count(*) AS points FROM acc WHERE path <> '1' AND (path <> '0' OR seq % 4 = 0) GROUP BY path, d",
    "stored_dropped": f"{_levels(_CORNER_OPTIONS, POINTS.replace('event_id AS seq', 'event_id + CASE WHEN event_id % 100 < 50 THEN 0 ELSE 1000000000 END AS seq'))} SELECT 'max_depth' AS reason, count(*) AS n FROM lv WHERE rn > 1 AND d = 2 HAVING count(*) > 0 UNION ALL SELECT 'out_of_bounds', count(*) FROM pts WHERE NOT ({_inside(CORNER.x, CORNER.size)}) HAVING count(*) > 0",
    "stored_node": f"{_levels(EVENTS)} SELECT acc.seq, acc.x, acc.y, acc.z, r, g, b FROM acc JOIN pts ON pts.seq = acc.seq WHERE acc.path = '0'",
}
