"""Queries: least-cost paths, their steps, and the transitions between areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import graph, paths, routes
from terralith.operators.scratch import settle
from terralith.plans.registry import query
from terralith.plans.selection import _DIRS

#: Steps between ways: by road 50, else by the far side's terrain; a bridge joins two bridge hexes 23 ids apart.
_STEPS = f"""st AS (SELECT a.id AS src, b.id AS dst, dir, CASE WHEN (a.road >> dir) & 1 = 1 THEN 50 ELSE 100 + b.terrain * 10 END AS cost
    FROM ways a CROSS JOIN {_DIRS} JOIN ways b ON b.col = a.col + dc AND b.row = a.row + CASE WHEN a.col % 2 = 0 THEN de ELSE dod END
    UNION ALL SELECT a.id, b.id, 6, 500 FROM ways a JOIN ways b ON b.id = a.id + 23 AND a.id % 46 = 0 AND a.kind = 5 AND b.kind = 5
    UNION ALL SELECT b.id, a.id, 6, 500 FROM ways a JOIN ways b ON b.id = a.id + 23 AND a.id % 46 = 0 AND a.kind = 5 AND b.kind = 5)"""
_CENTRES = "ce AS (SELECT area, arg_min(id, (abs(col % 13 - 6) + abs(row % 12 - 6)) * 1000000000 + id) AS id FROM ways GROUP BY area)"


def _steps(ways, shape=None, band=False):
    """src, dst, dir, cost, src_block, dst_block; band: only steps inside a band of rows."""
    near = graph.hex_edges(ways.select("id", "col", "row", "terrain", "road"))
    if band:
        near = near.filter(F.floor(F.col("row") / 12) == F.floor(F.col("nrow") / 12))
    cost = F.when(F.expr("(road >> dir) & 1 = 1"), 50).otherwise(100 + F.col("n_terrain") * 10).cast("bigint")
    hexes = near.select("src", "dst", "dir", cost.alias("cost"), paths.block_of("col", "row", shape).alias("src_block"), paths.block_of("ncol", "nrow", shape).alias("dst_block"))
    ends = ways.filter("kind = 5").select("id", paths.block_of("col", "row", shape).alias("block"), F.col("band").alias("in"))
    a, b = (ends.select(F.col("id").alias(n), F.col("block").alias(f"{n}_block"), F.col("in").alias(f"{n}_in")) for n in ("src", "dst"))
    bridge = a.filter("src % 46 = 0").withColumn("dst", F.col("src") + 23).join(b, "dst")
    bridge = (bridge.filter("src_in = dst_in") if band else bridge).select("src", "dst", F.lit(6).alias("dir"), F.lit(500).cast("bigint").alias("cost"), "src_block", "dst_block")
    back = bridge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dir", "cost", F.col("dst_block").alias("src_block"), F.col("src_block").alias("dst_block"))
    return settle(hexes.union(bridge).union(back))


def _nodes(ways, area="area", shape=None):
    return ways.select("id", "col", "row", F.col(area).cast("bigint").alias("area"), "shut", "kind", ((F.col("kind") <= 1) & ~F.col("shut")).alias("open"), paths.block_of("col", "row", shape).alias("block"))


def _centres(ways):
    order = (F.abs(F.col("col") % 13 - 6) + F.abs(F.col("row") % 12 - 6)) * 1000000000 + F.col("id")
    best = ways.groupBy("area").agg(F.min_by(F.struct("id", "col", "row", "kind"), order).alias("c"))
    return best.select(F.col("area").cast("bigint").alias("area"), "c.id", "c.col", "c.row", (F.col("c.kind") == 1).alias("sea")).withColumn("block", paths.block_of("col", "row"))


_REACH = f"""{_STEPS}, {_CENTRES},
    s(area, id, cost) USING KEY (area, id) AS (SELECT area, id, CAST(0 AS BIGINT) FROM ce UNION SELECT * FROM (SELECT s.area, st.dst, min(s.cost + st.cost) FROM s JOIN ways h ON h.id = s.id JOIN st ON st.src = s.id
        LEFT JOIN recurring.s k ON k.area = s.area AND k.id = st.dst WHERE (h.area = s.area OR h.kind > 1 OR h.shut) AND (k.cost IS NULL OR s.cost + st.cost < k.cost) GROUP BY s.area, st.dst))"""


@query(f"WITH RECURSIVE {_REACH} SELECT s.area, h.area AS n_area, s.id, s.cost FROM s JOIN ways h ON h.id = s.id WHERE h.area <> s.area AND h.kind <= 1 AND NOT h.shut")
def border_segments(v):
    """The open hexes of other areas that each area's search from its centre meets, with their costs."""
    w = v("ways")
    nodes = _nodes(w)
    return routes.segments(paths.block_graph(_steps(w), nodes), nodes, _centres(w))[0]


@query(f"WITH RECURSIVE {_REACH} SELECT s.area, max(s.cost) AS dearest FROM s JOIN ways h ON h.id = s.id WHERE h.area = s.area AND h.kind <= 1 AND NOT h.shut GROUP BY s.area")
def area_reach(v):
    """The largest cost at which an area's search from its centre meets an open hex of its own."""
    w = v("ways")
    nodes = _nodes(w)
    return routes.segments(paths.block_graph(_steps(w), nodes), nodes, _centres(w))[1]


def _asked(ways, shape):
    """A path for each fortieth hex, to another place in its band of rows."""
    target = (F.col("col") * 7 + 13) % 50 + 50 * (F.col("row") - F.col("row") % 12 + (F.col("row") * 5 + 3) % 12)
    return ways.filter("id % 40 = 7").select(F.col("id").alias("query"), F.col("id").alias("start"), paths.block_of("col", "row", shape).alias("block"), target.cast("bigint").alias("target"), F.col("band").cast("bigint").alias("area"))


def _paths(ways):
    """Blocks hold whole bands, and as the queries stay in theirs, no steps between bands."""
    shape = (paths.BLOCK, max(12, paths.BLOCK // 12 * 12))
    spots = ways.select("id", (F.col("col") * 1.5).alias("x"), (F.col("row") * 1.75 + F.col("col") % 2 * 0.875).alias("y"))
    steps = _steps(ways, shape, band=True)
    nodes = _nodes(ways, "band", shape).withColumns({"x": F.col("col") * 1.5, "y": F.col("row") * 1.75 + F.col("col") % 2 * 0.875})
    return paths.find_paths(paths.block_graph(steps, nodes), steps, _asked(ways, shape), spots)


_OFF = "dy * dy + dx * dx"
_PATHS = f"""{_STEPS}, sp AS (SELECT id, shut, band, kind, CAST(col * 1.5e0 AS FLOAT) AS x, CAST(row * 1.75e0 + col % 2 * 0.875e0 AS FLOAT) AS y FROM ways),
    q AS (SELECT id AS query, id AS start, band, (col * 7 + 13) % 50 + 50 * (row - row % 12 + (row * 5 + 3) % 12) AS target FROM ways WHERE id % 40 = 7),
    p(query, id, cost) USING KEY (query, id) AS (SELECT query, start, CAST(0 AS BIGINT) FROM q UNION SELECT * FROM (SELECT p.query, st.dst, min(p.cost + st.cost) FROM p JOIN q ON q.query = p.query JOIN st ON st.src = p.id JOIN sp n ON n.id = st.dst
        LEFT JOIN recurring.p k ON k.query = p.query AND k.id = st.dst WHERE p.id <> q.target AND n.band = q.band AND (NOT n.shut OR n.id = q.target) AND (k.cost IS NULL OR p.cost + st.cost < k.cost) GROUP BY p.query, st.dst)),
    ln AS (SELECT q.query, q.target, a.x AS ax, a.y AS ay, b.x - a.x AS fx, b.y - a.y AS fy FROM q JOIN sp a ON a.id = q.start JOIN sp b ON b.id = q.target),
    l1 AS (SELECT *, CAST(sqrt(fy * fy + fx * fx) AS FLOAT) AS size FROM ln), l2 AS (SELECT *, CASE WHEN size > 0 THEN CAST(CAST(1 AS FLOAT) / size AS FLOAT) END AS inv FROM l1),
    o1 AS (SELECT p.query, p.id, p.cost, l.target, ax, ay, fx, fy, s.x, s.y, size, (s.y - ay) * inv * fy * inv + (s.x - ax) * inv * fx * inv AS u FROM p JOIN l2 l ON l.query = p.query JOIN sp s ON s.id = p.id),
    o2 AS (SELECT *, CAST(CASE WHEN size <= 0 OR u < 0 THEN 0 WHEN u >= 1 THEN 1 ELSE u END AS FLOAT) AS t FROM o1), o3 AS (SELECT *, fy * t + ay - y AS dy, fx * t + ax - x AS dx FROM o2),
    b AS (SELECT f.query, st.dst AS id, f.id AS before FROM o3 f JOIN st ON st.src = f.id AND f.id <> f.target JOIN p ON p.query = f.query AND p.id = st.dst AND p.cost = f.cost + st.cost
        QUALIFY row_number() OVER (PARTITION BY f.query, st.dst ORDER BY f.cost, {_OFF}, f.id) = 1),
    r(query, back, id) AS (SELECT q.query, CAST(0 AS BIGINT), q.target FROM q JOIN p ON p.query = q.query AND p.id = q.target UNION ALL SELECT r.query, r.back + 1, b.before FROM r JOIN b ON b.query = r.query AND b.id = r.id),
    pa AS (SELECT r.query, max(back) OVER (PARTITION BY r.query) - back AS nth, r.id, p.cost FROM r JOIN p ON p.query = r.query AND p.id = r.id)"""


@query(f"WITH RECURSIVE {_PATHS} SELECT query, nth, id, cost FROM pa")
def path_steps(v):
    """The hexes of least-cost paths inside one band of rows, around shut hexes, ties by the line from start to target."""
    return _paths(v("ways"))


@query(f"""WITH RECURSIVE {_PATHS}, e AS (SELECT query, max(nth) AS last FROM pa GROUP BY query), k AS (SELECT pa.*, sp.kind, last FROM pa JOIN sp ON sp.id = pa.id JOIN e ON e.query = pa.query),
    w(query, i, taken, n) AS (SELECT query, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM e
      UNION ALL SELECT w.query, CASE WHEN b.kind = 5 THEN i + 3 ELSE i + 1 END, CASE WHEN b.kind = 5 THEN taken + d.cost - f.cost ELSE taken END, CASE WHEN b.kind = 5 THEN n + 1 ELSE n END
        FROM w JOIN k a ON a.query = w.query AND a.nth = w.i JOIN k b ON b.query = w.query AND b.nth = w.i + 1 JOIN k d ON d.query = w.query AND d.nth = least(w.i + 3, a.last)
        JOIN k f ON f.query = w.query AND f.nth = least(w.i + CASE WHEN a.kind = 6 THEN 1 ELSE 0 END, a.last))
    SELECT k.query, CAST(k.cost - taken + 500 * n AS BIGINT) AS cost, n AS crossings FROM k JOIN (SELECT query, max(taken) AS taken, max(n) AS n FROM (SELECT query, arg_max(taken, i) AS taken, arg_max(n, i) AS n FROM w GROUP BY query) GROUP BY query) t ON t.query = k.query WHERE k.nth = k.last""")
def path_costs(v):
    """Costs of these paths with 500 for each crossing by bridge."""
    w = v("ways")
    return paths.bridge_costs(_paths(w), w.select("id", "kind"))


def _transitions(ways):
    nodes, steps, centres = settle(_nodes(ways)), _steps(ways), settle(_centres(ways))
    border = settle(routes.segments(paths.block_graph(steps, nodes), nodes, centres)[0])
    owner = ways.select(F.col("id").alias("dst"), (F.col("area") * 3 + F.col("owner")).alias("_owner"), "owner")
    beside = steps.filter("dir < 6").join(owner.filter("owner >= 0"), "dst").groupBy(F.col("src").alias("id")).agg(F.min_by("_owner", "dir").alias("beside"))
    comp = graph.label_in_blocks(nodes, steps)
    full = nodes.join(beside, "id", "left").join(comp, "id").withColumns({"beside": F.coalesce("beside", F.lit(-1)), "x": F.col("col") * 1.5, "y": F.col("row") * 1.75 + F.col("col") % 2 * 0.875})
    return routes.transitions(settle(full.drop("open", "block")), steps, border, centres, tolerance=0.875), border, nodes, steps


@query()
def transition_points(v):
    """Transitions of all pairs of areas, numbered within each area; compared with a serial form on the whole map in the tests."""
    found, border, _, _ = _transitions(v("ways"))
    return routes.numbered(found, border)


@query()
def area_cost_tables(v):
    """Costs inside each area between its sides of all transitions; compared with a serial form in the tests."""
    found, border, nodes, steps = _transitions(v("ways"))
    points = routes.numbered(found, border).select("area", F.col("p").alias("id")).distinct()
    a, b = (nodes.select(F.col("id").alias(n), F.col("area").alias(k), *extra) for n, k, extra in (("src", "area", ()), ("dst", "n_area", ("shut",))))
    return routes.area_costs(steps.select("src", "dst", "cost").join(a, "src").join(b, "dst"), points)
