"""Queries: hex rules, graphs, rasters, merges, journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import graph, journal, merge, paths, raster, routes, spatial, validator
from terralith.plans.registry import query
from terralith.plans.selection import _DIST, NEIGHBOURS

EDGES = f"e AS (SELECT a.id AS src, a.dir, h.id AS dst, a.cat AS cat, h.cat AS n_cat, h.terrain AS n_terrain, a.terrain, a.road, a.impassable, h.impassable AS n_impassable FROM ({NEIGHBOURS}) a JOIN hexes h ON h.col = a.ncol AND h.row = a.nrow)"
AROUND = f"{EDGES}, n AS (SELECT h.id, h.cat, count(*) FILTER (n_cat = h.cat) AS same, count(*) FILTER (n_cat = 1) AS seas, count(*) FILTER (n_cat = 2) AS beaches, count(*) FILTER (n_cat IN (5, 6, 7, 8)) AS rivers FROM hexes h LEFT JOIN e ON e.src = h.id GROUP BY h.id, h.cat)"
_GOOD = ", ".join(f"'{g}'" for g in validator.GOOD_CROSSINGS)
CROSS = f"""x AS (SELECT h.id, coalesce(list(dir ORDER BY dir) FILTER (n_cat IN (5, 6, 7, 8)), []) AS rv, coalesce(list(dir ORDER BY dir) FILTER (n_cat = 9), []) AS rd FROM hexes h JOIN e ON e.src = h.id WHERE h.cat = 8 GROUP BY h.id),
    y AS (SELECT id, rv, rd, unnest(CASE WHEN len(rv) = 0 THEN [0] ELSE rv END) AS t FROM x),
    z AS (SELECT id, min(array_to_string(list_sort(list_transform(rv, lambda d: (d - t + 6) % 6)), ',') || '|' || array_to_string(list_sort(list_transform(rd, lambda d: (d - t + 6) % 6)), ',')) AS form FROM y GROUP BY id)"""
RULES = """SELECT id, 'line.thick' AS code FROM n WHERE cat IN (3, 4, 5, 6, 7, 8, 9, 11) AND same >= 4 UNION ALL SELECT id, 'coast.missing_ring' FROM n WHERE cat = 10 AND seas > 0
    UNION ALL SELECT id, 'coast.cliff_end' FROM n WHERE cat = 3 AND beaches > 0 OR cat = 4 AND beaches = 0
    UNION ALL SELECT id, 'river.ends' FROM n WHERE cat = 6 AND rivers <> 1 OR cat = 7 AND (rivers <> 1 OR seas = 0) OR cat = 5 AND rivers < 1"""
KEY = "SELECT h.id, h.cat, h.cat * 2985984 + coalesce(CAST(sum(n_cat * CAST(pow(12, 5 - dir) AS BIGINT)) AS BIGINT), 0) AS pattern FROM hexes h LEFT JOIN e ON e.src = h.id GROUP BY h.id, h.cat"


@query(f"WITH {AROUND}, {CROSS} {RULES} UNION ALL SELECT id, 'river.crossing' FROM (SELECT h.id, coalesce(form, '|') AS form FROM hexes h LEFT JOIN z ON z.id = h.id WHERE cat = 8) WHERE form NOT IN ({_GOOD})")
def tile_rules(v):
    return validator.rules(v("hexes")).select("id", "code")


@query(f"WITH {EDGES}, k AS ({KEY}) SELECT id, cat, pattern FROM k")
def pattern_keys(v):
    return graph.pattern_key(v("hexes")).select("id", "cat", "pattern")


@query(f"WITH {EDGES}, k AS ({KEY}) SELECT id, 'pattern.unseen' AS code FROM k WHERE cat IN (2, 3, 4, 5, 6, 7, 8) AND pattern NOT IN (SELECT pattern FROM k WHERE id % 3 = 0)")
def unseen_patterns(v):
    keys = graph.pattern_key(v("hexes"))
    known = keys.filter("id % 3 = 0").select("pattern").distinct()
    return keys.filter(F.col("cat").isin(*validator.PATTERNED)).join(known, "pattern", "left_anti").select("id", F.lit("pattern.unseen").alias("code"))


@query("SELECT cat, count(*) AS hexes FROM hexes WHERE cat NOT IN (SELECT kind FROM ways) GROUP BY cat")
def unused_sets(v):
    return validator.unused_sets(v("hexes"), v("ways").select(F.col("kind").alias("cat")))


@query("SELECT x // 2 AS c, y // 2 AS r FROM raster GROUP BY 1, 2 HAVING min(v % 4) <> max(v % 4)")
def mixed_hexes(v):
    return validator.mixed_hexes(v("raster").selectExpr("x div 2 as c", "y div 2 as r", "v % 4 as rgb"))


@query("SELECT count(*) AS differ FROM (SELECT x // 4 AS x, y // 4 AS y, v FROM raster WHERE x % 4 = 0 AND y % 4 = 0) f FULL OUTER JOIN (SELECT x // 4 AS x, y // 4 AS y, CASE WHEN x % 8 = 0 THEN v ELSE v + 1 END AS v FROM raster WHERE x % 4 = 0 AND y % 4 = 0) q ON q.x = f.x AND q.y = f.y WHERE q.v IS DISTINCT FROM f.v")
def climate_quarter(v):
    r = v("raster")
    quarter = r.filter("x % 4 = 0 and y % 4 = 0").selectExpr("x div 4 as x", "y div 4 as y", "case when x % 8 = 0 then v else v + 1 end as v")
    return validator.quarter_mismatches(r, quarter)


@query("SELECT climate, count(*) AS n FROM (SELECT coalesce(p.ordinal, 0) AS climate FROM (SELECT v % 50 * 7919 % 16777216 AS rgb FROM raster) r LEFT JOIN palette p ON p.rgb = r.rgb) GROUP BY climate")
def climate_index(v):
    return validator.climate_index(v("raster").selectExpr("v % 50 * 7919 % 16777216 as rgb"), v("palette")).groupBy("climate").agg(F.count("*").alias("n"))


@query(f"WITH {AROUND}, f AS ({RULES}), ring AS (SELECT dst AS id FROM e WHERE src % 37 = 0 UNION SELECT id FROM hexes WHERE id % 37 = 0) SELECT id, code FROM f WHERE id IN (SELECT id FROM ring)")
def scoped_rules(v):
    h = v("hexes")
    found = validator.rules(h).filter("code <> 'river.crossing'").select("id", "code")
    return validator.scoped(found, h, h.filter("id % 37 = 0"))


@query(f"WITH {EDGES}, c AS (SELECT src AS id, n_cat, n_terrain AS v, dir FROM e WHERE n_cat = 10), g AS (SELECT id, v, count(*) AS n, min(dir) AS d FROM c GROUP BY id, v) SELECT h.id, coalesce(k.v, -1) AS land FROM hexes h LEFT JOIN (SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, d) AS k FROM g) WHERE k = 1) k ON k.id = h.id")
def surrounding_land(v):
    return validator.surrounding_land(v("hexes").withColumn("value", F.col("terrain")))


@query()
def fix_scores(v):
    """Up to two candidates for every finding, scored on their windows; compared with a brute-force form in the tests."""
    h = v("hexes")
    found = validator.rules(h).select("id", "code")
    return validator.score_fixes(h, validator.fix_candidates(found, h))


@query(f"WITH {EDGES} SELECT src, dst, dir, CASE WHEN (road >> dir) & 1 = 1 THEN 50 ELSE 100 + n_terrain * 10 END AS cost FROM e WHERE NOT impassable AND NOT n_impassable AND abs(terrain - n_terrain) <= 2")
def movement_edges(v):
    spark = v("region").sparkSession
    allowed = spark.range(5).select(F.col("id").alias("t1")).crossJoin(spark.range(5).select(F.col("id").alias("t2"))).filter("abs(t1 - t2) <= 2")
    return graph.movement_edges(v("hexes"), allowed).select("src", "dst", F.col("dir").cast("int").alias("dir"), "cost")


@query(f"""WITH {EDGES}, d AS (SELECT DISTINCT src, dst FROM e WHERE cat = n_cat) SELECT count(DISTINCT least(src, dst) * 1000000 + greatest(src, dst)) AS links FROM d""")
def same_links(v):
    h = v("hexes")
    e = graph.hex_edges(h.select("id", "col", "row", "cat"), F.col("cat") == F.col("n_cat"))
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count("*").alias("links"))


@query(f"""WITH RECURSIVE {EDGES}, l(id, comp) USING KEY (id) AS (SELECT id, id FROM hexes UNION SELECT * FROM (SELECT e.dst, min(l.comp) AS c FROM l JOIN e ON e.src = l.id AND e.cat = e.n_cat JOIN recurring.l k ON k.id = e.dst AND l.comp < k.comp GROUP BY e.dst))
    SELECT comp, count(*) AS size FROM l GROUP BY comp""")
def hex_components(v):
    """Components of equal category and their sizes."""
    return graph.hex_components(v("hexes").select("id", "col", "row", "cat"), "cat").groupBy("comp").agg(F.count("*").alias("size"))


@query("""WITH RECURSIVE c AS (SELECT id, col AS x, row AS y FROM hexes WHERE NOT EXISTS (SELECT 1 FROM areas WHERE col BETWEEN min_x AND max_x AND row BETWEEN min_y AND max_y)),
    e AS (SELECT a.id AS src, b.id AS dst FROM c a, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy) JOIN c b ON b.x = a.x + dx AND b.y = a.y + dy),
    l(id, comp) USING KEY (id) AS (SELECT id, id FROM c UNION SELECT * FROM (SELECT e.dst, min(l.comp) AS m FROM l JOIN e ON e.src = l.id JOIN recurring.l k ON k.id = e.dst AND l.comp < k.comp GROUP BY e.dst))
    SELECT comp, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, bool_or(x < 2 OR y < 2 OR x >= 48 OR y >= (SELECT max(row) - 1 FROM hexes)) AS edge FROM l JOIN c ON c.id = l.id GROUP BY comp""")
def tile_holes(v):
    """Holes of every cell that no area covers, on a map as high as the table."""
    h = v("hexes")
    cells = spatial.uncovered(h.selectExpr("id", "col as x", "row as y"), v("areas"))
    return graph.holes(cells.select("id", "x", "y"), 50, (h.agg(F.max("row")).first()[0] or 0) + 1)


@query(f"""WITH RECURSIVE {EDGES}, l AS (SELECT id FROM hexes WHERE col = 5 AND row = 5 UNION SELECT e.dst FROM l JOIN e ON e.src = l.id WHERE e.cat = e.n_cat) SELECT id FROM l""")
def flood_fill(v):
    return graph.flood(v("hexes"), 5, 5, "cat").select("id")


_SEARCH = """SELECT * FROM (SELECT p.start, m.{far}, min(p.cost + m.cost) FROM p JOIN m ON m.{near} = p.id LEFT JOIN recurring.p k ON k.start = p.start AND k.id = m.{far}
    WHERE k.cost IS NULL OR p.cost + m.cost < k.cost GROUP BY p.start, m.{far})"""


@query(f"""WITH RECURSIVE {EDGES}, m AS (SELECT src, dst, CASE WHEN (road >> dir) & 1 = 1 THEN 5 ELSE 10 + n_terrain END AS cost FROM e WHERE NOT impassable AND NOT n_impassable),
    p(start, id, cost) USING KEY (start, id) AS (SELECT 1, id, CAST(0 AS BIGINT) FROM hexes WHERE id = 1 AND NOT impassable UNION {_SEARCH.format(far="dst", near="src")}) SELECT start, id, cost FROM p""")
def shortest_paths(v):
    """Costs over passable hexes from hex 1, by blocks."""
    h = v("hexes").filter("not impassable")
    shape = paths.long_blocks(h)
    return _searched(shape, h, _steps(shape, h, F.when(F.expr("(road >> dir) & 1 = 1"), 5).otherwise(10 + F.col("n_terrain"))), h.filter("id = 1").select(F.lit(1).alias("start"), "id", "col", "row"))


def _steps(shape, hexes, cost):
    """src, dst, cost and the blocks of both."""
    return graph.settle(graph.hex_edges(hexes).select("src", "dst", cost.cast("bigint").alias("cost"), paths.block_of("col", "row", shape).alias("src_block"), paths.block_of("ncol", "nrow", shape).alias("dst_block")))


def _searched(shape, hexes, steps, starts):
    nodes = hexes.select("id", paths.block_of("col", "row", shape).alias("block"))
    asked = starts.select(F.col("start").cast("bigint").alias("query"), F.col("id").alias("start"), paths.block_of("col", "row", shape).alias("block"))
    return paths.least_costs(paths.block_graph(steps, nodes), asked).select(F.col("query").cast("int").alias("start"), "id", "cost")


@query(f"""WITH RECURSIVE {EDGES}, m AS (SELECT src, dst, CASE WHEN (road >> dir) & 1 = 1 THEN 50 ELSE 100 + n_terrain * 10 END AS cost FROM e WHERE NOT impassable AND NOT n_impassable),
    b AS (SELECT min(col) AS x0, max(col) AS x1, min(row) AS y0, max(row) AS y1 FROM hexes WHERE NOT impassable),
    t AS (SELECT 0 AS landmark, x0 AS tx, y0 AS ty FROM b UNION ALL SELECT 1, (x0 + x1) // 2, y0 FROM b UNION ALL SELECT 2, x1, y0 FROM b UNION ALL SELECT 3, x0, (y0 + y1) // 2 FROM b
        UNION ALL SELECT 4, x1, (y0 + y1) // 2 FROM b UNION ALL SELECT 5, x0, y1 FROM b UNION ALL SELECT 6, (x0 + x1) // 2, y1 FROM b UNION ALL SELECT 7, x1, y1 FROM b),
    l AS (SELECT landmark, id FROM hexes CROSS JOIN t WHERE NOT impassable QUALIFY row_number() OVER (PARTITION BY landmark ORDER BY {_DIST.format(x="tx", y="ty")}, col, row) = 1),
    p(start, id, cost) USING KEY (start, id) AS (SELECT landmark * 2, id, CAST(0 AS BIGINT) FROM l UNION {_SEARCH.format(far="dst", near="src")}),
    r(start, id, cost) USING KEY (start, id) AS (SELECT landmark * 2 + 1, id, CAST(0 AS BIGINT) FROM l UNION {_SEARCH.format(far="src", near="dst").replace("p.", "r.").replace("FROM p ", "FROM r ").replace("recurring.p", "recurring.r")})
    SELECT start, id, cost FROM p UNION ALL SELECT start, id, cost FROM r""")
def landmark_paths(v):
    """Costs from eight landmarks to every hex and back, by blocks."""
    h = v("hexes").filter("not impassable")
    shape = paths.long_blocks(h)
    steps = _steps(shape, h, F.when(F.expr("(road >> dir) & 1 = 1"), 50).otherwise(100 + F.col("n_terrain") * 10))
    marks = graph.settle(spatial.landmarks(h).join(h.select("col", "row", "id"), ["col", "row"]).select((F.col("landmark") * 2).alias("start"), "id", "col", "row"))
    there = _searched(shape, h, steps, marks)
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", F.col("dst_block").alias("src_block"), F.col("src_block").alias("dst_block"))
    return there.union(_searched(shape, h, back, marks.withColumn("start", F.col("start") + 1)))


@query()
def erase_inward(v):
    """Rounds of majority votes; compared with a loop in the tests."""
    h = v("hexes").select("id", "col", "row", F.col("cat").alias("rgb"))
    return graph.erase_inward(h, h.filter("id % 1000 < 120")).select("id", "rgb")


@query("""SELECT id, col + dc AS col, row + dr AS row FROM (SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey * 13 % 53 AS col, s_suppkey * 29 % 1009 AS row FROM supplier), (SELECT unnest(range(-4, 5)) AS dc), (SELECT unnest(range(-4, 5)) AS dr)
    WHERE greatest(abs(dc), abs(row + dr - (col + dc - (col + dc + 4) % 2) // 2 - (row - (col - col % 2) // 2)), abs(-dc - (row + dr - (col + dc - (col + dc + 4) % 2) // 2 - (row - (col - col % 2) // 2)))) <= 4""")
def hex_circle(v):
    centres = v("supplier").selectExpr("cast(s_suppkey as bigint) as id", "s_suppkey * 13 % 53 as col", "s_suppkey * 29 % 1009 as row")
    return graph.circles(centres, 4).select("id", F.col("ncol").alias("col"), F.col("nrow").alias("row"))


@query("SELECT id FROM hexes, (SELECT col AS c2, row AS r2, id AS i2 FROM hexes) WHERE id = i2 AND (SELECT count(*) % 2 FROM (VALUES (3e0, 2e0, 40e0, 9e0), (40e0, 9e0, 30e0, 40e0), (30e0, 40e0, 5e0, 30e0), (5e0, 30e0, 3e0, 2e0)) AS t(x1, y1, x2, y2) WHERE (y1 > row + (col % 2) * 0.5e0) <> (y2 > row + (col % 2) * 0.5e0) AND col < x1 + (row + (col % 2) * 0.5e0 - y1) * ((x2 - x1) / (y2 - y1))) = 1")
def hex_polygon(v):
    return graph.polygon(v("hexes"), [(3, 2), (40, 9), (30, 40), (5, 30)]).select("id")


@query("WITH c AS (SELECT id, least(greatest(fx, 0), 49) AS cx, least(greatest(fy, 0), 299) AS cy FROM points), k AS (SELECT *, CAST(floor(cx) AS BIGINT) AS x0, CAST(floor(cy) AS BIGINT) AS y0, cx - floor(cx) AS fx, cy - floor(cy) AS fy FROM c) SELECT k.id, a.v * (1 - fx) * (1 - fy) + b.v * fx * (1 - fy) + c2.v * (1 - fx) * fy + d.v * fx * fy AS v FROM k JOIN raster a ON a.x = x0 AND a.y = y0 JOIN raster b ON b.x = least(x0 + 1, 49) AND b.y = y0 JOIN raster c2 ON c2.x = x0 AND c2.y = least(y0 + 1, 299) JOIN raster d ON d.x = least(x0 + 1, 49) AND d.y = least(y0 + 1, 299)")
def bilinear_sample(v):
    return raster.sample(v("points"), v("raster"), F.col("fx"), F.col("fy"), 50, 300).select("id", "v")


@query("SELECT x, y, CAST(floor((v - lo) / CAST(hi - lo AS DOUBLE) * 65535) AS BIGINT) AS v FROM raster, (SELECT min(v) AS lo, max(v) AS hi FROM raster)")
def raster_normalise(v):
    return raster.normalise(v("raster"))


@query("SELECT x // 3 AS x, y // 3 AS y, v FROM raster WHERE x % 3 = 0 AND y % 3 = 0")
def raster_shrink(v):
    return raster.shrink(v("raster"), 3)


@query("SELECT x * 4 + i AS x, y * 4 + j AS y, v FROM raster, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)")
def raster_enlarge(v):
    return raster.enlarge(v("raster"), 4)


@query("SELECT a.x, a.y, a.v AS height, b.v AS climate FROM raster a LEFT JOIN (SELECT x, y, v % 7 AS v FROM raster WHERE v % 3 > 0) b ON a.x = b.x AND a.y = b.y")
def channel_zip(v):
    r = v("raster")
    return raster.zip_channels(height=r, climate=r.filter("v % 3 > 0").selectExpr("x", "y", "v % 7 as v"))


@query("SELECT x // 5 AS cx, y // 5 AS cy, greatest(max(v), -1) AS v, CAST(ceil(greatest(max(v) / 70000e0, 0) * 65535) AS BIGINT) AS code FROM raster GROUP BY 1, 2")
def zonal_max(v):
    return raster.zonal_max(v("raster").selectExpr("x div 5 as cx", "y div 5 as cy", "v"), 70000.0).select("cx", "cy", F.col("v").cast("bigint").alias("v"), "code")


@query("SELECT a.ordinal, min(r.v) AS lo, max(r.v) AS hi FROM areas a JOIN raster r ON r.x BETWEEN min_x AND max_x AND r.y BETWEEN min_y AND max_y GROUP BY a.ordinal")
def window_range(v):
    return raster.window_range(v("areas"), v("raster"))


@query("SELECT x, y, avg(v) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM (SELECT x, y, avg(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM raster)")
def box_blur(v):
    return raster.box_blur(v("raster"), 2)


@query("SELECT c.x, c.y, r.v FROM (SELECT x, y FROM (SELECT unnest(range(0, 55)) AS x), (SELECT unnest(range(0, (SELECT max(y) + 5 FROM raster))) AS y)) c LEFT JOIN raster r ON r.x = least(greatest(c.x, 2), 51) - 2 AND r.y = least(greatest(c.y, 1), (SELECT max(y) + 1 FROM raster)) - 1")
def raster_pad(v):
    r = v("raster")
    return raster.pad(r, (50, (r.agg(F.max("y")).first()[0] or 0) + 1), (2, 1, 3, 3))


@query("SELECT x, y, v + 500 * CASE WHEN sqrt((x - 20) * (x - 20) + (y - 15) * (y - 15)) < 8 THEN 0.5e0 + 0.5e0 * cos(sqrt((x - 20) * (x - 20) + (y - 15) * (y - 15)) / 8 * pi()) ELSE 0 END AS v FROM raster")
def raise_brush(v):
    return raster.brush(v("raster"), 20, 15, 8, "raise", 500.0)


@query("SELECT x, y, coalesce(greatest(abs(lead(v) OVER (PARTITION BY y ORDER BY x) - v), abs(lead(v) OVER (PARTITION BY x ORDER BY y) - v)) > 40000, false) AS steep FROM raster")
def slope_mask(v):
    return raster.slope_mask(v("raster"), 40000)


@query("SELECT c.x, c.y, CAST(sum(n.v * (n.x - c.x) * CASE WHEN n.y = c.y THEN 2 ELSE 1 END) AS BIGINT) AS gx, CAST(sum(n.v * (n.y - c.y) * CASE WHEN n.x = c.x THEN 2 ELSE 1 END) AS BIGINT) AS gy FROM raster c JOIN raster n ON n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 AND (n.x <> c.x OR n.y <> c.y) GROUP BY c.x, c.y HAVING count(*) = 8")
def sobel(v):
    return raster.sobel(v("raster"))


@query("SELECT ordinal AS id, CAST((max_x - min_x) * (max_y - min_y) AS DOUBLE) AS area FROM areas")
def polygon_area(v):
    corners = v("areas").select(F.col("ordinal").alias("id"), F.inline(F.expr("array(named_struct('ordinal', 0, 'x', min_x, 'y', min_y), named_struct('ordinal', 1, 'x', max_x, 'y', min_y), named_struct('ordinal', 2, 'x', max_x, 'y', max_y), named_struct('ordinal', 3, 'x', min_x, 'y', max_y))")))
    return raster.polygon_area(corners)


@query("SELECT ordinal, CASE WHEN min_x // 32 = max_x // 32 AND min_y // 32 = max_y // 32 THEN CAST(min_x // 32 % 2 + 2 * (1 - min_y // 32 % 2) AS VARCHAR) || CASE WHEN min_x // 16 = max_x // 16 AND min_y // 16 = max_y // 16 THEN CAST(min_x // 16 % 2 + 2 * (1 - min_y // 16 % 2) AS VARCHAR) ELSE '' END ELSE '' END AS cell FROM areas")
def quad_cells(v):
    return v("areas").select("ordinal", raster.quad_cell(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), 64.0, 3).alias("cell"))


@query("SELECT p.id, p.ground - p.scale * m.min_y - p.y AS move FROM props p JOIN models m ON m.model = p.model WHERE p.ground - p.scale * m.min_y - p.y < -0.01e0")
def ground_clamp(v):
    return raster.ground_clamp(v("props").join(v("models"), "model"), "base", only_down=True).select("id", "move")


@query("WITH s AS (SELECT id, (row * 65536 + col) % 2147483647 * 48271 % 2147483647 AS s1 FROM hexes) SELECT id, s1 / 2147483647e0 AS jx, s1 * 48271 % 2147483647 / 2147483647e0 AS jz, (s1 * 48271 % 2147483647) * 48271 % 2147483647 / 2147483647e0 * 360 AS turn FROM s")
def tree_spots(v):
    return raster.tree_spots(v("hexes")).select("id", "jx", "jz", "turn")


@query("SELECT count(*) AS n, count(*) FILTER (v % 3 <> 0) AS equal, regr_slope(r, l) AS slope, regr_intercept(r, l) AS intercept, corr(l, r) AS correlation FROM (SELECT v, CAST(v AS DOUBLE) AS l, CAST(CASE WHEN v % 3 = 0 THEN v + 7 ELSE v END AS DOUBLE) AS r FROM raster)")
def raster_parity(v):
    return merge.parity(v("raster"), v("raster").selectExpr("x", "y", "case when v % 3 = 0 then v + 7 else v end as v"))


_3 = "SELECT coalesce(b.id, o.id, t.id) AS id, b.id IS NOT NULL AS ib, o.id IS NOT NULL AS io, t.id IS NOT NULL AS it, b.a AS ba, b.b AS bb, o.a AS oa, o.b AS ob, t.a AS ta, t.b AS tb FROM base_t b FULL OUTER JOIN ours_t o ON o.id = b.id FULL OUTER JOIN theirs_t t ON t.id = coalesce(b.id, o.id)"


@query(f"""WITH m AS ({_3}), d AS (SELECT *, CASE WHEN io = it AND oa IS NOT DISTINCT FROM ta AND ob IS NOT DISTINCT FROM tb THEN 'same' WHEN ib = io AND ba IS NOT DISTINCT FROM oa AND bb IS NOT DISTINCT FROM ob THEN 'theirs' WHEN ib = it AND ba IS NOT DISTINCT FROM ta AND bb IS NOT DISTINCT FROM tb THEN 'ours' WHEN io AND it THEN 'merged' ELSE 'edit_delete' END AS action FROM m)
    SELECT id, action, CASE action WHEN 'merged' THEN oa IS DISTINCT FROM ba AND ta IS DISTINCT FROM ba AND oa IS DISTINCT FROM ta OR ob IS DISTINCT FROM bb AND tb IS DISTINCT FROM bb AND ob IS DISTINCT FROM tb WHEN 'edit_delete' THEN true ELSE false END AS conflict, CASE action WHEN 'theirs' THEN it ELSE io END AS kept,
    CASE action WHEN 'theirs' THEN ta WHEN 'merged' THEN CASE WHEN oa IS NOT DISTINCT FROM ba THEN ta ELSE oa END ELSE oa END AS a, CASE action WHEN 'theirs' THEN tb WHEN 'merged' THEN CASE WHEN ob IS NOT DISTINCT FROM bb THEN tb ELSE ob END ELSE ob END AS b FROM d""")
def three_way_merge(v):
    return merge.three_way(v("base_t"), v("ours_t"), v("theirs_t"), ["id"]).select("id", "action", "conflict", "kept", "row.a", "row.b")


@query("SELECT id, a FROM (SELECT id, a FROM ours_t EXCEPT (SELECT id, a FROM base_t EXCEPT SELECT id, a FROM theirs_t)) UNION (SELECT id, a FROM theirs_t EXCEPT SELECT id, a FROM base_t)")
def link_merge(v):
    return merge.merge_links(*[v(t).select("id", "a") for t in ("base_t", "ours_t", "theirs_t")])


@query("SELECT coalesce(b.id, t.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN t.id IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN b.id IS NULL OR t.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.a IS DISTINCT FROM t.a THEN 'a' END, CASE WHEN b.b IS DISTINCT FROM t.b THEN 'b' END) END AS fields FROM base_t b FULL OUTER JOIN theirs_t t ON t.id = b.id WHERE b.id IS NULL OR t.id IS NULL OR b.a IS DISTINCT FROM t.a OR b.b IS DISTINCT FROM t.b")
def entity_diff(v):
    return merge.diff(v("base_t"), v("theirs_t"), ["id"]).select("id", "change", F.array_join("fields", ",").alias("fields"))


@query("SELECT array_to_string(list(CAST(n AS VARCHAR) || ' ' || change ORDER BY change), ', ') AS summary FROM (SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN t.id IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM base_t b FULL OUTER JOIN theirs_t t ON t.id = b.id WHERE b.id IS NULL OR t.id IS NULL OR b.a IS DISTINCT FROM t.a OR b.b IS DISTINCT FROM t.b GROUP BY 1)")
def change_summary(v):
    return merge.change_summary(merge.diff(v("base_t"), v("theirs_t"), ["id"]))


_SIDES = "SELECT x, y, v AS b, CASE WHEN (x + y) % 11 = 0 THEN v + 1 ELSE v END AS o, CASE WHEN (x + 2 * y) % 13 = 0 THEN v + 2 ELSE v END AS t FROM raster"


def _raster_sides(v):
    r = v("raster")
    return r, r.selectExpr("x", "y", "case when (x + y) % 11 = 0 then v + 1 else v end as v"), r.selectExpr("x", "y", "case when (x + 2 * y) % 13 = 0 then v + 2 else v end as v")


@query(f"SELECT x, y, CASE WHEN o = b THEN t ELSE o END AS v FROM ({_SIDES})")
def raster_merge(v):
    return merge.raster_merge(*_raster_sides(v))[0]


@query(f"SELECT x // 16 AS cx, y // 16 AS cy, count(*) AS pixels, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({_SIDES}) WHERE o <> b AND t <> b AND o <> t GROUP BY 1, 2")
def raster_conflicts(v):
    return merge.raster_merge(*_raster_sides(v), cell=16)[1]


@query(f"SELECT count(*) AS changed, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(DISTINCT (x // 16) * 100000 + y // 16) AS cells FROM ({_SIDES}) WHERE o <> b")
def raster_diff(v):
    base, ours, _ = _raster_sides(v)
    return merge.raster_diff(base, ours, 16)


@query("SELECT coalesce(o.id, t.id) AS path, CASE WHEN o.id IS NULL THEN 'only_right' WHEN t.id IS NULL THEN 'only_left' WHEN o.a = t.a THEN 'identical' ELSE 'differs' END AS status FROM ours_t o FULL OUTER JOIN theirs_t t ON t.id = o.id")
def file_status(v):
    return merge.file_status(*[v(t).select(F.col("id").alias("path"), F.col("a").alias("hash")) for t in ("ours_t", "theirs_t")])


@query(f"WITH m AS ({_3}) SELECT id, CASE WHEN oa IS NOT DISTINCT FROM ta THEN 'already' WHEN oa IS NOT DISTINCT FROM ba THEN CASE WHEN ta IS NULL THEN 'delete' ELSE 'apply' END WHEN ta IS NULL OR oa IS NULL THEN 'conflict' ELSE 'merge' END AS decision FROM m")
def package_import(v):
    side = lambda t, n: v(t).select("id", F.col("a").alias(n))
    rows = side("base_t", "base").join(side("ours_t", "current"), "id", "full_outer").join(side("theirs_t", "after"), "id", "full_outer")
    return merge.package_decision(rows).select("id", "decision")


def _journal(v):
    e = v("events")
    return e.selectExpr("event_id as seq", "concat('f', cast(user_id % 40 as string)) as path", "case when event_id % 9 = 0 then null else concat('h', cast(event_id % 50 as string)) end as after", "concat('h', cast(event_id % 13 as string)) as before")


_J = "j AS (SELECT event_id AS seq, 'f' || CAST(user_id % 40 AS VARCHAR) AS path, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'h' || CAST(event_id % 50 AS VARCHAR) END AS after, 'h' || CAST(event_id % 13 AS VARCHAR) AS before FROM events)"


@query(f"WITH {_J} SELECT path, after AS hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM j WHERE seq <= 700) WHERE k = 1 AND after IS NOT NULL")
def journal_state(v):
    return journal.state_at(_journal(v), 700)


@query(f"WITH {_J} SELECT path, before AS restore, path IN (SELECT path FROM j WHERE seq > 600) AS refused FROM j WHERE seq = 600")
def journal_undo(v):
    return journal.undo(_journal(v), 600)


@query(f"WITH {_J}, e AS (SELECT path, arg_max(coalesce(after, '~'), seq) AS t, arg_min(before, seq) AS f FROM j WHERE seq BETWEEN 300 AND 500 GROUP BY path), b AS (SELECT 'f' || CAST(c_custkey AS VARCHAR) AS path, 'h' || CAST(c_custkey % 13 AS VARCHAR) AS hash FROM customer) SELECT path, hash, moved FROM (SELECT coalesce(b.path, e.path) AS path, CASE WHEN e.path IS NOT NULL THEN nullif(t, '~') ELSE hash END AS hash, e.path IS NOT NULL AND hash IS DISTINCT FROM f AS moved FROM b FULL OUTER JOIN e ON e.path = b.path) WHERE hash IS NOT NULL")
def journal_replay(v):
    base = v("customer").selectExpr("concat('f', cast(c_custkey as string)) as path", "concat('h', cast(c_custkey % 13 as string)) as hash")
    return journal.replay(base, _journal(v), 300, 500)


@query("SELECT coalesce(b.id, o.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.val ELSE b.a END AS a FROM base_t b FULL OUTER JOIN (SELECT id, arg_max(op, seq) AS op, arg_max(val, seq) AS val FROM (SELECT event_id AS seq, event_id * 7 % 1200 AS id, CASE event_id % 5 WHEN 0 THEN 'delete' ELSE 'set' END AS op, event_type AS val FROM events) GROUP BY id) o ON o.id = b.id WHERE o.op IS NULL OR o.op <> 'delete'")
def batch_edits(v):
    ops = v("events").selectExpr("event_id as seq", "event_id * 7 % 1200 as id", "case event_id % 5 when 0 then 'delete' else 'set' end as op", "event_type as value")
    return journal.apply_edits(v("base_t"), ops, "a")


@query("SELECT p.id, p.x + coalesce(m.dx, 0) AS x, p.z + coalesce(m.dz, 0) AS z, p.scale * coalesce(m.f, 1) AS scale FROM props p LEFT JOIN (SELECT event_id % 500 AS id, sum(event_id % 3) AS dx, sum(event_id % 5) AS dz, product(1 + event_id % 2) AS f FROM events GROUP BY 1) m ON m.id = p.id")
def prop_moves(v):
    moves = v("events").selectExpr("event_id % 500 as id", "cast(event_id % 3 as double) as dx", "0D as dy", "cast(event_id % 5 as double) as dz", "cast(1 + event_id % 2 as double) as factor")
    return journal.move_props(v("props"), moves).select("id", "x", "z", "scale")


@query("SELECT id, CASE tags WHEN 'night,Snow' THEN 'Snow,fog,night' WHEN 'snow' THEN 'fog,snow' WHEN '' THEN 'fog' ELSE 'fog' END AS tags FROM props")
def tag_edits(v):
    return journal.edit_tags(v("props"), ["fog"], ["day"]).select("id", "tags")


@query("SELECT cat AS rgb, count(*) AS hexes, min(id) AS first FROM hexes WHERE cat % 2 = 1 AND id % 4 = 0 GROUP BY cat")
def paint_operations(v):
    h = v("hexes").select("id", F.col("cat").alias("rgb"))
    before = h.withColumn("rgb", F.expr("case when rgb % 2 = 1 and id % 4 = 0 then rgb - 1 else rgb end"))
    return journal.paint_ops(before, h).select("rgb", "hexes", "first")


@query("SELECT id, field, val FROM fields WHERE field = 'k' AND NOT regexp_full_match(val, 'true|false') OR field = 'position' AND len(string_split(val, ' ')) <> 2")
def value_checks(v):
    spark = v("region").sparkSession
    schema = spark.sql("select * from values ('ECProps', 'k', 'Bool'), ('ECTransform', 'position', 'Vec2') as t(comp, field, type)")
    return journal.check_values(v("fields"), schema).select("id", "field", "val")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(v):
    from terralith.streaming.windows import counts

    return counts(v("events"), "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n")



def _areas(v):
    h = v("hexes").select("id", "col", "row", "region", "terrain")
    return graph.hex_edges(h).select("src", "dst", (100 + F.col("n_terrain") * 10).cast("bigint").alias("cost"), F.col("region").alias("area"), F.col("n_region").alias("n_area"))


_AREAS = f"{EDGES}, r AS (SELECT e.src, e.dst, 100 + n_terrain * 10 AS cost, a.region AS area, b.region AS n_area FROM e JOIN hexes a ON a.id = e.src JOIN hexes b ON b.id = e.dst)"


@query(f"WITH {_AREAS} SELECT area, n_area, count(*) AS steps, count(DISTINCT dst) AS hexes, min(dst) AS first, max(cost) AS dearest FROM r WHERE area <> n_area GROUP BY area, n_area")
def area_borders(v):
    return routes.borders(_areas(v))


@query(f"WITH {_AREAS}, d AS (SELECT DISTINCT area, n_area, dst AS id FROM r WHERE area <> n_area), l AS (SELECT *, lag(id) OVER (PARTITION BY area, n_area ORDER BY id) AS p FROM d) SELECT area, n_area, id FROM l WHERE p IS NULL OR id - p >= 10")
def area_transitions(v):
    return routes.border_runs(_areas(v))
