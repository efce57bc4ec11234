"""Queries: fixing findings, planting, river flow, meshes and heights, first-use dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import graph, heights, hexops, mesh, paths, ranks, repair, rivers, scatter
from terralith.plans.registry import query


def _cats(v):
    return v("hexes").select("id", "col", "row", "cat")


@query()
def fix_suggestions(v):
    """The best fix of every finding on the map as it is; compared with a serial form in the tests."""
    return repair.suggestions(_cats(v))


@query()
def fix_all(v):
    """The hexes that change when all findings are fixed in order; compared with a serial form in the tests."""
    return repair.fix_all(_cats(v))[0]


@query()
def fix_all_report(v):
    """How many findings of each code are fixed, cleared by another fix, or left."""
    return repair.fix_all(_cats(v))[1].groupBy("code", "outcome").agg(F.count("*").alias("findings"))


_WET = "SELECT s.*, coalesce(r.v < 9000, false) AS wet FROM saplings s LEFT JOIN raster r ON r.x = floor(s.x) AND r.y = floor(s.z)"
_NEAR = "(CAST(CAST(a.x AS FLOAT) AS DOUBLE) - b.x) ** 2 + (CAST(CAST(a.z AS FLOAT) AS DOUBLE) - b.z) ** 2 < 1.2e0 * 1.2e0"
_CELLS = "(SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS k)"


@query(f"""WITH RECURSIVE w AS ({_WET}), n AS (SELECT floor(x / 2) + i AS gx, floor(z / 2) + k AS gz, x, z FROM old_trees, {_CELLS}),
    s AS (SELECT b.* FROM w b WHERE NOT wet AND x <= 50 AND NOT EXISTS (SELECT 1 FROM n a WHERE a.gx = floor(b.x / 2) AND a.gz = floor(b.z / 2) AND {_NEAR})),
    m AS (SELECT floor(x / 2) + i AS gx, floor(z / 2) + k AS gz, x, z, ordinal FROM s, {_CELLS}),
    c AS (SELECT a.ordinal AS a, b.ordinal AS b FROM m a JOIN s b ON a.gx = floor(b.x / 2) AND a.gz = floor(b.z / 2) AND a.ordinal < b.ordinal AND {_NEAR}),
    t(ordinal, state) USING KEY (ordinal) AS (SELECT ordinal, 0 FROM s UNION SELECT * FROM (SELECT u.ordinal, CASE WHEN coalesce(bool_or(e.state = 1), false) THEN 2 ELSE 1 END FROM recurring.t u LEFT JOIN c ON c.b = u.ordinal
        LEFT JOIN recurring.t e ON e.ordinal = c.a WHERE u.state = 0 AND EXISTS (SELECT 1 FROM t) GROUP BY u.ordinal HAVING coalesce(bool_or(e.state = 1), false) OR NOT coalesce(bool_or(e.state = 0), false)))
    SELECT s.ordinal, s.x, s.z FROM s JOIN t ON t.ordinal = s.ordinal WHERE state = 1""")
def tree_scatter(v):
    """Spots planted in order, none in water, none nearer than 1.2 to another tree."""
    s, r = v("saplings"), v("raster").select(F.col("x").alias("_i"), F.col("y").alias("_k"), (F.col("v") < 9000).alias("wet"))
    wet = s.withColumns({"_i": F.floor("x"), "_k": F.floor("z")}).join(r, ["_i", "_k"], "left")
    return scatter.scatter(wet, v("old_trees"), 1.2, 50.0, 1e9, "wet").select("ordinal", "x", "z")


@query("SELECT id, species FROM old_trees WHERE NOT (lower(species) = 'birch_b' AND (x - 25) * (x - 25) + (z - 100) * (z - 100) <= 3600)")
def tree_erase(v):
    return scatter.erase(v("old_trees"), 25.0, 100.0, 60.0, species="BIRCH_B").select("id", "species")


def river_tables(hexes):
    """(tiles, links) of the river hexes, each with three forms, whose entries differ in most."""
    wet = hexes.filter("cat in (5, 6, 7, 8)").select("id", "col", "row", "cat")
    near = graph.hex_edges(wet).select("src", F.col("dir").alias("nth"), "dst", paths.block_of("col", "row").alias("src_block"), paths.block_of("ncol", "nrow").alias("dst_block"))
    near = near.filter((F.least("src", "dst") * 5 + F.greatest("src", "dst")) % 7 != 0)
    side = (F.col("nth") + 3) % 6
    entry = lambda tile, k, form: (tile * 7 + k * 3 + tile % 5 * form) % 4 < 2
    back = F.array(*[F.when((F.col("src") + F.col("dst")) % 9 != 0, entry(F.col("dst"), side, form)) for form in range(3)])
    links = near.withColumn("back", back)
    own = near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), *[F.bool_or(entry(F.col("src"), F.col("nth"), form)).alias(f"_{form}") for form in range(3)])
    tiles = wet.join(own, "id", "left").select("id", (F.col("cat") == 7).alias("mouth"), (F.coalesce("n", F.lit(0)) >= 3).alias("junction"), (F.col("id") % 3).cast("int").alias("variant"), F.array(*[F.coalesce(f"_{form}", F.lit(False)) for form in range(3)]).alias("takes"))
    return tiles, links


@query()
def river_flow(v):
    """Flow of all river tiles from the mouths up; compared with a serial form in the tests."""
    return rivers.flow(*river_tables(v("hexes")))


def _triangles(v):
    return v("triangles").withColumnRenamed("b_y", "by")


_F = "CAST({} AS FLOAT)".format
_MESH = f"""t AS (SELECT ordinal, {', '.join(f'{_F(c)} AS {c}' for c in ('ax', 'ay', 'az', 'bx', 'b_y', 'bz', 'cx', 'cy', 'cz'))} FROM triangles),
    b AS (SELECT *, least(trunc(ax), trunc(bx), trunc(cx)) - 1 AS x0, greatest(trunc(ax), trunc(bx), trunc(cx)) AS x1, least(trunc(az), trunc(bz), trunc(cz)) - 1 AS z0, greatest(trunc(az), trunc(bz), trunc(cz)) AS z1 FROM t),
    c AS (SELECT *, unnest(range(CAST(z0 AS BIGINT), CAST(z1 AS BIGINT) + 1)) AS z FROM b), d AS (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) + 1)) AS x FROM c),
    e AS (SELECT *, bz - az AS pz, bx - ax AS px, cz - az AS qz, cx - ax AS qx, {_F('z')} - az AS sz, {_F('x')} - ax AS sx FROM d),
    f AS (SELECT *, pz * pz + px * px AS d00, qz * pz + qx * px AS d01, qz * qz + qx * qx AS d11, sz * pz + sx * px AS d02, sz * qz + sx * qx AS d12 FROM e),
    g AS (SELECT *, {_F('CAST(1 AS DOUBLE) / CAST(d11 * d00 - d01 * d01 AS DOUBLE)')} AS inv FROM f WHERE d11 * d00 - d01 * d01 <> 0),
    h AS (SELECT *, (d02 * d11 - d12 * d01) * inv AS u, (d12 * d00 - d02 * d01) * inv AS w FROM g), i AS (SELECT *, ({_F('1')} - u) - w AS s FROM h),
    m AS (SELECT x AS px, z AS pz, arg_max(w * cy + u * b_y + s * ay, ordinal) AS y FROM i WHERE x >= 0 AND x < {{width}} AND z >= 0
      AND s BETWEEN {_F('-9.999999747378752e-05')} AND {_F('1.000100016593933')} AND u BETWEEN {_F('-9.999999747378752e-05')} AND {_F('1.000100016593933')} AND w BETWEEN {_F('-9.999999747378752e-05')} AND {_F('1.000100016593933')} GROUP BY x, z)"""


@query(f"WITH {_MESH.format(width=50)} SELECT px, pz, CAST(y AS DOUBLE) AS y FROM m")
def mesh_field(v):
    """The height field of all triangles at scale 1, some of them larger than a piece."""
    return mesh.rasterise(_triangles(v), 1.0, 50, 1 << 30, piece=32).select("px", "pz", F.col("y").cast("double").alias("y"))


def _patches(v):
    return v("areas").selectExpr("ordinal", "min_x", "max_x", "min_y * 10 as min_z", "max_y * 10 as max_z", "ordinal % 9 as height", "ordinal % 4 as rise_x", "ordinal % 3 as rise_z")


@query(f"""WITH {_MESH.format(width=50)}, q AS (SELECT ordinal AS id, x, z FROM saplings), a AS (SELECT min_x, max_x, min_y * 10 AS min_z, max_y * 10 AS max_z, ordinal % 9 AS height, ordinal % 4 AS rx, ordinal % 3 AS rz FROM areas),
    p AS (SELECT id, max(height + rx * ((x - min_x) / (max_x - min_x)) + rz * ((z - min_z) / (max_z - min_z))) AS patch FROM q JOIN a ON x BETWEEN min_x AND max_x AND z BETWEEN min_z AND max_z GROUP BY id),
    o AS (SELECT q.id, CAST(m.y AS DOUBLE) AS mesh, patch, CASE WHEN q.id % 3 = 0 THEN q.id % 11 / 2e0 END AS tile FROM q LEFT JOIN m ON m.px = floor(q.x) AND m.pz = floor(q.z) LEFT JOIN p ON p.id = q.id)
    SELECT id, greatest(coalesce(mesh, tile, 0e0), coalesce(patch, coalesce(mesh, tile, 0e0))) AS height, CASE WHEN patch >= coalesce(mesh, tile, 0e0) THEN 'patch' WHEN mesh IS NOT NULL THEN 'mesh' WHEN tile IS NOT NULL THEN 'tile' ELSE 'none' END AS source FROM o""")
def scene_heights(v):
    """The height of the scene at each spot: mesh, patches, or the tile below."""
    points = v("saplings").select(F.col("ordinal").alias("id"), "x", "z")
    fallback = points.filter("id % 3 = 0").selectExpr("id", "id % 11 / 2D as height")
    return mesh.scene_heights(points, mesh.rasterise(_triangles(v), 1.0, 50, 1 << 30), _patches(v), fallback)


def _sample(name, rows, pixels, keys, w, h, lo, hi):
    """SQL of one sample in single precision: name(id, ordinal, s) from rows with u and v."""
    spot = lambda dx, dy: f"JOIN {pixels} {{n}} ON {keys.format(n='{n}')}{{n}}.x = least(greatest(CAST(trunc(fx) AS BIGINT) + {dx}, 0), {w} - 1) AND {{n}}.y = least(greatest(CAST(trunc(fy) AS BIGINT) + {dy}, 0), {h} - 1)"
    value = lambda n: f"{n}.v * {_F('1e0 / 65535e0')} * ({_F(hi)} - {_F(lo)}) + {_F(lo)}"
    joins = " ".join(spot(dx, dy).format(n=n) for n, dx, dy in (("a", 0, -1), ("b", 1, -1), ("c", 0, 0), ("d", 1, 0)))
    return f"""{name}0 AS (SELECT *, {_F(w)} * u AS fx, {_F(h)} * v AS fy FROM {rows}),
    {name}1 AS (SELECT r.*, {value('a')} AS va, {value('b')} AS vb, {value('c')} AS vc, {value('d')} AS vd FROM {name}0 r {joins}),
    {name}2 AS (SELECT *, (vb - va) * (fx - {_F('floor(fx)')}) + va AS top, (vd - vc) * (fx - {_F('floor(fx)')}) + vc AS bot FROM {name}1),
    {name} AS (SELECT *, (bot - top) * (fy - {_F('floor(fy)')}) + top AS s FROM {name}2)"""


_ANSWERS = f"""pt AS (SELECT CAST(c_custkey AS BIGINT) AS id, {_F('(c_custkey * 173 % 16400) / 100e0')} AS x, {_F('(c_custkey * 311 % 20000) / 100e0')} AS z FROM customer),
    big AS (SELECT x, y, {_F('v')} AS v FROM raster), hh AS (SELECT max(y) + 1 AS h FROM raster),
    lr AS (SELECT id, x, z, {_F('CAST(x AS DOUBLE) / 160e0')} AS u, {_F('1')} - {_F('CAST(z AS DOUBLE) / 200e0')} AS v, h FROM pt, hh),
    {_sample('lw', 'lr', 'big', '', '50', 'h', '0', '1')},
    lo AS (SELECT id, x, z, s * {_F('1100')} * ({_F('0.0078125')} * {_F('4')}) - ({_F('0.0078125')} * {_F('4')}) * {_F('240')} AS low FROM lw),
    pp AS (SELECT path, x, y, {_F('(length(path) * 131 + x * 977 + y * 3571) % 65536')} AS v FROM (SELECT DISTINCT path FROM tiles), (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 6)) AS y) WHERE length(path) % 4 <> 0),
    pl AS (SELECT *, CASE WHEN rot IN (32, 128) THEN h ELSE w END AS wide, CASE WHEN rot IN (32, 128) THEN w ELSE h END AS tall, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE mask END AS bits FROM tiles),
    c0 AS (SELECT lo.id, p.*, low, {_F('0.25')} * lo.x AS tx, {_F('0.25')} * lo.z AS ty FROM lo JOIN pl p ON {_F('0.25')} * lo.x >= p.x AND {_F('0.25')} * lo.x <= p.x + wide AND {_F('0.25')} * lo.z >= p.y AND {_F('0.25')} * lo.z <= p.y + tall
      WHERE lo.x >= 0 AND lo.z >= 0 AND lo.x <= 160 AND lo.z <= 200),
    c1 AS (SELECT *, CAST(trunc(tx - {_F('x')}) AS BIGINT) AS ix, CAST(trunc(ty - {_F('y')}) AS BIGINT) AS iy, {_F('CAST(tx - CAST(x AS FLOAT) AS DOUBLE) / wide')} AS a, {_F('CAST(ty - CAST(y AS FLOAT) AS DOUBLE) / tall')} AS b FROM c0),
    c2 AS (SELECT *, CASE rot WHEN 32 THEN w - iy - 1 WHEN 64 THEN w - ix - 1 WHEN 128 THEN iy ELSE ix END AS tc, CASE rot WHEN 32 THEN ix WHEN 64 THEN h - iy - 1 WHEN 128 THEN h - ix - 1 ELSE iy END AS tr,
      CASE rot WHEN 16 THEN a WHEN 32 THEN {_F('1')} - b WHEN 64 THEN {_F('1')} - a WHEN 128 THEN b END AS u, CASE rot WHEN 16 THEN b WHEN 32 THEN a WHEN 64 THEN {_F('1')} - b WHEN 128 THEN {_F('1')} - a END AS v FROM c1),
    c3 AS (SELECT *, tc >= 0 AND tr >= 0 AND tc < w AND tr < h AND (bits IS NULL OR (bits >> CAST(greatest(tc * h + tr, 0) AS INTEGER)) & 1 = 1) AS valid FROM c2),
    c4 AS (SELECT * FROM c3 WHERE bits IS NULL OR valid),
    {_sample('hs', 'c4', 'pp', '{n}.path = r.path AND ', '8', '6', '-1.5', '2.5')},
    an AS (SELECT c4.id, c4.ordinal, c4.low, c4.valid, coalesce(hs.s * ({_F('0.0078125')} * {_F('4')}), {_F('0')}) AS high FROM c4 LEFT JOIN hs ON hs.id = c4.id AND hs.ordinal = c4.ordinal),
    fi AS (SELECT * FROM an WHERE valid OR high <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1)"""


def _stack(v):
    points = v("customer").selectExpr("cast(c_custkey as bigint) as id", "cast((c_custkey * 173 % 16400) / 100D as float) as x", "cast((c_custkey * 311 % 20000) / 100D as float) as z")
    r = v("raster")
    size = r.agg((F.max("y") + 1).alias("h")).selectExpr("50 as w", "h", "0.0 as lo", "1.0 as hi")
    tiles = v("tiles").withColumn("mask", F.when(F.col("ordinal") % 5 != 0, F.col("mask")))
    paths = tiles.select("path").distinct().filter("length(path) % 4 <> 0")
    pixels = paths.selectExpr("path", "explode(sequence(0, 7)) as x").selectExpr("path", "x", "explode(sequence(0, 5)) as y").selectExpr("path", "x", "y", "(length(path) * 131 + x * 977 + y * 3571) % 65536 as v")
    low = heights.low_heights(points, r, size, 4.0, 160.0, 200.0)
    return low, tiles, pixels, paths.selectExpr("path", "8 as w", "6 as h", "-1.5 as lo", "2.5 as hi")


@query(f"WITH {_ANSWERS} SELECT pt.id, fi.ordinal, coalesce(CAST(fi.high AS DOUBLE), 0e0) AS high, coalesce(CAST(fi.high + fi.low AS DOUBLE), 0e0) AS height FROM pt LEFT JOIN fi ON fi.id = pt.id")
def first_heights(v):
    """Heights of the first answering tile under each point, in single precision."""
    return heights.first_heights(*_stack(v), 4.0, 160.0, 200.0).select("id", "ordinal", F.col("high").cast("double").alias("high"), F.col("height").cast("double").alias("height"))


@query("""WITH f AS (SELECT path, min(ordinal) AS first FROM tiles GROUP BY path), s AS (SELECT w * 10 + h AS size, min(ordinal) AS first FROM tiles GROUP BY 1)
    SELECT t.ordinal, p.code AS path_code, z.code AS size_code FROM tiles t JOIN (SELECT path, row_number() OVER (ORDER BY first) - 1 AS code FROM f) p ON p.path = t.path JOIN (SELECT size, row_number() OVER (ORDER BY first) - 1 AS code FROM s) z ON z.size = t.w * 10 + t.h""")
def tile_codes(v):
    """Records with the codes of their path and size in dictionaries by first use."""
    t = v("tiles").withColumn("size", F.col("w") * 10 + F.col("h"))
    return ranks.coded(ranks.coded(t, "path", "ordinal", "path_code"), "size", "ordinal", "size_code").select("ordinal", "path_code", "size_code")


_OPS = """o AS (SELECT CAST(p_partkey AS BIGINT) AS n, p_partkey * 7 % 50 AS c, p_partkey // 7 AS r, 1 + p_partkey % 3 AS k, p_partkey % 5 AS kind, p_partkey % 12 AS a, p_partkey * 5 % 12 AS b FROM part),
    w AS (SELECT o.n, h.id, CASE WHEN kind > 2 THEN a END AS f, b AS t FROM o JOIN hexes h ON kind <> 2 AND kind <> 4 AND h.col BETWEEN c AND c + 2 * k AND h.row BETWEEN r - 1 AND r + k
      UNION ALL SELECT o.n, h.id, NULL, b FROM o JOIN hexes h ON kind = 2 AND greatest(abs(h.col - c), abs(h.row - (h.col - h.col % 2) // 2 - (r - (c - c % 2) // 2)), abs(h.col - c + h.row - (h.col - h.col % 2) // 2 - (r - (c - c % 2) // 2))) <= k
      UNION ALL SELECT o.n, h.id, a, b FROM o JOIN hexes h ON kind = 4 AND n % 200 = 4)"""


@query(f"""WITH {_OPS}, l AS (SELECT id, list({{'n': n, 'f': CAST(f AS BIGINT), 't': CAST(t AS BIGINT)}} ORDER BY n) AS xs FROM w GROUP BY id)
    SELECT h.id, list_reduce(list_prepend({{'n': CAST(-1 AS BIGINT), 'f': CAST(NULL AS BIGINT), 't': CAST(cat AS BIGINT)}}, coalesce(xs, [])), lambda p, x: CASE WHEN x.f IS NULL OR x.f = p.t THEN x ELSE p END).t AS value FROM hexes h LEFT JOIN l ON l.id = h.id""")
def hex_operations(v):
    """The map after one JSON operation for each part: rectangles, circles and replacements, some over the whole map."""
    p = v("part").selectExpr("cast(p_partkey as bigint) as n", "cast(p_partkey * 7 % 50 as int) as c", "cast(p_partkey div 7 as int) as r", "cast(1 + p_partkey % 3 as int) as k", "p_partkey % 5 as kind", "concat('s', p_partkey % 12) as a", "concat('s', p_partkey * 5 % 12) as b")
    rect = F.array("c", F.col("r") - 1, F.col("c") + 2 * F.col("k"), F.col("r") + F.col("k"))
    json = (
        F.when(F.col("kind") < 2, F.to_json(F.struct(F.lit("paint").alias("op"), F.col("b").alias("set"), rect.alias("rect"))))
        .when(F.col("kind") == 2, F.to_json(F.struct(F.lit("paint").alias("op"), F.col("b").alias("set"), F.array("c", "r", "k").alias("circle"))))
        .when(F.col("kind") == 3, F.to_json(F.struct(F.lit("replace").alias("op"), F.col("a").alias("from"), F.col("b").alias("to"), rect.alias("rect"))))
        .when(F.col("n") % 200 == 4, F.to_json(F.struct(F.lit("replace").alias("op"), F.col("a").alias("from"), F.col("b").alias("to"), F.lit(True).alias("all"))))
    )
    ops = p.select(F.col("n").alias("ordinal"), json.alias("json")).filter("json is not null")
    sets = v("hexes").select("cat").union(p.selectExpr("n % 12")).distinct().selectExpr("concat('s', cat) as name", "cast(cat as bigint) as value", "cast(cat as int) as cat")
    return hexops.apply_ops(v("hexes").selectExpr("id", "col", "row", "cat as value"), ops, sets, 10, 1).select("id", "value")
