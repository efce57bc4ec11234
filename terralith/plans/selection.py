"""Queries: filters, projections, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions.hexgrid import neighbours
from terralith.operators import filters, spatial
from terralith.operators.ranks import ranked
from terralith.plans.registry import query

_DIRS = "(VALUES (0, 0, 1, 1), (1, 1, 0, 1), (2, 1, -1, 0), (3, 0, -1, -1), (4, -1, -1, 0), (5, -1, 0, 1)) AS dirs(dir, dc, de, dod)"
NEIGHBOURS = f"SELECT h.*, dir, col + dc AS ncol, row + CASE WHEN col % 2 = 0 THEN de ELSE dod END AS nrow FROM hexes h CROSS JOIN {_DIRS}"


def _components(fields):
    one = fields.groupBy("id", "comp").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "val")))).alias("m"))
    return one.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("comp", "m"))).alias("components"))


@query("""SELECT type, count(*) AS n FROM entities WHERE lower(type) IN ('click', 'view', 'purchase', 'signup', 'error', 'login', 'logout', 'search') AND x BETWEEN 5 AND 40 AND z BETWEEN 20 AND 250
    AND contains(lower(name), '_1') GROUP BY type""")
def entity_query(v):
    out = filters.entity_query(v("entities"), types=["Click", "VIEW", "purchase", "signup", "error", "login", "logout", "search"], name="_1", rect=(40, 250, 5, 20))
    return out.groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT p.id FROM (SELECT id, max(CASE WHEN comp = 'ECProps' AND field = 'k' THEN val END) AS k, max(CASE WHEN comp = 'ECTransform' THEN val END) AS t,
    max(CASE WHEN comp = 'ECProps' AND field = 'flag' THEN val END) AS f FROM fields GROUP BY id) p WHERE k <> '3' AND contains(lower(t), ' 1') AND f = 'true'""")
def field_filters(v):
    rows = _components(v("fields"))
    return filters.entity_query(rows.withColumn("type", F.lit("x")), where=["ECProps.k!=3", "ECTransform.position~ 1", "ECProps.flag=true", "ECMesh"]).select("id")


@query("SELECT id, model, kind FROM props WHERE kind <> 'tag_layer' AND contains(lower(model), 'rock') AND list_contains(list_transform(string_split(lower(tags), ','), lambda t: trim(t)), 'snow') AND (x - 25) * (x - 25) + (z - 150) * (z - 150) <= 10000")
def prop_query(v):
    return filters.prop_query(v("props"), asset="ROCK", tag="SNOW", circle=(25.0, 150.0, 100.0)).select("id", "model", "kind")


@query("SELECT p_partkey AS ordinal, p_type AS path FROM part WHERE contains(lower(p_type), 'm') AND (lower(p_type) LIKE '%um' OR lower(p_type) LIKE '%my') ORDER BY path, ordinal LIMIT 50")
def asset_find(v):
    return filters.find_assets(v("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("path")), "M", ["um", "my"], 50)


@query("""WITH m AS (SELECT p_partkey AS ordinal, p_name AS path FROM part WHERE contains(lower(p_name), 'a'))
    SELECT path, ordinal, (SELECT count(*) > 25 FROM m) AS truncated FROM m ORDER BY path, ordinal LIMIT 25""")
def prefab_list(v):
    rows = v("part").filter(F.contains(F.lower("p_name"), F.lit("a"))).select(F.col("p_name").alias("path"), F.col("p_partkey").alias("ordinal"))
    return filters.with_truncation(rows, ["path", "ordinal"], 25)


@query("""SELECT CASE WHEN contains(model, '/mountains/') THEN 'mountain' WHEN contains(model, '/rocks/') THEN 'rock' WHEN contains(model, '/vegetation/') THEN 'tree' WHEN contains(model, '/settlements/') THEN 'building' ELSE 'other' END AS category,
    regexp_matches(model, 'port|boat|ship|bridge|water|dock|pier|wharf|lily|lotus|reed|fish|river|sea|jetty|walkway|scaffold') AS water, count(*) AS n FROM props GROUP BY 1, 2""")
def category_counts(v):
    return v("props").groupBy(filters.category(F.col("model")).alias("category"), filters.is_water_model(F.col("model")).alias("water")).agg(F.count("*").alias("n"))


@query("""SELECT s AS tile_set, CASE s WHEN 'generic_sea' THEN 1 WHEN 'sea_coast' THEN 2 WHEN 'blockout_cliff' THEN 3 WHEN 'blockout_cliff_ends' THEN 4 WHEN 'river' THEN 5 WHEN 'river_start' THEN 6 WHEN 'canal' THEN 11 ELSE 10 END AS category, count(*) AS n
    FROM (SELECT CASE id % 9 WHEN 0 THEN 'generic_sea' WHEN 1 THEN 'sea_coast' WHEN 2 THEN 'blockout_cliff' WHEN 3 THEN 'blockout_cliff_ends' WHEN 4 THEN 'river' WHEN 5 THEN 'river_start' WHEN 6 THEN 'canal' WHEN 7 THEN 'unheard_of' END AS s FROM hexes) GROUP BY 1, 2""")
def tile_categories(v):
    sets = ["generic_sea", "sea_coast", "blockout_cliff", "blockout_cliff_ends", "river", "river_start", "canal", "unheard_of"]
    name = F.get(F.array(*map(F.lit, sets)), (F.col("id") % 9).cast("int"))
    return v("hexes").select(name.alias("tile_set")).groupBy("tile_set", filters.tile_category(F.col("tile_set")).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT 'm' || CAST(l_partkey % 13 AS VARCHAR) AS map FROM lineitem WHERE l_linenumber % 2 = 0
    UNION SELECT DISTINCT 'k' || CAST(l_suppkey % 7 AS VARCHAR) FROM lineitem WHERE l_linenumber % 2 = 1 AND l_suppkey % 7 <> 3""")
def map_discovery(v):
    k = F.col("l_suppkey") % 7
    path = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Terrain/campaigns/M"), (F.col("l_partkey") % 13).cast("string"), F.lit("/tiles.bin"))).otherwise(F.concat(F.lit("campaign_maps\\k"), k.cast("string"), F.when(k == 3, ".pack").otherwise(""), F.lit("\\x")))
    return filters.discover_maps(v("lineitem").select(path.alias("path")))


@query("SELECT id, road & 7 AS low, (road >> 3) & 7 AS high, (river >> 1) & 3 AS middle FROM hexes")
def bit_fields(v):
    cast = lambda c: c.cast("bigint")
    return v("hexes").select("id", cast(filters.bits(F.col("road"), 0, 3)).alias("low"), cast(filters.bits(F.col("road"), 3, 3)).alias("high"), cast(filters.bits(F.col("river"), 1, 2)).alias("middle"))


@query("""SELECT id, concat_ws(',', CASE WHEN road & 4 <> 0 THEN 'fog' END, CASE WHEN road & 1 <> 0 THEN 'tag2' END, CASE WHEN road & 2 <> 0 THEN 'tag10' END) AS tags FROM hexes""")
def tag_decode(v):
    return v("hexes").select("id", F.array_join(filters.names_of_mask(F.col("road"), ["tag2", "tag10", "fog"]), ",").alias("tags"))


@query("""SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey % 100, p_partkey) AS place FROM part""")
def natural_order(v):
    named = v("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("tile"), (F.col("p_partkey") % 100).cast("string"), F.lit("_x")).alias("name"))
    return ranked(named, filters.natural_key(F.col("name")), "id").select("id", (F.col("rank") + 1).alias("place"))


@query("SELECT id, CASE WHEN region_key LIKE '%1%' THEN 'city' WHEN region_key LIKE '%2%' THEN 'port' WHEN region_key LIKE '%3%' THEN 'mine_iron' END AS suggested FROM settlements")
def region_kinds(v):
    rows = v("settlements")
    layouts = rows.filter("region_key like '%1%' or region_key like '%2%'").select("region_key", F.when(F.col("region_key").like("%1%"), "settlement_land_layout_city_c").otherwise("port_layout_1").alias("layout"))
    buildings = rows.filter("region_key like '%3%'").select("region_key", F.lit("3k_resource_iron_1").alias("building"))
    from terralith.operators.regions import suggest_kind

    return suggest_kind(rows, layouts, buildings).select("id", F.split("kind", ":")[0].alias("suggested"))


@query(f"SELECT id, dir, ncol, nrow FROM ({NEIGHBOURS})")
def hex_neighbours(v):
    return neighbours(v("hexes")).select("id", F.col("dir").cast("int").alias("dir"), F.col("ncol").cast("bigint").alias("ncol"), F.col("nrow").cast("bigint").alias("nrow"))


@query("""WITH s AS (SELECT id, fx, fy, floor((fx + 0.75) / 1.125) AS c, (fx + 0.75) / 1.125 - floor((fx + 0.75) / 1.125) AS t FROM points),
    u AS (SELECT *, (fy + CASE WHEN CAST(c AS BIGINT) % 2 = 0 THEN 0.625 ELSE 0e0 END) / 1.25 AS a FROM s),
    w AS (SELECT id, CAST(c AS BIGINT) AS c, CAST(floor(a) AS BIGINT) AS r, t * 3 AS e, (a - floor(a) - 0.5) * 2 AS l FROM u),
    p AS (SELECT id, greatest(0, least(49, CASE WHEN e < 1 AND (l >= e OR -l >= e) THEN c - 1 ELSE c END)) AS col,
          greatest(0, least(299, CASE WHEN e < 1 AND l >= e THEN r + c % 2 WHEN e < 1 AND -l >= e THEN r + c % 2 - 1 ELSE r END)) AS row FROM w)
    SELECT p.id, p.col, p.row, h.region FROM p LEFT JOIN hexes h ON h.col = p.col AND h.row = p.row""")
def point_region(v):
    return spatial.point_region(v("points"), v("hexes"), 0.75, 0.625, 50, 300, "fx", "fy").select("id", "col", "row", "region")


@query("SELECT p.id, min(a.ordinal) AS ordinal FROM points p JOIN areas a ON p.x BETWEEN a.min_x AND a.max_x AND p.y BETWEEN a.min_y AND a.max_y GROUP BY p.id")
def first_box(v):
    return spatial.first_box(v("points"), v("areas"))


@query("""SELECT s.id, min(CASE WHEN list = 0 THEN a.ordinal END) AS std, min(CASE WHEN list = 1 THEN a.ordinal END) AS unf, min(CASE WHEN list = 2 THEN a.ordinal END) AS gate
    FROM settlements s LEFT JOIN areas a ON s.x BETWEEN a.min_x AND a.max_x AND s.y BETWEEN a.min_y AND a.max_y GROUP BY s.id""")
def settlement_lists(v):
    return spatial.boxes_by_list(v("settlements"), v("areas"), {"std": 0, "unf": 1, "gate": 2}).select("id", "std", "unf", "gate")


@query("SELECT a.id, b.id AS other FROM props a JOIN props b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 1")
def radius_join(v):
    return spatial.pairs_within(v("props").select("id", "x", "z"), 1.0)


@query("SELECT a.id FROM props a WHERE NOT EXISTS (SELECT 1 FROM props b WHERE b.id <> a.id AND (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 0.0625e0)")
def radius_anti_join(v):
    """Props with no other prop within a quarter: places are searched, each once, and a place of two ids holds none."""
    props = v("props").select("id", "x", "z")
    places = props.filter("x is not null and z is not null").groupBy("x", "z").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    single = places.filter("lo = hi").select("x", "z", F.col("lo").alias("id"))
    right = places.withColumnsRenamed({"x": "rx", "z": "rz"})
    near = spatial.within(single, right, 0.25).filter("lo <> id or hi <> id").select("x", "z")
    return props.join(places.filter("lo <> hi").select("x", "z").union(near), ["x", "z"], "left_anti").select("id")


@query("""SELECT rgb, name, distance FROM (SELECT h.rgb, p.name, greatest(abs((h.rgb >> 16 & 255) - (p.rgb >> 16 & 255)), abs((h.rgb >> 8 & 255) - (p.rgb >> 8 & 255)), abs((h.rgb & 255) - (p.rgb & 255))) AS distance,
    row_number() OVER (PARTITION BY h.rgb ORDER BY greatest(abs((h.rgb >> 16 & 255) - (p.rgb >> 16 & 255)), abs((h.rgb >> 8 & 255) - (p.rgb >> 8 & 255)), abs((h.rgb & 255) - (p.rgb & 255))), p.ordinal) AS k
    FROM (SELECT DISTINCT v * 251 % 16777216 AS rgb FROM raster) h CROSS JOIN palette p) WHERE k = 1""")
def nearest_colour(v):
    return spatial.nearest_colour(v("raster").selectExpr("v * 251 % 16777216 as rgb"), v("palette"))


_DIST = "greatest(abs(col - {x}), abs((row - (col - col % 2) // 2) - ({y} - ({x} - {x} % 2) // 2)), abs((-col - (row - (col - col % 2) // 2)) - (-{x} - ({y} - ({x} - {x} % 2) // 2))))"


@query(f"SELECT col, row, CAST(d AS BIGINT) AS distance FROM (SELECT col, row, {_DIST.format(x=17, y=11)} AS d FROM hexes WHERE cat = 3) ORDER BY d, col, row LIMIT 1")
def nearest_hex(v):
    return spatial.nearest_hex(v("hexes").filter("cat = 3"), (17, 11))


@query(f"SELECT col, row, CAST(d AS BIGINT) AS distance FROM (SELECT col, row, {_DIST.format(x=17, y=11)} AS d FROM hexes WHERE cat = 3) ORDER BY d, col DESC, row DESC LIMIT 1")
def nearest_hex_descending(v):
    return spatial.nearest_hex(v("hexes").filter("cat = 3"), (17, 11), (-F.col("col"), -F.col("row")))


@query(f"""WITH ok AS (SELECT col, row FROM hexes WHERE NOT impassable), b AS (SELECT min(col) AS x0, max(col) AS x1, min(row) AS y0, max(row) AS y1 FROM ok),
    t AS (SELECT 0 AS landmark, x0 AS tx, y0 AS ty FROM b UNION ALL SELECT 1, (x0 + x1) // 2, y0 FROM b UNION ALL SELECT 2, x1, y0 FROM b UNION ALL SELECT 3, x0, (y0 + y1) // 2 FROM b
          UNION ALL SELECT 4, x1, (y0 + y1) // 2 FROM b UNION ALL SELECT 5, x0, y1 FROM b UNION ALL SELECT 6, (x0 + x1) // 2, y1 FROM b UNION ALL SELECT 7, x1, y1 FROM b),
    d AS (SELECT landmark, col, row, {_DIST.format(x="tx", y="ty")} AS d FROM ok CROSS JOIN t)
    SELECT landmark, col, row, CAST(d AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY landmark ORDER BY d, col, row) AS k FROM d) WHERE k = 1""")
def landmarks(v):
    return spatial.landmarks(v("hexes"))


@query("SELECT layer, count(*) FILTER (sqrt((x - 20) * (x - 20) + (z - 100) * (z - 100)) < 4) AS near FROM props GROUP BY layer ORDER BY near DESC, min(sqrt((x - 20) * (x - 20) + (z - 100) * (z - 100))), layer LIMIT 1")
def layer_at_point(v):
    return spatial.layer_at_point(v("props"), 20.0, 100.0).select("layer", "near")


FOOT = """c AS (SELECT t.*, dx, dy FROM tiles t CROSS JOIN (SELECT unnest(range(0, 3)) AS dx) CROSS JOIN (SELECT unnest(range(0, 3)) AS dy)
        WHERE dx < CASE WHEN rot IN (32, 128) THEN h ELSE w END AND dy < CASE WHEN rot IN (32, 128) THEN w ELSE h END),
    i AS (SELECT *, CASE rot WHEN 16 THEN dx WHEN 32 THEN dy WHEN 64 THEN w - 1 - dx ELSE w - 1 - dy END * h + CASE rot WHEN 16 THEN dy WHEN 32 THEN h - 1 - dx WHEN 64 THEN h - 1 - dy ELSE dx END AS bit FROM c),
    foot AS (SELECT ordinal, x + dx AS cx, y + dy AS cy FROM i WHERE (mask >> CAST(bit AS INTEGER)) & 1 = 1)"""


@query(f"WITH {FOOT} SELECT ordinal, cx, cy FROM foot")
def tile_footprint(v):
    return spatial.footprint(v("tiles")).select("ordinal", "cx", "cy")


@query(f"WITH {FOOT} SELECT cx, cy, count(DISTINCT ordinal) AS tiles, min(ordinal) AS first, NOT (cx BETWEEN 0 AND 39 AND cy BETWEEN 0 AND 49) AS off_map FROM foot GROUP BY cx, cy HAVING count(DISTINCT ordinal) > 1 OR NOT (cx BETWEEN 0 AND 39 AND cy BETWEEN 0 AND 49)")
def tile_conflicts(v):
    return spatial.conflicts(spatial.footprint(v("tiles")), 40, 50)


@query(f"WITH {FOOT} SELECT p.id, min(ordinal) AS ordinal FROM points p JOIN foot ON cx = x AND cy = y GROUP BY p.id")
def tile_under_point(v):
    return spatial.first_tile_at(v("points"), spatial.footprint(v("tiles")))


@query("SELECT p.id, max(a.ordinal * 7 % 101) AS top FROM points p JOIN areas a ON p.x BETWEEN a.min_x AND a.max_x AND p.y BETWEEN a.min_y AND a.max_y GROUP BY p.id")
def patch_highest(v):
    return spatial.highest_box(v("points"), v("areas").withColumn("top", F.expr("ordinal * 7 % 101")), "top")


@query("SELECT count(*) AS uncovered FROM hexes h WHERE NOT impassable AND NOT EXISTS (SELECT 1 FROM areas a WHERE h.col BETWEEN min_x AND max_x AND h.row BETWEEN min_y AND max_y AND list = 3)")
def coverage_count(v):
    return spatial.uncovered(v("hexes").filter("not impassable").selectExpr("col as x", "row as y"), v("areas").filter("list = 3")).agg(F.count("*").alias("uncovered"))


@query("""SELECT path, id, priority FROM (SELECT lower(p_type) AS path, p_partkey AS id, p_size % 3 AS priority, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_size % 3, p_partkey) AS k FROM part) WHERE k = 1""")
def asset_overlay(v):
    rows = v("part").select(F.lower("p_type").alias("path"), F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("priority"), F.col("p_partkey").alias("ordinal"))
    return spatial.overlay(rows).select("path", "id", "priority")


@query("SELECT m.model, m.problem, CASE WHEN m.problem = 'no meshes' THEN 'info' ELSE 'error' END AS severity, count(*) AS uses FROM props p JOIN models m ON m.model = p.model WHERE m.problem IS NOT NULL GROUP BY 1, 2, 3")
def asset_check(v):
    rows = v("props").groupBy("model").agg(F.count("*").alias("uses")).join(v("models"), "model").filter("problem is not null")
    return rows.select("model", "problem", F.when(F.col("problem") == "no meshes", "info").otherwise("error").alias("severity"), "uses")


@query("SELECT coalesce(b.id, o.id) AS id, CASE WHEN b.id IS NOT NULL AND o.id IS NOT NULL THEN 'replaced' WHEN o.id IS NOT NULL THEN 'added' WHEN b.id % 2 = 0 THEN 'dropped' ELSE 'kept' END AS action, CASE WHEN o.id IS NOT NULL THEN o.a ELSE b.a END AS a FROM base_t b FULL OUTER JOIN theirs_t o ON b.id = o.id")
def base_override(v):
    return spatial.base_override(v("base_t"), v("theirs_t"), replaced=F.col("id") % 2 == 0).select("id", "action", "row.a")


@query("SELECT x.n, x.id AS left_id, y.id AS right_id, x.a IS NOT DISTINCT FROM y.a AS same FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM ours_t) x FULL OUTER JOIN (SELECT *, row_number() OVER (ORDER BY id) AS n FROM theirs_t) y ON x.n = y.n WHERE x.n IS NOT NULL")
def positional_compare(v):
    x, y = (ranked(v(t), "id").withColumn("n", F.col("rank") + 1).select("n", F.col("id").alias(f"{s}_id"), F.col("a").alias(f"{s}_a")) for t, s in (("ours_t", "left"), ("theirs_t", "right")))
    return x.join(y, "n", "left").select("n", "left_id", "right_id", F.col("left_a").eqNullSafe(F.col("right_a")).alias("same"))


@query("SELECT DISTINCT o.id FROM ours_t o WHERE NOT EXISTS (SELECT 1 FROM theirs_t t WHERE t.id = o.id)")
def unused_layers(v):
    return v("ours_t").join(v("theirs_t"), "id", "left_anti").select("id").distinct()


@query("""WITH RECURSIVE up AS (SELECT id, id AS top, 0 AS depth FROM entities WHERE parent IS NULL OR id % 40 = 0 UNION ALL SELECT e.id, u.top, u.depth + 1 FROM entities e JOIN up u ON e.parent = u.id WHERE e.id % 40 <> 0 AND u.depth < 30)
    SELECT top, count(*) AS members FROM up GROUP BY top""")
def layer_closure(v):
    from terralith.operators.graph import closure

    e = v("entities")
    return closure(e.filter("parent is null or id % 40 = 0").select("id"), e.filter("id % 40 <> 0").select("id", "parent")).groupBy("top").agg(F.count("*").alias("members"))
