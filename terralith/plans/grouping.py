"""Queries: aggregates, windows, sets, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terralith.operators import aggregates as agg
from terralith.operators import regions, spatial
from terralith.operators.ranks import ranked
from terralith.plans.registry import query

_MODE = "SELECT {k}, {v} FROM (SELECT {k}, {v}, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, min(ordinal)) AS rk FROM {t} GROUP BY {k}, {v}) WHERE rk = 1"


@query("SELECT type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, type) AS place FROM entities GROUP BY type")
def type_counts(v):
    return v("entities").groupBy("type").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "type")).cast("bigint"))


@query("SELECT layer, kind, count(*) AS n, min(CASE WHEN kind = 'prop' THEN x END) AS min_x, max(CASE WHEN kind = 'prop' THEN x END) AS max_x, min(CASE WHEN kind = 'prop' THEN z END) AS min_z, max(CASE WHEN kind = 'prop' THEN z END) AS max_z FROM props GROUP BY layer, kind")
def layer_summary(v):
    objects = lambda f, c: f(F.when(F.col("kind") == "prop", F.col(c))).alias(f"{f.__name__}_{c}")
    return v("props").groupBy("layer", "kind").agg(F.count("*").alias("n"), objects(F.min, "x"), objects(F.max, "x"), objects(F.min, "z"), objects(F.max, "z"))


@query(f"SELECT a.model, a.uses, a.mean_scale, m.layer FROM (SELECT model, count(*) AS uses, avg(scale) AS mean_scale FROM props GROUP BY model) a JOIN ({_MODE.format(k='model', v='layer', t='props')}) m ON m.model = a.model")
def asset_usage(v):
    return agg.asset_usage(v("props"))


@query("""WITH s AS (SELECT layer, list_sort(list(y)) AS l FROM props GROUP BY layer)
    SELECT layer, len(l) AS n, l[1 + CAST(floor(0.01 * (len(l) - 1)) AS BIGINT)] AS p1, l[1 + CAST(floor(0.05 * (len(l) - 1)) AS BIGINT)] AS p5, l[1 + CAST(floor(0.5 * (len(l) - 1)) AS BIGINT)] AS median,
    l[1 + CAST(floor(0.95 * (len(l) - 1)) AS BIGINT)] AS p95, l[1 + CAST(floor(0.99 * (len(l) - 1)) AS BIGINT)] AS p99 FROM s""")
def height_quantiles(v):
    return agg.indexed_quantiles(v("props"), ["layer"], "y", {"p1": 0.01, "p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99})


@query("WITH s AS (SELECT model, list_sort(list(y)) AS l FROM props GROUP BY model) SELECT model, len(l) AS n, l[1 + len(l) // 2] AS median FROM s")
def upper_median(v):
    return agg.upper_median(v("props"), ["model"], "y")


@query("SELECT model, median(y - ground) AS sink, count(*) AS n FROM props WHERE kind = 'prop' GROUP BY model HAVING count(*) >= 20")
def model_sink(v):
    return v("props").filter("kind = 'prop'").groupBy("model").agg(F.median(F.col("y") - F.col("ground")).alias("sink"), F.count("*").alias("n")).filter("n >= 20")


@query("""SELECT comp, field, CASE field WHEN 'k' THEN 'Int' WHEN 'flag' THEN 'Bool' WHEN 'position' THEN 'Vec3' ELSE 'Enum' END AS type, count(*) AS n, count(DISTINCT val) AS distinct_values,
    CASE WHEN count(DISTINCT val) <= 40 THEN (SELECT g.val FROM fields g WHERE g.comp = f.comp AND g.field = f.field GROUP BY g.val ORDER BY count(*) DESC, min(g.id) LIMIT 1) ELSE '0 0 0' END AS default_value FROM fields f GROUP BY comp, field""")
def schema_inference(v):
    return agg.infer_schema(v("fields"))


@query("""WITH l AS (SELECT id, string_agg(DISTINCT comp, ',' ORDER BY comp) AS layout FROM fields GROUP BY id), c AS (SELECT type, layout, count(*) AS n FROM l JOIN entities USING (id) GROUP BY type, layout)
    SELECT type, layout, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY n DESC, layout) AS INTEGER) AS rank FROM c) WHERE rank <= 12""")
def entity_templates(v):
    return agg.templates(v("fields"), v("entities"))


@query("SELECT ordinal, val, n, CAST(coalesce(sum(n) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM rle")
def rle_offsets(v):
    return agg.running_offsets(v("rle")).select("ordinal", "val", "n", "start")


@query("WITH o AS (SELECT ordinal, val, n, coalesce(sum(n) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM rle) SELECT val, count(*) AS cells, CAST(sum(s + i) AS BIGINT) AS total FROM o, (SELECT unnest(range(0, 50)) AS i) WHERE i < n GROUP BY val")
def rle_expand(v):
    return agg.expand_runs(v("rle")).groupBy("val").agg(F.count("*").alias("cells"), F.sum("pos").alias("total"))


@query("SELECT p_type AS type, arg_min(p_partkey, p_partkey) AS first_id, arg_max(p_partkey, p_partkey) AS last_id, arg_min(p_name, p_partkey) AS first_name, arg_max(p_name, p_partkey) AS last_name FROM part GROUP BY p_type")
def first_and_last(v):
    rows = v("part").select(F.col("p_type").alias("type"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))
    a = agg.first_rows(rows.withColumn("id", F.col("ordinal")), ["type"]).select("type", F.col("id").alias("first_id"), F.col("name").alias("first_name"))
    b = agg.last_rows(rows.withColumn("id", F.col("ordinal")), ["type"]).select("type", F.col("id").alias("last_id"), F.col("name").alias("last_name"))
    return a.join(b, "type")


@query("SELECT id, copies, first_id FROM (SELECT id, row_number() OVER w AS k, count(*) OVER (PARTITION BY x, z, model) AS copies, first_value(id) OVER w AS first_id FROM (SELECT id, floor(x) AS x, floor(z / 4) AS z, model FROM props) WINDOW w AS (PARTITION BY x, z, model ORDER BY id)) WHERE k > 1")
def later_copies(v):
    rows = v("props").select("id", "ordinal", F.floor("x").alias("x"), F.floor(F.col("z") / 4).alias("z"), "model")
    return agg.later_copies(rows, ["x", "z", "model"]).select("id", "copies", "first_id")


@query("SELECT id, y, y - avg(y) OVER (PARTITION BY model) AS gap FROM props")
def group_statistic(v):
    return v("props").select("id", "y", (F.col("y") - F.avg("y").over(Window.partitionBy("model"))).alias("gap"))


@query("SELECT id, number FROM (SELECT id, row_number() OVER (ORDER BY m DESC, id) AS number FROM (SELECT id, max(id) OVER (PARTITION BY layer) AS m FROM props))")
def river_numbers(v):
    from terralith.operators.graph import ordered_parts

    return ordered_parts(v("props").select("id", "layer"), "layer", "id").select("id", F.col("number").cast("bigint").alias("number"))


@query("SELECT cat, count(*) AS hexes, list_slice(list_sort(list(id)), 1, 200) AS listed FROM hexes GROUP BY cat")
def listed_hexes(v):
    """At most 200 ids a group are listed, beside the full count: the feature's own bound, kept while grouping."""
    ranked = v("hexes").withColumn("k", F.row_number().over(Window.partitionBy("cat").orderBy("id")))
    return ranked.groupBy("cat").agg(F.count("*").alias("hexes"), F.sort_array(F.collect_list(F.when(F.col("k") <= 200, F.col("id")))).alias("listed"))


@query("SELECT model, layer, count(*) AS uses FROM props GROUP BY model, layer ORDER BY uses DESC, model, layer LIMIT 30")
def top_assets(v):
    return v("props").groupBy("model", "layer").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "model", "layer").limit(30)


@query("SELECT id FROM ours_t UNION SELECT id FROM theirs_t")
def key_union(v):
    return v("ours_t").select("id").union(v("theirs_t").select("id")).distinct()


@query("SELECT a, b, count(*) AS n FROM (SELECT a, b FROM ours_t EXCEPT ALL SELECT a, b FROM theirs_t) GROUP BY a, b")
def row_difference(v):
    return v("ours_t").select("a", "b").exceptAll(v("theirs_t").select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS common FROM (SELECT id, a, b FROM ours_t INTERSECT SELECT id, a, b FROM theirs_t)")
def row_intersection(v):
    return v("ours_t").intersect(v("theirs_t")).agg(F.count("*").alias("common"))


@query("SELECT a, b, least(x.n, y.n) AS common FROM (SELECT a, b, count(*) AS n FROM ours_t GROUP BY a, b) x JOIN (SELECT a, b, count(*) AS n FROM theirs_t GROUP BY a, b) y USING (a, b)")
def multiset_common(v):
    return agg.multiset_common(v("ours_t"), v("theirs_t"), ["a", "b"])


@query("""WITH b AS (SELECT unnest(range(0, 6)) AS bit) SELECT bit, count(*) AS n FROM hexes, b WHERE (road >> CAST(bit AS INTEGER)) & 1 = 1 AND slot >= 0 GROUP BY bit ORDER BY n DESC, bit LIMIT 1""")
def land_bit(v):
    bits = v("hexes").filter("slot >= 0").select(F.explode(F.expr("filter(sequence(0L, 5L), b -> (road >> cast(b as int)) & 1 = 1)")).alias("bit"))
    return bits.groupBy("bit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bit").limit(1)


@query("SELECT p_brand AS name, list_sort(list(DISTINCT p_type)) AS origins, count(*) AS packs FROM part GROUP BY p_brand")
def catalogue_merge(v):
    return v("part").groupBy(F.col("p_brand").alias("name")).agg(F.sort_array(F.collect_set("p_type")).alias("origins"), F.count("*").alias("packs"))


@query("""WITH s AS (SELECT l_partkey % 97 AS tree, l_linenumber % 5 AS season, arg_max(l_quantity, (l_orderkey * 8 + l_linenumber) * 100 + l_quantity) AS q FROM lineitem GROUP BY 1, 2)
    SELECT tree, list(season ORDER BY season = 0, season) AS seasons FROM s WHERE q > 20 GROUP BY tree""")
def tree_seasons(v):
    """Latest row of each season wins; its seasons ascend, the default one (0) last."""
    rows = v("lineitem").select((F.col("l_partkey") % 97).alias("tree"), (F.col("l_linenumber") % 5).alias("season"), F.col("l_quantity").alias("q"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("ordinal"))
    last = agg.last_rows(rows, ["tree", "season"]).filter("q > 20")
    return last.groupBy("tree").agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("season") == 0).alias("d"), "season"))), lambda s: s["season"]).alias("seasons"))


@query("SELECT p_size % 4 AS set, min(p_partkey % 50) - 128 AS lo, max(p_partkey % 50) + 128 AS hi FROM part GROUP BY 1")
def field_bounds(v):
    return v("part").groupBy((F.col("p_size") % 4).alias("set")).agg((F.min(F.col("p_partkey") % 50) - 128).alias("lo"), (F.max(F.col("p_partkey") % 50) + 128).alias("hi"))


@query("SELECT coalesce(x.a, '') = coalesce(y.a, '') AS same, count(*) AS n FROM ours_t x JOIN theirs_t y USING (id) GROUP BY 1")
def parity_counts(v):
    y = v("theirs_t").select("id", F.col("a").alias("ya"))
    return v("ours_t").join(y, "id").groupBy((F.coalesce("a", F.lit("")) == F.coalesce("ya", F.lit(""))).alias("same")).agg(F.count("*").alias("n"))


_NEAR = "SELECT u.rgb, u.n, p.name, greatest(abs((u.rgb >> 16 & 255) - (p.rgb >> 16 & 255)), abs((u.rgb >> 8 & 255) - (p.rgb >> 8 & 255)), abs((u.rgb & 255) - (p.rgb & 255))) AS distance, p.ordinal FROM u CROSS JOIN palette p"


@query(f"""WITH h AS (SELECT (v % 700 * 7919 + v % 3) % 16777216 AS rgb FROM raster), u AS (SELECT rgb, count(*) AS n FROM h WHERE rgb NOT IN (SELECT rgb FROM palette) GROUP BY rgb), d AS ({_NEAR})
    SELECT rgb, n, name, distance, CASE WHEN rgb = 0 THEN 'black' WHEN n < 10 OR n < 500 AND distance <= 8 THEN 'stray' ELSE 'unknown' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY rgb ORDER BY distance, ordinal) AS k FROM d) WHERE k = 1""")
def unknown_colours(v):
    return agg.colour_report(v("raster").selectExpr("(v % 700 * 7919 + v % 3) % 16777216 as rgb"), v("palette"), spatial.nearest_colour)


@query("SELECT s.cat, coalesce(h.n, 0) AS hexes, s.parts, s.cat IN (1, 2, 3, 4) AS coast FROM (SELECT p_size % 15 AS cat, count(*) AS parts FROM part GROUP BY 1) s LEFT JOIN (SELECT cat, count(*) AS n FROM hexes GROUP BY cat) h ON h.cat = s.cat")
def set_usage(v):
    sets = v("part").groupBy((F.col("p_size") % 15).alias("cat")).agg(F.count("*").alias("parts"))
    used = v("hexes").groupBy("cat").agg(F.count("*").alias("n"))
    return sets.join(used, "cat", "left").select("cat", F.coalesce("n", F.lit(0)).alias("hexes"), "parts", F.col("cat").isin(1, 2, 3, 4).alias("coast"))


@query("""WITH w AS (SELECT 'list' AS src, x AS col, y AS row FROM points WHERE id % 5 = 0 UNION ALL SELECT 'rect', c, r FROM (SELECT unnest(range(3, 9)) AS c), (SELECT unnest(range(2, 5)) AS r))
    SELECT src, w.col, w.row, h.cat, h.id IS NULL AS outside FROM w LEFT JOIN hexes h ON h.col = w.col AND h.row = w.row""")
def tile_lookup(v):
    from terralith.operators.graph import rectangle

    listed = v("points").filter("id % 5 = 0").select(F.lit("list").alias("src"), F.col("x").alias("col"), F.col("y").alias("row"))
    asked = listed.unionByName(rectangle(listed.sparkSession, 3, 2, 8, 4).select(F.lit("rect").alias("src"), "col", "row"))
    return asked.join(v("hexes").select("col", "row", "cat", "id"), ["col", "row"], "left").select("src", "col", "row", "cat", F.col("id").isNull().alias("outside"))


@query("SELECT id, (x - 10) * (x - 10) + (z - 50) * (z - 50) AS d2 FROM props WHERE kind = 'prop' ORDER BY d2, id LIMIT 25")
def nearest_props(v):
    return v("props").filter("kind = 'prop'").select("id", F.expr("(x - 10) * (x - 10) + (z - 50) * (z - 50)").alias("d2")).orderBy("d2", "id").limit(25)


@query("""SELECT id, 'v' || CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || '.' || CAST(c AS VARCHAR) || ['', '-1', '-2', '-10', '-alpha', '-alpha.1', '-beta'][k + 1] AS version, row_number() OVER (ORDER BY a, b, c, CASE WHEN k = 0 THEN 7 ELSE k END, id) AS place
    FROM (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % 12 AS a, p_size % 3 AS b, p_partkey * 7 % 21 AS c, p_partkey // 12 % 7 AS k FROM part)""")
def version_order(v):
    parts = F.concat_ws(".", *[F.expr(f"cast({e} as string)") for e in ("p_partkey % 12", "p_size % 3", "p_partkey * 7 % 21")])
    pre = F.element_at(F.array(*map(F.lit, ["", "-1", "-2", "-10", "-alpha", "-alpha.1", "-beta"])), F.expr("cast(p_partkey div 12 % 7 + 1 as int)"))
    rows = v("part").select(F.col("p_partkey").cast("bigint").alias("id"), F.concat(F.lit("v"), parts, pre).alias("version"))
    return ranked(rows, agg.semver_key(F.col("version")), "id").select("id", "version", (F.col("rank") + 1).alias("place"))


@query("SELECT x.b AS section, CASE WHEN x.l = y.l THEN 'equal' WHEN x.s = y.s THEN 'reordered' WHEN len(x.l) <> len(y.l) THEN 'count differs' ELSE 'differs' END AS verdict FROM (SELECT b, list(a ORDER BY id) AS l, list_sort(list(a)) AS s FROM ours_t GROUP BY b) x JOIN (SELECT b, list(a ORDER BY id DESC) AS l, list_sort(list(a)) AS s FROM base_t GROUP BY b) y ON x.b = y.b")
def section_compare(v):
    from terralith.operators.merge import compare_sections

    return compare_sections(v("ours_t").withColumn("o", F.col("id")), v("base_t").withColumn("o", -F.col("id")), "b", "a", "o").withColumnRenamed("b", "section")


@query("SELECT id, kind FROM (SELECT s.id, CASE WHEN s.x > 49 OR s.y > 29 THEN 'OffGrid' WHEN s.kind = 3 THEN CASE WHEN g IS NULL THEN 'NoCatchment' ELSE 'Ok' END WHEN t IS NULL AND u IS NULL THEN 'NoCatchment' WHEN t IS NULL OR u IS NULL THEN 'PartialCatchment' WHEN s.id % 6 = 0 THEN 'RedirectMissing' WHEN s.id % 6 = 1 THEN 'RedirectInvalid' WHEN s.kind = 0 AND s.id % 6 = 2 THEN 'WrongType' ELSE 'Ok' END AS kind FROM settlements s LEFT JOIN (SELECT s.id, min(CASE WHEN list = 0 THEN a.ordinal END) AS t, min(CASE WHEN list = 1 THEN a.ordinal END) AS u, min(CASE WHEN list = 2 THEN a.ordinal END) AS g FROM settlements s JOIN areas a ON s.x BETWEEN a.min_x AND a.max_x AND s.y BETWEEN a.min_y AND a.max_y GROUP BY s.id) c ON c.id = s.id)")
def region_status(v):
    rows = spatial.boxes_by_list(v("settlements"), v("areas"), {"std": 0, "unf": 1, "gate": 2})
    folders = regions.folder_table(rows.sparkSession).withColumnRenamed("kind", "found_kind").select("found_kind", F.col("std").alias("std_folder"), F.col("unf").alias("unf_folder"))
    pick = F.when(F.col("id") % 6 == 0, "").when(F.col("id") % 6 == 1, "nowhere").when(F.col("id") % 6 == 2, "settlement_city_han_b_small_walled").otherwise("settlement_city_han_a_small_walled")
    own = rows.select("*", (F.col("kind") == 3).alias("is_gate"), pick.alias("std_folder"), F.when(F.col("kind") == 0, "city:a").alias("wanted"))
    both = own.drop("kind").withColumnRenamed("wanted", "kind").join(folders.drop("unf_folder"), "std_folder", "left").withColumn("unf_folder", F.col("std_folder"))
    return regions.status(both, 50, 30).select("id", F.col("status").alias("kind"))


@query("SELECT id, greatest(x - 7, 0) AS min_x, greatest(y - 7, 0) AS min_y, least(x + 7, 49) AS max_x, least(y + 7, 29) AS max_y FROM settlements s WHERE x BETWEEN 0 AND 49 AND y BETWEEN 0 AND 29 AND NOT EXISTS (SELECT 1 FROM areas a WHERE list = 2 AND s.x BETWEEN min_x AND max_x AND s.y BETWEEN min_y AND max_y)")
def siege_boxes(v):
    return regions.siege_boxes(spatial.boxes_by_list(v("settlements"), v("areas"), {"std": 2}), 50, 30)


@query("""WITH t AS (SELECT id, region_key AS k FROM settlements), f AS (SELECT id, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS fnv FROM t) SELECT id, CAST(fnv AS BIGINT) AS fnv FROM f""")
def row_ids(v):
    return v("settlements").select("id", regions.fnv1a(F.col("region_key")).alias("fnv"))
