"""Queries: entity classes, prefabs and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import scene
from terralith.plans.registry import query


@query("SELECT p_type AS name FROM part WHERE p_size % 3 = 0 OR p_size % 3 = 1 AND p_size % 2 = 0 GROUP BY p_type")
def types_allowed(v):
    rule = F.struct(F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 3 == 1, "campaign").otherwise("battle").alias("kind"), F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 2 == 0, "main").otherwise("other").alias("database"))
    types = v("part").groupBy(F.col("p_type").alias("name")).agg(F.collect_set(rule).alias("allow"))
    return scene.allowed_types(types, "campaign", "main").select("name")


_COMPS = "list_filter([CASE WHEN road & 1 <> 0 THEN 'a' END, CASE WHEN road & 2 <> 0 THEN 'b' END, CASE WHEN road & 4 <> 0 THEN 'c' END, CASE WHEN road & 8 <> 0 THEN 'd' END], lambda c: c IS NOT NULL)"


@query(f"""WITH e AS (SELECT id, {_COMPS} AS comps FROM hexes), t AS (SELECT * FROM (VALUES ('x', 0, ['a', 'b']), ('y', 1, ['a', 'b', 'c']), ('z', 2, ['d']), ('w', 3, ['c', 'd'])) AS t(type, ordinal, comps)),
    p AS (SELECT e.id, t.type, t.ordinal, len(list_intersect(e.comps, t.comps)) AS shared, len(t.comps) - len(list_intersect(e.comps, t.comps)) AS missing FROM e CROSS JOIN t)
    SELECT id, type, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, missing, ordinal) AS k FROM p) WHERE k = 1""")
def class_match(v):
    spark = v("region").sparkSession
    comps = F.filter(F.array(*[F.when(F.col("road").bitwiseAND(1 << k) != 0, n) for k, n in enumerate("abcd")]), lambda c: c.isNotNull())
    types = spark.sql("select * from values ('x', 0, array('a', 'b')), ('y', 1, array('a', 'b', 'c')), ('z', 2, array('d')), ('w', 3, array('c', 'd')) as t(type, ordinal, comps)")
    return scene.match_class(v("hexes").select("id", comps.alias("comps")), types)


_MEMBERS = "m AS (SELECT p_partkey // 5 AS prefab, p_partkey AS member, CASE WHEN p_partkey % 3 = 0 AND p_partkey // 5 % 12 < 9 THEN p_partkey // 5 + 3 END AS ref, CAST(p_size AS DOUBLE) AS dx, CAST(p_size % 7 AS DOUBLE) AS dz FROM part)"


@query(f"""WITH RECURSIVE {_MEMBERS}, w AS (SELECT s_suppkey AS instance, s_suppkey % 40 AS prefab, CAST(s_nationkey AS DOUBLE) AS x, 1e0 AS z, 0 AS depth FROM supplier UNION ALL SELECT w.instance, m.ref, w.x + m.dx, w.z + m.dz, w.depth + 1 FROM w JOIN m ON m.prefab = w.prefab WHERE m.ref IS NOT NULL AND w.depth < 7)
    SELECT w.instance, m.member, w.x + m.dx AS x, w.z + m.dz AS z, w.depth + 1 AS depth FROM w JOIN m ON m.prefab = w.prefab WHERE m.ref IS NULL""")
def prefab_expansion(v):
    members = v("part").selectExpr("p_partkey div 5 as prefab", "p_partkey as member", "case when p_partkey % 3 = 0 and p_partkey div 5 % 12 < 9 then p_partkey div 5 + 3 end as ref", "cast(p_size as double) as dx", "cast(p_size % 7 as double) as dz")
    instances = v("supplier").selectExpr("s_suppkey as id", "s_suppkey % 40 as prefab", "cast(s_nationkey as double) as x", "1D as z")
    return scene.expand_prefabs(instances, members).drop("path")


@query("SELECT l_partkey AS instance, l_linenumber AS member, arg_max(l_quantity, (l_orderkey * 8 + l_linenumber) * 100 + l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def last_overrides(v):
    return scene.last_overrides(v("lineitem").selectExpr("l_partkey as instance", "l_linenumber as member", "l_quantity as value", "(l_orderkey * 8 + l_linenumber) * 100 + l_quantity as ordinal"))


@query("SELECT p_name AS key, count(*) AS paths, arg_min(p_brand, p_partkey) AS used FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_keys(v):
    return scene.duplicate_keys(v("part").selectExpr("p_name as key", "p_brand as path", "p_partkey as ordinal"))


@query("SELECT min(col) AS min_col, max(col) AS max_col, min(row) AS min_row, max(row) AS max_row FROM hexes WHERE id % 97 = 5 AND cat > 3")
def edit_bounds(v):
    h = v("hexes")
    return scene.edit_bounds(h, h.withColumn("cat", F.expr("case when id % 97 = 5 and cat > 3 then cat - 1 else cat end")), "cat")


@query("SELECT avg(CASE WHEN v % 5 = 0 THEN 0e0 ELSE 1e0 END) * 100 AS percent FROM raster")
def percent_equal(v):
    r = v("raster")
    return scene.share_equal(r, r.selectExpr("x", "y", "case when v % 5 = 0 then null else v end as v"), ["x", "y"], "v")


@query("SELECT cat, id % 37 = 0 AS edited, count(*) AS n FROM hexes GROUP BY 1, 2")
def edited_split(v):
    h = v("hexes")
    return scene.split_by_edit(h, h.filter("id % 37 = 0")).groupBy("cat", "edited").agg(F.count("*").alias("n"))


@query("SELECT l.l_orderkey, l.l_linenumber, t.mask AS tile_mask FROM lineitem l LEFT JOIN (SELECT lower(path) AS key, arg_min(mask, ordinal) AS mask FROM tiles GROUP BY 1) t ON t.key = lower(CASE WHEN l_linenumber % 2 = 0 THEN 'PROMO' ELSE 'unheard/of' END)")
def tile_masks(v):
    tiles = v("tiles").select(F.lower("path").alias("key"), "mask", "ordinal")
    path = F.when(F.col("l_linenumber") % 2 == 0, "PROMO").otherwise("unheard/of")
    return scene.tile_masks(v("lineitem"), tiles, path).select("l_orderkey", "l_linenumber", "tile_mask")


@query("SELECT problem, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT m.problem, count(*) AS n FROM props p JOIN models m ON m.model = p.model WHERE problem IS NOT NULL GROUP BY m.problem) ORDER BY n DESC, problem LIMIT 15")
def asset_census(v):
    return scene.census(v("props").join(v("models"), "model"))


@query("WITH RECURSIVE f AS (SELECT id, parent FROM entities WHERE contains(lower(name), 'error_9') UNION SELECT e.id, e.parent FROM entities e JOIN f ON f.parent = e.id) SELECT id FROM f")
def layer_tree_filter(v):
    return scene.match_layers(v("entities"), "Error_9")
