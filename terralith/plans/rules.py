"""Queries: base tiles, map findings, brushes, orders of sequences, bulk edits, file parity."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from terralith.operators import filters, merge, raster, validator
from terralith.plans.registry import SQL, query

_PATH = "concat(CASE ordinal % 3 WHEN 0 THEN 'terrain/tiles/Campaign//' WHEN 1 THEN 'terrain/campaign/' ELSE 'terrain/battle/' END, CASE ordinal % 5 WHEN 0 THEN 'Generic' WHEN 1 THEN 'generic_sea' WHEN 2 THEN 'mountains_high' WHEN 3 THEN 'roads_paved' ELSE 'sea_coast' END, '/', path)"


@query(f"SELECT ordinal FROM (SELECT ordinal, regexp_extract(lower({_PATH}), '(?:^|/)campaign/+([^/]+)', 1) AS f FROM tiles) WHERE f IN ('generic', 'generic_sea', 'sea_coast') OR f LIKE 'mountains%'")
def base_tiles(v):
    return v("tiles").withColumn("path", F.expr(_PATH)).filter(filters.base_tile(F.col("path"))).select("ordinal")


@query("SELECT s.id, NOT EXISTS (SELECT 1 FROM settlements k WHERE k.kind = 1 AND k.region_key = s.region_key) AS is_new FROM settlements s")
def new_settlements(v):
    rows = v("settlements")
    return filters.is_new(rows, rows.filter("kind = 1"), "region_key", "3k_").select("id", "is_new")


@query("SELECT p.id, p.y + least(0e0, p.scale * m.min_y) - p.ground AS above FROM props p JOIN models m ON m.model = p.model WHERE p.y + least(0e0, p.scale * m.min_y) - p.ground > 1.5e0")
def floating_props(v):
    return raster.floating(v("props").join(v("models"), "model"), 1.5).select("id", "above")


_RULES = SQL["tile_rules"][SQL["tile_rules"].index("), e AS (") + 3 :]
_EDITED = "SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN 8 ELSE cat END AS cat) FROM hexes"


@query(f"SELECT id, code FROM (WITH edited AS ({_EDITED}), {re.sub(r'\bhexes\b', 'edited', _RULES)}) EXCEPT SELECT id, code FROM (WITH {_RULES})")
def new_findings(v):
    hexes = v("hexes")
    edited = hexes.withColumn("cat", F.expr("case when id % 97 = 0 then 8 else cat end"))
    return validator.new_findings(validator.rules(hexes), validator.rules(edited)).select("id", "code")


@query("SELECT ordinal, CASE WHEN w % 2 = 1 OR h % 2 = 0 THEN 'layout.size' ELSE 'layout.mesh_columns' END AS code FROM (SELECT ordinal, max_x - min_x + ordinal % 2 AS w, max_y - min_y + ordinal % 3 AS h FROM areas) WHERE w % 2 = 1 OR h % 2 = 0 OR w // 2 % 4 <> 0")
def layout_findings(v):
    images = v("areas").selectExpr("ordinal", "max_x - min_x + ordinal % 2 as width", "max_y - min_y + ordinal % 3 as height")
    return validator.layout(images).select("ordinal", "code")


@query("SELECT a.x, a.y, round(min(greatest(abs(a.x - b.x), abs(a.y - b.y)) + (sqrt(2e0) - 1) * least(abs(a.x - b.x), abs(a.y - b.y))), 6) AS d FROM raster a JOIN (SELECT x + dx AS kx, y + dy AS ky, x, y FROM (SELECT x, y FROM raster WHERE v % 7 = 0), (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy)) b ON b.kx = a.x AND b.ky = a.y WHERE abs(a.x - b.x) + abs(a.y - b.y) <= 6 GROUP BY a.x, a.y HAVING d <= 3")
def distance_transform(v):
    return raster.distance_transform(v("raster").selectExpr("x", "y", "cast(v % 7 = 0 as int) as v"), 3).filter("d is not null").select("x", "y", F.round("d", 6).alias("d"))


@query("""SELECT a.x, a.y, round(min(greatest(abs(a.x - b.x), abs(a.y - b.y)) + (sqrt(2e0) - 1) * least(abs(a.x - b.x), abs(a.y - b.y))), 6) AS d FROM raster a, (SELECT x, y FROM raster WHERE v % 997 = 0) b GROUP BY a.x, a.y""")
def distance_field(v):
    """Distances to the nearest of a few pixels, however far."""
    return raster.distance_field(v("raster").selectExpr("x", "y", "cast(v % 997 = 0 as int) as v")).select("x", "y", F.round("d", 6).alias("d"))


_FALL = "CASE WHEN sqrt((x - 22) * (x - 22) + (y - 17) * (y - 17)) < 9 THEN 0.5e0 + 0.5e0 * cos(sqrt((x - 22) * (x - 22) + (y - 17) * (y - 17)) / 9 * pi()) ELSE 0 END"


@query(f"SELECT x, y, v - 300 * {_FALL} AS v FROM raster")
def lower_brush(v):
    return raster.brush(v("raster"), 22, 17, 9, "lower", 300.0)


@query(f"SELECT x, y, v + (20000 - v) * 0.8e0 * 0.5e0 * {_FALL} AS v FROM raster")
def flatten_brush(v):
    return raster.brush(v("raster"), 22, 17, 9, "flatten", 0.8, 20000.0)


@query(f"WITH s AS (SELECT unnest(range(-4, 5, 2)) AS s), m AS (SELECT c.x, c.y, avg(n.v) AS m FROM raster c, s a, s b JOIN raster n ON n.x = least(greatest(c.x + a.s, 0), 49) AND n.y = greatest(c.y + b.s, 0) WHERE c.x BETWEEN 13 AND 31 AND c.y BETWEEN 8 AND 26 GROUP BY c.x, c.y) SELECT r.x, r.y, r.v + coalesce(m.m - r.v, 0) * (SELECT 0.7e0) * {_FALL.replace('(x ', '(r.x ').replace('(y ', '(r.y ')} AS v FROM raster r LEFT JOIN m ON m.x = r.x AND m.y = r.y")
def smooth_brush(v):
    pixels = v("raster")
    return raster.smooth(pixels, 22, 17, 9, (50, (pixels.agg(F.max("y")).first()[0] or 0) + 1), 0.7)


@query("SELECT p.id, least(-m.radius * p.c, m.radius * p.c) + least(-m.radius * p.s, m.radius * p.s) + p.x AS x0, greatest(-m.radius * p.c, m.radius * p.c) + greatest(-m.radius * p.s, m.radius * p.s) + p.x AS x1, p.scale * m.min_y + p.y AS y0, p.scale * m.max_y + p.y AS y1 FROM (SELECT *, scale * cos(id % 6) AS c, scale * sin(id % 6) AS s FROM props) p JOIN models m ON m.model = p.model")
def world_boxes(v):
    c, s, zero = F.col("scale") * F.cos(F.col("id") % 6), F.col("scale") * F.sin(F.col("id") % 6), F.lit(0.0)
    r, lo, hi = F.col("radius"), F.col("min_y"), F.col("max_y")
    box = raster.world_box((-r, lo, -r), (r, hi, r), [c, zero, s, zero, F.col("scale"), zero, -s, zero, c], (F.col("x"), F.col("y"), F.col("z")))
    return v("props").join(v("models"), "model").select("id", box[0][0].alias("x0"), box[0][1].alias("x1"), box[1][0].alias("y0"), box[1][1].alias("y1"))


@query("""WITH o AS (SELECT id % 7 AS g, id, row_number() OVER (PARTITION BY id % 7 ORDER BY id * 31 % 1009, id) AS a FROM props WHERE id % 5 <> 0), t AS (SELECT id % 7 AS g, id, row_number() OVER (PARTITION BY id % 7 ORDER BY id * 17 % 997, id) AS t FROM props WHERE id % 3 <> 0),
    j AS (SELECT t.g, t.id, t.t, o.a, max(CASE WHEN o.a IS NOT NULL THEN t.t END) OVER (PARTITION BY t.g ORDER BY t.t) AS c FROM t LEFT JOIN o ON o.g = t.g AND o.id = t.id),
    u AS (SELECT g, id, a AS p, 0 AS t FROM o UNION ALL SELECT j.g, j.id, coalesce(k.a, 0), j.t FROM j LEFT JOIN j k ON k.g = j.g AND k.t = j.c WHERE j.a IS NULL) SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY p, t) AS place FROM u""")
def sequence_merge(v):
    ours = v("props").filter("id % 5 <> 0").selectExpr("id % 7 as g", "id", "struct(id * 31 % 1009 as k, id) as o")
    theirs = v("props").filter("id % 3 <> 0").selectExpr("id % 7 as g", "id", "struct(id * 17 % 997 as k, id) as o")
    return merge.merge_order(ours, theirs, "g", "id", "o")


@query("SELECT o.id, CASE WHEN o.id % 3 = 0 THEN t.a ELSE o.a END AS a, CASE WHEN o.id % 3 = 0 THEN t.b ELSE o.b END AS b FROM ours_t o JOIN theirs_t t ON t.id = o.id WHERE o.a <> t.a OR o.b <> t.b")
def resolved_conflicts(v):
    ours, theirs = (v(t).select("id", F.struct("a", "b").alias(c)) for t, c in (("ours_t", "o"), ("theirs_t", "t")))
    choices = v("ours_t").filter("id % 6 <> 5").selectExpr("id", "case when id % 3 = 0 then 'theirs' else 'ours' end as side")
    return merge.resolve(ours.join(theirs, "id").filter("not o <=> t"), choices, ["id"]).select("id", "row.a", "row.b")


@query("SELECT id, CASE WHEN kind = 'light' AND scale > 2 THEN 'layer_0' ELSE layer END AS layer, CASE WHEN kind = 'light' AND scale > 2 THEN scale / 2 ELSE scale END AS scale, kind = 'light' AND scale > 2 AS edited FROM props")
def bulk_edits(v):
    changes = {"layer": F.lit("layer_0"), "scale": F.col("scale") / 2}
    return merge.bulk_update(v("props").select("id", "kind", "layer", "scale"), (F.col("kind") == "light") & (F.col("scale") > 2), changes).select("id", "layer", "scale", "edited")


_FILES = "CAST(p_partkey AS VARCHAR(20)) AS path, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN replace(p_name, 'e', 'a') ELSE concat(substring(p_name, 1, 3), '#', substring(p_name, 5)) END AS b"


@query(f"""WITH f AS (SELECT {_FILES} FROM part), d AS (SELECT path, i FROM (SELECT path, a, b, unnest(range(least(length(a), length(b)))) AS i FROM f) WHERE substring(a, i + 1, 1) <> substring(b, i + 1, 1) AND NOT i BETWEEN 2 AND 3), n AS (SELECT path, min(i) AS i, count(*) AS n FROM d GROUP BY path)
    SELECT f.path, CASE WHEN b IS NULL THEN 'no-reference' WHEN coalesce(n, 0) + abs(length(a) - length(b)) = 0 THEN 'identical' ELSE 'differs' END AS status, CASE WHEN b IS NULL THEN -1 ELSE coalesce(i, CASE WHEN length(a) <> length(b) THEN least(length(a), length(b)) END, -1) END AS first, CASE WHEN b IS NULL THEN -1 ELSE coalesce(n, 0) + abs(length(a) - length(b)) END AS bytes FROM f LEFT JOIN n ON n.path = f.path""")
def file_parity(v):
    files = v("part").selectExpr(*_split(_FILES.replace("VARCHAR(20)", "STRING")))
    pairs = files.select("path", F.encode("a", "UTF-8").alias("built"), F.encode("b", "UTF-8").alias("reference"))
    return merge.byte_parity(pairs, F.array(F.struct(F.lit(2).alias("lo"), F.lit(4).alias("hi"))))


def _split(columns: str) -> list[str]:
    return re.split(r"(?<= AS path), |(?<= AS a), ", columns)
