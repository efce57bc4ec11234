"""Queries: the map audit, check by check and as a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import audit
from terralith.plans.registry import query

GRID = audit.Grid(2 / 3, 0.5, 50, 300)
_R, _H = repr(2 / 3), "0.5e0"


def hex_of(table: str, x: str = "x", z: str = "z", carry: str = "*") -> str:
    """SQL: rows of a table with col and row of the hex at (x, z)."""
    return f"""(SELECT q.* EXCLUDE (c_, r_, e_, l_), greatest(0, least(49, CASE WHEN e_ < 1 AND (l_ >= e_ OR -l_ >= e_) THEN c_ - 1 ELSE c_ END)) AS col,
        greatest(0, least(299, CASE WHEN e_ < 1 AND l_ >= e_ THEN r_ + c_ % 2 WHEN e_ < 1 AND -l_ >= e_ THEN r_ + c_ % 2 - 1 ELSE r_ END)) AS row
        FROM (SELECT p.* EXCLUDE (f_, up_), CAST(floor(f_) AS BIGINT) AS c_, CAST(floor(up_) AS BIGINT) AS r_, (f_ - floor(f_)) * 3 AS e_, (up_ - floor(up_) - 0.5e0) * 2 AS l_
              FROM (SELECT o.*, ({z} + CASE WHEN CAST(floor(f_) AS BIGINT) % 2 = 0 THEN {_H} ELSE 0e0 END) / (2 * {_H}) AS up_ FROM (SELECT {carry}, ({x} + {_R}) / (1.5e0 * {_R}) AS f_ FROM {table}) o) p) q)"""


_CENTRE = f"col * 1.5e0 * {_R} AS tx, (row + 0.5e0) * 2 * {_H} - CASE WHEN col % 2 = 0 THEN {_H} ELSE 0e0 END AS tz"
_CAT = "CASE WHEN contains(model, '/mountains/') THEN 'mountain' WHEN contains(model, '/rocks/') THEN 'rock' WHEN contains(model, '/vegetation/') THEN 'tree' WHEN contains(model, '/settlements/') THEN 'building' ELSE 'other' END"
_WATER = "regexp_matches(model, 'port|boat|ship|bridge|water|dock|pier|wharf|lily|lotus|reed|fish|river|sea|jetty|walkway|scaffold')"
ROWS = f"r AS (SELECT p.*, m.min_y, m.max_y, m.radius, m.problem, {_CAT.replace('model', 'p.model')} AS category, CASE WHEN lf THEN 0.5e0 ELSE 0e0 END AS toff, p.y + p.scale * m.min_y AS base, p.y + p.scale * m.max_y AS top FROM props p JOIN models m ON m.model = p.model), s AS (SELECT * FROM r WHERE problem IS NULL)"
_FIND = "id, layer, model, x, z"


def _rows(v):
    return audit.prepare(v("props").withColumn("terrain_offset", F.when(F.col("lf"), 0.5).otherwise(0.0)), v("models"))


def _sound(v):
    return _rows(v).filter("problem is null")


MOUNTAINS = f"""mt AS (SELECT *, base - (1 - toff) * ground AS lift, top - (1 - toff) * ground AS peak FROM s WHERE category = 'mountain' AND toff > 0)"""
FLOATING = f"SELECT 'floating-mountain' AS code, CASE WHEN EXISTS (SELECT 1 FROM mt o WHERE o.id <> a.id AND sqrt((o.x - a.x) * (o.x - a.x) + (o.z - a.z) * (o.z - a.z)) < o.radius * o.scale * 0.7e0 AND o.top >= a.lift - 0.2e0) THEN 'info' ELSE 'warning' END AS severity, {_FIND}, lift AS value FROM mt a WHERE lift > 0.3e0"
BURIED_M = f"SELECT 'buried-mountain' AS code, 'warning' AS severity, {_FIND}, peak AS value FROM mt WHERE peak <= 0.05e0"
BURIED = f"SELECT 'buried-prop' AS code, 'warning' AS severity, {_FIND}, top - ground AS value FROM s WHERE toff <= 0 AND top < ground - 0.2e0 AND greatest(top - base, 0.0001e0) > 0.01e0 AND NOT {_WATER}"
FLOATING_P = f"SELECT 'floating-prop' AS code, 'warning' AS severity, {_FIND}, base - ground AS value FROM s a WHERE toff <= 0 AND category = 'rock' AND base > ground + greatest(0.15e0, 0.5e0 * greatest(top - base, 0.0001e0)) AND NOT EXISTS (SELECT 1 FROM mt o WHERE sqrt((o.x - a.x) * (o.x - a.x) + (o.z - a.z) * (o.z - a.z)) < o.radius * o.scale * 1.1e0)"
SEA = f"SELECT 'prop-in-sea' AS code, 'warning' AS severity, {_FIND}, sea - ground AS value FROM s WHERE category IN ('tree', 'building') AND NOT {_WATER} AND sea > ground + 0.2e0 AND sea > 0"
_PROBE = ", ".join(f"({dx * 2 * GRID.spacing!r}, {dz * 2 * GRID.spacing!r})" for dx, dz in audit.PROBES)
AWAY = f"aw AS (SELECT h.* FROM {hex_of('s')} h LEFT JOIN hexes g ON g.col = h.col AND g.row = h.row WHERE g.region IS DISTINCT FROM h.layer_region), pr AS (SELECT id, layer_region, x + dx AS px, z + dz AS pz FROM aw CROSS JOIN (VALUES {_PROBE}) AS t(dx, dz)), nr AS (SELECT DISTINCT h.id FROM {hex_of('pr', 'px', 'pz')} h JOIN hexes g ON g.col = h.col AND g.row = h.row WHERE g.region = h.layer_region)"
WRONG = f"SELECT 'wrong-region' AS code, 'info' AS severity, {_FIND}, 0e0 AS value FROM aw WHERE id NOT IN (SELECT id FROM nr)"
TOWNS = f"tw AS (SELECT {_CENTRE} FROM hexes WHERE slot >= 0), rd AS (SELECT h.id FROM {hex_of('s')} h JOIN hexes g ON g.col = h.col AND g.row = h.row WHERE h.category = 'tree' AND g.road > 0 AND g.terrain = 0)"
FOOT = f"SELECT 'on-city-footprint' AS code, 'warning' AS severity, {_FIND}, 0e0 AS value FROM s WHERE category IN ('mountain', 'rock', 'tree') AND (id IN (SELECT id FROM rd) OR EXISTS (SELECT 1 FROM tw WHERE sqrt((tx - x) * (tx - x) + (tz - z) * (tz - z)) < CASE WHEN category = 'tree' THEN 2e0 ELSE radius * scale * 0.7e0 + 1e0 END))"
ROAD = f"SELECT 'road-river' AS code, 'info' AS severity, id, CAST(NULL AS VARCHAR) AS layer, CAST(NULL AS VARCHAR) AS model, tx AS x, tz AS z, CAST(v AS DOUBLE) AS value FROM (SELECT id, {_CENTRE}, road & river AS v FROM hexes WHERE road & river <> 0 AND NOT bridge)"
CITY = "SELECT 'city' AS code, CASE WHEN n = 0 OR bad * 2 > n THEN 'warning' ELSE 'info' END AS severity, id, CAST(id AS VARCHAR) AS layer, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS z, CAST(bad AS DOUBLE) AS value FROM (SELECT region AS id, count(*) FILTER (slot = 0) AS n, count(*) FILTER (slot = 0 AND (terrain <> 0 OR impassable)) AS bad FROM hexes GROUP BY region) WHERE n = 0 OR bad > 0"
DRESS = f"""SELECT 'city-dressing' AS code, 'info' AS severity, CAST(NULL AS BIGINT) AS id, layer, CAST(NULL AS VARCHAR) AS model, x, z, d AS value FROM (SELECT layer, x, z, sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)) AS d FROM
    (SELECT layer, layer_region, list_sort(list(x))[1 + len(list(x)) // 2] AS x, list_sort(list(z))[1 + len(list(z)) // 2] AS z FROM s WHERE category IN ('building', 'other') GROUP BY layer, layer_region) a
    JOIN (SELECT region, avg(tx) AS cx, avg(tz) AS cz FROM (SELECT region, {_CENTRE} FROM hexes WHERE slot = 0) GROUP BY region) c ON c.region = a.layer_region) WHERE d > 3"""
DUP = f"SELECT 'duplicate' AS code, 'info' AS severity, {_FIND}, CAST(n AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY layer, model, round_even(x, 3), round_even(y, 3), round_even(z, 3), round_even(scale, 3) ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY layer, model, round_even(x, 3), round_even(y, 3), round_even(z, 3), round_even(scale, 3)) AS n FROM s) WHERE k > 1"
SCALE = f"SELECT 'scale-outlier' AS code, 'info' AS severity, {_FIND}, scale / m AS value FROM s JOIN (SELECT model AS mo, list_sort(list(scale))[1 + len(list(scale)) // 2] AS m, count(*) AS n FROM s GROUP BY model) g ON g.mo = s.model WHERE n >= 10 AND m > 0 AND (scale > m * 3 OR scale < m / 3)"
ASSET = "SELECT 'asset' AS code, CASE WHEN contains(problem, 'no meshes') THEN 'info' ELSE 'error' END AS severity, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS layer, model, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS z, CAST(count(*) AS DOUBLE) AS value FROM r WHERE problem IS NOT NULL GROUP BY model, problem"
ALL = " UNION ALL ".join([FLOATING, BURIED_M, BURIED, FLOATING_P, SEA, WRONG, FOOT, ROAD, CITY, DRESS, DUP, SCALE, ASSET])
_VALUE = "SELECT code, severity, id, layer, model, x, z, value FROM"


@query(f"WITH {ROWS}, {MOUNTAINS} {_VALUE} ({FLOATING})")
def audit_floating_mountain(v):
    return audit.mountains(_sound(v))[0]


@query(f"WITH {ROWS}, {MOUNTAINS} {_VALUE} ({BURIED_M})")
def audit_buried_mountain(v):
    return audit.mountains(_sound(v))[1]


@query(f"WITH {ROWS} {_VALUE} ({BURIED})")
def audit_buried_prop(v):
    return audit.prop_heights(_sound(v))[0]


@query(f"WITH {ROWS}, {MOUNTAINS} {_VALUE} ({FLOATING_P})")
def audit_floating_prop(v):
    return audit.prop_heights(_sound(v))[1]


@query(f"WITH {ROWS} {_VALUE} ({SEA})")
def audit_prop_in_sea(v):
    return audit.in_sea(_sound(v))


@query(f"WITH {ROWS}, {AWAY} {_VALUE} ({WRONG})")
def audit_wrong_region(v):
    return audit.wrong_region(_sound(v), v("hexes"), GRID)


@query(f"WITH {ROWS}, {TOWNS} {_VALUE} ({FOOT})")
def audit_city_footprint(v):
    return audit.city_footprint(_sound(v), v("hexes"), GRID)


@query(f"{_VALUE} ({ROAD})")
def audit_road_river(v):
    return audit.road_river(v("hexes"), GRID)


@query(f"{_VALUE} ({CITY})")
def audit_city(v):
    return audit.city(v("hexes"))


@query(f"WITH {ROWS} {_VALUE} ({DRESS})")
def audit_city_dressing(v):
    return audit.city_dressing(_sound(v), v("hexes"), GRID)


@query(f"WITH {ROWS}, c AS (SELECT * FROM s UNION ALL SELECT * REPLACE (id + 1000000 AS id, ordinal + 1000000 AS ordinal, x + 0.0001e0 AS x) FROM s WHERE id % 50 = 0) {_VALUE} ({DUP.replace('FROM s)', 'FROM c)')})")
def audit_duplicate(v):
    rows = _sound(v)
    copies = rows.filter("id % 50 = 0").withColumns({"id": F.col("id") + 1000000, "ordinal": F.col("ordinal") + 1000000, "x": F.col("x") + 0.0001})
    return audit.duplicates(rows.unionByName(copies))


_SCALED = "CASE WHEN id % 101 = 0 THEN scale * 4 WHEN id % 103 = 0 THEN scale / 8 ELSE scale END"


@query(f"WITH {ROWS}, c AS (SELECT * REPLACE ({_SCALED} AS scale) FROM s) {_VALUE} ({SCALE.replace('FROM s ', 'FROM c s ')})")
def audit_scale_outlier(v):
    return audit.scale_outliers(_sound(v).withColumn("scale", F.expr(_SCALED)))


@query(f"WITH {ROWS} {_VALUE} ({ASSET})")
def audit_asset(v):
    return audit.assets(_rows(v))


def _all(v, *checks):
    return audit.run(v("props").withColumn("terrain_offset", F.when(F.col("lf"), 0.5).otherwise(0.0)), v("models"), v("hexes"), GRID, checks)


@query(f"""WITH {ROWS}, {MOUNTAINS}, {AWAY}, {TOWNS}, a AS ({ALL}) SELECT code, count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
    count(*) FILTER (code IN ('floating-mountain', 'buried-mountain', 'buried-prop', 'floating-prop', 'duplicate') AND NOT (code = 'floating-mountain' AND severity = 'info')) AS fixable FROM a GROUP BY code""")
def audit_report(v):
    return audit.summary(_all(v))


@query(f"WITH {ROWS}, a AS ({BURIED} UNION ALL {SCALE}) SELECT code, id, value, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY value DESC, id, layer, model) AS INTEGER) AS place FROM a) WHERE place <= 100")
def audit_ranked(v):
    return audit.ranked(_all(v, "buried-prop", "scale-outlier")).filter("place <= 100").select("code", "id", "value", "place")
