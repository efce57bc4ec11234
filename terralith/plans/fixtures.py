"""Adapters: the driver's star-schema tables as hex grids, placed objects, rasters, boxes and versions of a table.

Each view is one SELECT that Spark and DuckDB read alike but for integer division, written DIV here. Only integer
arithmetic on keys is used, so both give the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "hexes": """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 50 AS col, o_orderkey DIV 50 AS row,
        (((o_orderkey DIV 50) DIV 3) * 5 + (o_orderkey % 50) DIV 4) % 12 AS cat, o_custkey % 8 AS region,
        o_orderkey * 7 % 64 AS road, o_orderkey * 13 % 64 AS river, o_orderkey % 3 = 0 AS bridge,
        CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 3 ELSE -1 END AS slot, o_orderkey % 5 AS terrain, o_orderkey % 17 = 0 AS impassable
        FROM {orders}""",
    "ways": """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 50 AS col, o_orderkey DIV 50 AS row, (o_orderkey DIV 50) DIV 12 AS band, (o_orderkey DIV 50) DIV 12 * 4 + (o_orderkey % 50) DIV 13 AS area,
        o_orderkey % 11 = 0 AS shut, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 3 ELSE -1 END AS owner, o_orderkey % 5 AS terrain, o_orderkey * 7 % 64 AS road,
        CASE WHEN (((o_orderkey DIV 50) DIV 3) * 5 + (o_orderkey % 50) DIV 4) % 12 = 1 THEN 1 WHEN o_orderkey % 23 = 0 THEN 5 WHEN (((o_orderkey DIV 50) DIV 3) * 5 + (o_orderkey % 50) DIV 4) % 12 IN (5, 6, 7) THEN 6 ELSE 0 END AS kind
        FROM {orders} WHERE o_orderkey % 17 <> 0""",
    "saplings": """SELECT event_id * 7919 % 1000003 AS ordinal, (event_id * 7919 % 5000) / 100e0 AS x, event_id * 3 / 100e0 + (event_id * 104729 % 700) / 1000e0 AS z FROM {events}""",
    "old_trees": """SELECT CAST(event_id AS BIGINT) AS id, CASE event_id % 3 WHEN 0 THEN 'Pine_a' WHEN 1 THEN 'birch_b' ELSE 'oak_c' END AS species, (event_id * 31 % 5000) / 100e0 AS x, event_id * 3 / 100e0 AS z FROM {events} WHERE event_id % 20 IN (3, 4)""",
    "triangles": """SELECT CAST(event_id AS BIGINT) AS ordinal, (event_id * 7919 % 5000) / 100e0 AS ax, (event_id * 37 % 900) / 100e0 AS ay, event_id * 3 / 100e0 AS az,
        (event_id * 7919 % 5000) / 100e0 + CASE WHEN event_id % 997 = 5 THEN 40e0 ELSE 1e0 + event_id % 7 END AS bx, (event_id * 53 % 700) / 100e0 AS b_y, event_id * 3 / 100e0 + event_id % 3 AS bz,
        (event_id * 7919 % 5000) / 100e0 + event_id % 5 - 1 AS cx, (event_id * 71 % 500) / 100e0 AS cy, event_id * 3 / 100e0 + CASE WHEN event_id % 997 = 5 THEN 90e0 ELSE 2e0 + event_id % 6 END AS cz FROM {events}""",
    "props": """SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id AS BIGINT) AS ordinal, (event_id * 7919 % 5000) / 100e0 AS x,
        (event_id * 10007 % 30000) / 100e0 AS z, (event_id * 37 % 900) / 100e0 AS y,
        CASE event_id % 7 WHEN 0 THEN 'terrain/mountains/peak_a' WHEN 1 THEN 'props/rocks/rock_b' WHEN 2 THEN 'props/vegetation/pine_c' WHEN 3 THEN 'props/settlements/hut_d'
             WHEN 4 THEN 'props/settlements/boat_e' WHEN 5 THEN 'props/misc/well_f' ELSE 'terrain/mountains/peak_g' END AS model,
        concat('layer_', CAST(user_id % 8 AS VARCHAR(20))) AS layer, user_id % 8 AS layer_region, CAST(1 + event_id % 7 AS DOUBLE) AS scale,
        CASE event_id % 4 WHEN 0 THEN 'night,Snow' WHEN 1 THEN 'snow' WHEN 2 THEN '' ELSE 'day' END AS tags,
        CASE event_id % 6 WHEN 0 THEN 'tag_layer' WHEN 1 THEN 'light' ELSE 'prop' END AS kind,
        (event_id * 31 % 700) / 100e0 AS ground, (event_id * 17 % 900) / 100e0 - 2e0 AS sea, event_id % 9 = 0 AS lf FROM {events}""",
    "models": """SELECT DISTINCT CASE event_id % 7 WHEN 0 THEN 'terrain/mountains/peak_a' WHEN 1 THEN 'props/rocks/rock_b' WHEN 2 THEN 'props/vegetation/pine_c' WHEN 3 THEN 'props/settlements/hut_d'
             WHEN 4 THEN 'props/settlements/boat_e' WHEN 5 THEN 'props/misc/well_f' ELSE 'terrain/mountains/peak_g' END AS model,
        -(event_id % 7) / 10e0 AS min_y, 1e0 + (event_id % 7) / 4e0 AS max_y, 0.5e0 + (event_id % 7) / 5e0 AS radius,
        CASE event_id % 7 WHEN 5 THEN 'no meshes' WHEN 4 THEN 'bad header' END AS problem FROM {events}""",
    "raster": """SELECT o_orderkey % 50 AS x, o_orderkey DIV 50 AS y, CAST(floor(o_totalprice) AS BIGINT) % 65536 AS v FROM {orders}""",
    "areas": """SELECT CAST(p_partkey AS BIGINT) AS ordinal, p_partkey % 5 AS list,
        greatest(0, p_partkey * 3 % 50 - 1 - p_size % 5) AS min_x, p_partkey * 3 % 50 + 1 + p_size % 5 AS max_x,
        greatest(0, p_partkey * 7 % 30 - 1 - p_size % 5) AS min_y, p_partkey * 7 % 30 + 1 + p_size % 5 AS max_y FROM {part}""",
    "fields": """SELECT CAST(event_id AS BIGINT) AS id, 'ECMesh' AS comp, 'model_path' AS field, event_type AS val FROM {events}
        UNION ALL SELECT event_id, 'ECTransform', 'position', concat(CAST(user_id AS VARCHAR(20)), ' ', CAST(event_id % 7 AS VARCHAR(20)), ' ', CAST(event_id % 3 AS VARCHAR(20))) FROM {events}
        UNION ALL SELECT event_id, 'ECProps', 'k', CAST(event_id % 9 AS VARCHAR(20)) FROM {events} WHERE event_id % 5 <> 0
        UNION ALL SELECT event_id, 'ECProps', 'flag', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END FROM {events} WHERE event_id % 5 <> 0""",
    "entities": """SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id AS BIGINT) AS ordinal, event_type AS type, concat('Obj_', event_type, '_', CAST(event_id % 100 AS VARCHAR(20))) AS name,
        CASE WHEN event_id = 0 THEN NULL ELSE event_id DIV 3 END AS parent, (event_id * 7919 % 5000) / 100e0 AS x, (event_id * 10007 % 30000) / 100e0 AS z FROM {events}""",
    "base_t": "SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS a, CAST(c_nationkey AS BIGINT) AS b FROM {customer}",
    "ours_t": "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS a, CAST(c_nationkey AS BIGINT) AS b FROM {customer} WHERE c_custkey % 13 <> 0",
    "theirs_t": """SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 11 = 0 THEN 'Y' ELSE c_mktsegment END AS a,
        CAST(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS BIGINT) AS b FROM {customer} WHERE c_custkey % 17 <> 0
        UNION ALL SELECT c_custkey + 1000000, c_mktsegment, c_nationkey FROM {customer} WHERE c_custkey % 19 = 0""",
    "palette": "SELECT CAST(p_partkey AS BIGINT) AS ordinal, p_brand AS name, p_partkey * 7919 % 16777216 AS rgb FROM {part}",
    "rle": "SELECT CAST(l_orderkey AS BIGINT) AS ordinal, l_orderkey % 7 AS val, count(*) AS n FROM {lineitem} GROUP BY l_orderkey",
    "tiles": "SELECT CAST(p_partkey AS BIGINT) AS ordinal, p_partkey % 40 AS x, p_partkey DIV 40 AS y, 1 + p_size % 3 AS w, 1 + p_size % 2 AS h, p_partkey * 11 % 64 AS mask, CASE p_partkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 64 ELSE 128 END AS rot, p_type AS path FROM {part}",
    "settlements": "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS region_key, s_suppkey * 13 % 53 AS x, s_suppkey * 29 % 33 AS y, s_suppkey % 4 AS kind FROM {supplier}",
    "points": "SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey * 17 % 50 AS x, c_custkey * 23 % 30 AS y, (c_custkey * 173 % 4900) / 100e0 AS fx, (c_custkey * 311 % 2900) / 100e0 AS fy FROM {customer}",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("VARCHAR(20)", "STRING")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def sql(body: str) -> str:
    """body for DuckDB, after the views that it names."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    parts = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n]).replace(' DIV ', ' // ')})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
