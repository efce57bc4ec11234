"""Queries: binary files made of the tables, read back; packs; trees as intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from terralith.operators import tree
from terralith.plans.registry import query
from terralith.sources import layouts

PART = {4: [("key", "i"), ("name", "s"), ("brand", "o"), ("price", "f"), ("big", "b")], 5: [("key", "i"), ("name", "s"), ("big", "b")]}


def _table_files(v):
    """Table files of at most a hundred parts each, of two versions."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p_partkey")
        group = int(frame["p_partkey"].iloc[0]) // 100
        rows = [(int(k), n, b if k % 3 else "", float(p), bool(s > 25)) for k, n, b, p, s in zip(frame["p_partkey"], frame["p_name"], frame["p_brand"], frame["p_retailprice"], frame["p_size"], strict=True)]
        if group % 4 == 3:
            raw = layouts.encode_db([(k, n, big) for k, n, _, _, big in rows], "isb", 5)
        else:
            raw = layouts.encode_db(rows, "isofb", 4, name="parts" if group % 2 else None)
        return pd.DataFrame({"path": [f"db/{group}"], "content": [raw]})

    return v("part").groupBy(F.expr("p_partkey div 100")).applyInPandas(run, "path string, content binary")


@query("""SELECT 'db/' || CAST(p_partkey // 100 AS VARCHAR) AS path, CASE WHEN p_partkey // 100 % 4 = 3 THEN 5 ELSE 4 END AS version, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS ordinal, CAST(p_partkey AS INTEGER) AS key, p_name AS name,
    CASE WHEN p_partkey // 100 % 4 = 3 THEN NULL WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_partkey // 100 % 4 <> 3 THEN CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) END AS price, p_size > 25 AS big FROM part""")
def db_tables(v):
    return layouts.db_rows(_table_files(v), PART).withColumn("price", F.col("price").cast("double"))


def _packs(v):
    """Packs of at most a hundred parts each, of both kinds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p_partkey")
        group = int(frame["p_partkey"].iloc[0]) // 100
        raw = layouts.encode_pack([(f"Parts/{t}/{k}.txt", n.encode()) for k, n, t in zip(frame["p_partkey"], frame["p_name"], frame["p_brand"], strict=True)], "PFH5" if group % 2 else "PFH4", stamped=group % 3 == 0, needs=("a.pack",) if group % 5 == 0 else ())
        return pd.DataFrame({"path": [f"pack/{group}"], "content": [raw]})

    return v("part").groupBy(F.expr("p_partkey div 100")).applyInPandas(run, "path string, content binary")


@query("""WITH m AS (SELECT p_partkey // 100 AS g, p_partkey, 'Parts/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) || '.txt' AS path, p_name, strlen(p_name) AS size FROM part),
    e AS (SELECT *, 5 + strlen(path) + g % 2 + CASE WHEN g % 3 = 0 THEN 4 ELSE 0 END AS entry FROM m),
    h AS (SELECT g, 28 + CASE WHEN g % 5 = 0 THEN 7 ELSE 0 END + sum(entry) AS head FROM e GROUP BY g)
    SELECT 'pack/' || CAST(e.g AS VARCHAR) AS pack, replace(lower(path), '/', '\\') AS key, CAST(head + sum(size) OVER (PARTITION BY e.g ORDER BY p_partkey) - size AS BIGINT) AS "offset", size, p_name AS content FROM e JOIN h ON h.g = e.g""")
def pack_files(v):
    """The members of all packs with their places and contents."""
    return layouts.pack_members(_packs(v), content=True).select("pack", "key", "offset", "size", F.col("content").cast("string").alias("content"))


@query("""WITH b AS (SELECT DISTINCT 'terrain\\b' || CAST(p_partkey % 50 AS VARCHAR) || '\\f' || CAST(p_partkey AS VARCHAR) AS key FROM part), o AS (SELECT DISTINCT 'terrain\\b' || CAST(c_custkey % 50 AS VARCHAR) || '\\f' || CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 4 = 1)
    SELECT coalesce(b.key, o.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN o.key IS NOT NULL THEN 'replaced' WHEN starts_with(b.key, 'terrain\\b3\\') OR starts_with(b.key, 'terrain\\b17\\') THEN 'dropped' ELSE 'kept' END AS status FROM b FULL OUTER JOIN o ON o.key = b.key""")
def pack_merge(v):
    base = v("part").selectExpr("concat('Terrain/b', p_partkey % 50, '/F', p_partkey) as path")
    new = v("customer").filter("c_custkey % 4 = 1").selectExpr(r"concat(r'terrain\B', c_custkey % 50, r'\f', c_custkey) as path")
    return layouts.merge_members(base, new, ["terrain/b3", "Terrain/B17/"])


def _battle_files(v):
    """Files of at most a hundred rows each, in which only the first columns of a row are known."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("event_id")
        group = int(frame["event_id"].iloc[0]) // 100
        rows = [(f"k{k}", f"land_{t}", k % 2 == 0, f"{'terrain' if k % 3 else 'Terrain'}\\battles\\{u}\\{k % 17}\\", float(x), "tail" * (k % 3)) for k, t, u, x in zip(frame["event_id"], frame["event_type"], frame["user_id"], frame["value"], strict=True)]
        return pd.DataFrame({"path": [f"battles/{group}"], "content": [layouts.encode_db(rows, "ssbsfo", 7)]})

    return v("events").groupBy(F.expr("event_id div 100")).applyInPandas(run, "path string, content binary")


@query("""SELECT 'battles/' || CAST(event_id // 100 AS VARCHAR) AS path, CASE WHEN event_id % 3 = 0 THEN 'T' ELSE 't' END || 'errain\\battles\\' || CAST(user_id AS VARCHAR) || '\\' || CAST(event_id % 17 AS VARCHAR) || '\\' AS map_path, 'land_' || event_type AS type FROM events""")
def binary_scan(v):
    """Rows found by pattern in files whose layout isn't known."""
    return layouts.scan_files(_battle_files(v))


_TREE = "WITH RECURSIVE d AS (SELECT id, [ordinal] AS path, 0 AS depth FROM entities WHERE parent IS NULL UNION ALL SELECT e.id, list_append(d.path, e.ordinal), d.depth + 1 FROM d JOIN entities e ON e.parent = d.id AND e.id <> d.id)"


def _nodes(v):
    return v("entities").filter("parent is null or parent <> id").select("id", "parent", "ordinal", "type")


@query(f"""{_TREE}, r AS (SELECT id, depth, row_number() OVER (ORDER BY path) - 1 AS nth FROM d), u AS (SELECT id, id AS top FROM r UNION ALL SELECT u.id, e.parent FROM u JOIN entities e ON e.id = u.top WHERE e.parent IS NOT NULL AND e.parent <> e.id),
    z AS (SELECT top AS id, count(*) AS size FROM u GROUP BY top) SELECT r.id, 2 * nth - depth AS start, 2 * nth - depth + 2 * size - 1 AS "end", CAST(depth AS BIGINT) AS depth FROM r JOIN z ON z.id = r.id""")
def tree_labels(v):
    return tree.labels(_nodes(v))


@query("""WITH RECURSIVE u AS (SELECT id, parent AS top FROM entities WHERE id % 7 = 2 AND parent <> id UNION ALL SELECT u.id, e.parent FROM u JOIN entities e ON e.id = u.top WHERE e.parent IS NOT NULL AND e.parent <> e.id) SELECT u.top, u.id FROM u JOIN entities e ON e.id = u.top WHERE e.type = (SELECT min(type) FROM entities)""")
def tree_descendants(v):
    """Every node of one kind under every node of one type, at any depth."""
    nodes = _nodes(v)
    known = tree.labels(nodes).join(nodes.select("id", "type"), "id")
    least = nodes.agg(F.min("type")).first()[0]
    return tree.descendants(known.filter(F.col("type") == least), known.filter("id % 7 = 2"))
