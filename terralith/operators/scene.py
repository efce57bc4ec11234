"""Entity classes, prefabs, catalogues and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.graph import settle

#: Levels to which prefabs may nest, by contract.
MAX_DEPTH = 8


def allowed_types(types: DataFrame, kind: str, database: str) -> DataFrame:
    """Types (name, allow: array of structs kind, database) that some rule lets into a project; a null in a rule fits anything."""
    fits = lambda r: (r["kind"].isNull() | (r["kind"] == kind)) & (r["database"].isNull() | (r["database"] == database))
    return types.filter(F.exists("allow", fits))


def match_class(entities: DataFrame, types: DataFrame) -> DataFrame:
    """id with the type that shares most components, then misses fewest, then comes first.

    Entities meet types on a shared component, so types that share none aren't paired; those fall to the least miss count.
    """
    e = entities.select("id", F.explode(F.array_distinct("comps")).alias("comp"))
    t = types.select("type", "ordinal", F.size(F.array_distinct("comps")).alias("size"), F.explode(F.array_distinct("comps")).alias("comp"))
    shared = e.join(t, "comp").groupBy("id", "type", "ordinal", "size").agg(F.count("*").alias("shared"))
    best = shared.groupBy("id").agg(F.max_by(F.struct("type", "shared"), F.struct("shared", (F.col("shared") - F.col("size")).alias("m"), (-F.col("ordinal")).alias("o"))).alias("b"))
    fallback = types.agg(F.min_by("type", F.struct(F.size(F.array_distinct("comps")), "ordinal")).alias("least"))
    return entities.select("id").join(best, "id", "left").crossJoin(F.broadcast(fallback)).select("id", F.coalesce("b.type", "least").alias("type"), F.coalesce("b.shared", F.lit(0)).cast("bigint").alias("shared"))


def expand_prefabs(instances: DataFrame, members: DataFrame) -> DataFrame:
    """Objects (instance, member, x, z, depth, path) that instances (id, prefab, x, z) stand for.

    members: prefab, member, ref (a prefab, or null for an object), dx, dz. Offsets add up; a prefab inside itself and
    levels beyond MAX_DEPTH end there. One join a level.
    """
    front = settle(instances.select(F.col("id").alias("instance"), "prefab", "x", "z", F.array("prefab").alias("path")))
    out = None
    for depth in range(1, MAX_DEPTH + 1):
        step = front.join(members, "prefab").select("instance", "member", "ref", (F.col("x") + F.col("dx")).alias("x"), (F.col("z") + F.col("dz")).alias("z"), "path", F.lit(depth).alias("depth"))
        step = settle(step)
        leaves = step.filter("ref is null").select("instance", "member", "x", "z", "depth", F.array_join("path", "/").alias("path"))
        out = leaves if out is None else out.unionByName(leaves)
        front = step.filter(F.col("ref").isNotNull() & ~F.array_contains("path", F.col("ref"))).select("instance", F.col("ref").alias("prefab"), "x", "z", F.concat("path", F.array("ref")).alias("path"))
        if front.isEmpty():
            break
    return out


def last_overrides(overrides: DataFrame) -> DataFrame:
    """The last override of each (instance, member)."""
    return overrides.groupBy("instance", "member").agg(F.max_by("value", "ordinal").alias("value"))


def duplicate_keys(rows: DataFrame, key: str = "key", path: str = "path", order: str = "ordinal") -> DataFrame:
    """Keys with more than one path: how many, and the first, which is used."""
    return rows.groupBy(key).agg(F.count("*").alias("paths"), F.min_by(path, order).alias("used")).filter("paths > 1")


def edit_bounds(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """Bounds of the hexes whose value changed, in one row."""
    both = after.join(before.select("id", F.col(value).alias("_old")), "id").filter(~F.col(value).eqNullSafe(F.col("_old")))
    return both.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("col", "row") for f in (F.min, F.max)])


def share_equal(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percent of common cells with the same value; nulls are equal."""
    both = left.join(right.select(*keys, F.col(value).alias("_r")), keys)
    return both.agg((F.avg(F.col(value).eqNullSafe(F.col("_r")).cast("double")) * 100).alias("percent"))


def split_by_edit(rows: DataFrame, edited: DataFrame, key: str = "id") -> DataFrame:
    """Rows with edited: whether their key is among the edited ones."""
    return rows.join(edited.select(key).distinct().withColumn("edited", F.lit(True)), key, "left").withColumn("edited", F.coalesce("edited", F.lit(False)))


def tile_masks(records: DataFrame, tiles: DataFrame, path: Column) -> DataFrame:
    """Records with the mask of the first tile of their normal path, or null."""
    first = tiles.groupBy("key").agg(F.min_by("mask", "ordinal").alias("tile_mask"))
    return records.withColumn("key", F.lower(F.replace(path, F.lit("/"), F.lit("\\")))).join(first, "key", "left")


def census(assets: DataFrame, most: int = 15) -> DataFrame:
    """Failure kinds by count, the first `most` (the report's own bound), with the total of failures."""
    bad = assets.filter("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))
    return bad.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "problem").limit(most)


def match_layers(rows: DataFrame, text: str) -> DataFrame:
    """Rows (id, parent, name) that hold text, and all their ancestors; one join a level."""
    found = settle(rows.filter(F.contains(F.lower("name"), F.lit(text.lower()))).select("id", "parent"))
    front = found
    while True:
        up = rows.join(front.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select("id", "parent")
        front = settle(up.join(found, "id", "left_anti"))
        if front.isEmpty():
            return found.select("id")
        found = found.unionByName(front)
