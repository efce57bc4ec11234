"""Projections and predicates over entities, props, tiles and assets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that mark a model as a water piece.
WATER_WORDS = ("port", "boat", "ship", "bridge", "water", "dock", "pier", "wharf", "lily", "lotus", "reed", "fish", "river", "sea", "jetty", "walkway", "scaffold")
#: Folders that give a model's category, in order.
CATEGORY_FOLDERS = (("/mountains/", "mountain"), ("/rocks/", "rock"), ("/vegetation/", "tree"), ("/settlements/", "building"))
#: Hex categories, and the tile sets of each; other sets are areas.
BLACK, SEA, BEACH, CLIFF, CLIFF_END, RIVER, START, MOUTH, CROSSING, ROAD, AREA, CANAL = range(12)
TILE_SETS = {
    SEA: ("generic_sea",), BEACH: ("sea_coast",), CLIFF: ("blockout_cliff",), CLIFF_END: ("blockout_cliff_ends",), RIVER: ("river",), START: ("river_start",), MOUTH: ("river_mouth",),
    CROSSING: ("river_crossing", "river_crossing_imperial", "river_crossing_track"), ROAD: ("roads_paved", "roads_imperial", "roads_tracks"), CANAL: ("canal", "canal_links"),
}


#: Folders under campaign whose tiles are base tiles, besides those that begin with mountains.
BASE_FOLDERS = ("generic", "generic_sea", "sea_coast")


def base_tile(path: Column) -> Column:
    """Whether the folder after the first campaign in a path holds base tiles; false without one."""
    parts = F.filter(F.split(F.lower(path), r"[\\\\/]+"), lambda p: p != "")
    folder = F.get(parts, F.array_position(parts, "campaign").cast("int"))
    return F.coalesce((F.array_position(parts, "campaign") > 0) & (folder.isin(*BASE_FOLDERS) | folder.startswith("mountains")), F.lit(False))


def is_new(rows: DataFrame, known: DataFrame | None, key: str, prefix: str) -> DataFrame:
    """Rows with is_new: their key is not among the known ones or, where none is known, lacks the prefix."""
    plain = ~F.col(key).startswith(prefix)
    if known is None or known.isEmpty():
        return rows.withColumn("is_new", plain)
    return rows.join(known.select(key, F.lit(False).alias("_new")).distinct(), key, "left").withColumn("is_new", F.coalesce("_new", F.lit(True))).drop("_new")


def field_filter(text: str, components: str = "components") -> Column:
    """One condition: EC.f=v, EC.f!=v, EC.f~v (contains, any case) or a bare EC. A missing field fails all of them."""
    comp = F.col(components)
    for op in ("!=", "~", "="):
        if op in text:
            path, value = text.split(op, 1)
            ec, _, name = path.strip().partition(".")
            got = comp[ec][name]
            test = {"!=": got != value, "=": got == value, "~": F.contains(F.lower(got), F.lit(value.lower()))}[op]
            return F.coalesce(test, F.lit(False))
    return comp[text.strip()].isNotNull()


def in_rect(x: Column, z: Column, x1: float, z1: float, x2: float, z2: float) -> Column:
    """Inside a rectangle given by any two opposite corners, edges included."""
    return x.between(min(x1, x2), max(x1, x2)) & z.between(min(z1, z2), max(z1, z2))


def in_circle(x: Column, z: Column, cx: float, cz: float, r: float) -> Column:
    return (x - cx) * (x - cx) + (z - cz) * (z - cz) <= r * r


def entity_query(entities: DataFrame, types=(), ids=(), name: str = "", where=(), rect=None, parent: int | None = None, layer_types=("layer",)) -> DataFrame:
    """Entities under all conditions given; layer rows only where a type or an id asks for them."""
    tests: list[Column] = []
    if types:
        tests.append(F.lower("type").isin([t.lower() for t in types]))
    if ids:
        tests.append(F.col("id").isin(list(ids)))
    if not types and not ids:
        tests.append(~F.lower("type").isin(list(layer_types)))
    if name:
        tests.append(F.contains(F.lower("name"), F.lit(name.lower())))
    if parent is not None:
        tests.append(F.col("parent") == parent)
    if rect:
        tests.append(in_rect(F.col("x"), F.col("z"), *rect))
    tests += [field_filter(w) for w in where]
    return entities.filter(reduce(lambda a, b: a & b, tests)) if tests else entities


def prop_query(props: DataFrame, kinds=(), asset: str = "", tag: str = "", rect=None, circle=None) -> DataFrame:
    """Props by kind, asset substring, tag in the comma list, rectangle and circle; tag layers only if asked for."""
    out = props.filter(F.col("kind").isin(list(kinds)) if kinds else F.col("kind") != "tag_layer")
    if asset:
        out = out.filter(F.contains(F.lower("model"), F.lit(asset.lower())))
    if tag:
        out = out.filter(F.array_contains(F.transform(F.split(F.lower("tags"), ","), F.trim), tag.lower()))
    if rect:
        out = out.filter(in_rect(F.col("x"), F.col("z"), *rect))
    if circle:
        out = out.filter(in_circle(F.col("x"), F.col("z"), *circle))
    return out


def category(model: Column) -> Column:
    """mountain, rock, tree, building or other, by the first folder that the path holds."""
    path = F.replace(F.lower(model), F.lit("\\"), F.lit("/"))
    return F.coalesce(*[F.when(F.contains(path, F.lit(folder)), name) for folder, name in CATEGORY_FOLDERS], F.lit("other"))


def is_water_model(model: Column) -> Column:
    return F.lower(model).rlike("|".join(WATER_WORDS))


def tile_category(tile_set: Column) -> Column:
    """Code of a tile set; unknown and missing ones are areas."""
    return F.coalesce(*[F.when(tile_set.isin(*sets), code) for code, sets in TILE_SETS.items()], F.lit(AREA))


def map_name(path: Column) -> Column:
    """The map folder that a path lies in, or null; folders with a dot are none."""
    p = F.replace(F.lower(path), F.lit("/"), F.lit("\\"))
    found = F.coalesce(F.nullif(F.regexp_extract(p, r"^terrain\\campaigns\\([^\\]+)\\", 1), F.lit("")), F.nullif(F.regexp_extract(p, r"^campaign_maps\\([^\\]+)\\", 1), F.lit("")))
    return F.when(~F.contains(found, F.lit(".")), found)


def discover_maps(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(map_name(F.col(path)).alias("map")).filter("map is not null").distinct()


def bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND((1 << width) - 1)


def names_of_mask(mask: Column, names: list[str]) -> Column:
    """The names of set bits, in natural order (numbers inside names count as numbers)."""
    every = F.array(*[F.when(F.getbit(mask, F.lit(k)) == 1, F.lit(n)) for k, n in sorted(enumerate(names), key=lambda x: natural(x[1]))])
    return F.filter(every, lambda n: n.isNotNull())


def natural(text: str) -> tuple:
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", text))


def natural_key(text: Column, width: int = 12) -> Column:
    """A sort key that compares digit runs as numbers: they are padded with zeros."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def find_assets(assets: DataFrame, text: str, extensions=(), limit: int = 100) -> DataFrame:
    """Assets whose path holds text and ends with an extension, by path, at most limit (the feature's own bound)."""
    out = assets.filter(F.contains(F.lower("path"), F.lit(text.lower())))
    if extensions:
        out = out.filter(F.lower("path").rlike("(" + "|".join(e.lower().replace(".", r"\.") for e in extensions) + ")$"))
    return out.orderBy("path", "ordinal").limit(limit)


def with_truncation(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in order, and truncated: whether there were more. One row above the limit decides it."""
    head = df.orderBy(*order).limit(limit + 1)
    numbered = head.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    more = numbered.agg((F.max("_n") > limit).alias("truncated"))
    return numbered.filter(F.col("_n") <= limit).drop("_n").crossJoin(F.broadcast(more))
