"""Map audit: thirteen checks over placed props and hexes, each a frame of findings, and their report.

Findings have check, severity, id, layer, model, x, z and value. props carry ground and sea heights at their place
(see raster.sample) and terrain_offset; models carry min_y, max_y, radius and problem. A model without facts is left to
the asset check.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.hexgrid import hex_centre, world_to_hex
from terralith.operators import aggregates as agg
from terralith.operators.filters import category, is_water_model

COLUMNS = ["code", "severity", "id", "layer", "model", "x", "z", "value"]
#: Cell of the radius searches, in world units.
CELL = 4.0
PROBES = tuple((math.cos(a * math.pi / 6), math.sin(a * math.pi / 6)) for a in range(12))


class Grid:
    """Where the hexes lie: radius, half height, columns, rows."""

    def __init__(self, radius: float, half: float, width: int, height: int):
        self.radius, self.half, self.width, self.height = radius, half, width, height
        self.spacing = 2 * half

    def at(self, x: Column, z: Column) -> tuple[Column, Column]:
        return world_to_hex(x, z, self.radius, self.half, self.width, self.height)

    def centre(self, col: Column, row: Column) -> tuple[Column, Column]:
        return hex_centre(col, row, self.radius, self.half)


def prepare(props: DataFrame, models: DataFrame) -> DataFrame:
    """Props with their model's facts, category, and base, top and height in the world."""
    both = props.join(models, "model", "left").withColumn("category", category(F.col("model")))
    base, top = F.col("y") + F.col("scale") * F.col("min_y"), F.col("y") + F.col("scale") * F.col("max_y")
    return both.withColumns({"base": base, "top": top, "tall": top - base})


def finding(df: DataFrame, check: str, severity: Column | str, value: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    own = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    return df.select(F.lit(check).alias("code"), severity.alias("severity"), own("id", "bigint").alias("id"), own("layer", "string").alias("layer"), own("model", "string").alias("model"), own("x", "double").alias("x"), own("z", "double").alias("z"), value.cast("double").alias("value"))


def reached(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
    """Pairs of left (x, z) with right (rx, rz, reach) less than reach apart. Right is listed in the cells its reach touches."""
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("reach")) / CELL), F.floor((F.col(c) + F.col("reach")) / CELL))
    r = right.filter("reach > 0").withColumn("_cx", F.explode(span("rx"))).withColumn("_cz", F.explode(span("rz")))
    cells = left.withColumns({"_cx": F.floor(F.col("x") / CELL), "_cz": F.floor(F.col("z") / CELL)})
    near = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("z") - F.col("rz")) ** 2) < F.col("reach")
    return cells.join(r, ["_cx", "_cz"]).filter(near if on is None else near & on).drop("_cx", "_cz")


def mountains(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """floating-mountain and buried-mountain, of props set on the relief."""
    rest = (1 - F.col("terrain_offset")) * F.col("ground")
    m = rows.filter("category = 'mountain' and terrain_offset > 0").withColumns({"lift": F.col("base") - rest, "peak": F.col("top") - rest})
    high = m.filter("lift > 0.3")
    other = m.select(F.col("id").alias("under"), F.col("ordinal").alias("under_ordinal"), F.col("x").alias("rx"), F.col("z").alias("rz"), F.col("top").alias("under_top"), (F.col("radius") * F.col("scale") * 0.7).alias("reach"))
    holds = reached(high.select("id", "x", "z", "lift"), other, (F.col("id") != F.col("under")) & (F.col("under_top") >= F.col("lift") - 0.2)).groupBy("id").agg(F.min_by("under", "under_ordinal").alias("under"))
    floating = high.join(holds, "id", "left")
    return finding(floating, "floating-mountain", F.when(F.col("under").isNotNull(), "info").otherwise("warning"), F.col("lift")), finding(m.filter("peak <= 0.05"), "buried-mountain", "warning", F.col("peak"))


def _off_water(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.contains("layer", F.lit("_sea_")) & ~F.contains("layer", F.lit("riv_")))


def prop_heights(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """buried-prop and floating-prop, of props with absolute heights."""
    p = rows.filter("terrain_offset <= 0")
    tall = F.greatest(F.col("tall"), F.lit(1e-4))
    buried = p.filter((F.col("top") < F.col("ground") - 0.2) & (tall > 0.01) & ~is_water_model(F.col("model")))
    high = _off_water(p.filter("category = 'rock'")).filter(F.col("base") > F.col("ground") + F.greatest(F.lit(0.15), 0.5 * tall))
    feet = rows.filter("category = 'mountain' and terrain_offset > 0").select(F.col("x").alias("rx"), F.col("z").alias("rz"), (F.col("radius") * F.col("scale") * 1.1).alias("reach"))
    on = reached(high.select("id", "x", "z"), feet).select("id").distinct()
    return finding(buried, "buried-prop", "warning", F.col("top") - F.col("ground")), finding(high.join(on, "id", "left_anti"), "floating-prop", "warning", F.col("base") - F.col("ground"))


def in_sea(rows: DataFrame) -> DataFrame:
    land = _off_water(rows.filter("category in ('tree', 'building')")).filter(~is_water_model(F.col("model")))
    return finding(land.filter("sea > ground + 0.2 and sea > 0"), "prop-in-sea", "warning", F.col("sea") - F.col("ground"))


def wrong_region(rows: DataFrame, hexes: DataFrame, grid: Grid) -> DataFrame:
    """Props of a region layer that stand in another region, with none of twelve probes two hexes around in their own."""
    region = hexes.select("col", "row", "region")
    col, row = grid.at(F.col("x"), F.col("z"))
    away = rows.filter("layer_region is not null").withColumns({"col": col, "row": row}).join(region, ["col", "row"], "left").filter(~F.col("region").eqNullSafe(F.col("layer_region"))).drop("col", "row", "region")
    around = away.select("id", "layer_region", F.inline(F.array(*[F.struct((F.col("x") + dx * 2 * grid.spacing).alias("px"), (F.col("z") + dz * 2 * grid.spacing).alias("pz")) for dx, dz in PROBES])))
    col, row = grid.at(F.col("px"), F.col("pz"))
    near = around.select("id", "layer_region", col.alias("col"), row.alias("row")).join(region, ["col", "row"]).filter("region = layer_region").select("id").distinct()
    return finding(away.join(near, "id", "left_anti"), "wrong-region", "info", F.lit(0.0))


def city_footprint(rows: DataFrame, hexes: DataFrame, grid: Grid) -> DataFrame:
    """Mountains and rocks that reach within a hex of a town, trees within two hexes of one or on a land road hex."""
    x, z = grid.centre(F.col("col"), F.col("row"))
    towns = hexes.filter("slot >= 0").select(x.alias("rx"), z.alias("rz"))
    reach = F.when(F.col("category") == "tree", 2 * grid.spacing).otherwise(F.col("radius") * F.col("scale") * 0.7 + grid.spacing)
    p = rows.filter("category in ('mountain', 'rock', 'tree')").withColumn("reach", reach).filter("reach is not null")
    # the reach is the prop's here, so props are listed in all cells they reach and towns in their own
    swapped = towns.select(F.col("rx").alias("x"), F.col("rz").alias("z"))
    hit = reached(swapped, p.select("id", F.col("x").alias("rx"), F.col("z").alias("rz"), "reach")).select("id").distinct()
    col, row = grid.at(F.col("x"), F.col("z"))
    roads = hexes.filter("road > 0 and terrain = 0").select("col", "row")
    on_road = p.filter("category = 'tree'").withColumns({"col": col, "row": row}).join(roads, ["col", "row"], "left_semi").select("id")
    return finding(p.join(hit.union(on_road).distinct(), "id", "left_semi"), "on-city-footprint", "warning", F.lit(0.0))


def road_river(hexes: DataFrame, grid: Grid) -> DataFrame:
    both = F.col("road").bitwiseAND(F.col("river"))
    x, z = grid.centre(F.col("col"), F.col("row"))
    return finding(hexes.filter((both != 0) & ~F.col("bridge")).select("id", x.alias("x"), z.alias("z"), both.alias("v")), "road-river", "info", F.col("v"))


def city(hexes: DataFrame) -> DataFrame:
    """Regions without a main slot, or with main-slot hexes off passable plain land (warning when most are)."""
    off = (F.col("terrain") != 0) | F.col("impassable")
    g = hexes.filter("region >= 0").groupBy(F.col("region").alias("id")).agg(F.count_if(F.col("slot") == 0).alias("n"), F.count_if((F.col("slot") == 0) & off).alias("bad")).filter("n = 0 or bad > 0")
    return finding(g.withColumn("layer", F.col("id").cast("string")), "city", F.when((F.col("n") == 0) | (F.col("bad") * 2 > F.col("n")), "warning").otherwise("info"), F.col("bad"))


def city_dressing(rows: DataFrame, hexes: DataFrame, grid: Grid) -> DataFrame:
    """Layers whose median building or other prop lies over three hexes from the mean main-slot hex of their region."""
    x, z = grid.centre(F.col("col"), F.col("row"))
    towns = hexes.filter("slot = 0").groupBy(F.col("region").alias("layer_region")).agg(F.avg(x).alias("cx"), F.avg(z).alias("cz"))
    p = rows.filter("category in ('building', 'other')")
    keys = ["layer", "layer_region"]
    mid = agg.upper_median(p, keys, "x").withColumnRenamed("median", "x").drop("n").join(agg.upper_median(p, keys, "z").withColumnRenamed("median", "z").drop("n"), keys)
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2) / grid.spacing
    return finding(mid.join(towns, "layer_region").withColumn("d", d).filter("d > 3"), "city-dressing", "info", F.col("d"))


def duplicates(rows: DataFrame, turn: tuple[str, ...] = ()) -> DataFrame:
    """Every copy after the first of the same layer, model and transform, rounded half to even to three decimals."""
    keys = ["layer", F.lower("model").alias("m"), *[F.bround(c, 3).alias(f"k_{c}") for c in ("x", "y", "z", "scale", *turn)]]
    named = rows.select("*", *keys[1:])
    copies = agg.later_copies(named, ["layer", "m", *[f"k_{c}" for c in ("x", "y", "z", "scale", *turn)]])
    return finding(copies, "duplicate", "info", F.col("copies"))


def scale_outliers(rows: DataFrame) -> DataFrame:
    """Scales over three times or under a third of the upper median of a model with ten uses or more."""
    named = rows.withColumn("_m", F.lower("model"))
    mid = agg.upper_median(named, ["_m"], "scale").filter("n >= 10 and median > 0")
    return finding(named.join(mid, "_m").filter("scale > median * 3 or scale < median / 3"), "scale-outlier", "info", F.col("scale") / F.col("median"))


def assets(rows: DataFrame) -> DataFrame:
    """One finding a model that doesn't load: info if it has no meshes, else error; the value is its uses."""
    bad = rows.filter("problem is not null").groupBy("model", "problem").agg(F.count("*").alias("uses"))
    return finding(bad, "asset", F.when(F.contains("problem", F.lit("no meshes")), "info").otherwise("error"), F.col("uses"))


def run(props: DataFrame, models: DataFrame, hexes: DataFrame, grid: Grid, checks: tuple[str, ...] = ()) -> DataFrame:
    """All findings, or those of the named checks."""
    rows = prepare(props, models)
    sound = rows.filter("problem is null")
    frames = [*mountains(sound), *prop_heights(sound), in_sea(sound), wrong_region(sound, hexes, grid), city_footprint(sound, hexes, grid), road_river(hexes, grid), city(hexes), city_dressing(sound, hexes, grid), duplicates(sound), scale_outliers(sound), assets(rows)]
    out = reduce(DataFrame.unionByName, frames)
    return out.filter(F.col("code").isin(*checks)) if checks else out


def summary(findings: DataFrame, fixable: tuple[str, ...] = ("floating-mountain", "buried-mountain", "buried-prop", "floating-prop", "duplicate")) -> DataFrame:
    """Totals by check and severity, and how many have a fix."""
    kind = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    fix = F.col("code").isin(*fixable) & ~((F.col("code") == "floating-mountain") & (F.col("severity") == "info"))
    return findings.groupBy("code").agg(F.count("*").alias("total"), kind("error"), kind("warning"), kind("info"), F.count_if(fix).alias("fixable"))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings numbered in report order: by check, then value descending."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("value"), "id", "layer", "model")))
