"""Spatial joins: points to hexes and boxes, radius and nearest searches, footprints.

Unbounded sides meet on computed cells, never in a nested loop. The right side of a box or palette join is a dimension;
it is cut to the cells it covers, so that it needs no broadcast either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.hexgrid import distance, world_to_hex


def point_region(points: DataFrame, hexes: DataFrame, radius: float, half: float, width: int, height: int, x: str = "x", z: str = "z") -> DataFrame:
    """Points with the col, row and region of their hex; region is null off the given hexes."""
    col, row = world_to_hex(F.col(x), F.col(z), radius, half, width, height)
    return points.withColumns({"col": col, "row": row}).join(hexes.select("col", "row", "region"), ["col", "row"], "left")


def box_cells(boxes: DataFrame, cell: int) -> DataFrame:
    """Each box once for each square cell that it touches, as bx and by."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return boxes.filter("min_x <= max_x and min_y <= max_y").withColumn("bx", F.explode(span("min_x", "max_x"))).withColumn("by", F.explode(span("min_y", "max_y")))


def covering_boxes(points: DataFrame, boxes: DataFrame, cell: int = 8) -> DataFrame:
    """Every (point, box) with the point inside, edges included."""
    p = points.withColumns({"bx": F.floor(F.col("x") / cell), "by": F.floor(F.col("y") / cell)})
    both = p.join(box_cells(boxes, cell), ["bx", "by"])
    return both.filter("x between min_x and max_x and y between min_y and max_y").drop("bx", "by")


def box_extremes(points: DataFrame, boxes: DataFrame, key: str, cell: int = 8, **best: tuple[str, Column]) -> DataFrame:
    """key and, for each name, the minimum ("min") or maximum ("max") of a column over the boxes that cover a point; covered points alone.

    Boxes of one extent become one, with their own extremes, and points of one place are looked up once; so what meets in a
    cell are different boxes and different places, however many rows share them.
    """
    of = {"min": F.min, "max": F.max}
    again = [of[kind](n).alias(n) for n, (kind, _) in best.items()]
    extents = boxes.groupBy("min_x", "max_x", "min_y", "max_y").agg(*[of[kind](c).alias(n) for n, (kind, c) in best.items()])
    places = covering_boxes(points.select("x", "y").distinct(), extents, cell).groupBy("x", "y").agg(*again)
    return points.select(key, "x", "y").join(places, ["x", "y"]).groupBy(key).agg(*again)


def first_box(points: DataFrame, boxes: DataFrame, key: str = "id", cell: int = 8) -> DataFrame:
    """For each covered point the box of least ordinal."""
    return box_extremes(points, boxes, key, cell, ordinal=("min", F.col("ordinal")))


def boxes_by_list(points: DataFrame, boxes: DataFrame, lists: dict[str, int], key: str = "id") -> DataFrame:
    """Points with, for each named list, the first covering box of that list, or null: one join and one grouping for all."""
    named = boxes.filter(F.col("list").isin(list(lists.values())))
    firsts = box_extremes(points, named, key, **{name: ("min", F.when(F.col("list") == n, F.col("ordinal"))) for name, n in lists.items()})
    return points.join(firsts, key, "left")


def within(left: DataFrame, right: DataFrame, radius: float, how: str = "inner") -> DataFrame:
    """left (x, z, …) and right (rx, rz, …) rows at most radius apart; how: inner, left_semi or left_anti.

    The right side is listed in every cell its circle's square touches, the left in its own.
    """
    near = lambda c: F.sequence(F.floor((F.col(c) - radius) / radius), F.floor((F.col(c) + radius) / radius))
    r = right.withColumn("_cx", F.explode(near("rx"))).withColumn("_cz", F.explode(near("rz")))
    cells = left.withColumns({"_lx": F.floor(F.col("x") / radius), "_lz": F.floor(F.col("z") / radius)})
    close = (F.col("_lx") == F.col("_cx")) & (F.col("_lz") == F.col("_cz")) & ((F.col("x") - F.col("rx")) ** 2 + (F.col("z") - F.col("rz")) ** 2 <= radius * radius)
    return cells.join(r, close, how).drop("_cx", "_cz", "_lx", "_lz")


#: Rows of one place that travel together at most.
TOGETHER = 1000


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """(id, other): all pairs of points (id, x, z) at most radius apart, the lesser id first.

    The ids of a place travel in lists of about `TOGETHER`, and lists meet, so that coordinates and cells are shuffled once a
    list and not once a point and cell. Pairs are written out where the lists meet.
    """
    crowds = points.groupBy("x", "z").agg(F.ceil(F.count("*") / TOGETHER).alias("_parts")).filter("_parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(0))
    lists = points.filter("x is not null and z is not null").join(crowds, ["x", "z"], "left").groupBy("x", "z", part.alias("_part")).agg(F.collect_list("id").alias("ids"))
    right = lists.select(F.col("ids").alias("others"), F.col("x").alias("rx"), F.col("z").alias("rz"))
    met = within(lists.select("x", "z", "ids"), right, radius).select("ids", "others")
    return met.select(F.explode("ids").alias("id"), "others").select("id", F.explode("others").alias("other")).filter("id < other")


def nearest_colour(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """rgb with the name of the palette colour of least Chebyshev distance (ties: least ordinal) and the distance.

    The colour cube is halved along its sides eight times. Each colour keeps the cells of the palette that may hold a nearest
    one: those no farther than the nearest of the colours that stand for the cells, one each. Cells that hold none are never
    met, so the work of a colour follows the cells around it, not the palette.
    """
    part = lambda c, k: F.shiftright(F.col(c), k).bitwiseAND(255).cast("int")
    own = palette.filter("rgb is not null").groupBy(F.col("rgb").bitwiseAND(0xFFFFFF).cast("int").alias("prgb")).agg(F.min(F.struct("ordinal", "name")).alias("p"))

    def cells(side: int) -> DataFrame:
        """The palette's cells of 2**side and the colour that stands for each."""
        keep = ((0xFF >> side) << side) * 0x10101
        return own.groupBy(F.col("prgb").bitwiseAND(keep).alias("cell")).agg(F.min("prgb").alias("prgb"))

    def near(rows: DataFrame, side: int) -> DataFrame:
        """rgb and the cells that are left of rows (rgb, cell, prgb)."""
        away = F.greatest(*[F.abs(part("rgb", k) - part("prgb", k)) for k in (16, 8, 0)])
        low = F.greatest(*[F.greatest(part("cell", k) - part("rgb", k), part("rgb", k) - part("cell", k) - ((1 << side) - 1), F.lit(0)) for k in (16, 8, 0)])
        least = F.min("away").over(Window.partitionBy("rgb"))
        return rows.withColumns({"away": away, "low": low}).withColumn("least", least).filter("low <= least").select("rgb", "cell")

    asked = colours.select("rgb").distinct()
    left = near(asked.filter("rgb is not null").crossJoin(F.broadcast(cells(7))), 7)  # eight cells at most
    for side in range(6, 0, -1):
        eighths = F.explode(F.array(*[F.col("cell") + ((i << 16 | j << 8 | k) << side) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
        left = near(left.select("rgb", eighths.alias("cell")).join(cells(side), "cell"), side)
    last = F.explode(F.array(*[F.col("cell") + (i << 16 | j << 8 | k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    gap = F.greatest(*[F.abs(part("rgb", k) - part("prgb", k)) for k in (16, 8, 0)])
    best = left.select("rgb", last.alias("prgb")).join(own, "prgb").groupBy("rgb").agg(F.min(F.struct(gap.alias("distance"), "p.ordinal", "p.name")).alias("best"))
    none = asked.filter("rgb is null").crossJoin(F.broadcast(palette.agg(F.min(F.struct("ordinal", "name")).alias("p")).filter("p is not null")))  # at no distance of any
    return best.select("rgb", "best.name", F.col("best.distance").cast("bigint").alias("distance")).union(none.select("rgb", "p.name", F.lit(None).cast("bigint")))


def nearest_hex(hexes: DataFrame, target: tuple[int, int], order: tuple[Column, Column] | None = None) -> DataFrame:
    """The hex nearest to target; ties by the order given (columns, then rows, by default)."""
    a, b = order or (F.col("col"), F.col("row"))
    d = distance(F.col("col"), F.col("row"), F.lit(target[0]), F.lit(target[1]))
    return hexes.agg(F.min_by(F.struct("col", "row", d.alias("d")), F.struct(d, a, b)).alias("best")).select("best.col", "best.row", F.col("best.d").cast("bigint").alias("distance"))


def landmarks(hexes: DataFrame) -> DataFrame:
    """The passable box of hexes and the passable hex nearest to each of its eight corners and edge middles."""
    ok = hexes.filter("not impassable")
    box = ok.agg(F.min("col").alias("x0"), F.max("col").alias("x1"), F.min("row").alias("y0"), F.max("row").alias("y1"))
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    spots = [("x0", "y0"), (None, "y0"), ("x1", "y0"), ("x0", None), ("x1", None), ("x0", "y1"), (None, "y1"), ("x1", "y1")]
    targets = box.select(F.inline(F.array(*[F.struct(F.lit(k).alias("landmark"), (F.col(x) if x else mid("x0", "x1")).cast("bigint").alias("tx"), (F.col(y) if y else mid("y0", "y1")).cast("bigint").alias("ty")) for k, (x, y) in enumerate(spots)])))
    d = distance(F.col("col"), F.col("row"), F.col("tx"), F.col("ty"))
    best = F.min(F.struct(d.alias("d"), F.col("col"), F.col("row"))).alias("best")
    return ok.crossJoin(F.broadcast(targets)).groupBy("landmark").agg(best).select("landmark", "best.col", "best.row", F.col("best.d").cast("bigint").alias("distance"))


def layer_at_point(objects: DataFrame, x: float, z: float, reach: float = 4.0) -> DataFrame:
    """The layer with most objects within reach of a point, else the layer of the nearest object."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("z") - z) ** 2)
    return objects.groupBy("layer").agg(F.count_if(d < reach).alias("near"), F.min(d).alias("nearest")).orderBy(F.desc("near"), "nearest", "layer").limit(1)


def footprint(tiles: DataFrame) -> DataFrame:
    """Each tile once for each cell it covers: width and height swap when turned a quarter (0x20, 0x80); a mask bit of 0 leaves a cell out.

    Bit i * height + j of the mask is the tile's own cell (i, j).
    """
    turned = F.col("rot").isin(0x20, 0x80)
    w, h = F.when(turned, F.col("h")).otherwise(F.col("w")), F.when(turned, F.col("w")).otherwise(F.col("h"))
    cells = tiles.withColumn("dx", F.explode(F.sequence(F.lit(0), (w - 1).cast("int")))).withColumn("dy", F.explode(F.sequence(F.lit(0), (h - 1).cast("int"))))
    i = F.when(F.col("rot") == 0x10, F.col("dx")).when(F.col("rot") == 0x20, F.col("dy")).when(F.col("rot") == 0x40, F.col("w") - 1 - F.col("dx")).otherwise(F.col("w") - 1 - F.col("dy"))
    j = F.when(F.col("rot") == 0x10, F.col("dy")).when(F.col("rot") == 0x20, F.col("h") - 1 - F.col("dx")).when(F.col("rot") == 0x40, F.col("h") - 1 - F.col("dy")).otherwise(F.col("dx"))
    kept = cells.withColumn("bit", (i * F.col("h") + j).cast("int")).filter(F.expr("(mask >> bit) & 1 = 1"))
    return kept.withColumns({"cx": (F.col("x") + F.col("dx")).cast("bigint"), "cy": (F.col("y") + F.col("dy")).cast("bigint")}).drop("dx", "dy", "bit")


def conflicts(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells held by more than one tile, or off the map: count, first tile and whether it lies off."""
    out = cells.groupBy("cx", "cy").agg(F.countDistinct("ordinal").alias("tiles"), F.min("ordinal").alias("first"))
    off = ~(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1))
    return out.withColumn("off_map", off).filter((F.col("tiles") > 1) | F.col("off_map"))


def first_tile_at(points: DataFrame, cells: DataFrame, key: str = "id") -> DataFrame:
    """For each point on a covered cell the tile of least ordinal."""
    return points.join(cells.select(F.col("cx").alias("x"), F.col("cy").alias("y"), "ordinal"), ["x", "y"]).groupBy(key).agg(F.min("ordinal").alias("ordinal"))


def highest_box(points: DataFrame, boxes: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The greatest value among the boxes over each point."""
    return box_extremes(points, boxes, key, **{value: ("max", F.col(value))})


def uncovered(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells (x, y) under no box."""
    covered = boxes.select(F.explode(F.sequence("min_x", "max_x")).alias("x"), "min_y", "max_y").select("x", F.explode(F.sequence("min_y", "max_y")).alias("y")).distinct()
    return cells.join(covered, ["x", "y"], "left_anti")


def overlay(assets: DataFrame, key: str = "path") -> DataFrame:
    """One row a path, case aside: that of the source first in priority."""
    best = Window.partitionBy(F.lower(key)).orderBy("priority", "ordinal")
    return assets.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def base_override(base: DataFrame, over: DataFrame, key: str = "id", replaced: Column | None = None) -> DataFrame:
    """Full outer merge with an action for each key: kept, replaced, added, or dropped where replaced holds for a base row without override."""
    b = base.select(F.col(key), F.struct(*[c for c in base.columns if c != key]).alias("_b"), F.lit(True).alias("_in_b"))
    o = over.select(F.col(key), F.struct(*[c for c in over.columns if c != key]).alias("_o"), F.lit(True).alias("_in_o"))
    both = b.join(o, key, "full_outer")
    gone = replaced if replaced is not None else F.lit(False)
    action = F.when(F.col("_in_b") & F.col("_in_o"), "replaced").when(F.col("_in_o"), "added").when(gone, "dropped").otherwise("kept")
    return both.select(key, action.alias("action"), F.when(F.col("_in_o"), F.col("_o")).otherwise(F.col("_b")).alias("row"))
