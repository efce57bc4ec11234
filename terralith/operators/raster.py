"""Raster algebra on long-form rasters (x, y, v): sampling, resampling, normalising, blurs, distance, brushes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.scratch import settle

#: Side of the blocks that array kernels work on.
BLOCK = 256


def sample(points: DataFrame, raster: DataFrame, px: Column, py: Column, width: int, height: int, key: str = "id") -> DataFrame:
    """Points with v, the raster bilinearly sampled at (px, py) in pixels, clamped at its edges.

    A point becomes its four weighted corners, so that one join and one grouping do what four joins would.
    """
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    cx, cy = clamp(px, width), clamp(py, height)
    x0, y0 = F.floor(cx), F.floor(cy)
    fx, fy = cx - x0, cy - y0
    corners = F.array(*[F.struct(clamp(x0 + i, width).cast("bigint").alias("x"), clamp(y0 + j, height).cast("bigint").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for j in (0, 1) for i in (0, 1)])
    spread = points.select(key, F.inline(corners)).filter("w > 0")
    v = spread.join(raster.select("x", "y", "v"), ["x", "y"]).groupBy(key).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return points.join(v, key, "left")


def world_pixels(x: Column, z: Column, world: tuple[float, float], size: tuple[int, int]) -> tuple[Column, Column]:
    """Pixel coordinates of a world point; row 0 is north."""
    return x / world[0] * size[0] - 0.5, (1 - z / world[1]) * size[1] - 0.5


def normalise(raster: DataFrame, top: int = 65535) -> DataFrame:
    """Values stretched to 0..top and truncated; all 0 where the raster is flat. The range is one row."""
    span = raster.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")).cast("double") * top)).otherwise(0)
    return raster.crossJoin(F.broadcast(span)).select("x", "y", v.cast("bigint").alias("v"))


def shrink(raster: DataFrame, step: int) -> DataFrame:
    """Every step-th pixel."""
    return raster.filter((F.col("x") % step == 0) & (F.col("y") % step == 0)).select((F.col("x") / step).cast("bigint").alias("x"), (F.col("y") / step).cast("bigint").alias("y"), "v")


def enlarge(raster: DataFrame, step: int) -> DataFrame:
    """Each pixel repeated step by step times; no join."""
    n = F.sequence(F.lit(0), F.lit(step - 1))
    return raster.withColumn("_i", F.explode(n)).withColumn("_j", F.explode(n)).select((F.col("x") * step + F.col("_i")).alias("x"), (F.col("y") * step + F.col("_j")).alias("y"), "v")


def zip_channels(**rasters: DataFrame) -> DataFrame:
    """One column a raster; pixels of any."""
    out = None
    for name, r in rasters.items():
        one = r.select("x", "y", F.col("v").alias(name))
        out = one if out is None else out.join(one, ["x", "y"], "full_outer")
    return out


def zonal_max(samples: DataFrame, hi: float, start: float = -1.0) -> DataFrame:
    """The greatest sample of each cell, from start, and its 16-bit code ceil(max(h / hi, 0) * 65535)."""
    g = samples.groupBy("cx", "cy").agg(F.greatest(F.max("v"), F.lit(start)).alias("v"))
    return g.withColumn("code", F.ceil(F.greatest(F.col("v") / hi, F.lit(0.0)) * 65535))


def window_range(windows: DataFrame, raster: DataFrame, key: str = "ordinal", cell: int = 8) -> DataFrame:
    """Least and greatest value in each box (min_x..max_y)."""
    from terralith.operators.spatial import covering_boxes

    return covering_boxes(raster, windows.select(key, "min_x", "max_x", "min_y", "max_y"), cell).groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def box_blur(raster: DataFrame, reach: int) -> DataFrame:
    """Mean over reach pixels either way, along rows and then columns; windows shrink at the edges."""
    side = lambda by, along: Window.partitionBy(by).orderBy(along).rangeBetween(-reach, reach)
    once = raster.select("x", "y", F.avg("v").over(side("y", "x")).alias("v"))
    return once.select("x", "y", F.avg("v").over(side("x", "y")).alias("v"))


def pad(raster: DataFrame, size: tuple[int, int], by: tuple[int, int, int, int], replicate: bool = True, fill: int = 0) -> DataFrame:
    """The raster on a larger canvas (left, top, right, bottom); new pixels repeat the edge or have the fill."""
    (w, h), (left, top, right, bottom) = size, by
    moved = raster.select((F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), "v")
    spark = raster.sparkSession
    canvas = spark.range(w + left + right).select(F.col("id").alias("x")).crossJoin(spark.range(h + top + bottom).select(F.col("id").alias("y")))
    if not replicate:
        return canvas.join(moved, ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(fill)).alias("v"))
    near = lambda c, lo, n: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(lo + n - 1)).cast("bigint")
    asked = canvas.select("x", "y", near("x", left, w).alias("sx"), near("y", top, h).alias("sy"))
    return asked.join(moved.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v"), ["sx", "sy"], "left").select("x", "y", "v")


def brush(raster: DataFrame, x: float, y: float, radius: float, mode: str, strength: float = 1.0, target: float = 0.0) -> DataFrame:
    """raise, lower or flatten under a cosine falloff."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    fall = F.when(d < radius, 0.5 + 0.5 * F.cos(d / radius * float(np.pi))).otherwise(0.0)
    new = {"raise": F.col("v") + strength * fall, "lower": F.col("v") - strength * fall, "flatten": F.col("v") + (target - F.col("v")) * strength * fall * 0.5}[mode]
    return raster.select("x", "y", new.alias("v"))


def smooth(raster: DataFrame, x: float, y: float, radius: float, size: tuple[int, int], strength: float = 1.0) -> DataFrame:
    """Pixels drawn towards the mean of 25 samples, two pixels apart and clamped to the image, under a cosine falloff.

    Only pixels under the brush ask for samples, from the part of the raster around it. Sums of whole heights are exact.
    """
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    near = raster.filter((F.abs(F.col("x") - x) <= radius + 4) & (F.abs(F.col("y") - y) <= radius + 4))
    steps = F.expr("flatten(transform(sequence(-4, 4, 2), dx -> transform(sequence(-4, 4, 2), dy -> struct(dx, dy))))")
    asked = near.filter(d < radius).select("x", "y", F.inline(steps)).select("x", "y", *[F.least(F.greatest(F.col(c) + F.col(f"d{c}"), F.lit(0)), F.lit(n - 1)).alias(f"s{c}") for c, n in zip("xy", size, strict=True)])
    mean = asked.join(near.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v"), ["sx", "sy"]).groupBy("x", "y").agg(F.avg("v").alias("mean"))
    fall = (0.5 + 0.5 * F.cos(d / radius * float(np.pi))) * strength
    return raster.join(mean, ["x", "y"], "left").select("x", "y", F.coalesce(F.col("v") + (F.col("mean") - F.col("v")) * fall, F.col("v")).alias("v"))


def slope_mask(raster: DataFrame, limit: float) -> DataFrame:
    """Pixels with whether the step to the right or down exceeds limit."""
    right = F.lead("v").over(Window.partitionBy("y").orderBy("x"))
    down = F.lead("v").over(Window.partitionBy("x").orderBy("y"))
    return raster.select("x", "y", F.coalesce(F.greatest(F.abs(right - F.col("v")), F.abs(down - F.col("v"))) > limit, F.lit(False)).alias("steep"))


def sobel(raster: DataFrame) -> DataFrame:
    """gx and gy of inner pixels: each pixel sends its weighted value to its eight neighbours, and sums meet."""
    kernel = [(dx, dy, -dx * (2 if dy == 0 else 1), -dy * (2 if dx == 0 else 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    parts = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("v") * gx).alias("gx"), (F.col("v") * gy).alias("gy")) for dx, dy, gx, gy in kernel])
    return raster.select(F.inline(parts)).groupBy("x", "y").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.count("*").alias("n")).filter("n = 8").drop("n")


def distance_transform(mask: DataFrame, reach: int, straight: float = 1.0, slant: float = 1.4142135623730951, only: DataFrame | None = None) -> DataFrame:
    """Chamfer distance of every pixel to the nearest set one, up to reach; blocks carry a halo of reach pixels.

    mask: x, y, v (0 or 1). Farther pixels have a null distance. only: the blocks (bx, by) that are wanted.
    """
    near = F.sequence(F.floor((F.col("x") - reach) / BLOCK), F.floor((F.col("x") + reach) / BLOCK)), F.sequence(F.floor((F.col("y") - reach) / BLOCK), F.floor((F.col("y") + reach) / BLOCK))
    tiled = mask.withColumn("bx", F.explode(near[0])).withColumn("by", F.explode(near[1]))
    tiled = tiled.filter((F.col("v") > 0) | (F.floor(F.col("x") / BLOCK) == F.col("bx")) & (F.floor(F.col("y") / BLOCK) == F.col("by")))  # of the halo only set pixels count
    if only is not None:
        tiled = tiled.join(only, ["bx", "by"], "left_semi")

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(frame["bx"].iloc[0]), int(frame["by"].iloc[0])
        n = BLOCK + 2 * reach
        x, y = frame["x"].to_numpy() - bx * BLOCK + reach, frame["y"].to_numpy() - by * BLOCK + reach
        d = np.full((n + 2, n + 2), np.inf)
        have = np.zeros((n + 2, n + 2), dtype=bool)
        have[y + 1, x + 1] = True
        d[y[frame["v"] > 0] + 1, x[frame["v"] > 0] + 1] = 0
        for _ in range(2):
            for rows, back in ((range(1, n + 1), -1), (range(n, 0, -1), 1)):
                for r in rows:
                    up = np.minimum(d[r + back, 1:-1] + straight, np.minimum(d[r + back, :-2], d[r + back, 2:]) + slant)
                    line = np.minimum(d[r, 1:-1], up)
                    k = np.arange(n) * straight
                    line = np.minimum(np.minimum.accumulate(line - k) + k, (np.minimum.accumulate((line + k)[::-1])[::-1]) - k)
                    d[r, 1:-1] = line
        keep = (x >= reach) & (x < reach + BLOCK) & (y >= reach) & (y < reach + BLOCK)
        got = d[y[keep] + 1, x[keep] + 1]
        return pd.DataFrame({"x": frame["x"].to_numpy()[keep], "y": frame["y"].to_numpy()[keep], "d": np.where(got <= reach, got, np.nan)})

    return tiled.groupBy("bx", "by").applyInPandas(kernel, "x bigint, y bigint, d double").select("x", "y", F.when(~F.isnan("d"), F.col("d")).alias("d"))


def distance_field(mask: DataFrame, reach: int = 16, straight: float = 1.0, slant: float = 1.4142135623730951) -> DataFrame:
    """(x, y, d): the chamfer distance of every pixel to the nearest set one, however far; null without any.

    Blocks in which all pixels find a set one within reach are done; the others are taken again with four times the reach, so
    a task holds a block and what lies about it as far as its own pixels must look.
    """
    pixels = settle(mask.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "v"))
    x0, x1, y0, y1, some = pixels.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.max("v")).first()
    if not some:
        return pixels.select("x", "y", F.lit(None).cast("double").alias("d"))
    far = slant * (max(x1 - x0, y1 - y0) + 1)
    only, out = None, None
    while True:
        blocks = {"bx": F.floor(F.col("x") / BLOCK), "by": F.floor(F.col("y") / BLOCK)}
        found = settle(distance_transform(pixels, reach, straight, slant, only).withColumns(blocks))
        left = settle(found.filter("d is null").select("bx", "by").distinct())
        done = found.join(left, ["bx", "by"], "left_anti").select("x", "y", "d")
        out = done if out is None else out.union(done)
        if left.isEmpty() or reach > far:
            return out
        only, reach = left, reach * 4


def polygon_area(corners: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    """Signed area of each polygon (counter-clockwise is positive)."""
    w = Window.partitionBy(key).orderBy(order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(full)) for c in "xy")
    return corners.select(key, (F.col("x") * ny - nx * F.col("y")).alias("c")).groupBy(key).agg((F.sum("c") / 2).alias("area"))


def quad_cell(x0: Column, z0: Column, x1: Column, z1: Column, world: float, levels: int = 7) -> Column:
    """The deepest quadtree cell that holds a box, as a path of NW, NE, SW, SE digits 0 to 3; boxes across a border stay above it."""
    path, ok = F.lit(""), F.lit(True)
    for level in range(1, levels):
        size = world / 2**level
        cx, cz = F.floor(x0 / size), F.floor(z0 / size)
        ok = ok & (cx == F.floor(x1 / size)) & (cz == F.floor(z1 / size)) & (x0 >= 0) & (z0 >= 0) & (x1 < world) & (z1 < world)
        digit = (cx % 2) + 2 * (1 - cz % 2)
        path = F.concat(path, F.when(ok, digit.cast("int").cast("string")).otherwise(""))
    return path


def world_box(corner_lo: tuple[Column, Column, Column], corner_hi: tuple[Column, Column, Column], matrix: list[Column], move: tuple[Column, Column, Column]) -> list[tuple[Column, Column]]:
    """Bounds of a box turned by a 3 by 3 matrix (row-major) and moved; each row's extremes are sums of the extremes of its terms."""
    out = []
    for r in range(3):
        terms = [(matrix[3 * r + c] * corner_lo[c], matrix[3 * r + c] * corner_hi[c]) for c in range(3)]
        out.append((move[r] + sum((F.least(*t) for t in terms[1:]), F.least(*terms[0])), move[r] + sum((F.greatest(*t) for t in terms[1:]), F.greatest(*terms[0]))))
    return out


def ground_clamp(props: DataFrame, mode: str, sinks: DataFrame | None = None, only_down: bool = False, tolerance: float = 0.01) -> DataFrame:
    """Moves that set props on the ground: by their base, their origin, or the usual sink of their model."""
    if mode == "vanilla":
        props = props.join(sinks.select("model", "sink"), "model", "left")
    to = {"base": F.col("ground") - F.col("scale") * F.col("min_y"), "origin": F.col("ground"), "vanilla": F.col("ground") + F.coalesce("sink", F.lit(0.0)) if mode == "vanilla" else None}[mode]
    move = to - F.col("y")
    test = move < -tolerance if only_down else F.abs(move) > tolerance
    return props.withColumn("move", move).filter(test)


def floating(props: DataFrame, threshold: float) -> DataFrame:
    """Props whose lower end, of origin and model base, is more than threshold above the ground."""
    lowest = F.col("y") + F.least(F.lit(0.0), F.col("scale") * F.coalesce("min_y", F.lit(0.0)))
    return props.withColumn("above", lowest - F.col("ground")).filter(F.col("above") > threshold)


def tree_spots(cells: DataFrame) -> DataFrame:
    """Jitter and turn of each hex's tree from a linear congruential generator seeded by its place."""
    step = lambda s: s * 48271 % 2147483647
    seed = (F.shiftleft(F.col("row").cast("bigint"), 16) + F.col("col")) % 2147483647
    s1 = step(seed)
    s2, s3 = step(s1), step(step(s1))
    unit = lambda s: s / 2147483647.0
    return cells.select("*", unit(s1).alias("jx"), unit(s2).alias("jz"), (unit(s3) * 360).alias("turn"))


