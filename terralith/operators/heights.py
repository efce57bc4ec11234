"""Heights in single precision: samples of stored rasters, and the first answering tile of an ordered stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators.scratch import settle, unsent

#: Rasters store 16-bit steps between two heights; a tile's own raster is scaled by SIZE / 128, the map's by
#: 1100 steps with 240 below zero.
_STEPS = 65535.0
LOW_RISE, LOW_BELOW = 1100.0, 240.0


def f32(x: Column | float) -> Column:
    """A single-precision column."""
    return (F.lit(float(x)) if isinstance(x, (int, float)) else x).cast("float")


def _quotient(a: Column, b: Column) -> Column:
    """a / b in single precision: rounding the double quotient once more gives the same."""
    return f32(a.cast("double") / b.cast("double"))


def sample(rows: DataFrame, pixels: DataFrame, sizes: DataFrame, key: str, on: tuple[str, ...] = ()) -> DataFrame:
    """rows with `sample`: the raster named by on under (u, v), bilinear between the pixel at (floor, floor - 1) and its neighbours, clamped; null where there is no such raster.

    rows: key, u, v (single precision); pixels: on, x, y, v; sizes: on, w, h, lo, hi. Four pixels a row are looked up by one
    join, so neither rasters nor rows must fit anywhere; operations are in single precision and a fixed order.
    """
    sizes = sizes.select(*on, F.col("w").cast("int").alias("_w"), F.col("h").cast("int").alias("_h"), f32(F.col("lo")).alias("_lo"), f32(F.col("hi")).alias("_hi"))
    asked = rows.join(sizes, list(on), "left") if on else rows.crossJoin(F.broadcast(sizes))  # one row
    asked = asked.withColumns({"_fx": f32(F.col("_w")) * F.col("u"), "_fy": f32(F.col("_h")) * F.col("v")})
    x, y = F.col("_fx").cast("int"), F.col("_fy").cast("int")
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.col(n) - 1)
    spots = F.array(*[F.struct(F.lit(k).alias("k"), clamp(x + dx, "_w").alias("x"), clamp(y + dy, "_h").alias("y")) for k, (dx, dy) in enumerate(((0, -1), (1, -1), (0, 0), (1, 0)))])
    looked = asked.filter("_w is not null").select(key, *on, "_lo", "_hi", F.inline(spots))
    pixel = pixels.select(*on, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), f32(F.col("v")).alias("_raw"))
    value = F.col("_raw") * f32(1.0 / _STEPS) * (F.col("_hi") - F.col("_lo")) + F.col("_lo")
    found = looked.join(pixel if on else unsent(pixel), [*on, "x", "y"]).select(key, "k", value.alias("_v"))
    four = found.groupBy(key).agg(*[F.max(F.when(F.col("k") == k, F.col("_v"))).alias(f"_{n}") for k, n in enumerate("abcd")])
    a, b, c, d = (F.col(f"_{n}") for n in "abcd")
    dx, dy = F.col("_fx") - f32(F.floor("_fx")), F.col("_fy") - f32(F.floor("_fy"))
    top, bottom = (b - a) * dx + a, (d - c) * dx + c
    return asked.join(unsent(four), key, "left").withColumn("sample", (bottom - top) * dy + top).drop("_w", "_h", "_lo", "_hi", "_fx", "_fy", "_a", "_b", "_c", "_d")


def low_heights(points: DataFrame, pixels: DataFrame, size: DataFrame, tile: float, across: float, along: float) -> DataFrame:
    """points (id, x, z) with `low`, the map's own raster (pixels x, y, v; size w, h, lo, hi) under them; its last row lies at z 0."""
    x, z = f32(F.col("x")), f32(F.col("z"))
    rows = points.withColumns({"u": _quotient(x, f32(across)), "v": f32(1.0) - _quotient(z, f32(along))})
    scale = f32(1.0 / 128.0) * f32(tile)
    return sample(rows, pixels, size, "id").withColumn("low", F.col("sample") * f32(LOW_RISE) * scale - scale * f32(LOW_BELOW)).drop("sample", "u", "v")


def first_heights(points: DataFrame, tiles: DataFrame, pixels: DataFrame, sizes: DataFrame, tile: float, across: float, along: float) -> DataFrame:
    """(id, ordinal, high, height): for each point (id, x, z, low) the first tile by ordinal that answers, its raster's height and the sum with low; zeros and no tile where none does.

    tiles: ordinal, x, y, w, h, rot (0x10, 0x20, 0x40, 0x80), mask (bit i * h + j for the sub-tile i, j from below; null for
    none), path. A tile answers where a masked-in sub-tile lies, or, without a mask, where its raster isn't 0. Tiles without
    a raster are flat. pixels: path, x, y, v; sizes: path, w, h, lo, hi.
    """
    inv = _quotient(f32(1.0), f32(tile))
    on_map = (F.col("x") >= 0) & (F.col("z") >= 0) & (f32(F.col("x")) <= f32(across)) & (f32(F.col("z")) <= f32(along))
    at = points.filter(on_map).select("id", "low", (inv * f32(F.col("x"))).alias("tx"), (inv * f32(F.col("z"))).alias("ty"))
    at = at.withColumns({"gx": F.floor("tx"), "gy": F.floor("ty")})
    turned = F.col("rot").isin(0x20, 0x80)
    wide, tall = F.when(turned, F.col("h")).otherwise(F.col("w")), F.when(turned, F.col("w")).otherwise(F.col("h"))
    span = lambda c, n: F.explode(F.sequence(F.col(c).cast("bigint"), (F.col(c) + n).cast("bigint")))  # noqa: E731  far edges included
    cells = tiles.select("ordinal", F.col("x").alias("x0"), F.col("y").alias("y0"), "w", "h", "rot", "mask", "path", wide.alias("wide"), tall.alias("tall"))
    cells = cells.withColumn("gx", span("x0", F.col("wide"))).withColumn("gy", span("y0", F.col("tall")))
    near = at.join(unsent(cells), ["gx", "gy"]).filter((f32(F.col("tx")) <= f32(F.col("x0") + F.col("wide"))) & (F.col("ty") <= f32(F.col("y0") + F.col("tall"))))
    a = _quotient(F.col("tx") - f32(F.col("x0")), f32(F.col("x0") + F.col("wide")) - f32(F.col("x0")))
    b = _quotient(F.col("ty") - f32(F.col("y0")), f32(F.col("y0") + F.col("tall")) - f32(F.col("y0")))
    one, rot = f32(1.0), F.col("rot")
    near = near.withColumns({"ix": (F.col("tx") - f32(F.col("x0"))).cast("int"), "iy": (F.col("ty") - f32(F.col("y0"))).cast("int")})
    col = F.when(rot == 0x20, F.col("w") - F.col("iy") - 1).when(rot == 0x40, F.col("w") - F.col("ix") - 1).when(rot == 0x80, F.col("iy")).otherwise(F.col("ix"))
    row = F.when(rot == 0x20, F.col("ix")).when(rot == 0x40, F.col("h") - F.col("iy") - 1).when(rot == 0x80, F.col("h") - F.col("ix") - 1).otherwise(F.col("iy"))
    inside = (col >= 0) & (row >= 0) & (col < F.col("w")) & (row < F.col("h"))
    bit = F.when(inside, F.getbit(F.col("mask").cast("bigint"), (col * F.col("h") + row).cast("int")) == 1).otherwise(F.lit(False))
    valid = F.when(F.col("mask").isNull(), inside).otherwise(bit)
    near = near.withColumn("valid", valid).filter("mask is null or valid")
    near = near.withColumns({
        "u": F.when(rot == 0x10, a).when(rot == 0x20, one - b).when(rot == 0x40, one - a).when(rot == 0x80, b).otherwise(f32(0.0)),
        "v": F.when(rot == 0x10, b).when(rot == 0x20, a).when(rot == 0x40, one - b).when(rot == 0x80, one - a).otherwise(f32(0.0)),
        "pair": F.struct("id", "ordinal"),
    })
    near = settle(near.select("pair", "path", "u", "v", "low", "valid"))
    high = F.coalesce(F.col("sample") * (f32(1.0 / 128.0) * f32(tile)), f32(0.0))
    answers = sample(near, pixels, sizes, "pair", ("path",)).withColumn("high", high).filter("valid or high <> 0")
    first = answers.groupBy("pair.id").agg(F.min_by(F.struct("pair.ordinal", "high", "low"), "pair.ordinal").alias("f")).select("id", "f.ordinal", "f.high", (F.col("f.high") + F.col("f.low")).alias("height"))
    return points.select("id").join(unsent(first), "id", "left").select("id", "ordinal", F.coalesce("high", f32(0.0)).alias("high"), F.coalesce("height", f32(0.0)).alias("height"))
