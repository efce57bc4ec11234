"""Triangles as height fields, and the heights of a scene."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators.scratch import unsent

#: Points that one vectorised step tests.
STEP = 1 << 18
#: Points a side of the pieces that a triangle's box is cut into before it is dealt out.
PIECE = 256
#: A point counts as inside while its weights lie between these, in single precision.
_LEAST, _MOST = np.float32(-9.999999747378752e-05), np.float32(1.000100016593933)

_CORNERS = ["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]


def _weights(p: dict[str, np.ndarray], x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inside, t, u, w): the weights of corners a, b and c at points, in single precision and this order of operations."""
    x, z = x.astype(np.float32), z.astype(np.float32)
    bz, bx, cz, cx = p["bz"] - p["az"], p["bx"] - p["ax"], p["cz"] - p["az"], p["cx"] - p["ax"]
    pz, px = z - p["az"], x - p["ax"]
    d00, d01, d11 = bz * bz + bx * bx, cz * bz + cx * bx, cz * cz + cx * cx
    d02, d12 = pz * bz + px * bx, pz * cz + px * cx
    den = d11 * d00 - d01 * d01
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        inv = np.float32(1) / den
        u = (d02 * d11 - d12 * d01) * inv
        w = (d12 * d00 - d02 * d01) * inv
        t = (np.float32(1) - u) - w
        inside = (den != 0) & (t >= _LEAST) & (t <= _MOST) & (u >= _LEAST) & (u <= _MOST) & (w >= _LEAST) & (w <= _MOST)
    return inside, t, u, w


def _scan(scale: float, width: int, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.float32(scale)
        for batch in batches:
            col = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
            wide = col["x1"] - col["x0"]
            size = wide * (col["z1"] - col["z0"])
            ends = np.cumsum(size)
            lo = 0
            while lo < len(size):
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + STEP, side="right")))
                k = np.repeat(np.arange(lo, hi), size[lo:hi])
                nth = np.arange(len(k)) - np.repeat(ends[lo:hi] - size[lo:hi] - base, size[lo:hi])
                z, x = col["z0"][k] + nth // wide[k], col["x0"][k] + nth % wide[k]
                corner = {c: col[c][k].astype(np.float32) for c in _CORNERS}
                inside, t, u, w = _weights(corner, x, z)
                sx, sz = factor * x.astype(np.float32), factor * z.astype(np.float32)
                keep = np.flatnonzero(inside & (sx >= 0) & (sx < width) & (sz >= 0) & (sz < height))
                y = w[keep] * corner["cy"][keep] + u[keep] * corner["by"][keep] + t[keep] * corner["ay"][keep]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (sx[keep].astype(np.int64), sz[keep].astype(np.int64), col["ordinal"][k][keep], z[keep], x[keep], y)], names=["px", "pz", "ordinal", "z", "x", "y"])
                lo = hi

    return run


def rasterise(triangles: DataFrame, scale: float, width: int, height: int, piece: int | None = None) -> DataFrame:
    """(px, pz, y): the height field of triangles (ordinal, ax, ay, az, bx, ..., cz); cells that none covers are absent.

    Each triangle is tested at the whole points of its box, from one below its least corner to its largest; a point inside
    sets the cell that it is scaled to. The triangle of largest ordinal wins a cell, there its last point by (z, x). Boxes are
    cut into pieces that are dealt out by the cells they set, so a giant triangle is the work of many tasks, and a cell keeps
    its winner alone before the shuffle.
    """
    piece = piece or PIECE
    f = triangles.select(F.col("ordinal").cast("bigint").alias("ordinal"), *[F.col(c).cast("float").alias(c) for c in _CORNERS])
    whole = lambda axis: [F.col(f"{k}{axis}").cast("bigint") for k in "abc"]  # noqa: E731  cut towards zero
    # only points that can set a cell, and none that a box of one missing corner would need
    box = {"_x0": F.least(*whole("x")) - 1, "_x1": F.greatest(*whole("x")) + 1, "_z0": F.least(*whole("z")) - 1, "_z1": F.greatest(*whole("z")) + 1}
    for axis, n in (("x", width), ("z", height)):
        box[f"_{axis}0"] = F.greatest(box[f"_{axis}0"], F.lit(0).cast("bigint"))
        box[f"_{axis}1"] = F.least(box[f"_{axis}1"], F.lit(int(n / scale) + 2).cast("bigint"))
    f = f.withColumns(box).filter("_x0 < _x1 and _z0 < _z1")
    cut = lambda axis: F.explode(F.sequence(F.floor(F.col(f"_{axis}0") / piece), F.floor((F.col(f"_{axis}1") - 1) / piece)))
    f = f.withColumn("_i", cut("x")).withColumn("_k", cut("z"))
    bounds = [(F.greatest("_x0", F.col("_i") * piece)).alias("x0"), (F.least("_x1", (F.col("_i") + 1) * piece)).alias("x1"), (F.greatest("_z0", F.col("_k") * piece)).alias("z0"), (F.least("_z1", (F.col("_k") + 1) * piece)).alias("z1")]
    pieces = f.repartition("_i", "_k", "ordinal").select("ordinal", *_CORNERS, *[b.cast("bigint").alias(n) for b, n in zip(bounds, ("x0", "x1", "z0", "z1"), strict=True)])
    points = pieces.mapInArrow(_scan(scale, width, height), "px bigint, pz bigint, ordinal bigint, z bigint, x bigint, y float")
    return points.groupBy("px", "pz").agg(F.max_by("y", F.struct("ordinal", "z", "x")).alias("y"))


def patch_heights(points: DataFrame, patches: DataFrame, cell: float = 16.0) -> DataFrame:
    """(id, patch): the highest patch at each point (id, x, z) that some patch answers.

    patches: a box on the map (min_x, max_x, min_z, max_z), edges included, and a plane over it: height at its least corner
    and rises along x and z over the box.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    near = patches.filter("min_x <= max_x and min_z <= max_z").select("min_x", "max_x", "min_z", "max_z", "height", "rise_x", "rise_z").distinct().withColumn("_i", span("min_x", "max_x")).withColumn("_k", span("min_z", "max_z"))
    over = points.withColumns({"_i": F.floor(F.col("x") / cell), "_k": F.floor(F.col("z") / cell)}).join(unsent(near), ["_i", "_k"]).filter("x between min_x and max_x and z between min_z and max_z")
    share = lambda p, a, b: F.when(F.col(b) > F.col(a), (F.col(p) - F.col(a)) / (F.col(b) - F.col(a))).otherwise(0.0)
    return over.groupBy("id").agg(F.max(F.col("height") + F.col("rise_x") * share("x", "min_x", "max_x") + F.col("rise_z") * share("z", "min_z", "max_z")).alias("patch"))


def scene_heights(points: DataFrame, field: DataFrame, patches: DataFrame, fallback: DataFrame, cell: Column | None = None) -> DataFrame:
    """(id, height, source) of every point (id, x, z): the higher of the mesh under it and the highest patch; without a mesh the fallback, 0 if that doesn't answer either.

    field: (px, pz, y) of the global mesh, a cell a whole unit; fallback: (id, height) of the tiles below. A patch counts only
    where it is higher.
    """
    at = points.select("id", "x", "z", F.floor("x").alias("px"), F.floor("z").alias("pz"))
    both = at.join(unsent(field.select("px", "pz", F.col("y").cast("double").alias("mesh"))), ["px", "pz"], "left")
    both = both.join(unsent(patch_heights(points, patches)), "id", "left").join(unsent(fallback.select("id", F.col("height").alias("_tile"))), "id", "left")
    ground = F.coalesce("mesh", "_tile", F.lit(0.0))
    source = F.when(F.col("patch") >= ground, "patch").when(F.col("mesh").isNotNull(), "mesh").when(F.col("_tile").isNotNull(), "tile").otherwise("none")
    return both.select("id", F.greatest(ground, F.coalesce("patch", ground)).alias("height"), source.alias("source"))
