"""Column forms of hex-grid geometry: flat-topped hexes, odd columns half a hex up, row 0 in the south."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (direction, column step, row step on even columns, row step on odd columns); up first, clockwise.
DIRECTIONS = ((0, 0, 1, 1), (1, 1, 0, 1), (2, 1, -1, 0), (3, 0, -1, -1), (4, -1, -1, 0), (5, -1, 0, 1))


def neighbours(hexes: DataFrame) -> DataFrame:
    """Each row once for each of six directions, with dir, ncol and nrow; no join, no shuffle."""
    steps = F.array(*[F.struct(F.lit(d).alias("dir"), (F.col("col") + dc).alias("ncol"), (F.col("row") + F.when(F.col("col") % 2 == 0, even).otherwise(odd)).alias("nrow")) for d, dc, even, odd in DIRECTIONS])
    return hexes.select("*", F.inline(steps))


def cube(col: Column, row: Column) -> tuple[Column, Column, Column]:
    """Offset to cube coordinates (q, y, z), which sum to 0."""
    z = row - F.floor(col / 2)
    return col, -col - z, z


def distance(c1: Column, r1: Column, c2: Column, r2: Column) -> Column:
    """Steps between two hexes."""
    a, b = cube(c1, r1), cube(c2, r2)
    return F.greatest(*[F.abs(p - q) for p, q in zip(a, b, strict=True)])


def world_to_hex(x: Column, z: Column, radius: float, half: float, width: int, height: int) -> tuple[Column, Column]:
    """Column and row of the hex that holds a world point measured from the grid's corner, clamped to the grid.

    Columns are 1.5 radii apart and rows two halves; in the first third of a column the point may lie beyond the slanted
    upper or lower edge, in the column to the left.
    """
    across = (x + radius) / (1.5 * radius)
    col = F.floor(across)
    up = (z + F.when(col % 2 == 0, half).otherwise(0.0)) / (2 * half)
    row = F.floor(up)
    edge = (across - col) * 3
    lean = (up - row - 0.5) * 2
    upper = (edge < 1) & (lean >= edge)
    lower = (edge < 1) & ~upper & (-lean >= edge)
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("bigint")
    return clamp(col - F.when(upper | lower, 1).otherwise(0), width), clamp(row + F.when(upper, col % 2).when(lower, col % 2 - 1).otherwise(0), height)


def hex_centre(col: Column, row: Column, radius: float, half: float) -> tuple[Column, Column]:
    """World centre of a hex, measured from the grid's corner."""
    return col * 1.5 * radius, (row + 0.5) * 2 * half - F.when(col % 2 == 0, half).otherwise(0.0)
