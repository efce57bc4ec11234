"""Graph operators: closures, components, floods, shortest paths, erosion. Loops keep their state in written tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.hexgrid import neighbours
from terralith.operators.ranks import ranked
from terralith.operators.scratch import release, settle

#: Rounds that any loop may take before it is an error.
MAX_ROUNDS = 10_000
#: Cells a side of the blocks that components are labelled in.
BLOCK = 64
#: Hexes that a flood may fill, by contract.
FLOOD_LIMIT = 20_000


def closure(tops: DataFrame, children: DataFrame) -> DataFrame:
    """(id, top, depth): every row reached from a top through (id, parent) links, one level of joins a round; cycles end at rows already reached."""
    reached = settle(tops.select("id", F.col("id").alias("top"), F.lit(0).alias("depth")))
    front = reached
    for depth in range(1, MAX_ROUNDS):
        step = children.join(front.select(F.col("id").alias("parent"), "top"), "parent").select("id", "top", F.lit(depth).alias("depth"))
        front = settle(step.join(reached.select("id", "top"), ["id", "top"], "left_anti").distinct())
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
    raise RuntimeError("the closure did not end")


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): each node with the least id of its component.

    A round takes the least label of the neighbours and then the label's own label, so labels move along chains in
    doubling steps; it ends when the sum of labels stays.
    """
    now = settle(nodes.select("id", F.col("id").alias("comp")))
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    last = None
    for _ in range(MAX_ROUNDS):
        near = both.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("comp").alias("m"))
        least = now.join(near, "id", "left").select("id", F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = settle(least)
        old, now = now, settle(jump.join(jump.select(F.col("id").alias("comp"), F.col("comp").alias("next")), "comp").select("id", F.col("next").alias("comp")))
        release(old, jump)
        mark = now.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if mark == last:
            release(both)
            return now
        last = mark
    raise RuntimeError("components did not settle")


def hex_edges(hexes: DataFrame, on: Column | None = None) -> DataFrame:
    """(src, dst, dir) between neighbouring hexes that are both given; on compares columns of n_ and own names."""
    here = hexes.select(F.col("id").alias("dst"), F.col("col").alias("ncol"), F.col("row").alias("nrow"), *[F.col(c).alias(f"n_{c}") for c in hexes.columns if c not in ("id", "col", "row")])
    out = neighbours(hexes).join(here, ["ncol", "nrow"])
    return (out.filter(on) if on is not None else out).withColumnRenamed("id", "src")


def _least_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """The least id that each node of one block's edges is connected with."""
    ids, at = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return pd.DataFrame({"id": ids, "local": ids[label]})
        label = new


def label_in_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label_components for edges (src, dst, src_block, dst_block) of a map cut into blocks of `BLOCK` cells a side.

    A block is labelled by an array kernel in one task, which holds at most its own cells; only the labels that meet over the
    borders of blocks go through the rounds.
    """
    edges = settle(edges.select("src", "dst", "src_block", "dst_block"))
    inner = edges.filter("src_block = dst_block").groupBy("src_block").applyInPandas(lambda pdf: _least_labels(pdf), "id bigint, local bigint")
    local = settle(nodes.select("id").join(inner, "id", "left").select("id", F.coalesce("local", "id").alias("local")))
    ends = local.withColumnRenamed("local", "a"), local.select(F.col("id").alias("dst"), F.col("local").alias("b"))
    over = edges.filter("src_block <> dst_block").join(ends[0].withColumnRenamed("id", "src"), "src").join(ends[1], "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    over = settle(over)
    names = label_components(over.select(F.col("src").alias("id")).union(over.select("dst")).distinct(), over)
    return local.join(names.withColumnRenamed("id", "local"), "local", "left").select("id", F.coalesce("comp", "local").alias("comp"))


def _block(x: str, y: str) -> Column:
    return F.struct(F.expr(f"{x} div {BLOCK}"), F.expr(f"{y} div {BLOCK}"))


def hex_components(hexes: DataFrame, same: str) -> DataFrame:
    """6-connected components of equal values."""
    edges = hex_edges(hexes, F.col(same) == F.col(f"n_{same}"))
    return label_in_blocks(hexes, edges.withColumns({"src_block": _block("col", "row"), "dst_block": _block("ncol", "nrow")}))


def cell_components(cells: DataFrame) -> DataFrame:
    """(id, comp) of the 4-connected components of cells (id, x, y)."""
    right = cells.select(F.col("id").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    steps = cells.select("id", "x", "y", F.inline(F.array(*[F.struct((F.col("x") + dx).alias("_x"), (F.col("y") + dy).alias("_y")) for dx, dy in ((1, 0), (0, 1))])))
    edges = steps.join(right, ["_x", "_y"]).withColumnRenamed("id", "src")
    return label_in_blocks(cells, edges.withColumns({"src_block": _block("x", "y"), "dst_block": _block("_x", "_y")}))


def holes(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Components of uncovered cells: size, bounds and whether they lie at the map's edge."""
    both = cells.join(cell_components(cells), "id")
    edge = (F.col("x") < 2) | (F.col("y") < 2) | (F.col("x") >= width - 2) | (F.col("y") >= height - 2)
    return both.groupBy("comp").agg(F.count("*").alias("size"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.bool_or(edge).alias("edge"))


def flood(hexes: DataFrame, col: int, row: int, same: str, limit: int = FLOOD_LIMIT) -> DataFrame:
    """The hexes of one value connected with a start; more than limit is an error, by contract."""
    start = hexes.filter((F.col("col") == col) & (F.col("row") == row)).select("id", same).first()
    if start is None:
        return hexes.limit(0)
    pool = settle(hexes.filter(F.col(same).eqNullSafe(F.lit(start[1]))))
    parts = settle(hex_components(pool.select("id", "col", "row", F.lit(0).alias("one")), "one"))
    filled = parts.join(parts.filter(F.col("id") == start[0]).select("comp"), "comp", "left_semi").select("id")
    if filled.count() > limit:
        raise ValueError(f"the fill has more than {limit} hexes")
    return pool.join(filled, "id", "left_semi")


def movement_edges(hexes: DataFrame, allowed: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """(src, dst, dir, cost): steps between passable hexes whose terrain pair is allowed; roads in a direction halve the cost, the last bridge between two hexes sets it."""
    steps = hex_edges(hexes.filter("not impassable"))
    road = F.expr("(road >> dir) & 1 = 1")
    cost = F.when(road, 50).otherwise(100 + F.col("n_terrain") * 10).cast("bigint")
    out = steps.join(allowed, (F.col("terrain") == F.col("t1")) & (F.col("n_terrain") == F.col("t2"))).select("src", "dst", F.col("dir").cast("bigint").alias("dir"), cost.alias("cost"))
    if bridges is None:
        return out
    last = bridges.groupBy("src", "dst").agg(F.max_by("cost", "ordinal").alias("bridge_cost"))
    both = out.join(last, ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.coalesce("dir", F.lit(-1)).alias("dir"), F.coalesce("bridge_cost", "cost").alias("cost"))


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, cost): least cost from every start, by relaxing only what changed; edges (src, dst, cost)."""
    edges = settle(edges.select("src", "dst", "cost"))
    best = front = settle(starts.select("start", F.col("id"), F.lit(0).cast("bigint").alias("cost")))
    for _ in range(MAX_ROUNDS):
        reach = front.withColumnRenamed("id", "src").join(edges.select("src", "dst", F.col("cost").alias("w")), "src").groupBy("start", F.col("dst").alias("id")).agg(F.min(F.col("cost") + F.col("w")).alias("c"))
        both = best.join(reach, ["start", "id"], "full_outer").select("start", "id", F.least("cost", "c").alias("cost"), (F.col("cost").isNull() | (F.col("c") < F.col("cost"))).alias("new"))
        now = settle(both)
        front, best = now.filter("new").drop("new"), now.drop("new")
        if front.isEmpty():
            return best
    raise RuntimeError("paths did not settle")


def erase_inward(hexes: DataFrame, todo: DataFrame, value: str = "rgb") -> DataFrame:
    """Rounds from the rim: a hex to erase takes the commonest value of its settled neighbours, ties to the least value."""
    left = settle(todo.select("id"))
    now = settle(hexes.select("id", "col", "row", value))
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            return now
        known = now.join(left, "id", "left_anti").select(F.col("col").alias("ncol"), F.col("row").alias("nrow"), F.col(value).alias("v"))
        votes = neighbours(now.join(left, "id", "left_semi").select("id", "col", "row")).join(known, ["ncol", "nrow"]).groupBy("id", "v").agg(F.count("*").alias("n"))
        new = settle(votes.groupBy("id").agg(F.max_by("v", F.struct("n", (-F.col("v")).alias("o"))).alias("new")))
        if new.isEmpty():
            return now
        now = settle(now.join(new, "id", "left").select("id", "col", "row", F.coalesce("new", value).alias(value)))
        left = settle(left.join(new, "id", "left_anti"))
    raise RuntimeError("the erasure did not end")


def circle(spark: SparkSession, col: int, row: int, r: int) -> DataFrame:
    """The hexes at most r steps from a centre."""
    from terralith.functions.hexgrid import distance

    box = spark.range(2 * r + 1).select((F.col("id") + (col - r)).alias("col")).crossJoin(spark.range(4 * r + 3).select((F.col("id") + (row - 2 * r - 1)).alias("row")))
    return box.filter(distance(F.col("col"), F.col("row"), F.lit(col), F.lit(row)) <= r)


def circles(centres: DataFrame, r: int) -> DataFrame:
    """Each centre (col, row and others) once for each hex at most r steps away, as ncol and nrow."""
    from terralith.functions.hexgrid import distance

    near = centres.withColumn("ncol", F.explode(F.sequence(F.col("col") - r, F.col("col") + r))).withColumn("nrow", F.explode(F.sequence(F.col("row") - r, F.col("row") + r)))
    return near.filter(distance(F.col("col"), F.col("row"), F.col("ncol"), F.col("nrow")) <= r)


def rectangle(spark: SparkSession, c1: int, r1: int, c2: int, r2: int) -> DataFrame:
    lo, hi = min(c1, c2), max(c1, c2)
    return spark.range(lo, hi + 1).select(F.col("id").alias("col")).crossJoin(spark.range(min(r1, r2), max(r1, r2) + 1).select(F.col("id").alias("row")))


def polygon(hexes: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Hexes whose centre lies inside a polygon, by the even-odd rule; one expression over the corners."""
    x, y = F.col("col").cast("double"), F.col("row") + F.when(F.col("col") % 2 == 0, 0.0).otherwise(0.5)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            at = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((y1 > y) != (y2 > y)) & (x < at), 1).otherwise(0)
    return hexes.filter(crossings % 2 == 1)


def line(spark: SparkSession, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """The hexes on a line: points of the cube between both ends, each rounded to the nearest hex; a small shift decides ties."""
    ca, cb = ((c, -c - (r - (c - c % 2) // 2), r - (c - c % 2) // 2) for c, r in (a, b))
    n = max(abs(p - q) for p, q in zip(ca, cb, strict=True))
    t = F.col("id") / float(max(n, 1))
    q, y, z = (F.lit(float(p)) + e + (float(s - p)) * t for p, s, e in zip(ca, cb, (1e-6, 2e-6, -3e-6), strict=True))
    rq, ry, rz = F.bround(q), F.bround(y), F.bround(z)
    dq, dy, dz = F.abs(rq - q), F.abs(ry - y), F.abs(rz - z)
    fq = F.when((dq > dy) & (dq > dz), -ry - rz).otherwise(rq)
    fz = F.when((dz >= dy) & ~((dq > dy) & (dq > dz)), -rq - ry).otherwise(rz)
    at = spark.range(n + 1).select("id", fq.cast("bigint").alias("col"), fz.cast("bigint").alias("_z"))
    return at.select(F.col("id").alias("step"), "col", (F.col("_z") + F.floor((F.col("col") - F.pmod(F.col("col"), F.lit(2))) / 2)).alias("row"))


def pattern_key(hexes: DataFrame, value: str = "cat", base: int = 12) -> DataFrame:
    """Hexes with the key of their seven values in base 12: own first, then the six neighbours, 0 off the map."""
    key = hex_edges(hexes.select("id", "col", "row", value)).groupBy(F.col("src").alias("id")).agg(F.sum(F.col(f"n_{value}") * F.pow(F.lit(base), F.lit(5) - F.col("dir")).cast("bigint")).alias("_k"))
    return hexes.join(key, "id", "left").withColumn("pattern", F.col(value) * base**6 + F.coalesce("_k", F.lit(0))).drop("_k")


def ordered_parts(df: DataFrame, by: str, key: str) -> DataFrame:
    """Ordinals of groups: by largest key descending, then rows by key."""
    most = df.groupBy(by).agg(F.max(key).alias("_m"))
    return ranked(df.join(most, df[by].eqNullSafe(most[by])).drop(most[by]), F.desc("_m"), key).withColumn("number", F.col("rank") + 1).drop("_m", "rank")
