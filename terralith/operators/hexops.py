"""Hex operations given as JSON, one a row: paint, line, replace, fill and erase, applied in order.

    {"op": "paint", "set": name, area}        {"op": "line", "set": name, "points": [[c, r], ...], "width": 1}
    {"op": "replace", "from": name, "to": name, area or "all": true}
    {"op": "fill", "set": name, "at": [c, r], "max": 20000}     {"op": "erase", area, "to": name}

An area is "hexes": [[c, r], ...], "circle": [c, r, radius], "rect": [c0, r0, c1, r1] or "polygon": [[c, r], ...]. Paint, line
and replace look at nothing but a hex itself: all of them between two fills or erasures are settled at once, by the last
paint of each hex and the replacements behind it. A fill or an erasure looks at neighbours, so it sees the map as it is by
then; there are as many stages as there are of these.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.hexgrid import distance, neighbours
from terralith.operators.filters import AREA, SEA
from terralith.operators.graph import FLOOD_LIMIT, flood
from terralith.operators.scratch import release, settle

_SCHEMA = "op string, set string, `from` string, to string, hexes array<array<int>>, circle array<int>, rect array<int>, polygon array<array<int>>, points array<array<int>>, width int, at array<int>, max int, all boolean"
OPS = ("paint", "line", "replace", "fill", "erase")


def parse(ops: DataFrame, sets: DataFrame) -> DataFrame:
    """ordinal and the fields of ops (ordinal, json), with to_value and from_value of the sets (name, value); a wrong operation is an error."""
    read = ops.select("ordinal", "json", F.from_json("json", _SCHEMA).alias("o")).select("ordinal", "json", "o.*")
    area = F.coalesce("hexes", "polygon").isNotNull() | (F.size("circle") == 3) | (F.size("rect") == 4)
    area = F.coalesce(area, F.lit(False))
    fits = (
        F.when(F.col("op") == "paint", area & F.col("set").isNotNull())
        .when(F.col("op") == "line", (F.size("points") >= 2) & F.col("set").isNotNull())
        .when(F.col("op") == "replace", (area | F.col("all")) & F.col("from").isNotNull() & F.col("to").isNotNull())
        .when(F.col("op") == "fill", (F.size("at") == 2) & F.col("set").isNotNull())
        .when(F.col("op") == "erase", area)
    )
    named = sets.select(F.col("name"), F.col("value"))
    target = F.when(F.col("op").isin("replace", "erase"), F.col("to")).otherwise(F.col("set"))
    out = read.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_name", target)
    out = out.join(named.select(F.col("name").alias("_name"), F.col("value").alias("to_value")), "_name", "left").join(named.select(F.col("name").alias("from"), F.col("value").alias("from_value")), "from", "left")
    known = (F.col("_name").isNull() | F.col("to_value").isNotNull()) & (F.col("from").isNull() | F.col("from_value").isNotNull())
    out = settle(out.withColumn("_fits", F.col("_fits") & known).drop("_name"))
    wrong = out.filter(~F.col("_fits")).orderBy("ordinal").select("ordinal", "json").first()
    if wrong:
        raise ValueError(f"operation {wrong[0]} can't be applied: {wrong[1]}")
    return out.drop("_fits")


def _xy(point: Column) -> tuple[Column, Column]:
    return F.get(point, F.lit(0)).cast("bigint"), F.get(point, F.lit(1)).cast("bigint")


def _points(rows: DataFrame, of: str) -> DataFrame:
    """rows once for each point of a list, as pc, pr and nth."""
    c, r = _xy(F.col("_p"))
    return rows.select("*", F.posexplode(of).alias("nth", "_p")).withColumns({"pc": c, "pr": r}).drop("_p")


def circles(spots: DataFrame, radius: str) -> DataFrame:
    """ordinal, col, row of the hexes at most radius steps from pc, pr."""
    near = spots.withColumn("col", F.explode(F.sequence(F.col("pc") - F.col(radius), F.col("pc") + F.col(radius)))).withColumn("row", F.explode(F.sequence(F.col("pr") - F.col(radius), F.col("pr") + F.col(radius))))
    return near.filter(distance(F.col("pc"), F.col("pr"), F.col("col"), F.col("row")) <= F.col(radius)).select("ordinal", "col", "row")


def lines(rows: DataFrame) -> DataFrame:
    """ordinal, pc, pr of the hexes on the way through points: stretches of cube coordinates, each step rounded to the nearest hex; a small shift decides ties."""
    stretch = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda k: F.struct(F.get("points", k - 1).alias("a"), F.get("points", k).alias("b")))
    one = rows.select("ordinal", "points", F.explode(stretch).alias("s"))
    (ac, ar), (bc, br) = _xy(F.col("s.a")), _xy(F.col("s.b"))
    one = one.select("ordinal", ac.alias("ac"), ar.alias("ar"), bc.alias("bc"), br.alias("br"))
    one = one.withColumn("n", distance(F.col("ac"), F.col("ar"), F.col("bc"), F.col("br")).cast("bigint")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))))
    cube = lambda c, r: (F.col(c).cast("double"), (-F.col(c) - (F.col(r) - F.floor(F.col(c) / 2))).cast("double"), (F.col(r) - F.floor(F.col(c) / 2)).cast("double"))
    t = F.col("k").cast("double") / F.col("n")
    q, y, z = (p + (s - p) * t + e for p, s, e in zip(cube("ac", "ar"), cube("bc", "br"), (1e-6, 2e-6, -3e-6), strict=True))
    step = one.filter("k > 0").select("ordinal", q.alias("q"), y.alias("y"), z.alias("z"))
    rq, ry, rz = (F.bround(c) for c in ("q", "y", "z"))
    dq, dy, dz = F.abs(rq - F.col("q")), F.abs(ry - F.col("y")), F.abs(rz - F.col("z"))
    first = (dq > dy) & (dq > dz)
    col, deep = F.when(first, -ry - rz).otherwise(rq).cast("bigint"), F.when(~first & (dy <= dz), -rq - ry).otherwise(rz).cast("bigint")
    on = step.select("ordinal", col.alias("pc"), deep.alias("_z")).select("ordinal", "pc", (F.col("_z") + F.floor(F.col("pc") / 2)).alias("pr"))
    return on.union(one.filter("k = 0").select("ordinal", F.col("ac").alias("pc"), F.col("ar").alias("pr"))).distinct()


def polygons(rows: DataFrame) -> DataFrame:
    """ordinal, col, row of the hexes whose centre lies in a polygon, by the even-odd rule; odd columns lie half a hex higher."""
    shown = rows.filter(F.size("polygon") >= 3)
    at = lambda p, k: F.get(p, F.lit(k)).cast("bigint")
    cs, rs = F.transform("polygon", lambda p: at(p, 0)), F.transform("polygon", lambda p: at(p, 1))
    boxed = shown.withColumn("col", F.explode(F.sequence(F.array_min(cs), F.array_max(cs)))).withColumn("row", F.explode(F.sequence(F.array_min(rs) - 1, F.array_max(rs) + 1)))
    x, y = F.col("col").cast("double"), F.col("row") + F.pmod("col", F.lit(2)) * 0.5
    high = lambda p: at(p, 1) + F.pmod(at(p, 0), F.lit(2)) * 0.5
    n = F.size("polygon")

    def crosses(i: Column) -> Column:
        a, b = F.get("polygon", i), F.get("polygon", (i + n - 1) % n)
        meets = (high(a) > y) != (high(b) > y)
        return F.when(meets, F.when(x < (at(b, 0) - at(a, 0)) * (y - high(a)) / F.nullif(high(b) - high(a), F.lit(0.0)) + at(a, 0), 1).otherwise(0)).otherwise(0)

    odd = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1
    return boxed.filter(odd).select("ordinal", "col", "row")


def areas(ops: DataFrame) -> DataFrame:
    """ordinal, col, row of the hexes of operations with an area or points; the first kind of area given counts. Hexes may repeat and lie off the map."""
    listed = _points(ops.filter("hexes is not null"), "hexes").select("ordinal", F.col("pc").alias("col"), F.col("pr").alias("row"))
    left = ops.filter("hexes is null and points is null")
    rounds = left.filter("circle is not null")
    c, r = _xy(F.col("circle"))
    round_ = circles(rounds.select("ordinal", c.alias("pc"), r.alias("pr"), F.get("circle", F.lit(2)).cast("bigint").alias("radius")).filter("radius >= 0"), "radius")
    left = left.filter("circle is null")
    span = lambda i, j: F.explode(F.sequence(F.least(F.get("rect", F.lit(i)), F.get("rect", F.lit(j))).cast("bigint"), F.greatest(F.get("rect", F.lit(i)), F.get("rect", F.lit(j))).cast("bigint")))
    box = left.filter("rect is not null").withColumn("col", span(0, 2)).withColumn("row", span(1, 3)).select("ordinal", "col", "row")
    shape = polygons(left.filter("rect is null and polygon is not null"))
    way = lines(ops.filter("op = 'line'")).join(ops.filter("op = 'line'").select("ordinal", F.greatest(F.coalesce(F.col("width"), F.lit(1)) - 1, F.lit(0)).cast("bigint").alias("radius")), "ordinal")
    return listed.union(round_).union(box).union(shape).union(circles(way, "radius"))


class Chain:
    """Replacements of the whole map in order, composed over halves of halves: a stretch of them is applied in as many steps as its length has bits."""

    def __init__(self, swaps: list[tuple[int, int, int]]):
        self.at = [o for o, _, _ in swaps]
        self.levels: list[list[dict[int, int]]] = [[{f: t} for _, f, t in swaps]]
        while len(low := self.levels[-1]) > 1:
            self.levels.append([{v: b.get(a.get(v, v), a.get(v, v)) for v in {*a, *b}} for a, b in zip(low[::2], low[1::2], strict=False)])
        self.known: dict[tuple[int, int], int] = {}

    def between(self, value: int, i: int, j: int) -> int:
        """value after the replacements from i to before j."""
        while i < j:
            k = min((i & -i).bit_length() - 1 if i else len(self.levels) - 1, (j - i).bit_length() - 1)
            value = self.levels[k][i >> k].get(value, value)
            i += 1 << k
        return value

    def run(self, value: int, since: int, own: Sequence[tuple[int, int, int]]) -> int:
        """value after all replacements behind since, with a hex's own (ordinal, from, to) among them in order."""
        i = bisect_right(self.at, since)
        for o, f, t in own:
            j = bisect_left(self.at, o)
            value, i = self.between(value, i, j), max(i, j)
            value = t if value == f else value
        if (out := self.known.get((value, i))) is None:
            out = self.between(value, i, len(self.at))
            if len(self.known) < 1 << 16:
                self.known[value, i] = out
        return out


def _settled(hexes: DataFrame, ops: DataFrame) -> DataFrame:
    """hexes (id, col, row, value) after paint, line and replace operations: the last paint of each hex, then the replacements behind it in order."""
    fields = ops.select("ordinal", "from_value", "to_value")
    touched = areas(ops.filter(~F.coalesce(F.col("all"), F.lit(False)))).join(hexes.select("id", "col", "row"), ["col", "row"]).select("id", "ordinal")
    everywhere = ops.filter(F.coalesce(F.col("all"), F.lit(False))).agg(F.sort_array(F.collect_list(F.struct("ordinal", "from_value", "to_value"))).alias("e")).first()[0]
    writes = touched.join(fields, "ordinal").groupBy("id").agg(
        F.max(F.when(F.col("from_value").isNull(), F.struct("ordinal", "to_value"))).alias("paint"),
        F.collect_set(F.when(F.col("from_value").isNotNull(), F.struct("ordinal", "from_value", "to_value"))).alias("swaps"),
    )
    kind = "array<struct<ordinal:bigint,from_value:bigint,to_value:bigint>>"
    both = hexes.join(writes, "id", "left")
    start = F.coalesce("paint.to_value", "value").cast("bigint")
    since = F.coalesce("paint.ordinal", F.lit(-(1 << 62)))
    swaps = F.filter(F.sort_array(F.coalesce("swaps", F.array().cast(kind)).cast(kind)), lambda s: s["ordinal"] > since)
    if not everywhere:
        return both.select("id", "col", "row", F.aggregate(swaps, start, lambda v, s: F.when(v == s["from_value"], s["to_value"]).otherwise(v)).alias("value"))
    chain = Chain([tuple(r) for r in everywhere])

    @F.pandas_udf("bigint")
    def replaced(value: pd.Series, since: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([chain.run(v, o, [(s["ordinal"], s["from_value"], s["to_value"]) for s in xs] if xs is not None else ()) for v, o, xs in zip(value.tolist(), since.tolist(), own, strict=True)], dtype="int64")

    # null is a value that no replacement meets
    value = F.when(start.isNotNull(), replaced(F.coalesce(start, F.lit(0)), since, F.when(F.size(swaps) > 0, swaps)))
    return both.select("id", "col", "row", value.alias("value"))


def _erased(hexes: DataFrame, op: DataFrame, sets: DataFrame, generic: int, sea: int) -> DataFrame:
    """hexes after one erasure: from the rim inwards, each hex takes the commonest land value of its neighbours that stand (ties: the least), else sea where it only touches sea, else the operation's to, or generic."""
    kinds = sets.groupBy("value").agg(F.min("cat").alias("cat"))
    back = op.select("to_value").first()[0]
    back = generic if back is None else back
    left = settle(areas(op).distinct().join(hexes.select("id", "col", "row"), ["col", "row"]).select("id"))
    now = hexes
    while not left.isEmpty():
        stands = now.join(left, "id", "left_anti").join(kinds, "value", "left").select(F.col("col").alias("ncol"), F.col("row").alias("nrow"), F.col("value").alias("v"), "cat")
        near = neighbours(now.join(left, "id", "left_semi").select("id", "col", "row")).join(stands, ["ncol", "nrow"])
        votes = near.groupBy("id", "v", "cat").agg(F.count("*").alias("n"))
        land = F.coalesce(F.col("cat") == AREA, F.lit(False))
        best = votes.groupBy("id").agg(F.max_by(F.when(land, F.col("v")), F.when(land, F.struct("n", (-F.col("v")).alias("o")))).alias("land"), F.bool_and(F.coalesce(F.col("cat") == SEA, F.lit(False))).alias("wet"))
        new = settle(best.select("id", F.coalesce("land", F.when(F.col("wet"), sea).otherwise(back)).cast("bigint").alias("new")))
        if new.isEmpty():  # nothing stands around: the whole map
            new = settle(left.select("id", F.lit(back).cast("bigint").alias("new")))
        now = settle(now.join(new, "id", "left").select("id", "col", "row", F.coalesce("new", "value").alias("value")))
        left = settle(left.join(new, "id", "left_anti"))
    return now


def apply_ops(hexes: DataFrame, ops: DataFrame, sets: DataFrame, generic: int, sea: int) -> DataFrame:
    """hexes (id, col, row, value) after all operations in order.

    ops: ordinal, json; sets: name, value and cat, the category of the value. Hexes off the map are left out; a fill from off
    the map, or of more hexes than it allows, is an error.
    """
    read = settle(parse(ops, sets))
    now = settle(hexes.select("id", "col", "row", F.col("value").cast("bigint").alias("value")))
    stages = read.filter(F.col("op").isin("fill", "erase")).orderBy("ordinal").select("ordinal", "op", "at", "max", "to_value").collect()  # one row a stage
    last = None
    for stage in [*stages, None]:
        plain = read.filter(~F.col("op").isin("fill", "erase"))
        plain = plain if last is None else plain.filter(F.col("ordinal") > last)
        plain = plain if stage is None else plain.filter(F.col("ordinal") < stage.ordinal)
        if not plain.isEmpty():
            old, now = now, settle(_settled(now, plain))
            release(old)
        if stage is None:
            return now
        last = stage.ordinal
        if stage.op == "erase":
            now = settle(_erased(now, read.filter(F.col("ordinal") == last), sets, generic, sea))
            continue
        col, row = stage["at"]
        here = now.filter((F.col("col") == col) & (F.col("row") == row)).select("value").first()
        if here is None:
            raise ValueError(f"hex [{col},{row}] is outside the map")
        if here[0] != stage.to_value:
            filled = flood(now, col, row, "value", FLOOD_LIMIT if stage["max"] is None else stage["max"]).select("id", F.lit(stage.to_value).cast("bigint").alias("new"))
            now = settle(now.join(filled, "id", "left").select("id", "col", "row", F.coalesce("new", "value").alias("value")))
    return now
