"""Tile-map validator: neighbourhood rules over hex categories, palettes and layouts. Findings are rows (code, severity, id)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.hexgrid import DIRECTIONS
from terralith.operators.board import GOOD_CROSSINGS, LINES, RIVERS, Board
from terralith.operators.filters import AREA, BEACH, CLIFF, CLIFF_END, CROSSING, MOUTH, RIVER, ROAD, SEA, START
from terralith.operators.graph import hex_edges, pattern_key
from terralith.operators.scratch import apart

PATTERNED = (BEACH, CLIFF, CLIFF_END, RIVER, START, MOUTH, CROSSING)
#: Hexes a side of the blocks that neighbours meet in, and that repaints are judged in.
SIDE = 64


def in_blocks(hexes: DataFrame, reach: int) -> DataFrame:
    """Each hex once for each block (bc, br) that holds it or lies within reach of it."""
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / SIDE), F.floor((F.col(c) + reach) / SIDE))
    return hexes.withColumn("bc", F.explode(span("col"))).withColumn("br", F.explode(span("row")))


def _facts(cat: Column, near: list[Column]) -> dict[str, Column]:
    """Sums over a hex's neighbours by direction: counts by kind and bit masks of river and road sides."""
    total = lambda test, size=lambda d: 1: sum((F.when(test(n), size(d)).otherwise(0) for d, n in enumerate(near)), F.lit(0))
    side = lambda d: 1 << d
    wet, road = (lambda n: n.isin(*RIVERS)), (lambda n: n == ROAD)
    return {"same": total(lambda n: n == cat), "seas": total(lambda n: n == SEA), "beaches": total(lambda n: n == BEACH), "rivers": total(wet), "river_sides": total(wet, side), "road_sides": total(road, side)}


def around(hexes: DataFrame, value: str = "cat") -> DataFrame:
    """id, col, row and value of hexes with neighbour facts: counts by kind and bit masks of river and road sides.

    Hexes are sent to the blocks that they touch, hardly more than once each; inside a block each tells its value to its
    neighbours, so that no step from hex to hex is shuffled. A place holds one hex.
    """
    sent = in_blocks(hexes.select("id", "col", "row", F.col(value).alias("_v")), 1).repartition("bc", "br")
    here = F.struct(F.lit(6).alias("side"), F.col("col").alias("ncol"), F.col("row").alias("nrow"), F.col("id").alias("_id"))
    up = lambda even, odd: F.col("row") + F.when(F.col("col") % 2 == 0, even).otherwise(odd)
    none = F.lit(None).cast(hexes.schema["id"].dataType)
    there = [F.struct(F.lit((d + 3) % 6).alias("side"), (F.col("col") + dc).alias("ncol"), up(even, odd).alias("nrow"), none.alias("_id")) for d, dc, even, odd in DIRECTIONS]
    told = sent.select("bc", "br", "_v", F.inline(F.array(here, *there)))  # one select, so that the blocks stay where they are
    met = told.groupBy("bc", "br", F.col("ncol").alias("col"), F.col("nrow").alias("row"))
    seen = met.agg(F.max("_id").alias("id"), *[F.max(F.when(F.col("side") == d, F.col("_v"))).alias(f"_{d}") for d in range(7)])
    own = seen.filter(F.col("id").isNotNull() & (F.floor(F.col("col") / SIDE) == F.col("bc")) & (F.floor(F.col("row") / SIDE) == F.col("br")))
    return own.select("id", "col", "row", F.col("_6").alias(value), *[c.alias(n) for n, c in _facts(F.col("_6"), [F.col(f"_{d}") for d in range(6)]).items()])


def _sides(mask: Column, turn: Column) -> Column:
    """The sides of a mask, turned back by turn, ascending, as text."""
    sides = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda d: F.getbit(mask.cast("int"), d) == 1)
    return F.array_join(F.array_sort(F.transform(sides, lambda d: F.pmod(d - turn, F.lit(6)))), ",")


def crossing_layout(rivers: Column, roads: Column) -> Column:
    """River and road sides, turned so that some river side is 0, in the least of these forms by text."""
    turns = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda d: F.getbit(rivers.cast("int"), d) == 1)
    forms = F.transform(F.when(F.size(turns) > 0, turns).otherwise(F.array(F.lit(0))), lambda t: F.concat(_sides(rivers, t), F.lit("|"), _sides(roads, t)))
    return F.array_min(forms)


def _codes() -> Column:
    """The codes that a hex with its facts breaks."""
    cat = F.col("cat")
    tests = [
        ("line.thick", cat.isin(*LINES) & (F.col("same") >= 4)),
        ("coast.missing_ring", (cat == AREA) & (F.col("seas") > 0)),
        ("coast.cliff_end", (cat == CLIFF) & (F.col("beaches") > 0) | (cat == CLIFF_END) & (F.col("beaches") == 0)),
        ("river.ends", (cat == START) & (F.col("rivers") != 1) | (cat == MOUTH) & ((F.col("rivers") != 1) | (F.col("seas") == 0)) | (cat == RIVER) & (F.col("rivers") < 1)),
        ("river.crossing", (cat == CROSSING) & ~crossing_layout(F.col("river_sides"), F.col("road_sides")).isin(*GOOD_CROSSINGS)),
    ]
    return F.filter(F.array(*[F.when(t, code) for code, t in tests]), lambda c: c.isNotNull())


def rules(hexes: DataFrame) -> DataFrame:
    """line.thick, coast.missing_ring, coast.cliff_end, river.ends and river.crossing of every hex, from one neighbour join."""
    return around(hexes).select("id", "col", "row", F.explode(_codes()).alias("code")).withColumn("severity", F.lit("warning"))


def unseen_patterns(hexes: DataFrame, reference: DataFrame) -> DataFrame:
    """Coast, river and crossing hexes whose seven-hex pattern the reference map never shows."""
    known = pattern_key(reference).select("pattern").distinct()
    return pattern_key(hexes).filter(F.col("cat").isin(*PATTERNED)).join(known, "pattern", "left_anti").select("id", F.lit("pattern.unseen").alias("code"))


def unused_sets(hexes: DataFrame, reference: DataFrame, name: str = "cat") -> DataFrame:
    """Sets that the reference map never paints, with how many hexes use them."""
    return hexes.groupBy(name).agg(F.count("*").alias("hexes")).join(reference.select(name).distinct(), name, "left_anti")


def mixed_hexes(pixels: DataFrame) -> DataFrame:
    """Hexes (c, r) whose pixels (c, r, rgb) have more than one colour."""
    return pixels.groupBy("c", "r").agg(F.min("rgb").alias("lo"), F.max("rgb").alias("hi")).filter("lo <> hi").select("c", "r")


def filler(pixels: DataFrame) -> DataFrame:
    """Non-black pixels outside every hex."""
    return pixels.filter("c is null and rgb <> 0")


def layout(images: DataFrame) -> DataFrame:
    """Codes that the sizes of images break: 2W by 2H + 1 pixels for W by H hexes, W a multiple of 4 where the size is right."""
    wrong = (F.col("width") % 2 != 0) | (F.col("height") % 2 == 0)
    code = F.when(wrong, "layout.size").when(F.floor(F.col("width") / 2) % 4 != 0, "layout.mesh_columns")
    return images.withColumn("code", code).filter("code is not null")


def quarter_mismatches(full: DataFrame, quarter: DataFrame) -> DataFrame:
    """One row: pixels of the quarter image that differ from every fourth pixel of the full one."""
    every = full.filter("x % 4 = 0 and y % 4 = 0").select((F.col("x") / 4).cast("bigint").alias("x"), (F.col("y") / 4).cast("bigint").alias("y"), F.col("v").alias("f"))
    return quarter.join(every, ["x", "y"], "full_outer").agg(F.count_if(~F.col("v").eqNullSafe(F.col("f"))).alias("differ"))


def climate_index(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels with the ordinal of their palette colour, the first of equal ones; 0 without a match."""
    first = palette.groupBy("rgb").agg(F.min("ordinal").alias("climate"))
    return pixels.join(first, "rgb", "left").withColumn("climate", F.coalesce("climate", F.lit(0)))


def scoped(findings: DataFrame, hexes: DataFrame, edited: DataFrame) -> DataFrame:
    """Findings on edited hexes and one ring around them."""
    ring = hex_edges(hexes.select("id", "col", "row")).join(edited.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return findings.join(ring.union(edited.select("id")).distinct(), "id", "left_semi")


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of after that before doesn't have."""
    return after.join(before.select("id", "code"), ["id", "code"], "left_anti")


def surrounding_land(hexes: DataFrame, generic: int = -1) -> DataFrame:
    """For every hex the commonest value among its area neighbours, ties to the first direction; generic without any."""
    n = hex_edges(hexes.select("id", "col", "row", "cat", "value"), F.col("n_cat") == AREA).groupBy(F.col("src").alias("id"), F.col("n_value").alias("v")).agg(F.count("*").alias("n"), F.min("dir").alias("d"))
    best = n.groupBy("id").agg(F.max_by("v", F.struct("n", (-F.col("d")).alias("o"))).alias("land"))
    return hexes.select("id").join(best, "id", "left").select("id", F.coalesce("land", F.lit(generic)).alias("land"))


#: Category that a finding's first candidate repaints the hex to, by code and category; None repaints to surrounding land.
CANDIDATES = {"line.thick": {None: None}, "coast.missing_ring": {None: BEACH}, "coast.cliff_end": {CLIFF: CLIFF_END, CLIFF_END: CLIFF}, "river.ends": {START: RIVER, MOUTH: RIVER, RIVER: START}, "river.crossing": {None: RIVER}}


def fix_candidates(findings: DataFrame, hexes: DataFrame) -> DataFrame:
    """(id, code, candidate, to_cat): up to two recolourings for each finding: the rule's own and the land around."""
    both = findings.join(hexes.select("id", "cat"), "id")
    own = None
    for code, table in CANDIDATES.items():
        for cat, to in table.items():
            test = (F.col("code") == code) & (F.lit(True) if cat is None else F.col("cat") == cat)
            value = F.lit(AREA if to is None else to)
            own = F.when(test, value) if own is None else own.when(test, value)
    options = F.array_distinct(F.filter(F.array(own, F.lit(AREA)), lambda c: c.isNotNull() & (c != F.col("cat"))))
    return both.select("id", "code", F.posexplode(options).alias("candidate", "to_cat"))


def _judge_block(cells: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
    board = Board(list(zip(cells["col"].tolist(), cells["row"].tolist(), strict=True)), cells["cat"].tolist()) if len(cells) else None
    out = []
    for code, col, row, to in zip(cands["code"].tolist(), cands["col"].tolist(), cands["row"].tolist(), cands["to_cat"].tolist(), strict=True):
        more, gone = board.judge(code, (int(col), int(row)), {(int(col), int(row)): to}) if board and col == col else (0, False)  # null: not on the map
        out.append((more, gone and more < 0))
    change, accepted = zip(*out, strict=True) if out else ((), ())
    return cands[["id", "code", "candidate", "to_cat"]].assign(change=pd.array(change, "int64"), accepted=pd.array(accepted, "bool"))


def score_fixes(hexes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the change in warnings within one ring, all candidates of all findings at once.

    A repaint changes the codes of its hex and its neighbours, which the two rings around it decide; a task holds a block of
    hexes with two rings around it and judges the block's candidates. accepted: the finding itself is gone and there are
    fewer warnings.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    placed = candidates.select("id", "code", "candidate", "to_cat").join(hexes.select("id", "col", "row"), "id", "left")
    placed = placed.withColumns({"bc": F.floor(F.col("col") / SIDE), "br": F.floor(F.col("row") / SIDE)})
    cells = in_blocks(hexes.select("col", "row", F.col("cat").cast("int").alias("cat")), 2)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", "code", "candidate", "to_cat")) + ", change bigint, accepted boolean"
    return cells.groupBy("bc", "br").cogroup(apart(placed).groupBy("bc", "br")).applyInPandas(_judge_block, schema)
