"""Fixing findings: suggestions scored on a window, and all fixes in order, by blocks in four rounds.

A finding's fix reads hexes up to `READ` steps away and repaints hexes up to one step away. Findings are fixed in the order
of their block's colour, block, code and id, blocks being coloured like a board of 2 x 2 fields: blocks of one colour lie
farther apart than any fix reads, so they are done at once, each in its own task with the hexes around it, and the result is
that of one serial pass in that order. A task holds one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.board import Board, Change, Spot, broken, ring
from terralith.operators.filters import AREA, BEACH, CLIFF, CLIFF_END, MOUTH, RIVER, ROAD, SEA, START
from terralith.operators.scratch import apart, release, settle
from terralith.operators.validator import rules

#: Hexes a side of a block; at least READ + 1.
BLOCK = 32
#: Steps from a finding to the farthest hex that decides its fix.
READ = 5
CODES = ("line.thick", "coast.missing_ring", "coast.cliff_end", "river.ends", "river.crossing")


def codes_at(spot: Spot, get: Callable[[Spot], int | None]) -> list[str]:
    """The codes that one hex breaks; get gives a hex's category, None off the map."""
    return list(broken(get(spot), tuple(get(s) for s in ring(spot))))


def candidates(code: str, spot: Spot, get: Callable[[Spot], int | None]) -> Iterator[tuple[str, Change]]:
    """(label, repaints) that may fix a finding, in order of preference."""
    cat = get(spot)
    one = lambda label, to: (label, {spot: to})
    if code == "line.thick":
        yield one("thin the line", AREA)
    elif code == "coast.missing_ring":
        yield one("paint coast", BEACH)
    elif code == "coast.cliff_end":
        yield one("paint cliff end", CLIFF_END) if cat == CLIFF else one("paint cliff", CLIFF)
    elif code == "river.ends":
        if cat == START:
            yield one("paint river", RIVER)
            yield one("paint land", AREA)
        elif cat == MOUTH:
            yield one("paint sea", SEA)
            yield one("paint river", RIVER)
        else:
            yield one("remove the stray river hex", AREA)
    elif code == "river.crossing":
        around = ring(spot)
        for d, near in enumerate(around):
            if get(near) == AREA:
                yield f"extend the road to {near[0]},{near[1]}", {near: ROAD}
            if get(near) != ROAD or sum(get(s) == ROAD for s in ring(near) if s != spot) > 1:
                continue  # no road, or a junction
            for side in ((d + 1) % 6, (d + 5) % 6):
                if get(around[side]) == AREA:
                    yield f"move the road from {near[0]},{near[1]} to {around[side][0]},{around[side][1]}", {around[side]: ROAD, near: AREA}
        yield one("drop the crossing", RIVER)


def _score(code: str, spot: Spot, change: Change, get: Callable[[Spot], int | None]) -> tuple[int, bool]:
    """Findings on the hexes of a change and the two rings around them, once it is painted; whether the finding itself is gone."""
    now = lambda s: change.get(s, get(s)) if change else get(s)
    region = {spot, *change}
    for _ in range(2):
        region |= {n for s in region for n in ring(s)}
    score, gone = 0, True
    for s in region:
        found = codes_at(s, now)
        score += len(found)
        if s == spot and code in found:
            gone = False
    return score, gone


def suggest(code: str, spot: Spot, get: Callable[[Spot], int | None]) -> tuple[str, Change, int, int] | None:
    """(label, repaints, findings before, findings after) of the candidate that leaves fewest findings, if it clears its own and lessens their number; the first of equals."""
    before, _ = _score(code, spot, {}, get)
    best = None
    for label, change in candidates(code, spot, get):
        if any(get(s) is None for s in change) or all(get(s) == to for s, to in change.items()):
            continue
        after, gone = _score(code, spot, change, get)
        if gone and after < before and (best is None or after < best[3]):
            best = label, change, before, after
    return best


def best_fix(board: Board, code: str, spot: Spot) -> tuple[str, Change, int, int] | None:
    """`suggest` on a board: what a candidate changes is counted where it changes."""
    before = board.findings({spot})
    best = None
    for label, change in candidates(code, spot, board.get):
        if any(board.get(s) is None for s in change) or all(board.get(s) == to for s, to in change.items()):
            continue
        more, gone = board.judge(code, spot, change)
        if not gone:
            continue
        after = more + (before if spot in change and len(change) == 1 else board.findings({spot, *change}))
        if after < before and (best is None or after < best[3]):
            best = label, change, before, after
    return best


def fix_in_order(findings: list[tuple[str, Spot]], cats: dict[Spot, int]) -> list[tuple[str, str | None, Change]]:
    """(outcome, label, repaints) of each finding, fixed one after the other on cats, which changes: fixed, cleared by an earlier fix, or skipped; the plain form of a block's task."""
    out = []
    for code, spot in findings:
        if code not in codes_at(spot, cats.get):
            out.append(("cleared", None, {}))
            continue
        fix = suggest(code, spot, cats.get)
        if fix is None:
            out.append(("skipped", None, {}))
            continue
        cats.update(fix[1])
        out.append(("fixed", fix[0], fix[1]))
    return out


def _windows(hexes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each hex once for each of the blocks given that hold it or lie within READ of it."""
    span = lambda c: F.sequence(F.floor((F.col(c) - READ) / BLOCK), F.floor((F.col(c) + READ) / BLOCK))
    near = hexes.select("id", "col", "row", "cat").withColumn("bc", F.explode(span("col"))).withColumn("br", F.explode(span("row")))
    return near.join(blocks, ["bc", "br"], "left_semi")


def _placed(findings: DataFrame) -> DataFrame:
    return findings.select("id", "code", "col", "row", F.floor(F.col("col") / BLOCK).alias("bc"), F.floor(F.col("row") / BLOCK).alias("br"))


def _in_order(marks: pd.DataFrame) -> pd.DataFrame:
    return marks.assign(rank=marks["code"].map(CODES.index)).sort_values(["rank", "id"])


def _spots(frame: pd.DataFrame) -> list[Spot]:
    return list(zip(frame["col"].tolist(), frame["row"].tolist(), strict=True))


_OUT = "id bigint, code string, outcome string, label string, to_id bigint, to_cat int"


def _fix_block(cells: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    spots = _spots(cells)
    board, ids = Board(spots, cells["cat"].tolist()), dict(zip(spots, cells["id"].tolist(), strict=True))
    marks = _in_order(marks)
    rows, painted = [], {}
    for i, code, spot in zip(marks["id"].tolist(), marks["code"].tolist(), _spots(marks), strict=True):
        if code not in board.codes(spot):
            rows.append((i, code, "cleared", None, None, None))
            continue
        fix = best_fix(board, code, spot)
        rows.append((i, code, "fixed" if fix else "skipped", fix and fix[0], None, None))
        if fix:
            board.paint(fix[1])
            painted.update(fix[1])
    rows += [(None, None, None, None, ids[s], to) for s, to in painted.items()]  # the last value that the block gives
    return pd.DataFrame(rows, columns=["id", "code", "outcome", "label", "to_id", "to_cat"], dtype=object)


def fix_all(hexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, before, after) of all hexes that change, and (id, code, outcome, label) of all findings, when all are fixed in order.

    hexes: id, col, row, cat; no others are on the map.
    """
    first = now = settle(hexes.select("id", "col", "row", F.col("cat").cast("int").alias("cat")))
    marks = settle(_placed(rules(now)))
    outcomes = None
    for colour in range(4):
        mine = marks.filter((F.pmod("bc", F.lit(2)) * 2 + F.pmod("br", F.lit(2))) == colour)
        cells = _windows(now, mine.select("bc", "br").distinct())
        done = settle(cells.groupBy("bc", "br").cogroup(apart(mine).groupBy("bc", "br")).applyInPandas(_fix_block, _OUT))
        told = done.filter("code is not null").select("id", "code", "outcome", "label")
        outcomes = told if outcomes is None else outcomes.union(told)
        new = done.filter("to_id is not null").select(F.col("to_id").alias("id"), "to_cat").distinct()
        old, now = now, settle(now.join(new, "id", "left").select("id", "col", "row", F.coalesce("to_cat", "cat").alias("cat")))
        if old is not first:
            release(old)
    changes = now.select("id", F.col("cat").alias("after")).join(first.select("id", F.col("cat").alias("before")), "id").filter("before <> after")
    return changes.select("id", "before", "after"), outcomes


def _suggest_block(cells: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    board = Board(_spots(cells), cells["cat"].tolist())
    rows = []
    for i, code, spot in zip(marks["id"].tolist(), marks["code"].tolist(), _spots(marks), strict=True):
        fix = best_fix(board, code, spot)
        rows.append((i, code, fix and fix[0], fix and ";".join(f"{c},{r}={to}" for (c, r), to in sorted(fix[1].items())), fix and fix[2], fix and fix[3]))
    return pd.DataFrame(rows, columns=["id", "code", "label", "changes", "before", "after"], dtype=object)


def suggestions(hexes: DataFrame) -> DataFrame:
    """(id, code, label, changes, before, after) for every finding: its best fix on the map as it is, nulls if none helps; changes as `col,row=category` parts."""
    cells = hexes.select("id", "col", "row", F.col("cat").cast("int").alias("cat"))
    marks = settle(_placed(rules(cells)))
    return _windows(cells, marks.select("bc", "br").distinct()).groupBy("bc", "br").cogroup(apart(marks).groupBy("bc", "br")).applyInPandas(_suggest_block, "id bigint, code string, label string, changes string, before int, after int")
