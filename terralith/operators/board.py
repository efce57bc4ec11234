"""A piece of a hex map in one task: the codes that its hexes break, kept as hexes are repainted.

A repaint changes the codes of a hex and of its six neighbours alone, so a candidate is judged by these, not by its whole window.
"""

from __future__ import annotations

from functools import lru_cache
from operator import itemgetter

from terralith.functions.hexgrid import DIRECTIONS
from terralith.operators.filters import AREA, BEACH, CANAL, CLIFF, CLIFF_END, CROSSING, MOUTH, RIVER, ROAD, SEA, START

LINES = (RIVER, START, MOUTH, CROSSING, ROAD, CLIFF, CLIFF_END, CANAL)
RIVERS = (RIVER, START, MOUTH, CROSSING)
#: River and road sides of crossings that tiles exist for, turned to the least description.
GOOD_CROSSINGS = ("0,3|1,4", "0,3|1,5", "0,3|2,5", "0,2|1,5", "0,2|1,3", "0,3|1,2,4", "0|1,4")
Spot = tuple[int, int]
Change = dict[Spot, int]
#: Steps around a piece that are off the map for certain, so that rings need no test of bounds.
EDGE = 5


def ring(spot: Spot) -> list[Spot]:
    """The six neighbours by direction."""
    c, r = spot
    return [(c + dc, r + (odd if c % 2 else even)) for _, dc, even, odd in DIRECTIONS]


def crossing_form(rivers: list[int], roads: list[int]) -> str:
    """River and road sides, turned so that some river side is 0, in the least of these forms by text."""
    text = lambda sides, turn: ",".join(map(str, sorted((d - turn) % 6 for d in sides)))
    return min(f"{text(rivers, t)}|{text(roads, t)}" for t in rivers or [0])


@lru_cache(1 << 17)
def broken(cat: int | None, around: tuple[int | None, ...]) -> tuple[str, ...]:
    """The codes that a hex breaks, from its category and those around it by direction; None is off the map."""
    if cat not in LINES and cat != AREA:
        return ()
    rivers = sum(n in RIVERS for n in around)
    out = []
    if cat in LINES and around.count(cat) >= 4:
        out.append("line.thick")
    if cat == AREA and SEA in around:
        out.append("coast.missing_ring")
    if cat == CLIFF and BEACH in around or cat == CLIFF_END and BEACH not in around:
        out.append("coast.cliff_end")
    if cat == START and rivers != 1 or cat == MOUTH and (rivers != 1 or SEA not in around) or cat == RIVER and rivers < 1:
        out.append("river.ends")
    if cat == CROSSING and crossing_form([d for d, n in enumerate(around) if n in RIVERS], [d for d, n in enumerate(around) if n == ROAD]) not in GOOD_CROSSINGS:
        out.append("river.crossing")
    return tuple(out)


@lru_cache(64)
def _rings(odd: int, wide: int, tall: int) -> tuple[list, list, list]:
    """For each cell of a field whose first column is even or odd: its neighbours, it and they, and the two rings with it."""
    spots = [(c, r) for c in range(wide) for r in range(tall)]
    inside = lambda c, r: min(max(c, 0), wide - 1) * tall + min(max(r, 0), tall - 1)
    near = [[inside(c - odd, r) for c, r in ring((c + odd, r))] for c, r in spots]
    first = [sorted({k, *near[k]}) for k in range(len(spots))]
    second = [sorted({n for m in first[k] for n in first[m]}) for k in range(len(spots))]
    return [itemgetter(*n) for n in near], first, second


class Board:
    """Hexes in a field with `EDGE` cells to spare on all sides."""

    def __init__(self, spots: list[Spot], cats: list[int]):
        cols, rows = [c for c, _ in spots], [r for _, r in spots]
        self.left, self.low = min(cols) - EDGE, min(rows) - EDGE
        wide, self.tall = max(cols) - self.left + EDGE + 1, max(rows) - self.low + EDGE + 1
        self._near, self._first, self._second = _rings(self.left % 2, wide, self.tall)
        self._cats: list[int | None] = [None] * (wide * self.tall)
        for s, cat in zip(spots, cats, strict=True):
            self._cats[self._at(s)] = cat
        self._codes: list[tuple[str, ...] | None] = [None] * len(self._cats)

    def _at(self, spot: Spot) -> int:
        return (spot[0] - self.left) * self.tall + spot[1] - self.low

    def get(self, spot: Spot) -> int | None:
        return self._cats[self._at(spot)]

    def _here(self, k: int) -> tuple[str, ...]:
        out = self._codes[k]
        if out is None:
            out = self._codes[k] = broken(self._cats[k], self._near[k](self._cats))
        return out

    def codes(self, spot: Spot) -> tuple[str, ...]:
        return self._here(self._at(spot))

    def findings(self, spots: set[Spot]) -> int:
        """Codes on the hexes given and the two rings around them."""
        if len(spots) == 1:
            return sum(len(self._here(k)) for k in self._second[self._at(next(iter(spots)))])
        return sum(len(self._here(k)) for k in {k for s in spots for k in self._second[self._at(s)]})

    def judge(self, code: str, spot: Spot, change: Change) -> tuple[int, bool]:
        """By how much a change would raise the number of codes; whether the spot would be rid of the code."""
        cells = [self._at(s) for s in change]
        touched = self._first[cells[0]] if len(cells) == 1 else {k for i in cells for k in self._first[i]}
        before = sum(len(self._here(k)) for k in touched)
        old = [self._cats[k] for k in cells]
        for k, to in zip(cells, change.values(), strict=True):
            self._cats[k] = to
        cats, near, at, more, gone = self._cats, self._near, self._at(spot), -before, True
        for k in touched:
            found = broken(cats[k], near[k](cats))
            more += len(found)
            if k == at and code in found:
                gone = False
        for k, cat in zip(cells, old, strict=True):
            self._cats[k] = cat
        return more, gone if at in touched else code not in self._here(at)

    def paint(self, change: Change) -> None:
        for s, to in change.items():
            k = self._at(s)
            self._cats[k] = to
            for n in self._first[k]:
                self._codes[n] = None
