"""Routes between areas: borders, crossings, cost tables inside areas, and path refinement."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators import paths
from terralith.operators.scratch import apart, settle


def borders(edges: DataFrame) -> DataFrame:
    """For each pair of neighbouring areas: crossing steps, hexes on the far side, the first of them, and the dearest step.

    edges: src, dst, cost, area, n_area.
    """
    cross = edges.filter("area <> n_area")
    return cross.groupBy("area", "n_area").agg(F.count("*").alias("steps"), F.countDistinct("dst").alias("hexes"), F.min("dst").alias("first"), F.max("cost").alias("dearest"))


def border_runs(edges: DataFrame, apart: int = 10) -> DataFrame:
    """The far-side hexes of each pair of areas in id order, one for each run of ids less than apart from the next."""
    far = edges.filter("area <> n_area").select("area", "n_area", F.col("dst").alias("id")).distinct()
    w = Window.partitionBy("area", "n_area").orderBy("id")
    starts = far.withColumn("_new", F.when(F.col("id") - F.lag("id", 1).over(w) < apart, 0).otherwise(1))
    return starts.filter("_new = 1").select("area", "n_area", "id")


def segments(graph: DataFrame, nodes: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Border segments and reach of areas.

    From its centre an area's search goes on through its own hexes and through those of others that are not open; open hexes
    of another area are met, and not left. The first result has (area, n_area, id, cost) of these, the second (area, dearest),
    the largest cost of an open hex of the area itself. graph: of `paths.block_graph` with area and open; nodes: id, area,
    open; centres: area, id, block.
    """
    found = paths.least_costs(graph, centres.select(F.col("area").alias("query"), F.col("id").alias("start"), "block", F.col("area").alias("home"), F.lit(True).alias("through")))
    met = found.join(nodes.filter("open").select("id", F.col("area").alias("n_area")), "id").withColumnRenamed("query", "area")
    return met.filter("area <> n_area").select("area", "n_area", "id", "cost"), met.filter("area = n_area").groupBy("area").agg(F.max("cost").alias("dearest"))


def _hex_distance(a: tuple[int, int], b: tuple[int, int]) -> int:
    (c1, r1), (c2, r2) = a, b
    q, z = c1 - c2, (r1 - c1 // 2) - (r2 - c2 // 2)
    return max(abs(q), abs(z), abs(q + z))


def line_distance(ax: float, ay: float, bx: float, by: float, px: float, py: float) -> np.float32:
    """Squared distance of a point from a stretch between two points, in single precision and a fixed order of operations."""
    f = np.float32
    ax, ay, bx, by, px, py = map(f, (ax, ay, bx, by, px, py))
    fx, fy = bx - ax, by - ay
    size = f(np.sqrt(fy * fy + fx * fx))
    t = f(0)
    if size > 0:
        inv = f(1) / size
        u = (py - ay) * inv * fy * inv + (px - ax) * inv * fx * inv
        t = f(0) if u < 0 else f(1) if u >= 1 else u
    dy, dx = fy * t + ay - py, fx * t + ax - px
    return dy * dy + dx * dx


class Patch:
    """A part of the map in one task: steps, and the hexes from which steps leave the part.

    `find` is a heap search; of the ways of least cost it takes back that of a search in order of cost, distance from the line
    and id. Its result is that of the whole map unless some step out of the part is cheaper than the target; that is noted in
    `sure`.
    """

    def __init__(self, nodes: pd.DataFrame, steps: pd.DataFrame):
        nodes = nodes.sort_values("id")
        self.ids = nodes["id"].to_numpy()
        ids = self.ids.tolist()
        self.place = dict(zip(ids, range(len(ids)), strict=True))
        self.at = dict(zip(ids, zip(nodes["col"].tolist(), nodes["row"].tolist(), strict=True), strict=True))
        self.x, self.y = nodes["x"].to_numpy(dtype=np.float32), nodes["y"].to_numpy(dtype=np.float32)
        self.shut, self.kind, self.beside, self.comp = (nodes[c].tolist() for c in ("shut", "kind", "beside", "comp"))
        self.out: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.into: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.leaves: dict[int, int] = {}  # the cheapest step out of the patch
        steps = steps[np.isin(steps["src"].to_numpy(), self.ids)]
        src, dst = np.searchsorted(self.ids, steps["src"]), np.searchsorted(self.ids, steps["dst"])
        inside = self.ids[np.minimum(dst, len(ids) - 1)] == steps["dst"].to_numpy()
        for s, d, c, here in zip(src.tolist(), dst.tolist(), steps["cost"].tolist(), inside.tolist(), strict=True):
            if here:
                self.out[s].append((d, c))
                self.into[d].append((s, c))
            else:
                self.leaves[s] = min(c, self.leaves.get(s, c))
        self.sure = True
        self._going: tuple = (-1, {}, [], math.inf)
        self._label()

    def _label(self) -> None:
        """Numbers the parts that hexes which aren't shut are connected in, and notes from which parts steps leave."""
        self.part, n = [-1] * len(self.out), 0
        self.open_parts = set()
        for first in range(len(self.out)):
            if self.part[first] >= 0 or self.shut[first]:
                continue
            todo, self.part[first] = [first], n
            while todo:
                k = todo.pop()
                if k in self.leaves:
                    self.open_parts.add(n)
                for ways in (self.out[k], self.into[k]):
                    for h, _ in ways:
                        if self.part[h] < 0 and not self.shut[h]:
                            self.part[h] = n
                            todo.append(h)
            n += 1

    def _parts(self, k: int, ways: list) -> set[int]:
        return {self.part[h] for h in (k, *(h for h, _ in ways[k])) if not self.shut[h]}

    def _walled(self, start: int, target: int) -> bool:
        """Whether shut hexes inside the patch close the target off from the start."""
        seen, todo = {target}, [target]
        while todo:
            k = todo.pop()
            if k in self.leaves or k == start:
                return False
            for h, _ in self.into[k]:
                if h not in seen and (h == start or not self.shut[h]):
                    seen.add(h)
                    todo.append(h)
        return True

    def find(self, start: int, target: int, shut: bool, line: bool = False) -> tuple[list[int], list[int]] | None:
        """(hexes, costs) of the path, or None; shut hexes are closed but for the target if asked."""
        start, target = self.place[start], self.place[target]
        cost = self._costs(start, target, shut)
        if cost is None:
            return None
        path = self._back(cost, start, target, line, {})
        return self.ids[path].tolist(), [cost[h] for h in path]

    def _costs(self, start: int, target: int, shut: bool) -> dict[int, int] | None:
        """Costs from the start, final up to the target's, which is among them; None without a path.

        A search that no shut hex hinders goes on where the last one from the same start ended.
        """
        if self.comp[start] != self.comp[target]:
            return None
        out, closed, leaves = self.out, self.shut, self.leaves
        if shut and start != target and all(h != target for h, _ in out[start]):
            here, there = self._parts(start, out), self._parts(target, self.into)
            if not here & there:  # no search of the whole patch for what isn't there
                stays = start not in leaves and not here & self.open_parts
                self.sure &= stays or target not in leaves and not there & self.open_parts
                return None
        going = self._going if not shut and self._going[0] == start else (start, {start: 0}, [(0, start)], math.inf)
        _, cost, heap, escape = going
        while heap and heap[0][0] < cost.get(target, math.inf):
            c, k = heapq.heappop(heap)
            if c > cost[k]:
                continue
            if k in leaves:
                escape = min(escape, c + leaves[k])
            for d, w in out[k]:
                n = c + w
                if n < cost.get(d, math.inf) and not (shut and closed[d] and d != target):
                    cost[d] = n
                    heapq.heappush(heap, (n, d))
        if not shut:
            self._going = start, cost, heap, escape
        if target in cost:
            self.sure &= escape >= cost[target]
            return cost
        self.sure &= escape == math.inf or shut and self._walled(start, target)
        return None

    def _back(self, cost: dict[int, int], start: int, target: int, line: bool, tight: dict[int, list[int]]) -> list[int]:
        """The path to the target from a start on a path of least cost to it: costs are from that path's own start."""
        floor, ways, todo = cost[start], {}, [target]
        while todo:  # the hexes of all such paths from the target back, as far as the start's cost
            k = todo.pop()
            if k in ways:
                continue
            if k not in tight:
                tight[k] = [s for s, w in self.into[k] if cost.get(s, -1) + w == cost[k] and s in cost]
            ways[k] = [s for s in tight[k] if cost[s] > floor or s == start] if k != start else []
            todo += ways[k]
        joined = {start}
        for k in sorted(ways, key=cost.__getitem__):
            if any(s in joined for s in ways[k]):
                joined.add(k)
        path = [target]
        while path[-1] != start:
            some = [s for s in ways[path[-1]] if s in joined]
            if line and len(some) > 1:
                off = paths.line_distances(self._line(start, target), self.x[some], self.y[some]).tolist()
                path.append(min(zip((cost[s] for s in some), off, some, strict=True))[2])
            else:
                path.append(min(some, key=lambda s: (cost[s], s)))
        return path[::-1]

    def _line(self, a: int, b: int) -> tuple:
        return self.x[a], self.y[a], self.x[b], self.y[b]

    def refined(self, start: int, target: int, tolerance: float) -> list[int] | None:
        """The path by lines: split at the hex farthest from its line and found anew, until none is farther than the tolerance (squared).

        Both parts of a path of least cost are such paths, and their hexes lie on such paths of the whole: one search has all costs.
        """
        start, target = self.place[start], self.place[target]
        cost = self._costs(start, target, shut=False)
        if cost is None:
            return None
        todo, out, tight = [(start, target)], [], {}
        while todo:
            a, b = todo.pop()
            found = self._back(cost, a, b, a != b, tight)
            off = paths.line_distances(self._line(a, b), self.x[found], self.y[found])
            far = found[int(np.argmax(off))]
            if off.max() <= tolerance or far in (a, b):
                out += found[:-1]
            else:
                todo += [(far, b), (a, far)]
        return self.ids[[*out, target]].tolist()

    def cost(self, a: int, b: int) -> int | None:
        """Cost of the path between two hexes, crossings by bridge counted as one; beside one settlement it leads through shut hexes."""
        if a == b:
            return 0
        beside = self.beside[self.place[a]]
        found = self.find(a, b, shut=beside < 0 or beside != self.beside[self.place[b]])
        if found is None:
            return None
        path, costs = found
        kind = [self.kind[self.place[h]] for h in path]
        total, i = costs[-1], 0
        while i + 1 < len(path):
            if kind[i + 1] == 5:
                total += paths.BRIDGE_COST - (costs[min(i + 3, len(path) - 1)] - costs[min(i + (kind[i] == 6), len(path) - 1)])
                i += 3
            else:
                i += 1
        return total


def pair_transitions(far: set[int], near: set[int], path: list[int] | None, at: dict[int, tuple[int, int]], apart: int = 10) -> list[tuple[int, int]]:
    """(p, q) of the transitions between two areas in order: p in the first area, q in the second.

    far: hexes of the second that the first meets, near: of the first that the second meets. The first transition is where
    the path between the centres crosses: its last hex of near and first hex of far. Then, while any are left at least apart
    steps away, the cluster of touching hexes around the last one by descending (col, row) gives its middle's nearest hexes
    on both sides, if each is nearer to the other than twice its way to its own side's whole border.
    """
    step = lambda a, b: _hex_distance(at[a], at[b])
    order = lambda hexes: sorted(hexes, key=lambda h: (-at[h][0], -at[h][1]))

    def nearest(hexes: list[int], spot: tuple[int, int]) -> int | None:
        return min(hexes, key=lambda h: _hex_distance(at[h], spot), default=None)  # the first of equals

    all_far, all_near = order(far), order(near)
    left_far, left_near, out = all_far, all_near, []

    def take(p: int, q: int) -> None:
        nonlocal left_far, left_near
        out.append((p, q))
        left_far = [h for h in left_far if step(h, q) >= apart]
        left_near = [h for h in left_near if step(h, p) >= apart]

    p = next((h for h in reversed(path or []) if h in near), None)
    q = next((h for h in path or [] if h in far), None)
    if p is not None and q is not None:
        take(p, q)
    while left_far or left_near:
        every = [*left_far, *left_near]
        last, touching = every[-1], {at[h]: h for h in every}
        cluster, todo = set(), [last]
        while todo:
            h = todo.pop()
            if h in cluster:
                continue
            cluster.add(h)
            c, r = at[h]
            for spot in ((c, r - 1), (c, r + 1), (c - 1, r - 1 + c % 2), (c - 1, r + c % 2), (c + 1, r - 1 + c % 2), (c + 1, r + c % 2)):
                if spot in touching:
                    todo.append(touching[spot])
        middle = sum(at[h][0] for h in cluster) // len(cluster), sum(at[h][1] for h in cluster) // len(cluster)
        q, p = nearest(left_far, middle), nearest(left_near, middle)
        if p is not None and q is not None and step(q, p) < 2 * step(nearest(all_far, at[p]), p) and step(q, p) < 2 * step(q, nearest(all_near, at[q])):
            take(p, q)
        else:
            left_far, left_near = ([h for h in side if h != last] for side in (left_far, left_near))
    return out


#: Cells a side of the tiles that pairs of areas are worked out in.
TILE = 256
_TRANSITIONS = "tile bigint, area bigint, n_area bigint, nth int, p bigint, q bigint, there bigint, back bigint, mixed boolean, sure boolean"
_TRANSITION_NAMES = [c.split()[0] for c in _TRANSITIONS.split(", ")]


def _tile(tolerance: float):
    def run(rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        patch, out = Patch(rows[~rows["is_pair"]], steps), []
        for pair in rows[rows["is_pair"]].sort_values("centre").itertuples(index=False):
            patch.sure = True
            far, near = set(np.asarray(pair.far).tolist()), set(np.asarray(pair.near).tolist())
            made = []
            for k, (p, q) in enumerate(pair_transitions(far, near, patch.refined(pair.centre, pair.n_centre, tolerance), patch.at)):
                made.append((pair.tile, pair.area_a, pair.area_b, k, p, q, patch.cost(p, q), patch.cost(q, p), bool(pair.mixed)))
            out += [(*m, patch.sure) for m in made or [(pair.tile, pair.area_a, pair.area_b, *[None] * 6)]]
        return pd.DataFrame(out, columns=_TRANSITION_NAMES, dtype=object)

    return run


def transitions(nodes: DataFrame, steps: DataFrame, border: DataFrame, centres: DataFrame, tolerance: float) -> DataFrame:
    """(area, n_area, nth, p, q, there, back, mixed): the transitions of each pair of areas that meet each other, area < n_area.

    p lies in area and q in n_area; there and back are path costs, null without a path; mixed: land meets sea. nodes: id, col,
    row, x, y, area, shut, kind (5 a bridge hex, 6 a river hex), beside (the settlement next to a hex, or -1); steps: src, dst,
    cost; border: of `segments`; centres: area, id, col, row, sea; nodes have a comp, the component of all steps that they lie in. The pairs
    whose first area has its centre in one tile of the map are worked out by one task on a patch: their areas and those around
    them, each once. Where a cheaper path might leave the patch a pair is done again on a patch that reaches as far
    again, until it is sure; so the paths are those of the whole map, and a task holds what its tile needs.
    """
    met = border.select("area", "n_area", "id").withColumns({"area_a": F.least("area", "n_area"), "area_b": F.greatest("area", "n_area"), "_up": F.col("area") < F.col("n_area")})
    sides = [F.collect_set(F.when(c, F.col("id"))).alias(n) for c, n in ((F.col("_up"), "far"), (~F.col("_up"), "near"))]
    pairs = met.groupBy("area_a", "area_b").agg(*sides).filter("size(far) > 0 and size(near) > 0")
    ends = [centres.select(F.col("area").alias(a), F.col("id").alias(c), F.col("sea").alias(f"_{a}"), *more) for a, c, more in (("area_a", "centre", [paths.block_of("col", "row", (TILE, TILE)).alias("tile")]), ("area_b", "n_centre", []))]
    pairs = settle(pairs.join(ends[0], "area_a").join(ends[1], "area_b").withColumn("mixed", F.col("_area_a") != F.col("_area_b")).drop("_area_a", "_area_b").withColumn("is_pair", F.lit(True)))
    area_of = nodes.select(F.col("id").alias("src"), F.col("area"))
    from_area = settle(steps.select("src", "dst", "cost").join(area_of, "src"))
    beside = from_area.join(area_of.select(F.col("src").alias("dst"), F.col("area").alias("n_area")), "dst").filter("area <> n_area").select("area", "n_area").distinct()
    beside = settle(beside.union(beside.select(F.col("n_area").alias("area"), F.col("area").alias("n_area"))).distinct())
    window = pairs.select("tile", F.explode(F.array("area_a", "area_b")).alias("area")).distinct()
    todo, done, reach, size = pairs, [], 1, -1
    while True:
        for _ in range(reach):
            window = settle(window.union(window.join(beside, "area").select("tile", F.col("n_area").alias("area"))).distinct())
        grown, parts = window.count(), 2 * window.select("tile").distinct().count()
        inside = window.join(nodes, "area").withColumn("is_pair", F.lit(False))
        empty = {f.name: F.lit(0).cast(f.dataType) if f.dataType.typeName() != "array" else F.array().cast(f.dataType) for f in pairs.schema if f.name not in ("tile", "is_pair", "mixed")}
        blank = {f.name: F.lit(0).cast(f.dataType) for f in inside.schema if f.name not in ("tile", "is_pair")}
        rows = inside.withColumns({**empty, "mixed": F.lit(False)}).unionByName(todo.withColumns(blank))
        moves = window.join(from_area, "area").select("tile", "src", "dst", "cost")
        found = settle(rows.repartition(parts or 1, "tile").groupBy("tile").cogroup(apart(moves).repartition(parts or 1, "tile").groupBy("tile")).applyInPandas(_tile(tolerance), _TRANSITIONS))
        unsure = settle(found.filter("not sure").select("tile", F.col("area").alias("area_a"), F.col("n_area").alias("area_b")).distinct())
        left = unsure.count()
        if not left or grown == size:  # a patch that can't grow is all that its hexes reach
            done.append(found)
            break
        done.append(found.filter("sure"))
        todo, reach = settle(todo.join(unsure, ["tile", "area_a", "area_b"], "left_semi")), reach * 2
        window = settle(window.join(unsure, "tile", "left_semi"))
        size = window.count()
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return settle(out.filter("nth is not null").drop("sure", "tile"))


def numbered(found: DataFrame, border: DataFrame) -> DataFrame:
    """(area, number, p, q, n_area, cost, mixed, free): both areas' sides of all transitions, numbered within each area in the order of their making.

    Pairs are made by their lesser area, there in the order in which its search meets the other; free: land meets sea at no
    cost.
    """
    first = border.groupBy("area", "n_area").agg(F.min(F.struct("cost", "id")).alias("met"))
    rows = found.join(first, ["area", "n_area"])
    sides = F.array(
        F.struct(F.col("area").alias("a"), F.col("n_area").alias("b"), F.col("p").alias("p"), F.col("q").alias("q"), F.col("there").alias("cost")),
        F.struct(F.col("n_area").alias("a"), F.col("area").alias("b"), F.col("q").alias("p"), F.col("p").alias("q"), F.col("back").alias("cost")),
    )
    rows = rows.withColumn("s", F.explode(sides)).select(F.col("s.a").alias("area"), F.col("s.b").alias("n_area"), "s.p", "s.q", "s.cost", "mixed", F.struct(F.col("area"), F.col("met"), F.col("nth")).alias("_made"))
    w = Window.partitionBy("area").orderBy("_made")
    return rows.select("area", (F.row_number().over(w) - 1).alias("number"), "p", "q", "n_area", "cost", "mixed", (F.col("mixed") & (F.col("cost") == 0)).alias("free"))


#: Areas whose numbers follow each other that one task takes together.
AREAS = 32


def area_costs(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(area, a, b, cost): least costs between the points of each area by steps inside it; one task for `AREAS` areas.

    edges: src, dst, cost, area, n_area and if wanted shut (dst is only entered if it is one of the points); points: area, id.
    So many areas must fit in a task, as the areas of a map do.
    """
    some = F.floor(F.col("area") / AREAS).alias("some")
    inner = edges.filter("area = n_area").select(some, "src", "dst", "cost", F.col("shut") if "shut" in edges.columns else F.lit(False).alias("shut"))

    def search(steps: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        out, rows = {}, []
        asked = set(marks["id"].tolist())
        for s, d, c, shut in zip(*(steps[c].tolist() for c in ("src", "dst", "cost", "shut")), strict=True):
            if not shut or d in asked:
                out.setdefault(s, []).append((d, c))
        for area, ids in marks.groupby("area")["id"]:
            wanted = sorted(set(ids.tolist()))
            for start in wanted:
                best, heap, left = {start: 0}, [(0, start)], set(wanted)
                while heap and left:
                    cost, k = heapq.heappop(heap)
                    if cost > best[k]:
                        continue
                    if k in left:
                        left.discard(k)
                        rows.append((area, start, k, cost))
                    for d, c in out.get(k, ()):
                        n = cost + c
                        if n < best.get(d, n + 1):
                            best[d] = n
                            heapq.heappush(heap, (n, d))
        return pd.DataFrame(rows, columns=["area", "a", "b", "cost"])

    return inner.groupBy("some").cogroup(apart(points.select(some, "area", "id")).groupBy("some")).applyInPandas(search, "area bigint, a bigint, b bigint, cost bigint")


def refine(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Indexes of the points kept when a path is split at its farthest point until all lie within tolerance."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        size = (dx * dx + dy * dy) ** 0.5
        far, at = -1.0, -1
        for k in range(a + 1, b):
            px, py = points[k][0] - ax, points[k][1] - ay
            d = abs(px * dy - py * dx) / size if size else (px * px + py * py) ** 0.5
            if d > far:
                far, at = d, k
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def refine_paths(paths: DataFrame, tolerance: float) -> DataFrame:
    """The kept points of each path (id, ordinal, x, y)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        return frame.iloc[refine(list(zip(frame["x"], frame["y"], strict=True)), tolerance)]

    return paths.select("id", "ordinal", "x", "y").groupBy("id").applyInPandas(run, paths.select("id", "ordinal", "x", "y").schema)
