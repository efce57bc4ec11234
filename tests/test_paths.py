"""Paths, their steps and transitions against serial forms on the whole map."""

import heapq
import random

import numpy as np
import pandas as pd
import pytest

from terralith import plans
from terralith.operators import paths, routes
from tests.test_queries import small_map

RING = [(0, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0)], [(0, 1), (1, 1), (1, 0), (0, -1), (-1, 0), (-1, 1)]


class Map:
    """The ways of a small map as plain tables, and a serial search on them."""

    def __init__(self, rows):
        cat = {i: (i // 50 // 3 * 5 + i % 50 // 4) % 12 for i in range(50 * rows)}
        self.ids = [i for i in range(50 * rows) if i % 17]
        known = set(self.ids)
        self.kind = {i: 1 if cat[i] == 1 else 5 if i % 23 == 0 else 6 if cat[i] in (5, 6, 7) else 0 for i in self.ids}
        self.shut = {i for i in self.ids if i % 11 == 0}
        self.area = {i: i // 50 // 12 * 4 + i % 50 // 13 for i in self.ids}
        self.spot = {i: (i % 50 * 1.5, i // 50 * 1.75 + i % 50 % 2 * 0.875) for i in self.ids}
        self.out = {i: [] for i in self.ids}
        self.beside = {}
        for i in self.ids:
            c, r = i % 50, i // 50
            self.beside[i] = -1
            for d, (dc, dr) in enumerate(RING[c % 2]):
                n = 50 * (r + dr) + c + dc
                if 0 <= c + dc < 50 and n in known:
                    self.out[i].append((n, 50 if i * 7 % 64 >> d & 1 else 100 + n % 5 * 10))
                    if n in self.shut and self.beside[i] < 0:
                        self.beside[i] = self.area[n] * 3 + (n * 7 % 31) % 3
            if i % 46 == 0 and i + 23 in known and self.kind[i] == self.kind[i + 23] == 5:
                self.out[i].append((i + 23, 500))
            if (i - 23) % 46 == 0 and i - 23 in known and self.kind[i] == self.kind[i - 23] == 5:
                self.out[i].append((i - 23, 500))

    def search(self, start, target=None, shut=True, line=False, stay=None, leave=None):
        """(costs of settled hexes in order, path to the target)."""
        off = lambda k: routes.line_distance(*self.spot[start], *self.spot[target], *self.spot[k]) if line and start != target else np.float32(0)
        cost, before, done, heap = {start: 0}, {}, {}, [(0, np.float32(0), start)]
        while heap:
            c, _, k = heapq.heappop(heap)
            if k in done:
                continue
            done[k] = c
            if k == target:
                path = [k]
                while path[-1] != start:
                    path.append(before[path[-1]])
                return done, path[::-1]
            if leave and not leave(k):
                continue
            for n, w in self.out[k]:
                if shut and n in self.shut and n != target or stay and not stay(n):
                    continue
                if n not in done and c + w < cost.get(n, c + w + 1):
                    cost[n], before[n] = c + w, k
                    heapq.heappush(heap, (c + w, off(n), n))
        return done, None

    def bridged(self, done, path):
        total, i, n = done[path[-1]], 0, 0
        while i + 1 < len(path):
            if self.kind[path[i + 1]] == 5:
                first = i + 1 if self.kind[path[i]] == 6 else i
                total += 500 - sum(done[path[k + 1]] - done[path[k]] for k in range(first, min(i + 3, len(path) - 1)))
                i, n = i + 2, n + 1
            i += 1
        return total, n


@pytest.fixture(scope="module")
def ways(spark, tmp_path_factory):
    return small_map(spark, tmp_path_factory.mktemp("ways"), 36), Map(36)


@pytest.mark.parametrize("block", [256, 20])
def test_path_steps(spark, ways, monkeypatch, block):
    monkeypatch.setattr(paths, "BLOCK", block)
    monkeypatch.setattr(paths, "TOGETHER", 5)
    sf, m = ways
    want, costs = [], []
    for q in range(7, 1800, 40):
        if q not in m.kind:
            continue
        c, r = q % 50, q // 50
        target = (c * 7 + 13) % 50 + 50 * (r - r % 12 + (r * 5 + 3) % 12)
        if target not in m.kind:
            continue
        done, path = m.search(q, target, line=True, stay=lambda n, b=r // 12: n // 50 // 12 == b)
        if path:
            want += [(q, k, h, done[h]) for k, h in enumerate(path)]
            costs.append((q, *m.bridged(done, path)))
    assert sorted(map(tuple, plans.QUERIES["path_steps"](spark, sf).collect())) == want and len({w[0] for w in want}) > 15
    assert sorted(map(tuple, plans.QUERIES["path_costs"](spark, sf).collect())) == costs and sum(c[2] for c in costs) > 2


def test_bridge_costs(spark):
    """Crossings over each other's hexes, at the end of a path and from rivers."""
    rng = random.Random(1)
    m = Map(1)
    rows, want = [], []
    for q in range(200):
        n, at, done = rng.randint(1, 9), 0, {}
        path = [1000 * q + k for k in range(n)]
        for k in path:
            done[k] = at
            at += rng.randint(1, 400)
            m.kind[k] = rng.choice([0, 5, 5, 6])
        rows += [(q, k, h, done[h], m.kind[h]) for k, h in enumerate(path)]
        want.append((q, *m.bridged(done, path)))
    table = spark.createDataFrame(rows, "query bigint, nth bigint, id bigint, cost bigint, kind int").repartition(3)
    assert sorted(map(tuple, paths.bridge_costs(table.drop("kind"), table.select("id", "kind")).collect())) == want


def serial_segments(m):
    centres = {}
    for i in m.ids:
        key = (abs(i % 50 % 13 - 6) + abs(i // 50 % 12 - 6), i)
        centres[m.area[i]] = min(centres.get(m.area[i], key), key)
    centres = {a: k[1] for a, k in centres.items()}
    opened = lambda k: m.kind[k] <= 1 and k not in m.shut
    border, reach = {}, {}
    for a, centre in centres.items():
        done, _ = m.search(centre, shut=False, leave=lambda k, a=a: m.area[k] == a or not opened(k))
        for k, c in done.items():
            if opened(k) and m.area[k] != a:
                border.setdefault((a, m.area[k]), {})[k] = c
            elif opened(k):
                reach[a] = max(reach.get(a, 0), c)
    return centres, border, reach


def test_border_segments(spark, ways):
    sf, m = ways
    _, border, reach = serial_segments(m)
    assert sorted(map(tuple, plans.QUERIES["border_segments"](spark, sf).collect())) == sorted((*pair, k, c) for pair, own in border.items() for k, c in own.items())
    assert dict(map(tuple, plans.QUERIES["area_reach"](spark, sf).collect())) == reach and len(reach) == 12


def serial_transitions(m):
    """(area, number, p, q, n_area, cost, mixed, free) by a loop over all pairs on the whole map."""
    centres, border, _ = serial_segments(m)
    sea = {a: m.kind[c] == 1 for a, c in centres.items()}
    made = {a: [] for a in centres}
    steps = lambda a, b: routes._hex_distance((a % 50, a // 50), (b % 50, b // 50))
    down = lambda hexes: sorted(hexes, key=lambda h: (-(h % 50), -(h // 50)))

    def refined(a, b):
        done, path = m.search(a, b, shut=False, line=True)
        if path is None:
            return None
        far = [(routes.line_distance(*m.spot[a], *m.spot[b], *m.spot[h]), -k) for k, h in enumerate(path)]
        worst, k = max(far)
        if worst <= 0.875 or path[-k] in (a, b):
            return path
        return refined(a, path[-k])[:-1] + refined(path[-k], b)

    def cost(a, b):
        done, path = m.search(a, b, shut=not (m.beside[a] >= 0 and m.beside[a] == m.beside[b]))
        return None if path is None else m.bridged(done, path)[0] if a != b else 0

    def nearest(hexes, c, r):
        best = None
        for h in down(hexes):
            d = routes._hex_distance((h % 50, h // 50), (c, r))
            if best is None or d < best[0]:
                best = d, h
        return best and best[1]

    for a in sorted(centres):
        for b in sorted((b for x, b in border if x == a and b > a and (b, a) in border), key=lambda b: min((c, k) for k, c in border[a, b].items())):
            far, near = set(border[a, b]), set(border[b, a])
            path = refined(centres[a], centres[b]) or []
            p = [h for h in path if h in near][-1:]
            q = [h for h in path if h in far][:1]
            pairs, left_far, left_near = [], set(far), set(near)

            def take(p, q, pairs=pairs, left_far=left_far, left_near=left_near):
                pairs.append((p, q))
                left_far -= {h for h in left_far if steps(h, q) < 10}
                left_near -= {h for h in left_near if steps(h, p) < 10}

            if p and q:
                take(p[0], q[0])
            while left_far or left_near:
                every = down(left_far) + down(left_near)
                cluster, grown = {every[-1]}, True
                while grown:
                    more = {h for h in every if h not in cluster and any(steps(h, k) == 1 for k in cluster)}
                    grown = bool(more)
                    cluster |= more
                c, r = sum(h % 50 for h in cluster) // len(cluster), sum(h // 50 for h in cluster) // len(cluster)
                q1, p1 = nearest(left_far, c, r), nearest(left_near, c, r)
                ok = q1 is not None and p1 is not None
                if ok:
                    d = steps(q1, p1)
                    ok = d < 2 * steps(nearest(far, p1 % 50, p1 // 50), p1) and d < 2 * steps(q1, nearest(near, q1 % 50, q1 // 50))
                if ok:
                    take(p1, q1)
                else:
                    left_far.discard(every[-1])
                    left_near.discard(every[-1])
            for p, q in pairs:
                there, back, mixed = cost(p, q), cost(q, p), sea[a] != sea[b]
                made[a].append((p, q, b, there, mixed, mixed and there == 0))
                made[b].append((q, p, a, back, mixed, mixed and back == 0))
    return sorted((a, k, p, q, b, c, mixed, free) for a, rows in made.items() for k, (p, q, b, c, mixed, free) in enumerate(rows))


def test_transitions(spark, ways):
    sf, m = ways
    want = serial_transitions(m)
    got = sorted(tuple(r) for r in plans.QUERIES["transition_points"](spark, sf).select("area", "number", "p", "q", "n_area", "cost", "mixed", "free").collect())
    assert got == want and len(want) > 40 and max(w[1] for w in want) > 3
    costs = []
    for a in {w[0] for w in want}:
        points = sorted({w[2] for w in want if w[0] == a})
        for s in points:
            done, _ = m.search(s, shut=False, stay=lambda n, a=a, points=points: m.area[n] == a and (n not in m.shut or n in points))
            costs += [(a, s, t, done[t]) for t in points if t in done]
    assert sorted(map(tuple, plans.QUERIES["area_cost_tables"](spark, sf).collect())) == sorted(costs)


def test_patches_grow_where_a_path_may_leave_them():
    """On a patch with a detour outside, find isn't sure; with walls of shut hexes it is."""
    import pandas as pd

    def patch(ids, steps, shut=()):
        nodes = pd.DataFrame({"id": ids, "col": ids, "row": 0, "x": [float(i) for i in ids], "y": 0.0, "area": 0, "shut": [i in shut for i in ids], "kind": 0, "beside": -1, "comp": 0})
        return routes.Patch(nodes, pd.DataFrame(steps, columns=["src", "dst", "cost"]))

    both = lambda *steps: [s for a, b, c in steps for s in ((a, b, c), (b, a, c))]
    long = patch([1, 2, 3], both((1, 2, 10), (2, 3, 10), (1, 9, 1), (9, 3, 1)))
    assert long.find(1, 3, shut=True)[0] == [1, 2, 3] and not long.sure
    near = patch([1, 2, 3, 4], both((1, 2, 1), (2, 3, 1), (1, 4, 5), (4, 9, 1)))
    assert near.find(1, 3, shut=True)[1] == [0, 1, 2] and near.sure
    walled = patch([1, 2, 3, 4], both((1, 2, 1), (2, 3, 1), (1, 9, 5)), shut={2})
    assert walled.find(1, 3, shut=True) is None and walled.sure
    assert walled.find(1, 3, shut=False)[0] == [1, 2, 3] and walled.sure


def test_groups_of_a_block(spark, tmp_path, monkeypatch):
    """A block's arrays go out once for as many of its queries as a group takes, however many queries other blocks have."""
    calls, plain = str(tmp_path / "calls"), paths._advance

    def counted(news, packed):
        with open(calls, "a") as f:
            print(len(news), len(packed), file=f)
        return plain(news, packed)

    monkeypatch.setattr(paths, "_advance", counted)
    monkeypatch.setattr(paths, "BLOCK", 8)
    nodes = spark.createDataFrame([(x * 100 + y, x, y) for x in range(8) for y in range(80)], "id bigint, x int, y int").withColumn("block", paths.block_of("x", "y"))
    near = nodes.selectExpr("id as src", "id + 1 as dst", "block as src_block").join(nodes.selectExpr("id as dst", "block as dst_block"), "dst").filter("src_block = dst_block").selectExpr("*", "1L as cost")
    asked = nodes.selectExpr("id as query", "id as start", "block")
    got = {tuple(r) for r in paths.least_costs(paths.block_graph(near, nodes), asked).collect()}
    assert got == {(x * 100 + y, x * 100 + to, to - y) for x in range(8) for y in range(80) for to in range(y, y // 8 * 8 + 8)}
    with open(calls) as f:
        groups = [tuple(map(int, row.split())) for row in f]
    assert sum(n for n, _ in groups) == 640 and sum(p for _, p in groups) <= 2 * 10


def test_rounds_of_a_narrow_map(spark, monkeypatch):
    """Blocks follow a narrow map, and states that are read again and merged give the same costs."""
    monkeypatch.setattr(paths, "BLOCK", 16)
    nodes = spark.createDataFrame([(k, 0, k) for k in range(400)], "id bigint, x int, y int")
    shape = paths.long_blocks(nodes, "x", "y")
    assert shape == (16, 256) and paths.long_blocks(nodes, "y", "x") == (256, 16)
    for shape in (shape, (1, 60)):
        cells = nodes.withColumn("block", paths.block_of("x", "y", shape))
        up = cells.selectExpr("id as src", "id + 1 as dst", "block as src_block").join(cells.selectExpr("id as dst", "block as dst_block"), "dst").selectExpr("*", "2L as cost")
        got = paths.least_costs(paths.block_graph(up, cells), cells.filter("id % 390 = 0").selectExpr("id as query", "id as start", "block")).collect()
        assert {tuple(r) for r in got} == {(q, k, 2 * (k - q)) for q in (0, 390) for k in range(q, 400)}


def test_paths_are_walked_back_where_they_lie(spark, ways, monkeypatch):
    """No rows are written for hexes that are reached but on no path, and bands cost one round."""
    wrote, plain = [], paths.settle
    monkeypatch.setattr(paths, "settle", lambda df: wrote.append(plain(df)) or wrote[-1])
    monkeypatch.setattr(paths, "release", lambda *t: None)
    found = plans.QUERIES["path_steps"](spark, ways[0]).count()
    assert found > 200 and sum(t.count() for t in wrote) < 200 and len(wrote) < 5


def test_pairs_of_a_tile_share_a_patch(spark, ways, tmp_path, monkeypatch):
    """a hex goes out once for a tile of pairs, not once a pair, and a refined path takes one search."""
    sf, m = ways
    calls, searches = str(tmp_path / "calls"), []

    class Counted(routes.Patch):
        def __init__(self, nodes, steps):
            with open(calls, "a") as f:
                print(len(nodes), file=f)
            super().__init__(nodes, steps)

    plain = routes.Patch
    monkeypatch.setattr(routes, "Patch", Counted)
    monkeypatch.setattr(routes, "TILE", 24, raising=False)
    want = serial_transitions(m)
    got = sorted(tuple(r) for r in plans.QUERIES["transition_points"](spark, sf).select("area", "number", "p", "q", "n_area", "cost", "mixed", "free").collect())
    assert got == want
    with open(calls) as f:
        assert sum(map(int, f)) < 8 * len(m.ids)
    table = lambda **c: pd.DataFrame({"id": m.ids, "col": [i % 50 for i in m.ids], "row": [i // 50 for i in m.ids], "x": [m.spot[i][0] for i in m.ids], "y": [m.spot[i][1] for i in m.ids], **c})
    patch = plain(table(area=0, shut=False, kind=0, beside=-1, comp=0), pd.DataFrame([(s, d, c) for s in m.ids for d, c in m.out[s]], columns=["src", "dst", "cost"]))
    monkeypatch.setattr(routes.heapq, "heappop", lambda heap, pop=heapq.heappop: searches.append(heap[0] == (0, heap[0][1])) or pop(heap))
    assert len(patch.refined(1, 1748, 0.875)) > 30 and sum(searches) == 1
