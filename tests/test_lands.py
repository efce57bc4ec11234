"""Fixes, planting, rivers, meshes and heights against serial forms."""

import random

import numpy as np
import pytest

from terralith.operators import graph, heights, hexops, mesh, ranks, repair, rivers, scatter, validator
from terralith.plans import lands

RINGS = [(0, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0)], [(0, 1), (1, 1), (1, 0), (0, -1), (-1, 0), (-1, 1)]


def a_map(seed, width, height):
    """Coasts, rivers and roads with noise, as {spot: category}."""
    rng = random.Random(seed)
    cats = {(c, r): (r // 3 * 5 + c // 4) % 12 for c in range(width) for r in range(height)}
    for s in cats:
        if rng.random() < 0.5:
            cats[s] = rng.choice([10, 10, 10, 1, 2, 3, 4, 5, 6, 7, 8, 9])
    for c in range(width):
        cats[c, 5] = 5
    for r in range(height):
        cats[7, r] = 9 if cats[7, r] != 5 else 8
    return cats


def frame(spark, cats, width):
    return spark.createDataFrame([(c + width * r, c, r, k) for (c, r), k in cats.items()], "id bigint, col bigint, row bigint, cat bigint")


def test_rules_of_one_hex_are_those_of_the_table(spark):
    cats = a_map(1, 40, 40)
    want = sorted((r.id, r.code) for r in validator.rules(frame(spark, cats, 40)).collect())
    assert sorted((c + 40 * r, code) for (c, r) in cats for code in repair.codes_at((c, r), cats.get)) == want
    assert {code for _, code in want} == set(repair.CODES)


def test_fix_all_is_the_serial_loop(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 7)
    width, cats = 45, a_map(2, 45, 38)
    findings = [(code, s) for s in cats for code in repair.codes_at(s, cats.get)]
    block = lambda s: (s[0] // 7, s[1] // 7)
    findings.sort(key=lambda f: (block(f[1])[0] % 2 * 2 + block(f[1])[1] % 2, block(f[1]), repair.CODES.index(f[0]), f[1][0] + width * f[1][1]))
    serial = dict(cats)
    done = repair.fix_in_order(findings, serial)
    changes, outcomes = repair.fix_all(frame(spark, cats, width))
    assert sorted(map(tuple, changes.collect())) == sorted((c + width * r, cats[c, r], k) for (c, r), k in serial.items() if cats[c, r] != k)
    want = sorted(((c + width * r, code, out, label) for (code, (c, r)), (out, label, _) in zip(findings, done, strict=True)), key=str)
    assert sorted(map(tuple, outcomes.collect()), key=str) == want
    assert {w[2] for w in want} == {"fixed", "cleared", "skipped"} and {w[1] for w in want if w[2] == "fixed"} == set(repair.CODES)
    count = lambda m: sum(len(repair.codes_at(s, m.get)) for s in m)
    # every fix lessens the findings by what it says
    now = dict(cats)
    for code, spot in findings:
        fix = repair.suggest(code, spot, now.get) if code in repair.codes_at(spot, now.get) else None
        if fix:
            before = count(now)
            now.update(fix[1])
            assert count(now) < before and code not in repair.codes_at(spot, now.get)
    assert now == serial


def test_suggestions_are_the_best_of_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 9)
    width, cats = 30, a_map(3, 30, 30)
    count = lambda m: sum(len(repair.codes_at(s, m.get)) for s in m)
    base, helped = count(cats), 0
    for row in repair.suggestions(frame(spark, cats, width)).collect():
        spot = row.id % width, row.id // width
        best = None
        for label, change in repair.candidates(row.code, spot, cats.get):
            if any(s not in cats for s in change):
                continue
            after = {**cats, **change}
            gone = row.code not in repair.codes_at(spot, after.get)
            # windows of different candidates differ in size: compare what their own window has left
            score, _ = repair._score(row.code, spot, change, cats.get)
            less = score < repair._score(row.code, spot, {}, cats.get)[0]
            if gone and less and (best is None or score < best[1]):
                best = label, score
            assert not (gone and less) or count(after) < base
        assert row.label == (best and best[0]) and (best is None or row.after == best[1] < row.before)
        helped += best is not None
    assert helped > 50


def greedy(spots, trees, spacing, width, height):
    kept, near = [], [(float(np.float32(x)), float(np.float32(z))) for x, z in trees]
    for ordinal, x, z, wet in sorted(spots):
        if 0 <= x <= width and 0 <= z <= height and not wet and all((a - x) ** 2 + (b - z) ** 2 >= spacing * spacing for a, b in near):
            kept.append(ordinal)
            near.append((float(np.float32(x)), float(np.float32(z))))
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_scatter_is_the_serial_choice(spark, seed):
    rng = random.Random(seed)
    spots = [(k, rng.uniform(-0.5, 12), rng.uniform(-0.5, 12), rng.random() < 0.1 or None) for k in range(600)]
    spots += [(600 + k, 5.0 + k * 1e-4, 5.0, False) for k in range(200)] + [(900 + k, 3.0, 3.0, False) for k in range(50)]  # a crowd, and one place
    spots += [(1000 + k, 0.3 * k, 11.9, False) for k in range(40)]  # in order along a line
    rng.shuffle(spots)
    trees = [(rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(15)]
    table = spark.createDataFrame(spots, "ordinal bigint, x double, z double, wet boolean").repartition(3)
    out = scatter.scatter(table, spark.createDataFrame(trees, "x double, z double"), 0.7, 12.0, 12.0, "wet")
    want = greedy(spots, trees, 0.7, 12.0, 12.0)
    assert sorted(r.ordinal for r in out.collect()) == sorted(want) and len(want) > 60
    assert scatter.scatter(table.limit(0), spark.createDataFrame(trees, "x double, z double"), 0.7, 12.0, 12.0).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_scatter_of_repeated_ordinals(spark, monkeypatch, block):
    """spots of one ordinal are planted together or not at all, each where it can stand."""
    monkeypatch.setattr(scatter, "BLOCK", block)
    rng = random.Random(block)
    spots = [(rng.randrange(250), rng.uniform(-0.5, 12), rng.uniform(-0.5, 12), rng.random() < 0.1 or None) for k in range(500)] + [(300 + k, 6.0, 6.0, False) for k in range(9)]
    spots += spots[:20] + [(k, 6.0, 6.0, False) for k in (240, 245, 240)]
    trees = [(rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(5)]
    single = lambda v: float(np.float32(v))
    far = lambda x, z, places: all((single(a) - x) ** 2 + (single(b) - z) ** 2 >= 0.49 for a, b in places)
    able = [s for s in spots if 0 <= s[1] <= 12 and 0 <= s[2] <= 12 and not s[3] and far(s[1], s[2], trees)]
    want, stood = [], []
    for ordinal in sorted({s[0] for s in able}):
        group = [s for s in able if s[0] == ordinal]
        if all(far(x, z, stood) for _, x, z, _ in group):
            want += group
            stood += [(x, z) for _, x, z, _ in group]
    table = spark.createDataFrame(spots, "ordinal int, x double, z double, wet boolean").repartition(3)
    out = scatter.scatter(table, spark.createDataFrame(trees, "x double, z double"), 0.7, 12.0, 12.0, "wet")
    key = lambda r: (r[0], r[1], r[2])
    assert out.schema == table.schema and sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert len(want) > 60 and len({s[0] for s in want}) < len(want) - 10


def test_erase(spark):
    trees = spark.createDataFrame([(1, "Oak", 0.0, 0.0), (2, "oak", 3.0, 4.0), (3, "oak", 3.0, 4.01), (4, "fir", 0.0, 1.0), (5, None, 0.0, 1.0)], "id bigint, species string, x double, z double")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(scatter.erase(trees, 0, 0, 5)) == [3]
    assert ids(scatter.erase(trees, 0, 0, 5, species="OAK")) == [3, 4, 5]
    assert ids(scatter.erase(trees, 0, 0, 5, hidden=("fir",))) == [3, 4, 5]
    many = spark.range(20_000).selectExpr("id", "'oak' as species", "(id % 200) / 20D - 5 as x", "0D as z")
    part = scatter.erase(many, 0, 0, 5, strength=0.5, seed=3)
    assert ids(part) == ids(scatter.erase(many, 0, 0, 5, strength=0.5, seed=3)) and 13_000 < part.count() < 17_000


def serial_flow(tiles, links):
    """The walk as a loop over the whole map: the queue is gone over anew for each mouth."""
    variant, flow, removed, seen, queue = {t.id: t.variant for t in tiles}, {}, set(), set(), []
    by, ways = {t.id: t for t in tiles}, {}
    for e in sorted(links, key=lambda e: (e.src, e.nth)):
        ways.setdefault(e.src, []).append(e)
    for t in sorted(tiles, key=lambda t: t.id):
        if not t.mouth or t.id in removed or t.id in seen:
            continue
        seen.add(t.id)
        queue.append(t.id)
        k = 0
        while k < len(queue):
            here = queue[k]
            if here not in removed:
                for e in ways.get(here, []):
                    if e.dst in removed or e.dst in seen or not by[e.dst].takes[variant[e.dst]]:
                        continue
                    enters = e.back[variant[e.dst]]
                    if not by[e.dst].junction:
                        if enters is not None:
                            flow[e.dst] = enters
                    elif enters:
                        fits = [w for w in range(len(e.back)) if e.back[w] is False]
                        if fits:
                            variant[e.dst] = fits[0]
                        else:
                            removed.add(e.dst)
                    queue.append(e.dst)
            seen.add(here)
            k += 1
    return {t.id: (t.id in set(queue), flow.get(t.id, False), variant[t.id], t.id in removed) for t in tiles}


def test_river_flow(spark, monkeypatch):
    monkeypatch.setattr("terralith.operators.paths.BLOCK", 16)
    rng = random.Random(4)
    cats = {(i % 50, i // 50): rng.choice([5, 5, 5, 7, 8, 10]) for i in range(600)}
    tiles, links = lands.river_tables(frame(spark, cats, 50))
    want = serial_flow(tiles.collect(), links.collect())
    got = {r.id: (r.reached, r.flow, r.variant, r.removed) for r in rivers.flow(tiles, links).collect()}
    assert got == want and len(got) > 300
    assert any(w[1] for w in want.values()) and any(w[3] for w in want.values()) and not all(w[0] for w in want.values())


def serial_field(triangles, scale, width, height):
    f, field = np.float32, {}
    for _, *v in sorted(triangles):
        ax, ay, az, bx, by, bz, cx, cy, cz = map(f, v)
        xs, zs = [int(ax), int(bx), int(cx)], [int(az), int(bz), int(cz)]
        for z in range(min(zs) - 1, max(zs) + 1):
            for x in range(min(xs) - 1, max(xs) + 1):
                d22, d25, d23, d26 = bz - az, bx - ax, cz - az, cx - ax
                pz, px = f(z) - az, f(x) - ax
                d00, d01, d11 = d22 * d22 + d25 * d25, d23 * d22 + d26 * d25, d23 * d23 + d26 * d26
                d02, d12 = pz * d22 + px * d25, pz * d23 + px * d26
                den = d11 * d00 - d01 * d01
                if den == 0:
                    continue
                inv = f(1) / den
                u, w = (d02 * d11 - d12 * d01) * inv, (d12 * d00 - d02 * d01) * inv
                t = (f(1) - u) - w
                if not all(f(-9.999999747378752e-05) <= k <= f(1.000100016593933) for k in (t, u, w)):
                    continue
                sx, sz = f(scale) * f(x), f(scale) * f(z)
                if 0 <= sx < width and 0 <= sz < height:
                    field[int(sx), int(sz)] = w * cy + u * by + t * ay
    return field


@pytest.mark.parametrize("scale", [1.0, 0.5, 1.7])
def test_rasterise(spark, scale):
    rng = random.Random(6)
    spot = lambda n: [rng.uniform(-3, n), rng.uniform(0, 9), rng.uniform(-3, n)]
    rows = [(k, *spot(40), *spot(40), *spot(40)) for k in range(25)] + [(40 + k, *(float(int(x)) for x in (*spot(20), *spot(20), *spot(20)))) for k in range(25)]
    rows += [(90, -50.0, 1.0, -50.0, 300.0, 2.0, -50.0, -50.0, 3.0, 300.0), (30, 5.0, 1.0, 5.0, 5.0, 2.0, 5.0, 9.0, 3.0, 9.0)]  # a giant, and one without area
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "ordinal bigint, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    got = {(r.px, r.pz): np.float32(r.y) for r in mesh.rasterise(table, scale, 48, 36, piece=8).collect()}
    assert got == serial_field(rows, scale, 48, 36) and len(got) > 400


def test_first_heights_in_single_precision(spark):
    rng, f = random.Random(8), np.float32
    rasters = {p: (w, h, rng.uniform(-3, 0), rng.uniform(1, 5), np.array([[0 if p == "zero" else rng.randrange(65536) for _ in range(w)] for _ in range(h)])) for p, w, h in (("a", 5, 4), ("b", 1, 1), ("zero", 3, 3))}
    rasters["zero"] = (3, 3, 0.0, 1.0, rasters["zero"][4])
    big = (7, 6, -0.25, 1.5, np.array([[rng.randrange(65536) for _ in range(7)] for _ in range(6)]))
    tiles = [(k, rng.randrange(6), rng.randrange(6), rng.randint(1, 3), rng.randint(1, 2), rng.choice([0x10, 0x20, 0x40, 0x80, 0x30]), rng.choice([None, None, 0b111111, rng.randrange(64)]), rng.choice(["a", "b", "zero", "none"])) for k in rng.sample(range(100), 25)]
    points = [(k, rng.uniform(-1, 33), rng.uniform(-1, 33)) for k in range(300)] + [(400 + k, float(k), 8.0) for k in range(33)]

    def sampled(r, u, v):
        w, h, lo, hi, data = r
        fx, fy = f(w) * u, f(h) * v
        value = lambda c, k: f(data[min(max(k, 0), h - 1), min(max(c, 0), w - 1)]) * f(1 / 65535) * (f(hi) - f(lo)) + f(lo)
        x, y, dx, dy = int(fx), int(fy), fx - f(np.floor(fx)), fy - f(np.floor(fy))
        a, b, c, d = value(x, y - 1), value(x + 1, y - 1), value(x, y), value(x + 1, y)
        top, bottom = (b - a) * dx + a, (d - c) * dx + c
        return (bottom - top) * dy + top

    scale, want = f(1 / 128) * f(4), {}
    for i, x, z in points:
        x, z = f(x), f(z)
        low = sampled(big, x / f(32), f(1) - z / f(32)) * f(1100) * scale - scale * f(240)
        want[i] = (None, f(0), f(0), low)
        if not (0 <= x <= f(32) and 0 <= z <= f(32)):
            continue
        tx, ty = f(0.25) * x, f(0.25) * z
        for o, px, py, w, h, rot, mask, path in sorted(tiles):
            wide, tall = (h, w) if rot in (0x20, 0x80) else (w, h)
            if not (px <= tx <= px + wide and py <= ty <= py + tall):
                continue
            ix, iy = int(tx - f(px)), int(ty - f(py))
            c, r = {0x20: (w - iy - 1, ix), 0x40: (w - ix - 1, h - iy - 1), 0x80: (iy, h - ix - 1)}.get(rot, (ix, iy))
            valid = 0 <= c < w and 0 <= r < h and (mask is None or mask >> (c * h + r) & 1 == 1)
            if mask is not None and not valid:
                continue
            a, b, one, nil = (tx - f(px)) / f(wide), (ty - f(py)) / f(tall), f(1), f(0)
            u, v = {0x10: (a, b), 0x20: (one - b, a), 0x40: (one - a, one - b), 0x80: (b, one - a)}.get(rot, (nil, nil))
            high = sampled(rasters[path], u, v) * scale if path in rasters else f(0)
            if valid or high != 0:
                want[i] = (o, high, high + low, low)
                break
    pixels = lambda d: [(x, y, int(d[y, x])) for y in range(d.shape[0]) for x in range(d.shape[1])]
    low = heights.low_heights(spark.createDataFrame(points, "id bigint, x double, z double"), spark.createDataFrame(pixels(big[4]), "x int, y int, v int"), spark.createDataFrame([big[:4]], "w int, h int, lo double, hi double"), 4.0, 32.0, 32.0)
    inside = {i for i, x, z in points}
    assert {r.id: f(r.low) for r in low.collect()} == {i: want[i][3] for i in inside}
    out = heights.first_heights(
        low, spark.createDataFrame(tiles, "ordinal bigint, x bigint, y bigint, w int, h int, rot int, mask bigint, path string"),
        spark.createDataFrame([(p, *q) for p, r in rasters.items() for q in pixels(r[4])], "path string, x int, y int, v int"), spark.createDataFrame([(p, *r[:4]) for p, r in rasters.items()], "path string, w int, h int, lo double, hi double"), 4.0, 32.0, 32.0,
    )
    got = {r.id: (r.ordinal, f(r.high), f(r.height)) for r in out.collect()}
    assert got == {i: w[:3] for i, w in want.items()} and len({w[0] for w in want.values()}) > 8 and any(w[0] is None for w in want.values())


def test_ranks_and_first_use_codes(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", None, "zz", "é"])) for k in rng.sample(range(1000), 300)]
    table = spark.createDataFrame(rows, "ordinal bigint, value string").repartition(7)
    assert [(r.ordinal, r.rank) for r in ranks.ranked(table, "ordinal").orderBy("rank").collect()] == [(k, n) for n, (k, _) in enumerate(sorted(rows))]
    codes = {}
    for _, value in sorted(rows):
        codes.setdefault(value, len(codes))
    assert {r.value: r.code for r in ranks.first_use_codes(table, "value", "ordinal").collect()} == codes
    assert sorted((r.ordinal, r.code) for r in ranks.coded(table, "value", "ordinal").collect()) == [(k, codes[v]) for k, v in sorted(rows)]
    assert ranks.ranked(table.limit(0), "ordinal").count() == 0


def test_flood_and_circles(spark):
    cats = a_map(5, 30, 30)
    hexes = frame(spark, cats, 30)
    todo, seen = [(4, 4)], set()
    while todo:
        s = todo.pop()
        if s not in seen and cats.get(s) == cats[4, 4]:
            seen.add(s)
            todo += [(s[0] + dc, s[1] + dr) for dc, dr in RINGS[s[0] % 2]]
    assert {(r.col, r.row) for r in graph.flood(hexes, 4, 4, "cat").collect()} == seen
    with pytest.raises(ValueError, match="more than 0"):
        graph.flood(hexes, 4, 4, "cat", limit=0)
    one = graph.circles(spark.createDataFrame([(1, 15, 15), (2, 4, 0)], "id bigint, col bigint, row bigint"), 2)
    assert one.filter("id = 1").count() == one.filter("id = 2").count() == 19


class Interpreter:
    """Hex operations one after the other."""

    def __init__(self, cats, sets):
        self.map, self.sets, self.cat = dict(cats), {n: v for n, v, _ in sets}, {v: c for _, v, c in sets}

    def ring(self, s):
        return [n for n in ((s[0] + dc, s[1] + dr) for dc, dr in RINGS[s[0] % 2]) if n in self.map]

    def area(self, o):
        cube = lambda c, r: (c, r - (c - c % 2) // 2)
        away = lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1]), abs(a[0] - b[0] + a[1] - b[1]))
        if "hexes" in o:
            return [tuple(h) for h in o["hexes"]]
        if "circle" in o:
            c, r, k = o["circle"]
            return [s for s in self.map if away(cube(*s), cube(c, r)) <= k]
        if "rect" in o:
            c0, r0, c1, r1 = o["rect"]
            return [s for s in self.map if min(c0, c1) <= s[0] <= max(c0, c1) and min(r0, r1) <= s[1] <= max(r0, r1)]
        if "polygon" in o:
            pts = [(c, r + c % 2 * 0.5) for c, r in o["polygon"]]
            inside = []
            for s in self.map:
                x, y, odd = s[0], s[1] + s[0] % 2 * 0.5, False
                for (ax, ay), (bx, by) in zip(pts, pts[-1:] + pts[:-1], strict=True):
                    if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                        odd = not odd
                inside += [s] if odd else []
            return inside
        path, points = [], o["points"]
        for k, p in enumerate(points):
            if not k:
                path.append(tuple(p))
                continue
            (aq, az), (bq, bz) = cube(*points[k - 1]), cube(*p)
            n = away((aq, az), (bq, bz))
            for i in range(1, n + 1):
                t = i / n
                q, y, z = aq + (bq - aq) * t + 1e-6, (-aq - az) + ((-bq - bz) - (-aq - az)) * t + 2e-6, az + (bz - az) * t - 3e-6
                rq, ry, rz = round(q), round(y), round(z)
                dq, dy, dz = abs(rq - q), abs(ry - y), abs(rz - z)
                if dq > dy and dq > dz:
                    rq = -ry - rz
                elif dy <= dz:
                    rz = -rq - ry
                path.append((rq, rz + (rq - rq % 2) // 2))
        width = o.get("width", 1) - 1
        return [s for s in self.map if any(away(cube(*s), cube(*p)) <= max(width, 0) for p in path)]

    def apply(self, o):
        name = o["op"]
        if name in ("paint", "line"):
            for s in self.area(o):
                if s in self.map:
                    self.map[s] = self.sets[o["set"]]
        elif name == "replace":
            for s in self.map if o.get("all") else self.area(o):
                if self.map.get(s) == self.sets[o["from"]]:
                    self.map[s] = self.sets[o["to"]]
        elif name == "fill":
            todo, seen = [tuple(o["at"])], set()
            while todo:
                s = todo.pop()
                if s not in seen and self.map[s] == self.map[tuple(o["at"])]:
                    seen.add(s)
                    todo += self.ring(s)
            for s in seen:
                self.map[s] = self.sets[o["set"]]
        else:
            todo = {s for s in self.area(o) if s in self.map}
            back = self.sets[o["to"]] if "to" in o else 100
            while todo:
                new = {}
                for s in todo:
                    known = [self.map[n] for n in self.ring(s) if n not in todo]
                    land = [k for k in known if self.cat.get(k) == 10]
                    if known:
                        new[s] = min(land, key=lambda k: (-land.count(k), k)) if land else 101 if all(self.cat.get(k) == 1 for k in known) else back
                if not new:
                    new = dict.fromkeys(todo, back)
                self.map.update(new)
                todo -= set(new)


def test_hex_operations_are_the_serial_ones(spark):
    import json

    rng = random.Random(12)
    sets = [("land", 100, 10), ("wood", 103, 10), ("sea", 101, 1), ("river", 5, 5), ("road", 9, 9)]
    names = [n for n, _, _ in sets]
    cats = {(c, r): rng.choice([100, 100, 101, 101, 103, 5]) for c in range(24) for r in range(20)}
    spot = lambda: [rng.randrange(-1, 25), rng.randrange(-1, 21)]
    inner = lambda: [rng.randrange(24), rng.randrange(20)]

    def an_area():
        return rng.choice([lambda: {"hexes": [spot() for _ in range(rng.randint(0, 4))]}, lambda: {"circle": [*spot(), rng.randint(0, 4)]}, lambda: {"rect": [*spot(), *spot()]}, lambda: {"polygon": [spot() for _ in range(rng.randint(2, 6))]}])()

    ops = []
    for k in range(240):
        name = rng.choice(["paint"] * 3 + ["line"] * 2 + ["replace"] * 3) if k % 40 else ["fill", "erase"][k // 40 % 2]
        o = {"op": name}
        if name in ("paint", "erase"):
            o |= an_area()
        if name in ("paint", "line", "fill"):
            o["set"] = rng.choice(names)
        if name == "line":
            o |= {"points": [inner() for _ in range(rng.randint(2, 4))], "width": rng.choice([1, 1, 2])}
        if name == "fill":
            o["at"] = inner()
        if name == "replace":
            o |= {"from": rng.choice(names), "to": rng.choice(names)} | ({"all": True} if rng.random() < 0.2 else an_area())
        ops.append((k * 3, o))
    want = Interpreter(cats, sets)
    for _, o in ops:
        want.apply(o)
    hexes = spark.createDataFrame([(c + 24 * r, c, r, k) for (c, r), k in cats.items()], "id bigint, col bigint, row bigint, value int")
    rows = [(k, json.dumps(o)) for k, o in ops]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "ordinal bigint, json string")
    named = spark.createDataFrame(sets, "name string, value bigint, cat int")
    got = {(r.col, r.row): r.value for r in hexops.apply_ops(hexes, table, named, 100, 101).collect()}
    assert got == want.map and got != cats
    whole = spark.createDataFrame([(1, '{"op": "erase", "rect": [0, 0, 30, 30]}')], "ordinal bigint, json string")
    assert {r.value for r in hexops.apply_ops(hexes, whole, named, 100, 101).collect()} == {100}
    for wrong in ('{"op": "paint", "set": "land"}', '{"op": "dig"}', "no json", '{"op": "fill", "set": "none", "at": [1, 1]}', '{"op": "line", "set": "land", "points": [[1, 1]]}'):
        with pytest.raises(ValueError, match="operation 4 can't be applied"):
            hexops.apply_ops(hexes, spark.createDataFrame([(4, wrong)], "ordinal bigint, json string"), named, 100, 101)
    with pytest.raises(ValueError, match="outside the map"):
        hexops.apply_ops(hexes, spark.createDataFrame([(4, '{"op": "fill", "set": "land", "at": [99, 1]}')], "ordinal bigint, json string"), named, 100, 101)


def test_distance_field(spark, monkeypatch):
    from terralith.operators import raster

    monkeypatch.setattr(raster, "BLOCK", 8)
    rng = random.Random(5)
    spots = {(rng.randrange(12), rng.randrange(40)) for _ in range(3)}
    table = spark.createDataFrame([(x, y, int((x, y) in spots)) for x in range(50) for y in range(40)], "x int, y int, v int")
    got = {(r.x, r.y): r.d for r in raster.distance_field(table, reach=2).collect()}
    want = lambda x, y: min(max(abs(x - a), abs(y - b)) + (2**0.5 - 1) * min(abs(x - a), abs(y - b)) for a, b in spots)
    assert len(got) == 2000 and all(abs(d - want(x, y)) < 1e-9 for (x, y), d in got.items())
    assert {r.d for r in raster.distance_field(table.filter("v = 0")).collect()} == {None}
