"""What meets in a join must not grow with the square of rows that are alike."""

import glob
import random
from itertools import takewhile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralith import plans
from terralith.operators import board, graph, heights, hexops, paths, repair, rivers, scatter, scratch, spatial, tree, validator
from terralith.operators.scratch import settle


@pytest.fixture(scope="module")
def crowd(spark):
    """1,000 points at 10 places and 1,200 boxes of 6 extents."""
    rng = random.Random(3)
    places, extents = [(k * 3, k) for k in range(10)], [(k, k * 4 + 3, 0, 9 - k) for k in range(6)]
    points = [(k, *rng.choice(places)) for k in range(1000)]
    boxes = [(k, k % 3, k * 7 % 101, *rng.choice(extents)) for k in range(1200)]
    over = {i: [b for b in boxes if b[3] <= x <= b[4] and b[5] <= y <= b[6]] for i, x, y in points}
    return spark.createDataFrame(points, "id bigint, x int, y int"), spark.createDataFrame(boxes, "ordinal bigint, list int, top int, min_x int, max_x int, min_y int, max_y int"), over


@pytest.fixture
def met(monkeypatch):
    """Counts the pairs that meet in cells."""
    pairs, plain = [], spatial.covering_boxes

    def counted(*args):
        out = plain(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "covering_boxes", counted)
    return pairs


def test_first_box_of_crowds(crowd, met):
    points, boxes, over = crowd
    want = {(i, min(b[0] for b in bs)) for i, bs in over.items() if bs}
    assert {tuple(r) for r in spatial.first_box(points, boxes).collect()} == want and len(want) > 500
    assert sum(met) <= 60


def test_highest_box_of_crowds(crowd, met):
    points, boxes, over = crowd
    want = {(i, max(b[2] for b in bs)) for i, bs in over.items() if bs}
    assert {tuple(r) for r in spatial.highest_box(points, boxes, "top").collect()} == want and len(want) > 500
    assert sum(met) <= 60


def test_boxes_by_list_of_crowds(crowd, met):
    points, boxes, over = crowd
    least = lambda bs, n: min((b[0] for b in bs if b[1] == n), default=None)
    got = spatial.boxes_by_list(points, boxes, {"std": 0, "gate": 2}).select("id", "std", "gate").collect()
    assert {tuple(r) for r in got} == {(i, least(bs, 0), least(bs, 2)) for i, bs in over.items()}
    assert sum(met) <= 60


def test_nearest_colour_of_many(spark):
    """Against all pairs, with ties and nulls; no join but the first, with eight cells, and that of null lacks a key."""
    rng = random.Random(5)
    few = lambda: rng.choice([0, 1, 63, 64, 127, 128, 129, 200, 255])
    palette = [(k, f"n{k}", few() << 16 | few() << 8 | few()) for k in range(300)] + [(300, "n300", None)]
    asked = [rng.randrange(1 << 24) for _ in range(200)] + [p[2] for p in palette[:20]]
    gap = lambda a, b: max(abs((a >> k & 255) - (b >> k & 255)) for k in (16, 8, 0))
    want = {(a, *[(n, d) for d, _, n in [min((gap(a, rgb), k, n) for k, n, rgb in palette if rgb is not None)]][0]) for a in asked} | {(None, "n0", None)}
    colours = spark.createDataFrame([(a,) for a in asked] + [(None,)], "rgb bigint")
    table = spark.createDataFrame(palette, "ordinal bigint, name string, rgb bigint")
    plan = spatial.nearest_colour(colours, table)
    assert {tuple(r) for r in plan.collect()} == want
    # every colour meets the eight cells of the cube alone, and the rest by equal cells
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert len([r for r in text.splitlines() if "Join Cross" in r or "Join Inner" in r and "=" not in r]) <= 2 and text.count("Join Inner, (") == 7


def sent(df):
    """Whether the plan gathers rows that an explode makes in the driver, to send them whole."""
    rows = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda row: next((k for k, c in enumerate(row) if c.isalpha()), 0)
    for k, row in enumerate(rows):
        if "BroadcastExchange" in row:
            below = takewhile(lambda r, d=depth(row): depth(r) > d, rows[k + 1 :])
            if any("Generate" in r for r in below):
                return True
    return False


def planned(spark, monkeypatch, name, *modules):
    """All frames that a query plans: those that it settles, and its result."""
    frames = []
    for module in modules:
        monkeypatch.setattr(module, "settle", lambda df: frames.append(df) or settle(df), raising=False)
    out = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    return [*frames, out]


def test_first_heights_sends_no_cells(spark, monkeypatch):
    monkeypatch.setattr(heights, "sample", lambda rows, *args, **kw: rows.withColumn("sample", F.lit(1.0).cast("float")))  # pixels of a raster aside
    assert not any(map(sent, planned(spark, monkeypatch, "first_heights", heights)))


def test_scene_heights_sends_no_cells(spark, monkeypatch):
    assert not any(map(sent, planned(spark, monkeypatch, "scene_heights")))


def test_tree_scatter_sends_no_cells(spark, monkeypatch):
    frames = planned(spark, monkeypatch, "tree_scatter", scatter)
    assert len(frames) > 5 and not any(map(sent, frames))


def test_radius_anti_join_of_copies(spark, tmp_path, monkeypatch):
    """Props that share a place don't meet each other."""
    pairs, plain = [], spatial.within

    def counted(*args):
        out = plain(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within", counted)
    ids = [k * 30000 for k in range(500)] + [7, 8, 9, 30009]
    spark.createDataFrame([(i, 0) for i in ids], "event_id bigint, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r[0] for r in plans.QUERIES["radius_anti_join"](spark, str(tmp_path)).collect()) == [7, 8]
    assert sum(pairs) <= 4


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rules_and_scores_shuffle_hexes_not_steps_or_windows(spark):
    """hexes go to blocks once; no step to a neighbour and no copy of a candidate's window is shuffled."""
    cells = [(c - 70 + 200 * (r + 70), c - 70, r - 70, (r // 3 * 5 + c // 4) % 12) for c in range(140) for r in range(140) if (c * 7 + r * 5) % 11]
    hexes = spark.createDataFrame(cells, "id bigint, col bigint, row bigint, cat bigint")
    assert exchanges(validator.rules(hexes)) == 1
    at = {(c, r): k for _, c, r, k in cells}
    ids = {(c, r): i for i, c, r, _ in cells}
    found = {(ids[s], code) for s in at for code in repair.codes_at(s, at.get)}
    rules = validator.rules(hexes).select("id", "code")
    assert {tuple(r) for r in rules.collect()} == found and len(found) > 5000
    candidates = settle(validator.fix_candidates(rules, hexes))
    scores = validator.score_fixes(hexes, candidates)
    assert exchanges(scores) <= 4
    got = {(r.id, r.code, r.candidate): r for r in scores.collect()}
    assert len(got) == candidates.count()
    spots = {i: s for s, i in ids.items()}
    for i, code, k in sorted(got)[::97]:
        s, row = spots[i], got[i, code, k]
        after = {**at, s: row.to_cat}
        near = [s, *board.ring(s)]
        change = sum(len(repair.codes_at(n, after.get)) - len(repair.codes_at(n, at.get)) for n in near)
        assert row.change == change and row.accepted == (code not in repair.codes_at(s, after.get) and change < 0)


def test_a_candidate_is_judged_where_it_changes_something(monkeypatch):
    """codes are worked out for a repaint's own neighbours, not for its whole window, before and after."""
    at = {(c, r): (r // 3 * 5 + c // 4) % 12 for c in range(40) for r in range(40)}
    field = board.Board(list(at), list(at.values()))
    for s in at:
        field.findings({s, *board.ring(s)})
    seen, plain = [], board.broken
    monkeypatch.setattr(board, "broken", lambda *a: seen.append(a) or plain(*a))
    tried = 0
    for s in at:
        for code in repair.codes_at(s, at.get):
            tried += sum(1 for _ in repair.candidates(code, s, at.get))
            del seen[:]
            assert repair.best_fix(field, code, s) == repair.suggest(code, s, at.get)
            assert len(seen) <= 14 * max(1, sum(1 for _ in repair.candidates(code, s, at.get)))
    assert tried > 500


def test_replacements_of_the_whole_map_are_composed():
    """a hex's work follows the bits of their number, not their number."""
    rng = random.Random(5)
    swaps = sorted((rng.randrange(10_000), rng.randrange(9), rng.randrange(9)) for _ in range(700))
    chain, looked = hexops.Chain(swaps), []
    chain.levels = [[type("Seen", (dict,), {"get": lambda d, *a: looked.append(1) or dict.get(d, *a)})(d) for d in level] for level in chain.levels]
    for _ in range(300):
        value, since = rng.randrange(10), rng.choice([-1, rng.randrange(10_000)])
        own = sorted((rng.randrange(10_000), rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(4)))
        own = [s for s in own if s[0] > since]
        want = value
        for _, _, f, t in sorted([(o, 1, f, t) for o, f, t in swaps if o > since] + [(o, 0, f, t) for o, f, t in own], key=lambda s: s[:2]):
            want = t if want == f else want
        del looked[:]
        assert chain.run(value, since, own) == want
        assert len(looked) <= 20 * (1 + len(own))


def test_lists_are_shortened_before_pointers_double(spark, monkeypatch):
    """rows written are a few times the list, not one list a round."""
    rng = random.Random(7)
    n = 3000
    order = rng.sample(range(n), n)
    steps = [(a, b, 1 + a % 3, a % 5 - 2) for a, b in zip(order, [*order[1:], None], strict=True)]
    want, far, up = {}, 0, 0
    for a, _, f, u in reversed(steps):
        far, up = far + f, up + u
        want[a] = far, up
    ring = [(n, n + 1, 1, 1), (n + 1, n, 1, 1), (n + 2, n + 2, 1, 1), (n + 3, n + 2, 1, 1)]  # no end
    wrote, plain = [], tree.settle
    monkeypatch.setattr(tree, "settle", lambda df: wrote.append(plain(df)) or wrote[-1])
    monkeypatch.setattr(tree, "release", lambda *t: None)
    monkeypatch.setattr(tree, "ENOUGH", 100)
    got = tree.list_sums(plain(spark.createDataFrame([*steps, *ring], "step bigint, to bigint, far bigint, up bigint")))
    assert {r.step: (r.far, r.up) for r in got.collect()} == want
    assert sum(t.count() for t in wrote) < 9 * n


def test_pairs_of_crowded_places(spark, monkeypatch):
    """lists of a place's points meet, not the points."""
    monkeypatch.setattr(spatial, "TOGETHER", 50)
    met, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: met.append(plain(*a)) or met[-1])
    rng = random.Random(9)
    points = [(k, *rng.choice([(0.0, 0.0), (0.5, 0.5), (1.0, 0.0), (2.0, -1.0), (3.5, 0.5)])) for k in range(600)]
    want = {(a, b) for a, x, z in points for b, p, q in points if a < b and (x - p) ** 2 + (z - q) ** 2 <= 1}
    rows = spark.createDataFrame([*points, (9999, None, 0.0)], "id bigint, x double, z double")
    got = spatial.pairs_within(rows, 1.0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert met[0].count() < 300


def test_river_systems_are_labelled_in_blocks(spark, monkeypatch):
    """a river inside one block takes part in no round over the map."""
    tiles = spark.createDataFrame([(k, k % 50 == 0, False, 0, [True]) for k in range(100)], "id bigint, mouth boolean, junction boolean, variant int, takes array<boolean>")
    rows = [(k, 0, k + 1, [True], k // 50, (k + 1) // 50) for k in range(99) if k != 20]
    links = spark.createDataFrame(rows, "src bigint, nth int, dst bigint, back array<boolean>, src_block bigint, dst_block bigint")
    want = sorted(map(tuple, rivers.flow(tiles, links.drop("src_block", "dst_block")).collect()))
    went, plain = [], graph.label_components
    monkeypatch.setattr(graph, "label_components", lambda nodes, edges: went.append(edges.count()) or plain(nodes, edges))
    monkeypatch.setattr(rivers, "label_components", None)
    assert sorted(map(tuple, rivers.flow(tiles, links).collect())) == want and len({r[1] for r in want}) == 2
    assert went == [1]


def test_row_groups_of_wide_rows_are_bounded(spark, monkeypatch):
    """rows with long arrays are not gathered by the hundred in a writer, and so not in a reader."""
    pq = pytest.importorskip("pyarrow.parquet")
    monkeypatch.setattr(scratch, "_WIDE_GROUP", 1 << 20)
    rows = spark.range(0, 48, 1, 1).withColumn("costs", F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda k: F.xxhash64("id", k)))
    files = glob.glob(f"{settle(scratch.wide(rows))._settled_path.removeprefix('file://')}/*.parquet")
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in groups) == 48
    assert max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) <= 12
    # what a block's search holds are views, not an object a step
    packed = paths._pack(pd.DataFrame({"src": [1, 2], "dst": [2, 1], "cost": [1000, 2000], "src_block": 0, "dst_block": 0}), pd.DataFrame({"id": [1, 2], "block": 0, "shut": False, "open": False, "area": 0, "x": 0.0, "y": 0.0}))
    block = paths._Block(packed)
    assert [type(c) for c in (block.begin, block.dst, block.step)] == [memoryview] * 3 and list(block.step) == [1000, 2000]
