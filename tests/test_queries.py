"""Every query with SQL against DuckDB on the smallest tables, and some against loops."""

import heapq
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terralith import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(norm, x)) + "]"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_landmark_paths(spark):
    from terralith.operators import graph, paths

    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 1), (5, 1, 1)], "src bigint, dst bigint, cost bigint")
    starts = spark.createDataFrame([(7, 1), (8, 5)], "start bigint, id bigint")
    want = sorted(map(tuple, graph.shortest_paths(edges, starts).collect()))
    blocks = edges.selectExpr("*", "src % 2 as src_block", "dst % 2 as dst_block")
    packed = paths.block_graph(blocks, spark.range(1, 6).selectExpr("id", "id % 2 as block"))
    got = paths.least_costs(packed, starts.selectExpr("start as query", "id as start", "id % 2 as block"))
    assert want == sorted(map(tuple, got.collect())) == [(7, 1, 0), (7, 2, 5), (7, 3, 10), (7, 4, 11), (8, 1, 1), (8, 2, 6), (8, 3, 11), (8, 4, 12), (8, 5, 0)]


def test_hex_lines_and_circles(spark):
    from terralith.operators import graph

    assert graph.circle(spark, 15, 15, 2).count() == 19
    steps = [(r.col, r.row) for r in graph.line(spark, (2, 3), (20, 9)).orderBy("step").collect()]
    assert steps[0] == (2, 3) and steps[-1] == (20, 9)
    cube = lambda c, r: (c, -c - (r - (c - c % 2) // 2), r - (c - c % 2) // 2)
    assert all(max(abs(p - q) for p, q in zip(cube(*a), cube(*b), strict=True)) == 1 for a, b in zip(steps, steps[1:], strict=False))


def test_erase_inward(spark):
    from terralith.operators import graph

    hexes = spark.createDataFrame([(c + 6 * r, c, r, 1 if c < 3 else 2) for c in range(6) for r in range(6)], "id bigint, col bigint, row bigint, rgb bigint")
    out = {(r.col, r.row): r.rgb for r in graph.erase_inward(hexes, hexes.filter("col in (1, 2) and row in (2, 3)")).collect()}
    assert out[(1, 2)] == out[(1, 3)] == 1 and set(out.values()) == {1, 2} and len(out) == 36


def test_distance_transform(spark):
    from terralith.operators import raster

    mask = spark.createDataFrame([(x, y, int((x, y) == (250, 10))) for x in range(235, 275) for y in range(0, 25)], "x bigint, y bigint, v int")
    got = {(r.x, r.y): r.d for r in raster.distance_transform(mask, 12).collect()}
    for (x, y), d in got.items():
        dx, dy = abs(x - 250), abs(y - 10)
        want = abs(dx - dy) + min(dx, dy) * 2**0.5
        assert (d is None) if want > 12 else abs(d - want) < 1e-9
    assert len(got) == 1000


def test_fix_scores(spark):
    """Scores from windows are those of the whole map with the hex repainted."""
    from terralith.operators import validator

    cells = [(c + 9 * r, c, r, 1 if r < 4 else 10) for c in range(9) for r in range(9)]
    make = lambda rows: spark.createDataFrame(rows, "id bigint, col bigint, row bigint, cat bigint")
    hexes = make(cells)
    count = lambda h: validator.rules(h).filter("code <> 'river.crossing'").count()
    before = count(hexes)
    found = validator.rules(hexes).filter("col = 4").select("id", "code")
    scores = validator.score_fixes(hexes, validator.fix_candidates(found, hexes)).collect()
    assert scores
    for s in scores:
        after = make([(i, c, r, s.to_cat if i == s.id else k) for i, c, r, k in cells])
        assert s.change == count(after) - before


def test_tables(spark, tmp_path):
    from terralith.sources import tables

    (tmp_path / "a.tsv").write_text("key\ttext\ttooltip\n#t;1;x\nk1\thello\tyes\nk2\tshort\n")
    got = tables.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert [(r.key, r.text, r.tooltip) for r in got.orderBy("ordinal").collect()] == [("k1", "hello", "yes"), ("k2", "short", "")]
    assert [r.value for r in tables.tsv_lines(got, "t").collect()] == ["key\ttext\ttooltip", "#t;0;", "k1\thello\tyes", "k2\tshort\t"]
    rows = [(True, -5, 1.5, "é", ""), (False, 7, 0.25, "", "opt")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.bin").write_bytes(tables.encode_table(rows, "bifso", 3))
    back = tables.read_binary_tables(spark, str(tmp_path / "t"), {3: "bifso"}, ["a", "b", "c", "d", "e"]).orderBy("ordinal").collect()
    assert [tuple(r)[2:] for r in back] == rows
    with pytest.raises(ValueError):
        list(tables.decode_table(tables.encode_table(rows, "bifso", 4), {3: "bifso"}))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.pack").write_bytes(tables.write_archive({"A/b.txt": b"one", "c": b""}))
    (tmp_path / "p" / "2.pack").write_bytes(tables.write_archive({"a\\B.txt": b"two", "d": b"x"}))
    one, two = (tables.read_archives(spark, str(tmp_path / "p" / f"{k}.pack")) for k in (1, 2))
    assert {r.key: bytes(r.content) for r in tables.overlay_members(one, two).collect()} == {"a\\b.txt": b"one", "c": b"", "d": b"x"}


def test_streamed_windows(spark, tmp_path):
    from terralith.streaming import windows

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    flow = windows.counts(windows.read_events(spark, str(tmp_path / "in"), schema), "1 hour", late="1 hour")
    windows.write_counts(flow, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window.start, r.event_type): r.n for r in windows.counts(events, "1 hour").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_routes(spark):
    from terralith.operators import graph, routes

    edges = spark.createDataFrame([(1, 2, 5, 0, 0), (2, 3, 5, 0, 0), (1, 3, 20, 0, 0), (3, 9, 1, 0, 1), (9, 2, 1, 1, 0)], "src bigint, dst bigint, cost bigint, area bigint, n_area bigint")
    points = spark.createDataFrame([(0, 1), (0, 3)], "area bigint, id bigint")
    got = sorted(map(tuple, routes.area_costs(edges, points).collect()))
    inner = graph.shortest_paths(edges.filter("area = n_area"), points.selectExpr("id as start", "id")).filter("id in (1, 3)")
    assert got == sorted((0, *r) for r in map(tuple, inner.collect())) == [(0, 1, 1, 0), (0, 1, 3, 10), (0, 3, 3, 0)]
    assert routes.refine([(0, 0), (1, 0.1), (2, 3), (4, 0)], 0.5) == [0, 1, 2, 3]
    assert routes.refine([(0, 0), (1, 0.1), (2, 0)], 0.5) == [0, 2]


def small_map(spark, tmp_path, rows):
    """orders and part of a map of 50 columns and so many rows, at tmp_path."""
    spark.range(50 * rows).selectExpr("id as o_orderkey", "id * 7 % 31 as o_custkey", "cast(id * 37 % 9000 as double) as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("id as p_partkey", "id % 3 as p_size").filter("p_partkey % 4 <> 1").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def hex_ring(c, r):
    return [(c, r - 1), (c, r + 1), *((c + d, r + e + c % 2 - 1) for d in (-1, 1) for e in (0, 1))]


def union_find(cells, near):
    parent = {c: c for c in cells}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for c in cells:
        for d in near(c):
            if d in parent and cells[d][1] == cells[c][1]:
                a, b = find(c), find(d)
                parent[max(a, b, key=lambda k: cells[k][0])] = min(a, b, key=lambda k: cells[k][0])
    groups = {}
    for c in cells:
        groups.setdefault(cells[find(c)][0], []).append(c)
    return groups


def test_whole_components(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("terralith.operators.graph.BLOCK", 7)  # many borders
    sf = small_map(spark, tmp_path, 60)
    cells = {(i % 50, i // 50): (i, (i // 50 // 3 * 5 + i % 50 // 4) % 12) for i in range(3000)}
    want = {k: len(g) for k, g in union_find(cells, lambda c: hex_ring(*c)).items()}
    got = {r.comp: r["size"] for r in plans.QUERIES["hex_components"](spark, sf).collect()}
    assert got == want and max(want) >= 1500 and sum(want.values()) == 3000


def test_whole_holes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("terralith.operators.graph.BLOCK", 7)
    sf = small_map(spark, tmp_path, 60)
    covered = set()
    for k in range(200):
        if k % 4 != 1:
            x, y, n = k * 3 % 50, k * 7 % 30, 1 + k % 3
            covered |= {(i, j) for i in range(max(0, x - n), x + n + 1) for j in range(max(0, y - n), y + n + 1)}
    cells = {(i % 50, i // 50): (i, 0) for i in range(3000) if (i % 50, i // 50) not in covered}
    want = []
    for k, g in union_find(cells, lambda c: [(c[0] + a, c[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]).items():
        xs, ys = zip(*g, strict=True)
        want.append((k, len(g), min(xs), max(xs), min(ys), max(ys), any(x < 2 or y < 2 or x >= 48 or y >= 58 for x, y in g)))
    got = sorted(map(tuple, plans.QUERIES["tile_holes"](spark, sf).collect()))
    assert got == sorted(want) and len(want) > 1 and max(w[5] for w in want) == 59


def test_whole_paths(spark, tmp_path):
    sf = small_map(spark, tmp_path, 60)
    ring = [(0, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0)], [(0, 1), (1, 1), (1, 0), (0, -1), (-1, 0), (-1, 1)]
    best, heap = {1: 0}, [(0, 1)]
    while heap:
        cost, k = heapq.heappop(heap)
        for d, (dc, dr) in enumerate(ring[k % 50 % 2]):
            c, r = k % 50 + dc, k // 50 + dr
            n = 50 * r + c
            if cost == best[k] and 0 <= c < 50 and 0 <= r < 60 and n % 17:
                step = cost + (5 if k * 7 % 64 >> d & 1 else 10 + n % 5)
                if step < best.get(n, step + 1):
                    best[n] = step
                    heapq.heappush(heap, (step, n))
    got = {r.id: r.cost for r in plans.QUERIES["shortest_paths"](spark, sf).collect()}
    assert got == best and len(best) > 2500 and max(best.values()) > 60


@pytest.mark.parametrize("name", ["radius_join", "radius_anti_join", "nearest_colour", "class_match", "last_overrides", "siege_boxes", "raster_enlarge", "raster_pad", "batch_edits", "prop_moves", "prefab_expansion", "tile_masks", "journal_replay", "channel_zip"])
def test_as_sql_on_more_rows(spark, name):
    sf = SF.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in [*TABLES]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(plans.SQL[name])
    names, rows = want.columns, rows_of(want.columns, want.fetchall())
    df = plans.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names) and rows_of(df.columns, df.collect()) == rows and rows


def test_fix_scores_of_all_codes(spark, tmp_path):
    """Every code of the rules is scored; crossings, made or broken, count."""
    from terralith.operators import validator

    found = {r.code for r in validator.rules(spark.createDataFrame([(i, i % 50, i // 50, (i // 50 // 3 * 5 + i % 50 // 4) % 12) for i in range(3000)], "id bigint, col bigint, row bigint, cat bigint")).select("code").distinct().collect()}
    assert {r.code for r in plans.QUERIES["fix_scores"](spark, small_map(spark, tmp_path, 60)).select("code").distinct().collect()} == found >= {"line.thick", "river.ends", "river.crossing"}
    # a river along column 4 with a crossing that roads meet on one side; beside it a river hex to be painted over
    cats = {(4, r): 5 for r in range(9)} | {(4, 4): 8, (5, 4): 9, (1, 1): 8, (1, 2): 7, (7, 7): 8, (7, 8): 5}
    cells = [(c + 9 * r, c, r, cats.get((c, r), 10)) for c in range(9) for r in range(9)]
    make = lambda rows: spark.createDataFrame(rows, "id bigint, col bigint, row bigint, cat bigint")
    hexes = make(cells)
    count = validator.rules(hexes).count()
    scores = validator.score_fixes(hexes, validator.fix_candidates(validator.rules(hexes).select("id", "code"), hexes)).collect()
    assert {"river.crossing", "river.ends"} <= {s.code for s in scores}
    for s in scores:
        after = validator.rules(make([(i, c, r, s.to_cat if i == s.id else k) for i, c, r, k in cells]))
        assert s.change == after.count() - count
