"""Binary layouts and trees against plain readers and recursion."""

import random

import pytest

from terralith.operators import tree
from terralith.sources import layouts

KINDS = {3: [("id", "i"), ("name", "s"), ("note", "o")], 0: [("id", "i"), ("ok", "b")]}


def test_tables_with_and_without_markers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    rows = [(1, "é", None), (-5, "", "n"), (7, "x" * 300, "")]
    (tmp_path / "t" / "a.bin").write_bytes(layouts.encode_db(rows, "iso", 3, name="some-id"))
    (tmp_path / "t" / "b.bin").write_bytes(layouts.encode_db(rows[:1], "iso", 3))
    (tmp_path / "t" / "c.bin").write_bytes(layouts.encode_db([(9, True)], "ib"))  # no version: 0
    (tmp_path / "t" / "d.bin").write_bytes(layouts.encode_db([], "iso", 3))
    got = sorted((r.path[-5:], r.version, r.ordinal, r.id, r.name, r.note, r.ok) for r in layouts.read_db(spark, str(tmp_path / "t"), KINDS).collect())
    assert got == [("a.bin", 3, 0, 1, "é", "", None), ("a.bin", 3, 1, -5, "", "n", None), ("a.bin", 3, 2, 7, "x" * 300, "", None), ("b.bin", 3, 0, 1, "é", "", None), ("c.bin", 0, 0, 9, None, None, True)]


def test_broken_tables_are_errors():
    raw = layouts.encode_db([(1, "abc", "d"), (2, "ef", None)], "iso", 3)
    for cut in range(13, len(raw)):
        with pytest.raises(ValueError, match="ends within row"):
            layouts.decode_db(raw[:cut], KINDS)
    with pytest.raises(ValueError, match="1 bytes left after 2 rows"):
        layouts.decode_db(raw + b"x", KINDS)
    with pytest.raises(ValueError, match="unknown table version 9"):
        layouts.decode_db(layouts.encode_db([], "i", 9), KINDS)


@pytest.mark.parametrize(("magic", "stamped", "needs"), [("PFH5", False, ()), ("PFH4", True, ("one.pack", "two.pack")), ("PFH5", True, ("b.pack",))])
def test_packs(spark, magic, stamped, needs):
    members = [("A/b.txt", b"one"), ("c", b""), ("a\\B.TXT", b"later"), ("d/é.bin", bytes(range(256)))]
    raw = layouts.encode_pack(members, magic, stamped, needs)
    assert [(p, raw[o : o + n]) for p, o, n, _ in layouts.pack_index(raw)] == members
    files = spark.createDataFrame([("p", bytearray(raw)), ("q", bytearray(layouts.encode_pack([], magic)))], "path string, content binary")
    got = {r.key: (r.nth, r.path, bytes(r.content)) for r in layouts.pack_members(files, content=True).collect()}
    assert got == {"a\\b.txt": (2, "a\\B.TXT", b"later"), "c": (1, "c", b""), "d\\é.bin": (3, "d/é.bin", bytes(range(256)))}
    with pytest.raises(ValueError, match="not a pack"):
        list(layouts.pack_index(b"PK12" + raw[4:]))
    with pytest.raises(ValueError, match="encrypted"):
        list(layouts.pack_index(raw[:4] + b"\x83" + raw[5:]))


def test_merged_packs(spark):
    frame = lambda rows: spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    base = frame([("terrain/old/a", b"1"), ("terrain/old/b", b"2"), ("terrain/older/c", b"3"), ("x", b"4")])
    over = frame([("Terrain\\Old\\B", b"new"), ("y", b"5")])
    assert {r.key: r.status for r in layouts.merge_members(base, over, ["terrain/old/"]).collect()} == {"terrain\\old\\a": "dropped", "terrain\\old\\b": "replaced", "terrain\\older\\c": "kept", "x": "kept", "y": "added"}
    assert {r.key: bytes(r.content) for r in layouts.merge_packs(base, over, ["terrain\\old"]).collect()} == {"terrain\\old\\b": b"new", "terrain\\older\\c": b"3", "x": b"4", "y": b"5"}


def test_scan_of_unknown_tables(spark, tmp_path):
    rows = [("k1", "land_siege", True, "terrain\\battles\\one\\", "tail"), ("k2", "Bad", False, "terrain\\battles\\two\\", ""), ("k3", "ambush", False, "TERRAIN\\Battles\\three\\", "terrain\\battles\\ without length")]
    raw = layouts.encode_db(rows, "ssbss", 11)
    want = [("terrain\\battles\\one\\", "land_siege"), ("TERRAIN\\Battles\\three\\", "ambush")]
    assert list(layouts.scan_pairs(raw)) == want
    assert list(layouts.scan_pairs(b"")) == list(layouts.scan_pairs(b"terrain\\battles\\")) == []
    end = raw.index(b"three") + 3
    assert list(layouts.scan_pairs(raw[:end])) == want[:1]  # the last path is cut
    (tmp_path / "one").write_bytes(raw)
    (tmp_path / "two").write_bytes(raw[:end])
    got = layouts.scan_files(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted((r.path[-3:], r.map_path, r.type) for r in got.collect()) == sorted([("one", *w) for w in want] + [("two", *want[0])])


def recursive(nodes):
    """{id: (start, end, depth)} by a plain walk."""
    below, out, at = {}, {}, 0
    for i, parent, ordinal in nodes:
        below.setdefault(parent, []).append((ordinal, i))
    todo = [(i, 0, True) for _, i in sorted(below.get(None, []), reverse=True)]
    while todo:
        i, depth, enter = todo.pop()
        if enter:
            out[i] = [at, None, depth]
            todo.append((i, depth, False))
            todo += [(k, depth + 1, True) for _, k in sorted(below.get(i, []), reverse=True)]
        else:
            out[i][1] = at
        at += 1
    return {i: tuple(v) for i, v in out.items()}


def test_tree_labels_and_axes(spark):
    rng = random.Random(3)
    nodes = [(0, None, 5), (1, None, 2)] + [(i, rng.randrange(i), rng.randrange(50)) for i in range(2, 120)]
    nodes += [(200 + i, 199 + i if i else 1, 0) for i in range(300)]  # a deep chain
    lost = [(900, 901, 0), (901, 900, 0), (902, 901, 0), (903, 999, 0)]  # a cycle, what hangs from it, and an orphan
    table = spark.createDataFrame(nodes + lost, "id bigint, parent bigint, ordinal bigint").repartition(3)
    known = tree.labels(table)
    want = recursive(nodes)
    assert {r.id: (r.start, r.end, r.depth) for r in known.collect()} == want
    parent = {i: p for i, p, _ in nodes}
    pairs = set()
    for i in parent:
        up = parent[i]
        while up is not None:
            if up % 3 == 0 and i % 2 == 0:
                pairs.add((up, i))
            up = parent[up]
    got = [tuple(r) for r in tree.descendants(known.filter("id % 3 = 0"), known.filter("id % 2 = 0")).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {tuple(r) for r in tree.children(table.filter("id = 0"), table).collect()} == {(0, i) for i, p, _ in nodes if p == 0}
    assert tree.labels(table.limit(0)).count() == 0
