"""The mix against a serial form: water-filling by rounds, prefixes of the hash order."""

import hashlib
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from terralith.llm import common, mixture

SCHEMA = "doc_id bigint, text string, source string, size int, target int, copies string, `_row` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], SCHEMA)


def brute(rows):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)) for d, t, s in rows]
    names = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(n for _, z, n, _ in sized if z == s) for s in names}
    total, full, goal = sum(size.values()), set(), {}
    while True:  # shares of what the full sources leave, by weight
        free = total - sum(3 * size[s] for s in full)
        units = sum(weight[s] for s in names if s not in full)
        goal = {s: Fraction(3 * size[s]) if s in full else Fraction(free * weight[s], units) for s in names}
        new = {s for s in names if s not in full and goal[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    out = []
    for s in names:
        copies = min(3, goal[s] // size[s]) if size[s] else 0
        rest = goal[s] - copies * size[s]
        upto = 0
        for h in sorted({h for _, z, _, h in sized if z == s}):
            group = [(d, n) for d, z, n, x in sized if z == s and x == h]
            own = sum(n for _, n in group)
            once = 2 * upto + own < 2 * rest
            upto += own
            out += [(d, n, size[s], float(goal[s]), n * int(copies + once)) for d, n in group]
    return out


def agrees(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(got, want, strict=True))


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["a", "B", "é", "", "b", None, "zz", "src 1"]
    rows = []
    for i in range(n):
        s = rng.choices(names, weights=[1, 60, 3, 20, 1, 9, 5, 1])[0]
        rows.append((i, rng.choice([" ", "", "\n"]) + " ".join(rng.choices(["x", "yy", "é\x1fz"], k=rng.randint(0, 40))), s))
    return rows


def test_mix_is_the_serial_form(spark):
    rows = corpus(5)
    rows += [(900, None, "B"), (901, "", None), (902, " \t\r\n\x0b\x0c", "a"), (None, "one two", "B"), (None, "one two", "B"), (7, "x y", "B"), (903, "w " * 5000, "only"), (904, "", "empty")]
    rows += [(950, "same text here", "B")] * 30
    docs = frame(spark, rows).repartition(3)
    first = mixture.mix(docs).collect()
    agrees(first, brute(rows))
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, mixture.mix(docs.repartition(5)).collect()), key=str)  # reruns agree
    taken = {}
    for r in first:
        assert 0 <= r.taken <= 3 * r.size
        taken[(r.source_size, r.target)] = taken.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(t - goal) <= 2500 for (_, goal), t in taken.items())


def test_small_and_empty_tables(spark):
    agrees(mixture.mix(frame(spark, [(1, "a b c", "s")])).collect(), brute([(1, "a b c", "s")]))
    agrees(mixture.mix(frame(spark, [(1, "", "s"), (2, None, None)])).collect(), [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])
    assert mixture.mix(frame(spark, [(1, "a", "s")]).limit(0)).count() == 0


def test_boundary_buckets_are_opened_to_one_hash(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 3), "s" if i % 4 else "t") for i in range(3000)]
    monkeypatch.setattr(mixture, "STEP_BITS", 4)
    agrees(mixture.mix(frame(spark, rows)).collect(), brute(rows))


def test_many_sources_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = corpus(8, 300) + [(1000 + i, "a b", f"s{i}") for i in range(60)]
    agrees(mixture.mix(frame(spark, rows)).collect(), brute(rows))


def test_drawn_holds_what_mix_takes(spark):
    rows = corpus(11)
    docs = frame(spark, rows)
    out = mixture.drawn(docs)
    assert out.columns == [*docs.columns, "copy"]
    times = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(r.taken == r.size * times.get(r.doc_id, 0) for r in mixture.mix(docs).collect())
    assert out.filter("size <> 1 or copies <> 'c' or _row <> 3").count() == 0
