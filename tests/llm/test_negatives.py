"""Hard negatives against a search over all pairs."""

import math
import random
import re

import numpy as np
import pytest

from terralith.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, vec string, norm int, far string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, "f") for r in rows], SCHEMA)


def brute(rows):
    """By definition; of rows with the same vec_id that of least label, then packed vector."""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        label = (label + 1) % 10 if i % 7 == 0 else label
        new = (label, np.array(ints, "<i4").tobytes(), ints)
        kept[i] = min(kept.get(i, new), new)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][2], kept[b][2], strict=False))
    out = []
    for a in kept:
        if a % 50:
            continue
        order = sorted((-score(a, b), b) for b in kept if b != a)
        for s, p in [x for x in order if kept[x[1]][0] == kept[a][0]][:5]:
            fits = [(n, b) for n, b in order if kept[b][0] != kept[a][0] and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, k + 1, b, -s, -n) for k, (n, b) in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows):
    docs = frame(spark, rows).repartition(3)
    vectors = negatives.integer_vectors(docs.selectExpr("vec_id", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label", "embedding"))
    return sorted(map(tuple, negatives.mine(vectors).collect()))


def clustered(seed, n, dim, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(clusters)] + 0.4 * rng.normal(size=dim)
        rows.append((i, int(rng.integers(4)), [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]))
    return rows


def test_all_rows_are_searched(spark, monkeypatch):
    rows = clustered(1, 900, 12)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    monkeypatch.setattr(negatives, "WAVE", 4)  # many waves, small blocks, few rows a task
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "TASK_BYTES", 4_000)
    assert mined(spark, rows) == want
    monkeypatch.setattr(negatives, "_SPARSE", 1.1)  # survivors one by one
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, 1 + i % 2, [0.5, 0.25, float(i % 5) / 8]) for i in range(1, 200)]
    rows += [(200, 1, [0.5, 0.25, 0.0])] * 3 + [(0, None, [1.0, 1.0, 1.0]), (250, 1, None), (300, 1, [None, 1.0, 1.0]), (350, 1, [nan, 1.0, 1.0]), (400, 2, [inf, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0])]
    rows += [(450, 1, [0.5]), (500, 2, []), (-50, 1, [0.4, -0.3, 0.2]), (550, 3, [0.5, 0.25, 0.25]), (601, 1, [0.5, 0.3, 0.9]), (601, 0, [0.5, 0.3, 0.9]), (600, 9, [-1.0, -1.0, -1.0])]
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_one_vector_held_by_a_third_of_all_rows(spark):
    rows = clustered(2, 300, 8)
    rows += [(1000 + i, 1 + i % 3, rows[0][2]) for i in range(150)]
    assert mined(spark, rows) == brute(rows)


def test_large_components_and_empty_tables(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.uniform(0.5, 1) * 2.0**21 for _ in range(4)]) for i in range(1, 120)]
    assert mined(spark, rows) == brute(rows)  # products beyond 53 bits
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == []
    with pytest.raises(Exception, match=re.compile("32 bits")):
        mined(spark, [(50, 1, [1e9])])


def test_brackets_hold():
    """No row whose score lies in the asked range is cut off, and far rows are."""
    rng = np.random.default_rng(7)
    x = rng.integers(-150, 150, size=(400, 16))
    x[:200] = x[:1] + rng.integers(-4, 4, size=(200, 16))
    norm = (x**2).sum(axis=1)
    space = negatives._Space(16, int(norm.max()), [(r.astype("<i4").tobytes(), int(n)) for r, n in zip(x[::9], norm[::9], strict=True)])

    class Row:
        def __init__(self, k):
            self.vec_id, self.label, self.vec = k, 0, x[k].astype("<i4").tobytes()

    wave = negatives._Wave(space, [Row(k) for k in range(40)])
    far, true = space.rows(x, norm).astype("<f4"), x[:40] @ x.T
    least, most = np.full(40, int(np.quantile(true, 0.97))), np.full(40, int(np.quantile(true, 0.99)))
    anchors, mask = wave.survivors(np.arange(40), far, least, most)
    held = np.zeros(true.shape, bool)
    held[anchors] = mask
    wanted = (true >= least[:, None]) & (true <= most[:, None])
    assert not (wanted & ~held).any() and held.mean() < 0.9
