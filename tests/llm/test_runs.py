"""Periodic runs against a form that tries every period at every word."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terralith.llm import runs

_W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of all runs by definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            smallest = all(any(words[k] != words[k + d] for k in range(s, s + length - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = _W.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def found(texts):
    return [sorted(zip(s.tolist(), n.tolist(), q.tolist(), strict=True), key=lambda r: (r[0], r[2])) for s, q, n in runs._rows([[w.encode() for w in t] for t in texts])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=5))
def test_small_alphabet(texts):
    assert found(texts) == [brute(t) for t in texts]


def test_built_texts():
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(0, 5)):
            block = rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 5, 7, 8, 12, 31, 32, 33]))
            text += (block * 9)[: rng.randint(1, 9 * len(block))] + rng.choices("abcdefgh", k=rng.randint(0, 9))
        texts.append(text)
    nested = (["a"] * 7 + ["b"]) * 5
    texts += [nested, nested * 4, ["x"] * 5, ["x"] * 6, ["x"] * 400, list("ab") * 4, list("ab") * 3 + ["a"], []]
    assert found(texts) == [brute(t) for t in texts]


def test_neighbouring_texts_do_not_join():
    assert found([["x"] * 5, ["x"] * 5, ["x"] * 5]) == [[], [], []]
    assert found([list("ab") * 4, list("ab") * 4]) == [[(0, 8, 2)]] * 2


def test_query_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["a", "b", "ccc", "é"], k=rng.randint(0, 50)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (None, "x x x x x x x"), (503, "a\tb\n" * 30), (503, "a\tb\n" * 30), (504, "no-break space \x1f " * 8), (2**40, "y " * 300)]
    docs = spark.createDataFrame([(*r, "e", "n", 0) for r in rows], "doc_id bigint, text string, `runs` string, `collapsed` string, n_runs int").repartition(3)
    out = runs.periodic_runs(docs)
    from pyspark.sql import functions as F

    got = [tuple(r) for r in out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256)).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_long_texts_are_near_linear():
    took = []
    for n in (20_000, 80_000):
        rng = random.Random(n)
        texts = [["x"] * n, (rng.choices("abcd", k=n // 7) * 8)[:n], [str(rng.randrange(n)) for _ in range(n)]]
        began = time.process_time()
        out = found(texts)
        took.append(time.process_time() - began)
        assert out[0] == [(0, n, 1)] and out[1][-1][2] <= n // 7
    assert took[1] < 12 * max(took[0], 0.1)


def test_looped_follows_the_rule():
    for doc_id in range(2000):
        n = 1 + doc_id % 37
        at = runs.looped(n, doc_id)
        h = zlib.crc32(str(doc_id).encode())
        assert (at is None) == (h % 10 != 0)
        if at is not None:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert at.tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert runs.looped(0, 7) is None and isinstance(runs._least_factors(50), np.ndarray)
    assert runs._least_factors(50)[[2, 9, 15, 49, 47]].tolist() == [2, 3, 3, 7, 47]
