"""Periodic runs of words, found by Karp-Miller-Rosenberg naming.

Words get a number each; level j names the stretch of 2**j words at a place by the pair of its halves' names, so equal names
of a level mean equal words. The texts of a step stand one after the other, longest first, each closed by a word that occurs
nowhere else: no stretch of two texts is equal to another, and level j is only built over texts that can hold a run of its
periods.

A run of period q and at least 4q words holds three neighbouring places of the grid 0, q, 2q, ... whose q words equal the
next q words; two names of the level below q, one from each end, tell that. Each streak of such places is one candidate. It
is extended by less than q words to either side, by descending name levels, and kept if no divisor of q is a period too.
So all runs are found, with no hash of text and no order of suffixes.

null texts have no words; texts without words have no runs and the digest of nothing. A null doc_id leaves its text as it is.
Rows are kept as they are, repeats included, and equal rows get equal results. A text longer than a step is one step: it
takes about 4 bytes a word and level, 2 + log2(words / 4) levels, besides its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import text_steps

#: A run has at least this many words and at least this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Grid places that one vectorised step looks at.
_STEP = 1 << 18


def looped(n: int, doc_id: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words, for the tenth of the documents that are made periodic at the end; None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _levels(names: np.ndarray, reach: list[int]) -> list[np.ndarray]:
    """names[j][i] names the 2**j words from place i; level j covers the first reach[j] places, all that its texts hold."""
    out = [names]
    for j in range(1, len(reach)):
        half, below = 1 << (j - 1), out[-1][: reach[j]]
        # past the last place stands the closing word of a text, so a stretch that leaves its level is like no other
        second = np.concatenate([below[half:], np.full(min(half, len(below)), -1, below.dtype)]).astype(np.int64)
        pair = below.astype(np.int64) << 32 | (second + 1)
        _, named = np.unique(pair, return_inverse=True)
        out.append(named.astype(np.int32))
    return out


def _grid(first: int, last: int, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of the grid places below each period's limit, some periods at a time; limit[q - first]."""
    sizes = -(-limit // np.arange(first, last + 1))
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + _STEP, side="right")))
        size = sizes[lo:hi]
        q = np.repeat(np.arange(first + lo, first + hi), size)
        nth = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
        yield q, nth * q
        lo = hi


def _least_factors(top: int) -> np.ndarray:
    """The least prime factor of every number up to top; 1 of 0 and 1."""
    out = np.arange(top + 1)
    out[:1] = 1
    for p in range(2, int(top**0.5) + 1):
        if out[p] == p:
            many = out[p * p :: p]
            many[many > p] = np.minimum(many[many > p], p)
    return out


def find_runs(names: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts that stand one after the other, lengths descending, each with a closing name of its own that lengths count."""
    words = lengths - 1
    past = np.cumsum(lengths)
    least = lambda q: np.maximum(LEAST_WORDS, LEAST_PERIODS * q)  # noqa: E731  words of a run
    top = int(words.max(initial=0)) // LEAST_PERIODS
    if not top or words.max() < LEAST_WORDS:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    able = lambda q: np.concatenate([[0], past])[np.searchsorted(-words, -least(q), side="right")]  # noqa: E731  places of texts that can hold the period
    depth = top.bit_length()
    level = _levels(names, [len(names), *[int(able(np.int64(1 << j))) for j in range(1, depth)]])
    factor = _least_factors(top)
    starts, ends, periods = [], [], []

    def same(j: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the names of a level at places a and b are equal; places outside the level differ from all."""
        name = level[j]
        ok = (a >= 0) & (np.maximum(a, b) < len(name))
        out = np.zeros(len(a), dtype=bool)
        out[ok] = name[a[ok]] == name[b[ok]]
        return out

    for j in range(depth):
        first, last = 1 << j, min((2 << j) - 1, top)
        limit = able(np.arange(first, last + 1))
        for q, g in _grid(first, last, limit):
            far = q - (1 << j)
            match = same(j, g, g + q)
            at = np.flatnonzero(match)
            match[at] &= same(j, g[at] + far[at], g[at] + far[at] + q[at])
            before = np.zeros(len(match), dtype=bool)
            before[1:] = match[:-1] & (q[1:] == q[:-1])
            after = np.zeros(len(match), dtype=bool)
            after[:-1] = match[1:] & (q[1:] == q[:-1])
            opens, closes = np.flatnonzero(match & ~before), np.flatnonzero(match & ~after)
            many = closes > opens  # one match alone is too short
            opens, closes = opens[many], closes[many]
            if not len(opens):
                continue
            p = q[opens]
            lo, hi = g[opens].copy(), g[closes] + p  # words lo..hi equal those p later
            for k in range(j, -1, -1):
                more = same(k, hi, hi + p)
                hi[more] += 1 << k
                more = same(k, lo - (1 << k), lo - (1 << k) + p)
                lo[more] -= 1 << k
            hi += p
            keep = hi - lo >= least(p)
            lo, hi, p = lo[keep], hi[keep], p[keep]
            whole, left = np.ones(len(p), dtype=bool), p.copy()
            while (left > 1).any():  # p less one prime factor at a time
                part = p // factor[left]
                tail = lo + p - (1 << j)
                whole &= (left == 1) | ~(same(j, lo, lo + part) & same(j, tail, tail + part))
                left //= factor[left]
            starts.append(lo[whole])
            ends.append(hi[whole])
            periods.append(p[whole])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, periods))


def _rows(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, period, length) of the runs of each text, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number: dict[bytes, int] = {}
    put = number.setdefault
    parts = [np.fromiter((put(w, len(number)) for w in texts[i]), np.int64, len(texts[i])) for i in order]
    names = np.concatenate([x for k, part in enumerate(parts) for x in (part, np.array([len(number) + k]))]) if parts else np.zeros(0, np.int64)
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    start, end, period = find_runs(names.astype(np.int32), lengths)
    begin = np.cumsum(lengths) - lengths
    text = np.searchsorted(begin, start, side="right") - 1
    by = np.lexsort((period, start))
    start, end, period, text = start[by], end[by], period[by], text[by]
    cut = np.searchsorted(text, np.arange(len(order) + 1))  # start grows, so text does
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        own = slice(cut[k], cut[k + 1])
        out[i] = (start[own] - begin[k], period[own], (end - start)[own])
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, hi, data, off in text_steps(batch):
            raw = data.tobytes()
            texts = [raw[off[i] : off[i + 1]].split() for i in range(hi - lo)]
            for i, words in enumerate(texts):
                at = looped(len(words), ids[lo + i]) if ids[lo + i] is not None else None
                if at is not None:
                    texts[i] = [words[k] for k in at.tolist()]
            rows = []
            for words, (start, period, length) in zip(texts, _rows(texts), strict=True):
                lines = "".join(f"{s},{n},{q}\n" for s, q, n in zip(start.tolist(), period.tolist(), length.tolist(), strict=True))
                best = (None, None, None, None)
                if len(start):
                    k = int(np.lexsort((period, start, -length))[0])
                    best = (int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k]))
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, start + period, 1)
                    np.add.at(change, start + length, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                rows.append((len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), lines, b" ".join(words)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "runs", "collapsed"],
            )


def periodic_runs(documents: DataFrame) -> DataFrame:
    """Per document: n_runs; start, length, period and exponent_milli of its longest run; runs_sha256; runs, a line `start,length,period` for each; collapsed, the text with each run cut to its first period."""
    slim = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return slim.mapInArrow(_found, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, runs string, collapsed string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))
