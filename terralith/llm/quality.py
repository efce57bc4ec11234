"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table per feature, over quantile bins, and then one per chosen pair of
features, over coarse bins of the residual. A score is the logistic of a sum of table entries, added for all documents of
a batch at once. Features are read from the bytes of the whole text; labels, lang, source and doc_id are none.

The model is fitted on at most `MAX_TRAIN` labelled documents, those of least xxhash64(doc_id) among the rows whose
crc32(doc_id as text) mod 5 is not 0. Without labels of both kinds the score is the smoothed share of label 1.

null text is an empty text, and is scored. Repeated rows are scored alike; in training they count once. A document with two
labels counts once for each. A text longer than a step is one step, at some 40 bytes of a worker a byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import _LOWER, span_hashes, text_steps, words_of

MAX_TRAIN = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 40, 0.15, 4.0

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:", "call": b"!", "ask": b"?", "bar": b"|", "symbol": b"*$%#&^~@=+_\\/<>", "bracket": b"()[]{}", "quote": b"'\"`-"}
_CLASS = np.full(256, len(_KINDS), dtype=np.uint8)
for _k, _chars in enumerate(_KINDS.values()):
    _CLASS[list(_chars)] = _k
_CLASS[:32] = np.where(_CLASS[:32] == len(_KINDS), len(_KINDS) + 1, _CLASS[:32])
_N_CLASS = len(_KINDS) + 2
NAMES = [*_KINDS, "high", "control", "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "log_lines", "line_words", "distinct_lines", "stop_words", "odd_ends", "caps_words"]


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct values, and how often the commonest occurs."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n)
    np.maximum.at(most, row[at], np.diff(np.append(at, len(row))))
    return np.bincount(row[at], minlength=n), most


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(off) - 1
    size = np.diff(off)
    of = np.repeat(np.arange(n), size)
    count = np.bincount(of * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
    share = count / np.maximum(size, 1)[:, None]
    start, end, row = words_of(data, off)
    words = np.bincount(row, minlength=n)
    per_word = np.maximum(words, 1)
    distinct, top = _distinct(row, span_hashes(_LOWER[data], start, end), n) if len(start) else (np.zeros(n), np.zeros(n))
    line = (data == 0x0A) | (data == 0x0D)
    edge = line.copy()
    ls = np.zeros(len(data), dtype=bool)
    if len(data):
        ls[1:] = edge[:-1]
        ls[off[:-1][size > 0]] = True
        ls &= ~edge
    l_start = np.flatnonzero(ls)
    stops = np.zeros(len(data) + 1, dtype=bool)
    stops[: len(data)] = edge
    stops[off[1:]] = True
    marks = np.flatnonzero(stops)
    l_end = marks[np.searchsorted(marks, l_start, side="right")] if len(l_start) else l_start
    l_row = np.searchsorted(off, l_start, side="right") - 1
    lines = np.bincount(l_row, minlength=n)
    d_lines = _distinct(l_row, span_hashes(data, l_start, l_end), n)[0] if len(l_start) else np.zeros(n)
    ends = _CLASS[data[end - 1]] if len(end) else np.zeros(0, np.uint8)
    names = list(_KINDS)
    odd = np.bincount(row[np.isin(ends, [names.index(k) for k in ("symbol", "bar", "call", "ask", "bracket")])], minlength=n)
    caps = np.bincount(row[(end - start > 1) & (_CLASS[data[start]] == 0) & (_CLASS[data[np.minimum(start + 1, max(len(data) - 1, 0))]] == 0)], minlength=n) if len(start) else np.zeros(n)
    more = [np.log1p(size), np.log1p(words), np.where(words, (end - start).sum() and np.bincount(row, weights=(end - start), minlength=n) / per_word, 0), distinct / per_word, top / per_word, np.log1p(lines), words / np.maximum(lines, 1), d_lines / np.maximum(lines, 1), count[:, names.index("stop")] / per_word, odd / per_word, caps / per_word]
    return np.column_stack([share, *more])


@dataclass
class Gam:
    """Bin edges and lookup tables; bins are numbers of edges at most the value."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        for a, b, ea, eb, table in self.pairs:
            z += table[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-z))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _shallow(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of at most 2**depth leaves over ordered bins with gradient and curvature sums; the leaf value of each bin."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
            return np.concatenate([_shallow(g[:cut], h[:cut], depth - 1), _shallow(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + RIDGE))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes: its gain and the value of each cell."""
    gc, hc = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))

    def parts(c):
        inner = c[1:-1, 1:-1]
        return inner, c[1:-1, -1:] - inner, c[-1:, 1:-1] - inner, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + inner

    pg, ph = parts(gc), parts(hc)
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(pg, ph, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(pg, ph, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + RIDGE)), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learns the tables; deterministic."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Gam(base=float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_quantiles(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[k])
            step = RATE * _shallow(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[k] += step
            z += step[b]
    coarse = [_quantiles(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        na, nb = len(coarse[a]) + 1, len(coarse[b]) + 1
        at = cells[a] * nb + cells[b]
        g, h = slopes()
        return np.bincount(at, g, na * nb).reshape(na, nb), np.bincount(at, h, na * nb).reshape(na, nb)

    ranked = sorted(((_quadrants(*sums(a, b))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for a, b, _, _, table in model.pairs:
            step = RATE * _quadrants(*sums(a, b))[1]
            table += step
            z += step[cells[a], cells[b]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_steps(batch):
            x = features(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Gam:
    """Fits the model on at most `most` labelled documents and rows of features (about 300 bytes each reach the driver)."""
    known = labels.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`quality`").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    docs = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    picked = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_features, "doc_id bigint, x array<double>")
    # rows that are alike count once, so that a repeated doc_id doesn't pass the bound
    rows = picked.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "x").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("x")).limit(most).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    if not rows:
        return Gam()
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows], dtype=float))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_steps(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.value.score(features(data, off)))], names=["doc_id", "score"])

    return run


def score(documents: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; held_out is false for a missing doc_id."""
    docs = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = docs.mapInArrow(_scored(shared), "doc_id bigint, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _passing(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.value.score(features(data, off)) >= THRESHOLD for _, _, data, off in text_steps(batch)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return run


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents that the model accepts; all columns and their order stay."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    return documents.mapInArrow(_passing(model), documents.schema)


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def crc_fold(doc_id: int) -> int:
    """The fold of a document; fold 0 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 5
