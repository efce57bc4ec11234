"""Hard negatives by a pivot table.

Vectors of integers are augmented so that inner products become distances: with M the largest norm, a row x becomes
(x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0), and then d^2 = M^2 + |q|^2 - 2 q.x. The pivot table holds each row's
distances to PIVOTS rows of a bounded sample. By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), so
each pivot brackets the score, first for a whole block of rows from the block's least and greatest distances, then for each
row. What the brackets leave is scored exactly, in integers. The table is ordered by label, nearest pivot and distance, which
keeps blocks narrow; the sample only chooses pivots, every row is in the table, and nothing is approximate.

Anchors go over the table in waves of bounded size. A task keeps the best rows of each anchor so far, which raises the floor
that a bracket must reach; tasks' lists meet by anchor. The first pass of a wave finds positives among blocks of the anchor's
label, the second negatives within the score window of each positive.

Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; shorter vectors count as followed
by zeros. Of rows with the same vec_id that of least label, then vector, stays. Equal scores go by vec_id. Components beyond
32 bits, or norms whose products pass 63 bits, are an error. Without anchors, positives or rows in a window there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import columns, drop_scratch, materialize, scratch
from terralith.operators.ranks import ranked

PIVOTS = 12
#: Rows that pivots are chosen from: those of least hash of the identifier.
SAMPLE = 2_048
#: Rows of a block, anchors of a wave at most, and bytes of a wave's vectors at most.
BLOCK = 2_048
WAVE = 8_192
WAVE_BYTES = 16 << 20
#: Bytes of the pivot table that one task reads.
TASK_BYTES = 64 << 20
POSITIVES = 5
NEGATIVES = 3
#: Percent of a positive's score that a negative's must reach and must not pass.
FROM, TO = 50, 95
#: Survivors' share of a block below which they are gathered one by one.
_SPARSE = 0.05


def _integers(scale: int):
    """vec_id, label, vec and norm of the rows that take part: components floor(scale * x) as 32-bit integers, squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            at = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1].astype(np.int64) if len(vectors) else np.zeros(1, np.int64)
            values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            with np.errstate(invalid="ignore", over="ignore"):
                values = np.floor(scale * values)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            whole = (bad[at[1:]] == bad[at[:-1]]) & ~(ids.is_null().to_numpy(False) | labels.is_null().to_numpy(False) | vectors.is_null().to_numpy(False))
            values[~np.isfinite(values)] = 0
            rows = np.flatnonzero(whole)
            large = np.concatenate([[0], np.cumsum(np.abs(values) >= 2**31)])
            if (large[at[rows + 1]] > large[at[rows]]).any():
                raise ValueError("a component has more than 32 bits")
            values = np.clip(values, -(2**31), 2**31 - 1).astype("<i4")
            norms = [int(np.dot(v, v)) if np.abs(v).max(initial=0) < 2**20 else sum(int(c) ** 2 for c in v.tolist()) for v in (values[at[r] : at[r + 1]].astype(np.int64) for r in rows)]
            if max(norms, default=0) >= 2**62:
                raise ValueError("a norm is too large for inner products of 63 bits")
            keep = pa.array(rows)
            packed = [values[at[r] : at[r + 1]].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([ids.take(keep), labels.take(keep), pa.array(packed, pa.binary()), pa.array(norms, pa.int64())], names=["vec_id", "label", "vec", "norm"])

    return run


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vec and norm of embeddings (vec_id, label, embedding), one row a vec_id."""
    rows = embeddings.select(F.col("`vec_id`").cast("bigint").alias("vec_id"), F.col("`label`").cast("bigint").alias("label"), F.col("`embedding`").cast("array<double>").alias("embedding"))
    found = materialize(rows.mapInArrow(_integers(scale), "vec_id bigint, label bigint, vec binary, norm bigint"), "vector")
    if found.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return found
    one = materialize(found.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "norm")).alias("r")).select("vec_id", "r.label", "r.vec", "r.norm"), "vector")
    drop_scratch(found)
    return one


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    """Rows of packed integers as a matrix, shorter ones filled with zeros."""
    parts = packed.to_pylist() if isinstance(packed, pa.Array) else packed
    out = np.zeros((len(parts), dim), dtype=np.int64)
    if all(len(p) == 4 * dim for p in parts):
        return np.frombuffer(b"".join(parts), "<i4").reshape(len(parts), dim).astype(np.int64)
    for row, p in zip(out, parts, strict=True):
        row[: len(p) // 4] = np.frombuffer(p, "<i4")
    return out


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, both with their added coordinate."""
    out = np.empty((len(x), len(pivots)))
    for j, (p, up) in enumerate(zip(pivots, pivot_lift, strict=True)):
        out[:, j] = np.sqrt(((x - p).astype(np.float64) ** 2).sum(axis=1) + (lift - up) ** 2)
    return out


def choose_pivots(x: np.ndarray, lift: np.ndarray, k: int) -> list[int]:
    """Rows that lie far apart: each next one is farthest from those chosen."""
    out = [int(np.argmax(lift))] if len(x) else []
    near = np.full(len(x), np.inf)
    while out and len(out) < k:
        near = np.minimum(near, _distances(x, lift, x[out[-1:]], lift[out[-1:]])[:, 0])
        if near.max() <= 0:
            break
        out.append(int(np.argmax(near)))
    return out


class _Space:
    """What all tasks know: dimension, largest squared norm and the pivots."""

    def __init__(self, dim: int, top: int, sample: list[tuple[bytes, int]]):
        self.dim, self.top = dim, top
        x = _matrix([v for v, _ in sample], dim)
        lift = np.sqrt(np.array([float(top - n) for _, n in sample]))
        chosen = choose_pivots(x, lift, PIVOTS)
        self.pivots, self.pivot_lift = x[chosen], lift[chosen]

    def rows(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return _distances(x, np.sqrt((self.top - norm).astype(np.float64)), self.pivots, self.pivot_lift)

    def anchors(self, q: np.ndarray) -> np.ndarray:
        return _distances(q, np.zeros(len(q)), self.pivots, self.pivot_lift)

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where no partial sum can pass 53 bits, else in 64-bit integers."""
        if self.top < 1 << 52:
            return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        return q @ x.T


def _table_rows(space: _Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norm = _matrix(batch.column(2), space.dim), batch.column(3).to_numpy()
            far = space.rows(x, norm).astype("<f4")
            packed = x.astype("<i4")
            cols = [pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, pa.array(far.argmin(axis=1), pa.int32()), pa.array(far.min(axis=1), pa.float32())], names=["vec_id", "label", "vec", "far", "cell", "near"])

    return run


_NONE = np.iinfo(np.int64).min


class _Best:
    """The best k (score, id) of each of some lists, higher scores first, then smaller ids."""

    def __init__(self, lists: int, k: int):
        self.score = np.full((lists, k), _NONE)
        self.id = np.full((lists, k), np.iinfo(np.int64).max)

    @property
    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows of scores for the lists given; _NONE is no candidate; ids of the columns, ascending. scores is used up."""
        k = self.score.shape[1]
        got, of = [], []
        at = np.arange(len(lists))
        for _ in range(min(k, scores.shape[1])):
            j = scores.argmax(axis=1)  # the first of equals, that of smallest id
            got.append(scores[at, j])
            of.append(np.where(got[-1] > _NONE, ids[j], np.iinfo(np.int64).max))
            scores[at, j] = _NONE
        score = np.concatenate([self.score[lists], np.stack(got, axis=1)], axis=1)
        who = np.concatenate([self.id[lists], np.stack(of, axis=1)], axis=1)
        order = np.lexsort((who, ~score), axis=1)[:, :k]  # ~s falls as s rises, without overflow
        self.score[lists] = np.take_along_axis(score, order, axis=1)
        self.id[lists] = np.take_along_axis(who, order, axis=1)


class _Wave:
    """Anchors of one pass over the table, with the scores that a row must have to be of use to them."""

    def __init__(self, space: _Space, rows: list):
        self.space = space
        self.id = np.array([r.vec_id for r in rows], dtype=np.int64)
        self.label = np.array([r.label for r in rows], dtype=np.int64)
        self.q = _matrix([r.vec for r in rows], space.dim)
        self.base = space.top + (self.q.astype(np.float64) ** 2).sum(axis=1)
        self.slack = 1 + 4e-6 * self.base  # of distances kept in 32 bits
        self.far = space.anchors(self.q).astype(np.float32)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, matrix, distances) of blocks of the table, by id."""
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                far = np.frombuffer(b"".join(part.column(3).to_pylist()), "<f4").reshape(len(ids), -1)
                yield ids[order], part.column(1).to_numpy()[order], _matrix(part.column(2), self.space.dim)[order], far[order]

    def survivors(self, anchors: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchors for which some row of the block may score from least to most, and a mask of those rows; least and most for each anchor."""
        lo, hi = far.min(axis=0), far.max(axis=0)
        own = self.far[anchors]
        nearest = np.maximum(np.maximum(lo - own, own - hi), 0).max(axis=1, initial=0).astype(np.float64)
        farthest = (own + hi).min(axis=1, initial=np.inf).astype(np.float64)
        base, slack = self.base[anchors], self.slack[anchors]
        some = ((base - nearest**2) / 2 + slack >= least) & ((base - farthest**2) / 2 - slack <= most)
        anchors, own, base, slack, least, most = anchors[some], own[some], base[some], slack[some], least[some], most[some]
        near = np.zeros((len(anchors), len(far)), np.float32)
        away = np.full((len(anchors), len(far)), np.inf, np.float32)
        for j in range(far.shape[1]):
            np.maximum(near, np.abs(own[:, j, None] - far[None, :, j]), out=near)
            np.minimum(away, own[:, j, None] + far[None, :, j], out=away)
        # the bracket of scores, as one of distances
        reach = np.sqrt(np.maximum(base + 2 * slack - 2 * least.astype(np.float64), 0)).astype(np.float32) * np.float32(1 + 1e-6)
        short = np.sqrt(np.maximum(base - 2 * slack - 2 * most.astype(np.float64), 0)).astype(np.float32) * np.float32(1 - 1e-6)
        mask = (near <= reach[:, None]) & (away >= short[:, None])
        some = mask.any(axis=1)
        return anchors[some], mask[some]

    def exact(self, anchors: np.ndarray, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The scores that the mask leaves, exactly; _NONE for the others."""
        if mask.mean() < _SPARSE:
            out = np.full(mask.shape, _NONE)
            a, r = np.nonzero(mask)
            for lo in range(0, len(a), 1 << 15):
                part = slice(lo, lo + (1 << 15))
                out[a[part], r[part]] = (self.q[anchors[a[part]]] * x[r[part]]).sum(axis=1)
            return out
        return np.where(mask, self.space.scores(self.q[anchors], x), _NONE)


def _positives(wave: _Wave):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(wave.id), POSITIVES)
        most = np.full(len(wave.id), np.iinfo(np.int64).max)
        of = {label: np.flatnonzero(wave.label == label) for label in np.unique(wave.label)}
        for ids, labels, x, far in wave.blocks(batches):
            for label in np.unique(labels):
                if label not in of:
                    continue
                rows = np.flatnonzero(labels == label)
                anchors, mask = wave.survivors(of[label], far[rows], best.floor[of[label]], most[of[label]])
                mask &= ids[rows][None, :] != wave.id[anchors][:, None]
                if len(anchors):
                    best.add(anchors, wave.exact(anchors, x[rows], mask), ids[rows])
        a, k = np.nonzero(best.score > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(wave.id[a]), pa.array(best.id[a, k]), pa.array(best.score[a, k])], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(wave: _Wave, positive: np.ndarray, score: np.ndarray, known: np.ndarray):
    """positive, score and known: arrays with POSITIVES columns, a row for each anchor."""
    whole, part = np.divmod(score, 100)  # percents without overflow
    low, high = FROM * whole - (-FROM * part) // 100, TO * whole + TO * part // 100
    open_ = known & (low <= high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(wave.id)
        best = [_Best(n, NEGATIVES) for _ in range(POSITIVES)]
        far_off = np.iinfo(np.int64).max
        most = np.where(open_, high, _NONE + 1).max(axis=1)
        some = np.flatnonzero(open_.any(axis=1))
        for ids, labels, x, far in wave.blocks(batches):
            floor = np.stack([np.maximum(low[:, i], best[i].floor) for i in range(POSITIVES)], axis=1)
            least = np.where(open_, floor, far_off).min(axis=1)
            anchors, mask = wave.survivors(some, far, least[some], most[some])
            mask &= labels[None, :] != wave.label[anchors][:, None]
            if not len(anchors):
                continue
            scores = wave.exact(anchors, x, mask)
            for i in range(POSITIVES):
                fits = (scores >= floor[anchors, i][:, None]) & (scores <= high[anchors, i][:, None])
                use = np.flatnonzero(fits.any(axis=1) & open_[anchors, i])
                if len(use):
                    best[i].add(anchors[use], np.where(fits[use], scores[use], _NONE), ids)
        for i in range(POSITIVES):
            a, k = np.nonzero(best[i].score > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (wave.id[a], positive[a, i], best[i].id[a, k], score[a, i], best[i].score[a, k])], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def _first(rows: DataFrame, keys: list[str], score: str, who: str, k: int) -> DataFrame:
    """The first k rows of each key with their rank; tasks have at most k rows of a key each."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), who)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def pivot_table(vectors: DataFrame) -> tuple[DataFrame, _Space] | None:
    """The table of (vec_id, label, vec, far, cell, near), ordered by label, cell and distance, and its space; None without rows."""
    spark = vectors.sparkSession
    n, top, dim = vectors.agg(F.count("*"), F.max("norm"), F.max(F.length("vec"))).first()
    if not n:
        return None
    dim //= 4
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec", "norm").collect()
    space = _Space(dim, top, [(bytes(v), k) for v, k in sample])
    rows = vectors.mapInArrow(_table_rows(space), "vec_id bigint, label bigint, vec binary, far binary, cell int, near float")
    parts = max(spark.sparkContext.defaultParallelism, n * 4 * (dim + PIVOTS) // TASK_BYTES + 1)
    order = ["label", "cell", "near", "vec_id"]  # vec_id parts equal vectors over tasks
    return materialize(rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order), "pivots"), space


def mine(vectors: DataFrame, every: int = 50) -> DataFrame:
    """For each anchor (vec_id divisible by every) and each of its first POSITIVES rows of the same label, the first NEGATIVES rows of another label whose score is FROM to TO percent of the positive's."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    made = pivot_table(vectors)
    if made is None:
        return out
    table, space = made
    scan = columns(table, "vec_id", "label", "vec", "far")
    anchors = materialize(ranked(columns(vectors.filter(F.col("vec_id") % every == 0), "vec_id", "label", "vec"), "vec_id", name="nth"), "anchor")
    n, size, path = anchors.count(), max(1, min(WAVE, WAVE_BYTES // (4 * max(space.dim, 1)))), scratch(spark, "negative")
    for lo in range(0, n, size):
        rows = anchors.filter((F.col("nth") >= lo) & (F.col("nth") < lo + size)).collect()  # at most WAVE short rows
        wave = _Wave(space, rows)
        near = scan.mapInArrow(_positives(wave), "anchor_id bigint, positive_id bigint, positive_score bigint")
        chosen = _first(near, ["anchor_id"], "positive_score", "positive_id", POSITIVES).collect()  # POSITIVES a row of the wave
        place = {int(a): k for k, a in enumerate(wave.id)}
        positive, score, known = np.zeros((len(rows), POSITIVES), np.int64), np.zeros((len(rows), POSITIVES), np.int64), np.zeros((len(rows), POSITIVES), bool)
        for r in chosen:
            at = place[r.anchor_id], r.rank - 1
            positive[at], score[at], known[at] = r.positive_id, r.positive_score, True
        found = scan.mapInArrow(_negatives(wave, positive, score, known), "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
        best = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
        best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    drop_scratch(table, anchors)
    return spark.read.schema(SCHEMA).parquet(path) if n else out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("`vec_id`") % 7 == 0, (F.col("`label`") + 1) % 10).otherwise(F.col("`label`"))
    return mine(integer_vectors(rows.select("`vec_id`", label.alias("label"), "`embedding`")))


OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
