"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with the same shingle set are one class, named by a 128-bit digest of the set; only classes are compared.
A class keeps its shingles in one global order, rare ones first, and shows only a prefix: two classes that link share
a prefix shingle. Frequencies come from all documents by a counting sketch of fixed size; any fixed order gives right
results, a coarse count only makes the order less sharp.

1. one pass: set size, digest and bin histogram of each document, and the sketch
2. one pass: prefix shingles, packed by hash range; each range is sorted in one task. Shingles above `HOT` in the
   sketch are dealt over several ranges
3. round A joins neighbours in the (size, class) order of each shared prefix shingle, keeps one partner per class,
   verifies it once, and contracts components: large groups of copies collapse here, with one check per class
4. round B takes, for each prefix shingle, all remaining pairs between different components that pass the length and
   positional filters. Shingles of at most `GROUP` classes join rows, then come the suffix filter (bin histograms bound
   the symmetric difference) and the exact check. Larger ones are cut into blocks of bounded size, and a task takes two
   blocks, keeps pairs that share no earlier prefix shingle, counts their overlaps at once and returns a forest of links

So every link between different texts counts for the components, while pairs inside a component are never listed.

No task holds a large group: rows of a class with many copies, of a component's centre and of a common shingle are dealt
over parts.

Rows: null or blank text has no shingles and links to nothing; repeated rows of a document stay rows. A row without doc_id
links as others do; its component_id is the least doc_id reached, null if there is none. Columns other than doc_id and text
are not looked at. A text is as long as a row may be; one above a step is a step of its own, at some 100 bytes a byte.
Classes are known by 64 bits of their digest only inside round A and the entries, where both of two such classes keep theirs.
Words are hashed by a key drawn for each run; classes and links of sets of at most `FEW` shingles, which few equal hashes
could feign, are made sure of on the shingles' bytes.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import binary_column, columns, drop_scratch, hot_keys, materialize, mix, salted_join, shingle_hashes, text_steps
from terralith.llm.components import components

WIDTH = 5
#: The similarity threshold is NUM / DEN.
NUM, DEN = 3, 4
SKETCH_BITS = 20
SLICES = 64
BINS = 64
#: Prefix entries that one range of shingles holds on average, and the count, beyond what any slot of the sketch holds,
#: from which a shingle is dealt out.
RANGE_ENTRIES = 400_000
HOT = 4096
#: Classes of a shingle whose pairs are joined as rows, and shingles of all classes in a block beyond that.
GROUP = 64
BLOCK_SHINGLES = 250_000
#: Shingles of a set up to which classes and links are made sure of on bytes.
FEW = 16
_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Map-side rows are written after so many steps.
FLUSH_STEPS = 8


def shingles_of(raw: bytes) -> frozenset[bytes]:
    """The shingles of a text as bytes: `WIDTH` words, or all of fewer, a blank between two."""
    words = raw.translate(_LOWER_TABLE).split()
    if len(words) < WIDTH:
        return frozenset([b" ".join(words)] if words else [])
    return frozenset(b" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1))


def _digests(rows: np.ndarray, hashes: np.ndarray, n_rows: int, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """128-bit digests of the rows' sets, their sizes and first places. Sets of at most `FEW` shingles are digested from the shingles' bytes: so few 64-bit hashes could agree by chance in a very large corpus."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    raw = hashes.astype("<u8")
    out: list[bytes | None] = []
    for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        if a == b:
            out.append(None)
        elif b - a <= FEW:
            out.append(hashlib.blake2b(b"\n".join(sorted(shingles_of(data[off[i] : off[i + 1]].tobytes()))), digest_size=16, person=b"shingles").digest())
        else:
            out.append(hashlib.blake2b(raw[a:b].tobytes(), digest_size=16).digest())
    return out, count, begin


def _histograms(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    flat = np.bincount(rows * BINS + (hashes >> np.uint64(58)).astype(np.int64), minlength=n_rows * BINS)
    return np.minimum(flat, 255).astype(np.uint8).reshape(n_rows, BINS)


def _describe(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["doc_id", "n", "cls", "bins", "slice", "counts"]
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in text_steps(batch):
                rows, h = shingle_hashes(data, off, WIDTH, key)
                sketch += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                cls, count, _ = _digests(rows, h, hi - lo, data, off)
                bins = _histograms(rows, h, hi - lo)
                k = hi - lo
                yield pa.RecordBatch.from_arrays([ids.slice(lo, k), pa.array(count, pa.int64()), binary_column(cls), binary_column([b.tobytes() if c else None for b, c in zip(bins, cls, strict=True)]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if sketch.any():
            parts = sketch.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.binary()), pa.array(np.arange(SLICES), pa.int32()), binary_column([p.astype("<u4").tobytes() if p.max() < 2**32 else np.minimum(p, 2**32 - 1).astype("<u4").tobytes() for p in parts])], names=names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)
            total[s] = total[s] + part if s in total else part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), binary_column([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in total.values()])], names=["slice", "counts"])


def _sketch(parts: DataFrame) -> np.ndarray:
    """The counts of all tasks, added in two steps; what reaches the driver is of fixed size (4 * 2**SKETCH_BITS bytes)."""
    parts = parts.filter("slice is not null").select("slice", "counts")
    once = parts.repartition("slice", F.spark_partition_id() % 16).mapInArrow(_add_slices, "slice int, counts binary")
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.int64)
    for r in once.repartition("slice").mapInArrow(_add_slices, "slice int, counts binary").toLocalIterator():
        out[r["slice"]] += np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def _rank(counts: np.ndarray) -> np.ndarray:
    """What a slot holds beyond the median slot, in steps of that one's spread: in a large corpus every slot holds many rare
    shingles, and a common one shows above them while its count is above the root of theirs."""
    usual = float(np.median(counts))
    return np.round(8 * np.log2(1 + np.maximum(counts - usual, 0) / (1 + usual**0.5))).astype(np.uint64)


def _global_order(rows: np.ndarray, h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Puts every row's shingles, sorted by hash, in the global order: coarse frequency, then hash."""
    key = (rank[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(48)) | (h >> np.uint64(16))
    return np.lexsort((key, rows))  # stable: equal keys keep the order of their hashes


def _prefixes(sketch, n_ranges: int, key: int):
    """Packs every class's prefix entries by range of shingles; copies of a class within a flush are packed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        rank = _rank(counts)
        crowd = 2 * int(counts.mean())  # what a slot of the sketch holds of rare shingles
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            token, cid, size, pos, salt = (np.concatenate(x) for x in zip(*held, strict=True))
            to = (mix(token + salt.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(n_ranges)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            parts = [[x.tobytes() for x in np.split(col[order], cuts)] for col in (token, cid, size, pos, salt)]
            keys = to[order][np.concatenate([[0], cuts])]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *map(binary_column, parts)], names=["range", "token", "cid", "size", "pos", "salt"])

        for batch in batches:
            for lo, hi, data, off in text_steps(batch):
                rows, h = shingle_hashes(data, off, WIDTH, key)
                if not len(h):
                    continue
                cls, count, begin = _digests(rows, h, hi - lo, data, off)
                fresh = np.zeros(hi - lo, dtype=bool)
                for i, c in enumerate(cls):
                    if c is not None and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                slot = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                order = _global_order(rows, h, rank)
                pos = np.arange(len(h)) - begin[rows]
                size = count[rows]
                keep = (pos < size - (NUM * size + DEN - 1) // DEN + 1) & fresh[rows]
                order = order[keep]
                r = rows[keep]
                cid = np.frombuffer(b"".join(c or bytes(16) for c in cls), "<u8")[::2][r]
                deal = -(-np.maximum(counts[slot[order]] - crowd, 0) // HOT)
                salt = np.where(deal > 1, cid % np.maximum(deal, 1).astype(np.uint64) + np.uint64(1), np.uint64(0)).astype(np.uint32)
                held.append((h[order], cid, size[keep].astype(np.uint32), pos[keep].astype(np.uint32), salt))
                if len(held) >= FLUSH_STEPS:
                    yield flush()
        if held:
            yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of shingles that two classes show, and neighbour pairs among them. Rows arrive sorted by range."""
    names = ["token", "cid", "size", "pos", "other"]

    def emit(parts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        token, cid, size, pos, salt = (np.frombuffer(b"".join(p), d) for p, d in zip(parts, ("<u8", "<u8", "<u4", "<u4", "<u4"), strict=True))
        order = np.lexsort((pos, cid, size, salt, token))
        token, cid, size, pos, salt = token[order], cid[order], size[order].astype(np.int64), pos[order].astype(np.int64), salt[order]
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        keep = np.concatenate([[True], ~(same & (cid[1:] == cid[:-1]) & (size[1:] == size[:-1]) & (pos[1:] == pos[:-1]))])
        token, cid, size, pos, salt = token[keep], cid[keep], size[keep], pos[keep], salt[keep]
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        some = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (salt > 0)
        room = np.minimum(size[1:] - pos[1:], size[:-1] - pos[:-1])
        pair = np.concatenate([same & (DEN * size[:-1] >= NUM * size[1:]) & ((NUM + DEN) * room >= NUM * (size[1:] + size[:-1])), [False]])
        other = np.concatenate([cid[1:], cid[:1]]).view(np.int64)
        pick = np.flatnonzero(some)
        for k in range(0, len(pick), 100_000):
            i = pick[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(token[i].view(np.int64)), pa.array(cid[i].view(np.int64)), pa.array(size[i], pa.int64()), pa.array(pos[i], pa.int64()), pa.array(other[i], pa.int64(), mask=~pair[i])], names=names)

    now, parts = None, [[], [], [], [], []]
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and now is not None:
                yield from emit(parts)
                parts = [[], [], [], [], []]
            now = row[0]
            for p, v in zip(parts, row[1:], strict=True):
                p.append(v)
    if now is not None:
        yield from emit(parts)


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose bin histograms allow the overlap: the sum of differences is at most the symmetric difference."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, na, nb, ba, bb = batch.columns
        x = np.frombuffer(b"".join(ba.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64)
        y = np.frombuffer(b"".join(bb.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64)
        total = na.to_numpy() + nb.to_numpy()
        ok = (NUM + DEN) * (total - np.abs(x - y).sum(axis=1)) >= 2 * NUM * total
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok))


def linked(a: str, b: str) -> bool:
    """Whether two texts' shingle sets, as bytes, reach the threshold."""
    x, y = shingles_of(a.encode()), shingles_of(b.encode())
    return DEN * len(x & y) >= NUM * len(x | y)


def _verified(key: int):
    """Pairs whose shingle sets reach the threshold, by exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * 2_000_000 / max(batch.nbytes, 1)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                n = part.num_rows
                sides = []
                for name in ("text_a", "text_b"):
                    got = [(r + lo, h) for lo, _, data, off in text_steps(part, name) for r, h in [shingle_hashes(data, off, WIDTH, key)]]
                    sides.append((np.concatenate([r for r, _ in got]), np.concatenate([h for _, h in got])))
                (ra, ha), (rb, hb) = sides
                rows, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                both = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (h[1:] == h[:-1])], minlength=n)
                union = np.bincount(rows, minlength=n) - both
                yield part.select(["a", "b"]).filter(pa.array(DEN * both >= NUM * union))

    return run


def _count(of: np.ndarray, h: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """How many values of h each row of left shares with each row of right; of: the row of each value."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[column]
    of, column = of[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    at = np.full((2, n), -1, dtype=np.int64)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    for first in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [first, first + columns])
        sides = []
        for k, rows in ((0, left), (1, right)):
            side = np.zeros((len(rows), columns), dtype=np.float32)
            to = at[k, of[a:b]]
            side[to[to >= 0], column[a:b][to >= 0] - first] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray, text: list[str]) -> np.ndarray:
    """label joined by the links (i, j) of small sets that hold on bytes; only those that join two components are looked at."""
    root = label.tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in range(0, len(i), 100_000):
        for x, y in zip(i[k : k + 100_000].tolist(), j[k : k + 100_000].tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b and linked(text[x], text[y]):
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(len(root))], dtype=np.int64)


def _blocks(sketch, key: int):
    """Links between two blocks of one shingle's classes; rows arrive sorted by (token, lo, hi)."""

    def links(rows: list[tuple]) -> tuple[list[bytes], list[bytes]]:
        token, lo, hi = rows[0][:3]
        cls, comp, text = ([r[k] for r in rows] for k in (4, 5, 8))
        blk, size, pos = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 6, 7))
        comp = np.unique(np.array([c.hex() for c in comp]), return_inverse=True)[1]
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        ok = comp[left][:, None] != comp[right][None, :]
        if lo == hi:
            ok &= left[:, None] < right[None, :]
        sl, sr = size[left][:, None], size[right][None, :]
        ok &= (DEN * sl >= NUM * sr) & (DEN * sr >= NUM * sl)
        ok &= (NUM + DEN) * np.minimum(sl - pos[left][:, None], sr - pos[right][None, :]) >= NUM * (sl + sr)
        if not ok.any():
            return [], []
        left, right, ok = left[ok.any(1)], right[ok.any(0)], ok[ok.any(1)][:, ok.any(0)]
        got = [(r + a, h) for a, _, data, off in text_steps(pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"])) for r, h in [shingle_hashes(data, off, WIDTH, key)]]
        of, h = np.concatenate([r for r, _ in got]), np.concatenate([x for _, x in got])
        order = _global_order(of, h, _rank(sketch.value))
        begin = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(rows)))])
        place = np.arange(len(h)) - begin[of]
        earlier = place < pos[of]
        ok &= _count(of[earlier], h[order][earlier], left, right, len(rows)) == 0
        if not ok.any():
            return [], []
        both = _count(of, h, left, right, len(rows))
        ok &= DEN * both >= NUM * (size[left][:, None] + size[right][None, :] - both)
        i, j = np.nonzero(ok)
        i, j = left[i], right[j]
        few = size[i] <= FEW
        (i, small_i), (j, small_j) = ((x[~few], x[few]) for x in (i, j))
        label = np.arange(len(rows))
        while True:  # a forest of the links: each class to the least of its component here
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        if len(small_i):
            label = _joined(label, small_i, small_j, text)
        moved = np.flatnonzero(label != np.arange(len(rows)))
        return [cls[k] for k in moved], [cls[k] for k in label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    a, b = links(held)
                    if a:
                        yield pa.RecordBatch.from_arrays([binary_column(a), binary_column(b)], names=["a", "b"])
                    held = []
                held.append(row)
        if held:
            a, b = links(held)
            if a:
                yield pa.RecordBatch.from_arrays([binary_column(a), binary_column(b)], names=["a", "b"])

    return run


def _classed(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_steps(batch):
                cls, _, _ = _digests(*shingle_hashes(data, off, WIDTH, key), hi - lo, data, off)
                yield pa.RecordBatch.from_arrays([binary_column(cls), batch.slice(lo, hi - lo).column(0)], names=["cls", "text"])

    return run


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls becomes a class's node: bytes that sort by its least doc_id (none comes last), then by digest."""
    for batch in batches:
        cls, rep = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        node = [(b"\1" + bytes(8) if r is None else b"\0" + (r + (1 << 63)).to_bytes(8, "big")) + c for c, r in zip(cls, rep, strict=True)]
        cid = np.frombuffer(b"".join(cls), "<i8")[::2]
        yield pa.RecordBatch.from_arrays([binary_column(node), *batch.columns[1:], pa.array(cid, pa.int64())], names=["cls", "rep", "n", "bins", "cid"])


def _least_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's digest and the doc_id of the node that names its component."""
    for batch in batches:
        least = [None if c[0] else int.from_bytes(c[1:9], "big") - (1 << 63) for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([binary_column([x[9:] for x in batch.column(0).to_pylist()]), pa.array(least, pa.int64())], names=["cls", "component_id"])


class NearDuplicates:
    """Classes, links and components of a table of documents; tables are in the shared folder until close()."""

    def __init__(self, documents: DataFrame):
        spark = documents.sparkSession
        self._key = key = secrets.randbits(63)
        docs = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
        texts = docs.filter("text is not null")
        self._docs = docs
        first = materialize(docs.mapInArrow(_describe(key), "doc_id bigint, n bigint, cls binary, bins binary, slice int, counts binary"), "described")
        counts = _sketch(first)
        self._described = first
        rows = first.filter("slice is null")
        classes = materialize(rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.count("*").alias("n_rows")), "classes")
        total = int(counts.sum())
        n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 0.25 / RANGE_ENTRIES))
        sketch = spark.sparkContext.broadcast(counts.astype(np.int64))
        packed = texts.mapInArrow(_prefixes(sketch, n_ranges, key), "range int, token binary, cid binary, size binary, pos binary, salt binary")
        shared = materialize(packed.repartition(n_ranges, "range").sortWithinPartitions("range").mapInArrow(_shared, "token bigint, cid bigint, size bigint, pos bigint, other bigint"), "shared")
        keyed = classes.select("cls", "rep", "n", "bins").mapInArrow(_nodes, "cls binary, rep bigint, n bigint, bins binary, cid bigint")
        named = materialize(keyed.join(shared.select("cid").distinct(), "cid", "left_semi"), "named")
        nodes = named.select(F.col("cls").alias("node"), "rep", F.expr("substring(cls, 10, 16)").alias("cls"))
        if rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
            found = texts.join(nodes.filter("rep is not null").select("node", F.col("rep").alias("doc_id")).hint("merge"), "doc_id").select(F.col("node").alias("cls"), "text")
            lone = nodes.filter("rep is null")
        else:  # doc_ids don't name a text: find every class's by its digest
            found, lone = None, nodes
        by_class = (texts.filter("doc_id is null") if found is not None else texts).select("text").mapInArrow(_classed(key), "cls binary, text string").groupBy("cls").agg(F.min("text").alias("text"))
        by_class = by_class.join(lone.hint("merge"), "cls").select(F.col("node").alias("cls"), "text")
        held = materialize(by_class if found is None else found.union(by_class), "texts")  # one text a class
        # round A: one neighbour per class
        near = shared.filter("other is not null").groupBy("cid", "other").count().groupBy("cid").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
        name_a, name_b = (named.select(F.col("cid").alias(c), F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}")) for c, x in (("cid", "a"), ("other", "b")))
        pairs = near.join(name_a.hint("merge"), "cid").join(name_b.hint("merge"), "other").select("a", "b", "n_a", "n_b", "bins_a", "bins_b")
        links_a = materialize(self._check(pairs, held), "links")
        comp_a = materialize(components(links_a.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
        # round B: all pairs between components
        label = named.join(comp_a.select(F.col("node").alias("cls"), "component").hint("merge"), "cls", "left").select("cid", "cls", "n", F.coalesce("component", "cls").alias("comp"))
        entries = shared.select("token", "cid", "size", "pos").join(label.select("cid", "cls", "comp").hint("merge"), "cid").drop("cid")
        entries = materialize(entries, "entries")
        mixed = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("group"), F.sum("size").alias("sizes")).filter("lo < hi").select("token", "group", F.ceil(F.col("sizes") / BLOCK_SHINGLES).alias("blocks"))
        mixed = materialize(mixed, "mixed")
        if mixed.isEmpty():  # no shingle joins two components
            open_rows = links_b = None
            comp = comp_a
        else:
            open_rows = materialize(salted_join(entries, mixed, "token", hot_keys(mixed, "token", "group")), "open")
            a, b = (open_rows.filter(F.col("group") <= GROUP).select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "comp", "size", "pos")]) for x in "ab")
            where = f"""comp_a <> comp_b and (size_a < size_b or size_a = size_b and cls_a < cls_b)
                and {DEN} * size_a >= {NUM} * size_b
                and pos_a < size_a - ceil({2 * NUM} * size_a / {NUM + DEN}) + 1
                and {NUM + DEN} * least(size_a - pos_a, size_b - pos_b) >= {NUM} * (size_a + size_b)"""
            more = a.hint("merge").join(b, "token").filter(where).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
            side = named.select("cls", "n", "bins")
            more = more.join(side.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("bins").alias("bins_a")).hint("merge"), "a").join(side.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("bins").alias("bins_b")).hint("merge"), "b")
            few = self._check(more.select("a", "b", "n_a", "n_b", "bins_a", "bins_b"), held)
            dealt = open_rows.filter(F.col("group") > GROUP).withColumn("blk", F.expr("pmod(xxhash64(cls), blocks)")).join(held.hint("merge"), "cls")
            dealt = dealt.withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("token", F.least("blk", "k").alias("lo"), F.greatest("blk", "k").alias("hi"), "blk", "cls", "comp", "size", "pos", "text")
            many = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(_blocks(sketch, key), "a binary, b binary")
            links_b = materialize(few.union(many), "links")
            edges = comp_a.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).union(links_b.select("a", "b"))
            comp = components(edges)
        # a component is named by the node of its least doc_id
        self.labels = materialize(comp.mapInArrow(_least_ids, "cls binary, component_id bigint"), "labels")
        drop_scratch(shared, named, held, links_a, links_b, comp_a, entries, mixed, open_rows)
        sketch.unpersist()
        self.classes, self.rows = classes, rows

    def _check(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        pairs = pairs.mapInArrow(_suffix_filter, "a binary, b binary")
        for x in "ab":
            pairs = pairs.join(held.select(F.col("cls").alias(x), F.col("text").alias(f"text_{x}")).hint("merge"), x)
        return pairs.mapInArrow(_verified(self._key), "a binary, b binary").distinct()

    def table(self) -> DataFrame:
        """doc_id, n_shingles, component_id, class_id: one row for each row of documents."""
        labels = self.classes.select("cls", "rep").join(self.labels.hint("merge"), "cls", "left")
        rows = self.rows.select("doc_id", "n", "cls")
        named = salted_join(rows.filter("cls is not null"), labels, "cls", hot_keys(self.classes, "cls", "n_rows"))
        named = named.select("doc_id", "n", F.coalesce("component_id", "rep").alias("component_id"), F.col("rep").alias("class_id"))
        blank = rows.filter("cls is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
        return named.union(blank).withColumnRenamed("n", "n_shingles")

    def close(self) -> None:
        """Deletes the tables; table() can't be read afterwards."""
        drop_scratch(self._described, self.classes, self.labels)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for each row of documents (see the module for nulls and repeats)."""
    return NearDuplicates(documents).table()


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without those that link to one of a smaller doc_id, directly or through others; all columns stay.

    Documents without words link to nothing and stay; rows without doc_id stay.
    """
    found = NearDuplicates(columns(documents, "doc_id", "text"))
    losers = materialize(found.table().filter("component_id <> doc_id").select("doc_id").distinct(), "losers")
    found.close()
    return documents.join(losers.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
