"""Shared ground of the training-data operators: scratch tables, vectorised word hashing, fixed-size sketches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is one step of its own.
STEP_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Fixed values of the span hash: two primes below 2**31 with a base each. A prefix sum over fewer than `_PLAIN` bytes fits
#: 63 bits without reduction.
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = (1_540_483_477, 1_103_515_245)
_PLAIN = 1 << 23
#: Spans above this length are hashed by BLAKE2b instead.
LONG_SPAN = 256


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Where it is unset a local session, as in tests, gets a temporary one and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terralith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/terralith-{label}-{uuid.uuid4().hex}"


#: Drops the shuffle files of a write as soon as it is done: the next plan reads the written table, never those.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df in the shared folder and reads it back: lineage ends here and lost executors cost one stage at most."""
    spark = df.sparkSession
    path = scratch(spark, label)
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes scratch tables that no returned plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


#: A key with more than 1/HOT_SHARE of all rows, and more than HOT_ROWS of them, is hot: there are at most HOT_SHARE such keys.
HOT_SHARE = 10_000
HOT_ROWS = 64


def hot_keys(counted: DataFrame, key: str, count: str) -> DataFrame:
    """key and _parts, the number of parts that its rows are dealt over, of the hot keys of a table with one row a key; at most HOT_SHARE rows."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    share = max(total / HOT_SHARE, HOT_ROWS)
    return counted.filter(F.col(count) > share).select(key, F.ceil(F.col(count) / share).alias("_parts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The inner join of left and right, which has one row a key, with the rows of hot keys dealt over tasks.

    The list of hot keys is of bounded size, so it is broadcast; right's rows of hot keys are copied once a part, 2 * HOT_SHARE
    times in all at most. left is read in a fixed order, as from a table, so that a task that is run again deals alike.
    """
    hot = F.broadcast(hot)
    salt = F.when(F.col("_parts").isNotNull(), F.expr("pmod(monotonically_increasing_id(), _parts)")).otherwise(F.lit(0))
    dealt = left.join(hot, key, "left").withColumn("_salt", salt.cast("bigint")).drop("_parts")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(F.expr("sequence(0L, coalesce(_parts, 1L) - 1)"))).drop("_parts")
    return dealt.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def columns(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, by exact name; other columns of whatever name stay out of the operator."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a lane's base and of its inverse, from 0 to n at least."""
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n + 1:
        p = _PRIMES[lane]
        out = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, p)):
            up = np.ones(1 << max(16, n.bit_length()), dtype=np.int64)
            done = 1
            while done < len(up):  # doubling: up[done + i] = up[i] * base**done
                up[done : 2 * done] = up[:done] * pow(base, done, p) % p
                done *= 2
            out.append(up)
        have = out[0], out[1]
        if n <= _PLAIN:  # a giant text's table isn't kept
            _POWERS[lane] = have
    return have


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans.

    Two polynomials modulo primes, from prefix sums moved to a common origin, are mixed with the length; a span of more
    than `LONG_SPAN` bytes has its BLAKE2b digest. Equal bytes have equal hashes wherever they stand.
    """
    lanes = []
    for lane, p in enumerate(_PRIMES):
        up, down = _powers(lane, len(data))
        term = (data.astype(np.int64) + 1) * up[: len(data)]
        if len(data) >= _PLAIN:
            term %= p
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(term, out=total[1:])
        lanes.append((total[end] - total[start]) % p * down[start] % p)
    out = mix((lanes[0] << 32 | lanes[1]).astype(np.uint64) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(end - start > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def text_steps(batch: pa.RecordBatch, name: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) of slices of a string column; nulls have no bytes. The bytes of a row are bytes[offsets[i]:offsets[i+1]]."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + step, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words, runs of bytes that are no ASCII white space; words end with their row."""
    space = _SPACE[data]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= space[1:]
    inner = off[1:-1]
    inner = inner[inner > 0]
    last[inner - 1] |= word[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, by a key that the bytes' author doesn't know.

    Eight bytes at a time go through multiplications and shifts that mix all bits, so no two texts can be made to collide
    without the key, as they can where a hash is a sum over bytes; a span of more than `LONG_SPAN` bytes has its keyed
    BLAKE2b digest.
    """
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(key))
    salt = np.uint64(key) * np.uint64(2) + np.uint64(1)
    at = np.flatnonzero(size <= LONG_SPAN)
    left, place = size[at], start[at]
    while len(at):
        block = eight[place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        out[at] = mix(out[at] * np.uint64(0x9FB21C651E98DF25) + mix((block ^ salt) * np.uint64(0xD6E8FEB86659FD93) + salt))
        more = left > 8
        at, left, place = at[more], left[more] - 8, place[more] + 8
    for k in np.flatnonzero(size > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8, key=int(key).to_bytes(8, "little")).digest(), "little")
    return out


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int = 5, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every row's distinct shingles of `width` words (A-Z lower-cased), sorted by row and hash; with fewer words the whole sequence is one; words are hashed by the key."""
    data = _LOWER[data]
    start, end, row = words_of(data, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(data, start, end, key)
    n_rows = len(off) - 1
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    pad = np.concatenate([h, np.zeros(width, np.uint64)])
    rows, out = [], []
    for size in range(1, width + 1):  # size words: whole sequences of short rows, and full shingles
        pick = np.flatnonzero(count[row] >= width) if size == width else begin[(count == size).nonzero()[0]]
        if size == width:
            pick = pick[pick - begin[row[pick]] + width <= count[row[pick]]]
        if not len(pick):
            continue
        acc = np.full(len(pick), size, dtype=np.uint64)
        for k in range(size):
            acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + pad[pick + k])
        rows.append(row[pick])
        out.append(acc)
    rows, out = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return rows[keep], out[keep]


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
