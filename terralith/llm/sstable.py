"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    data blocks   entries (shared key bytes u8, other key bytes u8, value bytes u32, other key bytes, value); the first
                  entry of a block shares nothing; then the crc32 of the entries (u32)
    block index   per block: first key, last key (9 bytes each), offset u64, bytes u32, entries u32, ids before it u64
    Bloom filter  bits, 10 a key, 7 probes
    footer        offsets and sizes of index and filter, documents, ids, bytes an id takes, magic

A key is 0x01 and doc_id with its sign bit flipped, big-endian, so bytes sort as numbers; a missing doc_id has the key of
nine zero bytes and comes first. Values are ids of 2 or 4 bytes. Shards are dealt by ranges of doc_id: reading them in
order is reading the corpus in ascending doc_id order. Writers name files by task attempt and only files named by a
finished task are in the manifest, so a lost executor leaves no half shard behind.

null and empty texts have the end id alone. Repeated rows stay rows, ordered by xxhash64(text) and text within a doc_id; an
identifier with many rows, or many rows without one, may go on in the next shard. A value is at most 4 GiB of ids.
"""

from __future__ import annotations

import bisect
import math
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.bytebpe import ByteBpe, default_path
from terralith.llm.common import materialize, mix, scratch, text_steps

MAGIC = b"TLSST001"
END_ID = 2
BLOCK_BYTES = 1 << 16
#: Bytes of a shard's input, on average, where that makes more shards than spark.sql.shuffle.partitions.
SHARD_BYTES = 256 << 20
BITS_A_KEY, PROBES = 10, 7
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<9s9sQIIQ")
_FOOTER = struct.Struct("<QQQQQQI8s")
MANIFEST = "path string, first_key binary, n_docs bigint, n_tokens bigint, n_bytes bigint"


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = mix(keys), mix(keys ^ np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _key_hash(key: bytes) -> int:
    return (int.from_bytes(key[1:], "little") + key[0]) & ((1 << 64) - 1)


class Writer:
    """Writes entries in ascending key order to a binary stream."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.dtype = stream, width, {2: "<u2", 4: "<u4"}[width]
        self.at = self.tokens = self.before = 0
        self.hashes = array("Q")  # 8 bytes a document until the filter's size is known
        self.first_key = self.last_key = b""
        self.index: list[bytes] = []
        self._open()

    def _open(self) -> None:
        self.parts, self.size, self.entries, self.first, self.last, self.before = [], 0, 0, b"", b"", self.tokens

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last_key:
            raise ValueError("keys must ascend")
        self.first_key = self.first_key or key
        shared = 0
        if self.entries:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype(self.dtype).tobytes()
        self.parts += [_ENTRY.pack(shared, 9 - shared, len(value)), key[shared:], value]
        self.size += _ENTRY.size + 9 - shared + len(value)
        self.entries += 1
        self.last = self.last_key = key
        self.hashes.append(_key_hash(key))
        self.tokens += len(ids)
        if self.size >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.entries:
            raw = b"".join(self.parts)
            self.stream.write(raw)
            self.stream.write(struct.pack("<I", zlib.crc32(raw)))
            self.index.append(_INDEX.pack(self.first, self.last, self.at, len(raw), self.entries, self.before))
            self.at += len(raw) + 4
        self._open()

    def finish(self) -> int:
        self._close()
        index = b"".join(self.index)
        bits = max(64, BITS_A_KEY * len(self.hashes))
        bloom = np.zeros(-(-bits // 8), dtype=np.uint8)
        for k in range(0, len(self.hashes), 100_000):
            at = _probes(np.frombuffer(self.hashes[k : k + 100_000], np.uint64), bits).ravel().astype(np.int64)
            np.bitwise_or.at(bloom, at >> 3, (0x80 >> (at & 7)).astype(np.uint8))
        packed = bloom.tobytes()
        self.stream.write(index)
        self.stream.write(packed)
        self.stream.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.hashes), self.tokens, self.width, MAGIC))
        return self.at + len(index) + len(packed) + _FOOTER.size


class Reader:
    """Reads a shard: index, filter and footer are held, blocks are read as asked for."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, index_size, bloom_at, self.bits, self.n_docs, self.n_tokens, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        self.index = list(_INDEX.iter_unpack(self.file.read_at(index_size, index_at)))
        self.first_keys = [x[0] for x in self.index]
        self.bloom = (bloom_at, -(-self.bits // 8))
        self._bloom: np.ndarray | None = None

    def close(self) -> None:
        self.file.close()

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, _, at, size, entries, _ = self.index[k]
        raw = self.file.read_at(size + 4, at)
        if zlib.crc32(raw[:size]) != struct.unpack_from("<I", raw, size)[0]:
            raise ValueError("a block is damaged")
        pos, key, dtype = 0, b"", {2: "<u2", 4: "<u4"}[self.width]
        for _ in range(entries):
            shared, other, value = _ENTRY.unpack_from(raw, pos)
            pos += _ENTRY.size
            key = key[:shared] + raw[pos : pos + other]
            pos += other
            yield key, np.frombuffer(raw, dtype, value // self.width, pos)
            pos += value

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier: filter, then binary search of the index, then one block (more if rows repeat)."""
        key = key_of(doc_id)
        if self._bloom is None:
            self._bloom = np.unpackbits(np.frombuffer(self.file.read_at(self.bloom[1], self.bloom[0]), np.uint8))
        if not self._bloom[_probes(np.array([_key_hash(key)], np.uint64), self.bits).ravel().astype(np.int64)].all():
            return []
        out: list[np.ndarray] = []
        k = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while k < len(self.index) and self.index[k][0] <= key:
            if self.index[k][1] >= key:
                out += [ids for x, ids in self.block(k) if x == key]
            k += 1
        return out


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path)
        width = 2 if max(bpe.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        writer = stream = None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for lo, hi, data, off in text_steps(batch):
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    writer = Writer(stream, width)
                ids, at = bpe.encode_rows(data, off)
                for i, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    writer.add(key_of(doc_id), np.concatenate([ids[at[i] : at[i + 1]], end]))
        if writer is not None:
            size = writer.finish()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([writer.first_key], pa.binary()), pa.array([len(writer.hashes)], pa.int64()), pa.array([writer.tokens], pa.int64()), pa.array([size], pa.int64())], names=["path", "first_key", "n_docs", "n_tokens", "n_bytes"])

    return run


def _size(df: DataFrame) -> int:
    """What the optimiser takes for the size of df in bytes; 0 if it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write(documents: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encodes and writes documents; returns the manifest (one row a shard, first_key ascending) as a written table."""
    spark = documents.sparkSession
    folder = folder or scratch(spark, "sstable")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(_size(documents) / SHARD_BYTES))
    docs = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    docs = docs.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text"), F.col("_row")]
    dealt = docs.repartitionByRange(shards, *order).sortWithinPartitions(order[0], "_text", "text").select("doc_id", "text")
    return materialize(dealt.mapInArrow(_write(folder, path or default_path(), end_id), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader, rows = Reader(path), []
            for doc_id, ids in reader:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                start += len(ids)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                    rows = []
            reader.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            reader = Reader(path)
            for k in range(len(reader.index)):
                block = list(reader.block(k))
                yield pa.RecordBatch.from_arrays([pa.array([id_of(x) for x, _ in block], pa.int64()), pa.array([ids.astype(np.int64) for _, ids in block], pa.list_(pa.int64()))], names=["doc_id", "ids"])
            reader.close()


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id and ids of every stored document."""
    return manifest.select("path").mapInArrow(_ids, "doc_id bigint, ids array<bigint>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document. The running start is over one row a shard."""
    order = Window.orderBy("first_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n).mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
