"""Binary layouts: tables with version markers, packs with a file index, and a scan that needs no layout."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.sources.tables import KINDS, normal_path, normal_path_column

#: Fixed values of the layouts: the marker before an identifier, the one before a version, and flags of packs.
_NAMED, _VERSIONED = 0xFFFCFEFD, 0xFFFEFDFC
_SEALED, _LONG_HEADER, _STAMPED = 0x80, 0x100, 0x40
Layouts = dict[int, list[tuple[str, str]]]


def encode_db(rows: list[tuple], kinds: str, version: int | None = None, name: str | None = None) -> bytes:
    """A table file: an identifier and a version if wanted, a byte, the row count, the rows' fields by KINDS."""
    out = [struct.pack("<IH", _NAMED, len(name)) + name.encode("utf-16-le")] if name is not None else []
    out += [struct.pack("<Ii", _VERSIONED, version)] if version is not None else []
    out.append(struct.pack("<BI", 1, len(rows)))
    for row in rows:
        for kind, value in zip(kinds, row, strict=True):
            if kind in "so":
                raw = (value or "").encode()
                out.append((struct.pack("<?", bool(value)) if kind == "o" else b"") + (struct.pack("<H", len(raw)) + raw if kind == "s" or value else b""))
            else:
                out.append(struct.pack(KINDS[kind][0], value))
    return b"".join(out)


def decode_db(raw: bytes, layouts: Layouts) -> tuple[int, list[tuple]]:
    """(version, rows). An unknown version, a file that ends within a row and bytes behind the last row are errors."""
    at, version = 0, 0
    marker = lambda: struct.unpack_from("<I", raw, at)[0] if len(raw) >= at + 4 else None
    if marker() == _NAMED:
        at = 6 + 2 * struct.unpack_from("<H", raw, 4)[0]
    if marker() == _VERSIONED:
        version = struct.unpack_from("<i", raw, at + 4)[0]
        at += 8
    if version not in layouts:
        raise ValueError(f"unknown table version {version}")
    try:
        (count,) = struct.unpack_from("<I", raw, at + 1)
        at, rows = at + 5, []
        for _ in range(count):
            row = []
            for _, kind in layouts[version]:
                if kind == "o":
                    at += 1
                    if not raw[at - 1]:
                        row.append("")
                        continue
                if kind in "so":
                    (n,) = struct.unpack_from("<H", raw, at)
                    if at + 2 + n > len(raw):
                        raise IndexError
                    row.append(raw[at + 2 : at + 2 + n].decode())
                    at += 2 + n
                else:
                    row.append(struct.unpack_from(KINDS[kind][0], raw, at)[0])
                    at += struct.calcsize(KINDS[kind][0])
            rows.append(tuple(row))
    except (struct.error, IndexError):
        raise ValueError(f"the table ends within row {len(rows) if at > 5 else 0}") from None
    if at != len(raw):
        raise ValueError(f"{len(raw) - at} bytes left after {count} rows")
    return version, rows


def db_rows(files: DataFrame, layouts: Layouts) -> DataFrame:
    """path, version, ordinal and the columns of all versions' layouts, null where a version lacks one, of files (path, content)."""
    kinds: dict[str, str] = {}
    for layout in layouts.values():
        for name, kind in layout:
            if KINDS[kinds.setdefault(name, kind)][1] != KINDS[kind][1]:
                raise ValueError(f"{name} has two types")
    types = {"boolean": pa.bool_(), "int": pa.int32(), "float": pa.float32(), "string": pa.string()}
    schema = "path string, version int, ordinal bigint, " + ", ".join(f"`{n}` {KINDS[k][1]}" for n, k in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                version, rows = decode_db(content, layouts)
                at = {name: k for k, (name, _) in enumerate(layouts[version])}
                cols = [pa.array([r[at[n]] for r in rows] if n in at else [None] * len(rows), types[KINDS[k][1]]) for n, k in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([version] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), *cols], names=["path", "version", "ordinal", *kinds])

    return files.select("path", "content").mapInArrow(run, schema)


def read_db(spark: SparkSession, path: str, layouts: Layouts) -> DataFrame:
    """The rows of all table files under path."""
    return db_rows(spark.read.format("binaryFile").load(path), layouts)


def encode_pack(members: list[tuple[str, bytes]], magic: str = "PFH5", stamped: bool = False, needs: tuple[str, ...] = ()) -> bytes:
    """A pack: header, names of packs it needs, index (size, time if stamped, packed flag in PFH5, path), then the members in order."""
    text = lambda s: s.encode() + b"\0"
    index = b"".join(struct.pack("<I", len(raw)) + (struct.pack("<I", 0) if stamped else b"") + (b"\0" if magic == "PFH5" else b"") + text(path) for path, raw in members)
    names = b"".join(map(text, needs))
    head = magic.encode() + struct.pack("<IIIII", 3 | (_STAMPED if stamped else 0), len(needs), len(names), len(members), len(index)) + bytes(4)
    return head + names + index + b"".join(raw for _, raw in members)


def pack_index(raw: bytes) -> Iterator[tuple[str, int, int, bool]]:
    """(path, offset, size, packed) of each member, in order."""
    magic = raw[:4]
    if magic not in (b"PFH4", b"PFH5"):
        raise ValueError("not a pack")
    mask, needs, names, count, index = struct.unpack_from("<IIIII", raw, 4)
    if mask & _SEALED:
        raise ValueError("the pack's index is encrypted")
    at = 24 + (24 if mask & _LONG_HEADER else 4)
    offset = at + names + index
    for _ in range(needs):
        at = raw.index(b"\0", at) + 1
    for _ in range(count):
        (size,) = struct.unpack_from("<I", raw, at)
        at += 8 if mask & _STAMPED else 4
        packed = magic == b"PFH5" and bool(raw[at])
        at += magic == b"PFH5"
        end = raw.index(b"\0", at)
        yield raw[at:end].decode(), offset, size, packed
        at, offset = end + 1, offset + size


def pack_members(files: DataFrame, content: bool = False) -> DataFrame:
    """pack, nth, path, key (its normal form), offset, size, packed and, if asked for, content of all members of packs (path, content); of equal keys in a pack the last counts.

    A packed member's content is null: its coding isn't read. A pack must fit in a row, as binaryFile gives it.
    """
    schema = "pack string, nth bigint, path string, key string, offset bigint, size bigint, packed boolean, content binary"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = {normal_path(p.strip()): (name, k, p, normal_path(p.strip()), o, n, z, raw[o : o + n] if content and not z else None) for k, (p, o, n, z) in enumerate(pack_index(raw))}
                cols = list(zip(*last.values(), strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    out = files.select("path", "content").mapInArrow(run, schema)
    return out if content else out.drop("content")


def merge_members(base: DataFrame, overrides: DataFrame, replace: list[str]) -> DataFrame:
    """key and status of every member of a pack (path) merged with overrides (path): kept, replaced, added, or dropped, as it lies in a folder that is replaced and the overrides lack it."""
    folders = [normal_path(d.rstrip("/\\") + "/") for d in replace]
    key = lambda df: df.select(F.trim(normal_path_column(F.col("path"))).alias("key")).distinct()
    both = key(base).withColumn("b", F.lit(True)).join(key(overrides).withColumn("o", F.lit(True)), "key", "full_outer")
    inside = F.lit(False)
    for d in folders:
        inside = inside | F.col("key").startswith(d)
    status = F.when(F.col("b").isNull(), "added").when(F.col("o"), "replaced").when(inside, "dropped").otherwise("kept")
    return both.select("key", status.alias("status"))


def merge_packs(base: DataFrame, overrides: DataFrame, replace: list[str]) -> DataFrame:
    """The members (path, key, content) of the merged pack: those kept, by their order, then the overrides by path."""
    status = merge_members(base, overrides, replace)
    keyed = lambda df: df.select("path", F.trim(normal_path_column(F.col("path"))).alias("key"), "content")
    kept = keyed(base).join(status.filter("status = 'kept'").select("key"), "key", "left_semi")
    return kept.select("path", "key", "content").unionByName(keyed(overrides).select("path", "key", "content"))


#: Where a map's path starts, and the longest type before it.
_FOLDER = re.compile(rb"(?=terrain\\battles\\)", re.I)
_LONGEST = 40
_TYPE = re.compile(rb"[a-z_]+")


def scan_pairs(raw: bytes) -> Iterator[tuple[str, str]]:
    """(map_path, type) of rows found by pattern, whatever the table's version: a path with its length before it, before that a byte and a text of lower-case letters with its length. A path that the file cuts off is left out."""
    for m in _FOLDER.finditer(raw):
        p = m.start()
        if p < 5:
            continue
        (n,) = struct.unpack_from("<H", raw, p - 2)
        if not n or p + n > len(raw):
            continue
        end = p - 3
        for size in range(1, min(_LONGEST, end - 2) + 1):
            at = end - size
            if struct.unpack_from("<H", raw, at - 2)[0] == size and _TYPE.fullmatch(raw[at:end]):
                yield raw[p : p + n].decode("latin-1"), raw[at:end].decode()
                break


class ScanPairs:
    """scan_pairs as a table function."""

    def eval(self, content: bytes) -> Iterator[tuple[str, str]]:
        if content is not None:
            yield from scan_pairs(bytes(content))


def scan_files(files: DataFrame) -> DataFrame:
    """path, map_path and type of every pair found in files (path, content)."""
    spark = files.sparkSession
    spark.udtf.register("terralith_scan_pairs", F.udtf(ScanPairs, returnType="map_path string, type string"))
    return spark.sql("SELECT f.path, p.map_path, p.type FROM {files} f, LATERAL terralith_scan_pairs(f.content) p", files=files)
