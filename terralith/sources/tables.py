"""Table sources and sinks: TSV with a metadata line, versioned binary tables, archives, run-length regions."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field codes of binary tables: (struct format, Spark type); s is text after a u16 length, o the same after a presence byte.
KINDS = {"b": ("<?", "boolean"), "i": ("<i", "int"), "f": ("<f", "float"), "s": (None, "string"), "o": (None, "string")}


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text: a header line, a metadata line that begins with #, rows of text; short rows read as empty texts.

    ordinal numbers the rows of a file by their place in it: bytes before them, as far as one split reads them.
    """
    lines = spark.read.text(path, wholetext=False).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))
    names = columns or lines.filter(~F.col("value").startswith("#")).orderBy("ordinal").first()["value"].split("\t")
    header = "\t".join(names)
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != header) & (F.col("value") != ""))
    parts = F.split("value", "\t", -1)
    return rows.select("ordinal", *[F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


def tsv_lines(df: DataFrame, name: str, version: int = 0) -> DataFrame:
    """The lines of a TSV file: header, metadata, rows in ordinal order; ready for write.text of one file."""
    cols = [c for c in df.columns if c != "ordinal"]
    spark = df.sparkSession
    head = spark.createDataFrame([(-2, "\t".join(cols)), (-1, f"#{name};{version};")], "ordinal bigint, value string")
    body = df.select("ordinal", F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value"))
    return head.unionByName(body).orderBy("ordinal").select("value")


def encode_table(rows: list[tuple], layout: str, version: int) -> bytes:
    """A binary table: version, row count, then the fields of each row by the codes of layout."""
    out = [struct.pack("<ii", version, len(rows))]
    for row in rows:
        for kind, value in zip(layout, row, strict=True):
            if kind in "so":
                raw = (value or "").encode()
                out.append((struct.pack("<?", bool(value)) if kind == "o" else b"") + (struct.pack("<H", len(raw)) + raw if kind == "s" or value else b""))
            else:
                out.append(struct.pack(KINDS[kind][0], value))
    return b"".join(out)


def decode_table(raw: bytes, layouts: dict[int, str]) -> Iterator[tuple]:
    """The rows; an unknown version is an error. An absent optional text reads as an empty one."""
    version, count = struct.unpack_from("<ii", raw)
    if version not in layouts:
        raise ValueError(f"unknown table version {version}")
    at = 8
    for _ in range(count):
        row = []
        for kind in layouts[version]:
            if kind == "o":
                at += 1
                if not raw[at - 1]:
                    row.append("")
                    continue
            if kind in "so":
                (n,) = struct.unpack_from("<H", raw, at)
                row.append(raw[at + 2 : at + 2 + n].decode())
                at += 2 + n
            else:
                row.append(struct.unpack_from(KINDS[kind][0], raw, at)[0])
                at += struct.calcsize(KINDS[kind][0])
        yield tuple(row)


def read_binary_tables(spark: SparkSession, path: str, layouts: dict[int, str], columns: list[str]) -> DataFrame:
    """Rows of all binary tables under path, with path and ordinal."""
    kinds = next(iter(layouts.values()))
    schema = "path string, ordinal bigint, " + ", ".join(f"{c} {KINDS[k][1]}" for c, k in zip(columns, kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(decode_table(content, layouts))
                types = {"boolean": pa.bool_(), "int": pa.int32(), "float": pa.float32(), "string": pa.string()}
                cols = [pa.array([r[k] for r in rows], types[KINDS[kind][1]]) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), *cols], names=["path", "ordinal", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def write_archive(members: dict[str, bytes]) -> bytes:
    """An archive: magic, count, index of (offset, size, path), then the members."""
    names = sorted(members, key=normal_path)
    index = b"".join(struct.pack("<H", len(n.encode())) + n.encode() for n in names)
    at = 8 + len(index) + 12 * len(names)
    spans = []
    for n in names:
        spans.append(struct.pack("<QI", at, len(members[n])))
        at += len(members[n])
    return b"TPK1" + struct.pack("<I", len(names)) + b"".join(spans) + index + b"".join(members[n] for n in names)


def archive_index(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(path, offset, size) of each member."""
    if raw[:4] != b"TPK1":
        raise ValueError("not an archive")
    (count,) = struct.unpack_from("<I", raw, 4)
    at = 8 + 12 * count
    for k in range(count):
        offset, size = struct.unpack_from("<QI", raw, 8 + 12 * k)
        (n,) = struct.unpack_from("<H", raw, at)
        yield raw[at + 2 : at + 2 + n].decode(), offset, size
        at += 2 + n


def normal_path(path: str) -> str:
    return path.replace("/", "\\").lower()


def normal_path_column(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("/"), F.lit("\\")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """pack, path, key (normal path), offset, size and content of all members of all archives under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, p, normal_path(p), o, n, raw[o : o + n]) for p, o, n in archive_index(raw)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["pack", "path", "key", "offset", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "pack string, path string, key string, offset bigint, size bigint, content binary")


def overlay_members(*sources: DataFrame) -> DataFrame:
    """Members by key from ordered sources: the first that holds a key wins; a minimum by key, combined before the shuffle."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("priority", F.lit(k)) for k, s in enumerate(sources)])
    cols = [c for c in sources[0].columns if c != "key"]
    return ranked.groupBy("key").agg(F.min_by(F.struct(*cols), F.struct("priority", "pack", "path")).alias("m")).select("key", "m.*")


def read_layers(spark: SparkSession, path: str, row_tag: str = "entity") -> DataFrame:
    """Entities of layer XML files by Spark's own reader."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
