"""Token shards against the tokenizers library, and lookups."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from terralith.llm import sstable
from terralith.llm.bytebpe import ByteBpe, default_path
from terralith.llm.common import text_steps

LIB = Tokenizer.from_file(default_path())
BITS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "\xa0", "　", "a", "re", "S", "é", "ß", "1", "²", "½", "漢", "!", "..", "\x1c", "\x85", "_", "🙂", "<|endoftext|>", "l", "\x00"]


def test_ids_as_the_library():
    random.seed(2)
    a, b = "a", "b"
    for _ in range(10):  # words that polynomials modulo powers of two can't tell apart
        a, b = a + b, b + a
    texts = ["", a, b, a + " " + b, *("".join(random.choices("abé", k=2048)) for _ in range(4)), "x" * 5000, *("".join(random.choices(BITS, k=random.randint(0, 14))) for _ in range(4000))]
    bpe = ByteBpe.load(default_path())
    got = []
    for lo, hi, data, off in text_steps(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), step=5000):
        ids, at = bpe.encode_rows(data, off)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark):
    rows = [(i * 7 - 60, f"text {i} " * (i % 40)) for i in range(400)] + [(None, "no id"), (5, None), (5, ""), (5, "the same"), (5, "the same"), (1 << 62, "far " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    manifest = sstable.write(df)
    got = sorted(map(tuple, sstable.read_digests(manifest).collect()), key=lambda r: r[1])
    want, start = [], 0
    hashed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]])):
        ids = LIB.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    readers = [sstable.Reader(r.path) for r in manifest.collect()]
    for doc_id, n in ((5, 4), (None, 1), (-60, 1), (1 << 62, 1), (6, 0), (-1000, 0)):
        assert sum(len(r.get(doc_id)) for r in readers) == n
    assert sum(r.n_docs for r in readers) == len(rows)
    ids = {r.doc_id: list(r.ids) for r in sstable.read_ids(manifest).collect()}
    assert ids[1 << 62] == LIB.encode("far " * 30000, add_special_tokens=False).ids + [2]


def test_empty(spark):
    assert sstable.read_digests(sstable.write(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


def test_one_identifier(spark):
    """Nine of ten rows without an identifier are dealt over the shards."""
    df = spark.createDataFrame([(None if i % 10 else i, "same text" if i % 3 else f"text {i}") for i in range(4000)], "doc_id bigint, text string")
    manifest = sstable.write(df.repartition(8), shards=8).collect()
    assert sum(r.n_docs for r in manifest) == 4000 and max(r.n_docs for r in manifest) < 1200
    got = sorted(map(tuple, sstable.read_digests(sstable.write(df)).select("start", "n_tokens").collect()))
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and len(got) == 4000
