"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the vocabulary crosses from a character into a whitespace marker (checked when the model is loaded), so a
text falls into chunks, each a run of markers and the characters up to the next marker; merges never leave a chunk.
Every distinct chunk is segmented once by the library, and ids are joined back by position. Decoding gathers the bytes of
each id's piece; byte pieces of a text always make up whole characters.

null and empty texts have the begin and end id alone and decode to nothing. Rows are kept as they are, repeats included. A
text longer than a step is one step: it takes some 60 bytes of a worker a byte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.chunks import ChunkTable, gather
from terralith.llm.common import text_steps

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_SPACE = 0x20
_LOADED: dict[str, Pieces] = {}


class Pieces:
    """The model at a path, with its chunk table; one per worker process."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = model.bos_id(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(len(names))]
        self.whole = any(_MARK in p.lstrip(_MARK) for p, s in zip(names, special, strict=True) if not s)
        self._space = model.piece_to_id(_MARK)
        shown = [b"" if s else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_MARK, " ").encode() for i, (p, s) in enumerate(zip(names, special, strict=True))]
        self._shown_size = np.array([len(b) for b in shown], dtype=np.int64)
        self._shown_at = np.cumsum(self._shown_size) - self._shown_size
        self._shown = np.frombuffer(b"".join(shown), np.uint8)
        self.table = ChunkTable(self._encode)

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        out = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [x or [self._space] for x in out]  # a lone marker is a piece; the library adds none to an empty text

    def decode_ids(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bytes before each row) of rows of ids; the blank of a row's first piece, which stands for the opening marker, is left out."""
        size = self._shown_size[ids]
        raw = gather(self._shown, self._shown_at[ids], size)
        past = np.concatenate([[0], np.cumsum(size)])[at]
        opens = past[:-1][past[1:] > past[:-1]]
        opens = opens[raw[opens] == _SPACE]
        keep = np.ones(len(raw), dtype=bool)
        keep[opens] = False
        return raw[keep], past - np.searchsorted(opens, past, side="left")

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
            if _LOADED[path].whole:
                raise ValueError("pieces of this model cross whitespace markers")
        return _LOADED[path]

    def encode_rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each row), without begin and end ids."""
        if (data == 0xE2).any() and b"\xe2\x96\x81" in data.tobytes():  # a marker in a text is a space to the model
            rows = [data[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            data = np.frombuffer(b"".join(rows), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        size = np.diff(off)
        some = (size > 0).astype(np.int64)  # rows that get an opening marker
        before = np.concatenate([[0], np.cumsum(some)])
        new = off + before
        marked = np.full(int(new[-1]), _SPACE, dtype=np.uint8)
        marked[np.arange(len(data)) + np.repeat(before[1:], size)] = data
        space = marked == _SPACE
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[new[:-1][some > 0]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(marked))[: len(start)]
        row = np.searchsorted(new, start, side="right") - 1
        entry = self.table.look_up(marked, start, end)
        ids, n_ids = self.table.take_ids(entry)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(row, weights=n_ids, minlength=len(off) - 1).astype(np.int64))])


def _digests(path: str, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (pieces.begin, pieces.end))
        for batch in batches:
            for lo, hi, data, off in text_steps(batch):
                ids, at = pieces.encode_rows(data, off)
                raw, raw_at = pieces.decode_ids(ids, at)
                ids = ids.astype("<u4", copy=False)
                of_ids, of_raw = [], []
                for i in range(hi - lo):
                    h = hashlib.sha256(begin)
                    h.update(ids[at[i] : at[i + 1]])
                    h.update(end)
                    of_ids.append(h.hexdigest())
                    of_raw.append(hashlib.sha256(raw[raw_at[i] : raw_at[i + 1]]).hexdigest())
                kept = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at) + 2, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_raw, pa.string())], names=[*carried, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            for lo, hi, data, off in text_steps(batch):
                ids, at = pieces.encode_rows(data, off)
                n = hi - lo
                full = np.full(len(ids) + 2 * n, pieces.end, dtype=np.int32)
                new = at + 2 * np.arange(n + 1)
                full[new[:-1]] = pieces.begin
                full[np.arange(len(ids)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))] = ids
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.ListArray.from_arrays(pa.array(new, pa.int32()), pa.array(full))], names=["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces.model.decode([x or [] for x in batch.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])

    return run


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (begin and end ids included) of every document."""
    path = path or public_tokenizers.path(MODEL)
    return documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text")).mapInArrow(_encoded(path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids decode to nothing."""
    path = path or public_tokenizers.path(MODEL)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id bigint, text string")


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded in one pass."""
    path = path or public_tokenizers.path(MODEL)
    return documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text")).mapInArrow(_digests(path, ["doc_id"]), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
