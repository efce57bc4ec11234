"""SentencePiece digests against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from terralith.llm import chunks
from terralith.llm import pieces as pieces_module
from terralith.llm.common import text_steps
from terralith.llm.pieces import MODEL, Pieces, digests, encode, decode

PATH = public_tokenizers.path(MODEL)
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
EDGE = ["", " ", "  ", "a", " a", "a ", "  a  b  ", "▁", "a▁b", "▁▁x", "\n", "\n\n a\n", "<s>", "</s> x", "<unk>", "<0x41>", "é ü 漢字 🙂", "x" * 3000, "a\tb c　d", "\x00 \x01", " " * 40 + "z", "the the the"]


def both(texts):
    pieces = Pieces.load(PATH)
    out = []
    for lo, hi, data, off in text_steps(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
        ids, at = pieces.encode_rows(data, off)
        raw, raw_at = pieces.decode_ids(ids, at)
        for i in range(hi - lo):
            out.append(([1, *ids[at[i] : at[i + 1]].tolist(), 2], raw[raw_at[i] : raw_at[i + 1]].tobytes().decode()))
    return out


def expected(text):
    ids = LIB.encode(text, add_bos=True, add_eos=True)
    return ids, LIB.decode(ids)


def test_edges():
    assert both(EDGE) == [expected(t) for t in EDGE]


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words():
    """Words that polynomials modulo powers of two can't tell apart, alone and repeated, and random long words."""
    rng = random.Random(3)
    texts = [*thue_morse(10), *thue_morse(11), *thue_morse(7), " ".join(thue_morse(10)), *("".join(rng.choices("abé", k=2048)) for _ in range(4))]
    assert both(texts + texts[::-1]) == [expected(t) for t in texts + texts[::-1]]


def test_equal_hashes(monkeypatch):
    """Chunks of one hash stay apart, in one step and over steps."""
    monkeypatch.setattr(chunks, "span_hashes", lambda data, start, end: np.full(len(start), 5 << 60, np.uint64) + (end - start).astype(np.uint64) % np.uint64(2))
    monkeypatch.setattr(pieces_module, "_LOADED", {})
    texts = ["one two three", "six ten two one", "three", "", "ten ten one"]
    assert both(texts) + both(texts[::-1]) == [expected(t) for t in texts + texts[::-1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab ▁ \n\té漢"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_random(texts):
    assert both(texts) == [expected(t) for t in texts]


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(99, None), (None, "a b"), (1, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(digests(df).collect(), key=str)
    want = []
    for i, t in rows:
        ids, text = expected(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(tuple(r))) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = {r.doc_id: r.text for r in decode(encode(df.filter("doc_id > 1"))).collect()}
    assert all(back[i] == expected(t or "")[1] for i, t in rows if i is not None and i > 1)
    assert digests(df.limit(0)).count() == 0
