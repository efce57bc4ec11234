"""Byte-level BPE ids with a distinct-chunk table: pre-tokens are found by vectorised byte classes, each distinct one is merged once."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from terralith.llm.chunks import ChunkTable

MODEL = "byte_bpe_50k.json"
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_LOADED: dict[str, ByteBpe] = {}


def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{White_Space}+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


class ByteBpe:
    """A tokenizers file of GPT-2's kind (byte level, its regular expression, no prefix space, no normaliser)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.by_code = _classes()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.table = ChunkTable(self._encode)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        tokenize, letters = self.model.tokenize, self.letters
        return [[t.id for t in tokenize(c.decode("latin-1").translate(letters))] for c in chunks]

    def _byte_classes(self, data: np.ndarray) -> np.ndarray:
        kind = self.by_code[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            at = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
            b = at[lead]
            two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
            code = np.where(two, (b & 0x1F) << 6 | at[lead + 1] & 0x3F, np.where(three, (b & 0x0F) << 12 | (at[lead + 1] & 0x3F) << 6 | at[lead + 2] & 0x3F, (b & 0x07) << 18 | (at[lead + 1] & 0x3F) << 12 | (at[lead + 2] & 0x3F) << 6 | at[lead + 3] & 0x3F))
            k = self.by_code[code]
            kind[lead] = kind[lead + 1] = k
            kind[lead[~two] + 2] = k[~two]
            four = ~two & ~three
            kind[lead[four] + 3] = k[four]
        return kind

    def chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pre-tokens."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self._byte_classes(data)
        opens = np.ones(n, dtype=bool)
        opens[1:] = kind[1:] != kind[:-1]
        opens[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], n)
        run = kind[start]
        row_end = np.zeros(n + 1, dtype=bool)
        row_end[off] = True
        # white space before something else leaves its last character: a blank joins what follows, another stands alone
        ws = np.flatnonzero((run == _SPACE) & ~row_end[end])
        last = end[ws] - 1
        while (inner := (data[last] & 0xC0) == 0x80).any():
            last -= inner
        blank = data[last] == 0x20
        opens[last] = True
        opens[end[ws[blank]]] = False
        # 's 't 're 've 'm 'll 'd where a lone apostrophe opens a chunk
        quote = start[(run == _OTHER) & (end - start == 1)]
        quote = quote[(data[quote] == 0x27) & opens[quote] & ~row_end[quote + 1]]
        if len(quote):
            at = np.append(data, np.zeros(2, np.uint8))
            a, b = at[quote + 1], np.where(row_end[np.minimum(quote + 2, n)], 0, at[quote + 2])
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            hit = one | two
            quote, past = quote[hit], (quote + np.where(one, 2, 3))[hit]
            opens[quote + 1] = False
            past = past[past < n]
            opens[past[(kind[past] == _LETTER)]] = True
        start = np.flatnonzero(opens)
        return start, np.append(start[1:], n)

    def encode_rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each row)."""
        n = len(off) - 1
        start, end = self.chunks(data, off)
        row = np.searchsorted(off, start, side="right") - 1
        entry = self.table.look_up(data, start, end)
        ids, n_ids = self.table.take_ids(entry)
        past = np.concatenate([[0], np.cumsum(np.bincount(row, weights=n_ids, minlength=n).astype(np.int64))])
        raw = None
        for s in self.special:
            if (data == s[0]).any() and s in (raw := raw or data.tobytes()):  # the library takes these strings out of a text first
                rows = [ids[a:b] for a, b in zip(past[:-1], past[1:], strict=True)]
                for i in range(n):
                    if s in raw[off[i] : off[i + 1]]:
                        rows[i] = np.array(self.whole.encode(raw[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, past


def default_path() -> str:
    return public_tokenizers.path(MODEL)
