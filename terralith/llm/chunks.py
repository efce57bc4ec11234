"""Distinct-chunk tables: each distinct chunk of text is tokenised once, and ids are joined back by position.

A worker keeps a direct-mapped table of bounded size from a chunk, found by its 64-bit hash and known by its bytes, to its
ids; a step looks all its chunks up at once, tokenises the distinct ones it lacks, and gathers ids by position.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from terralith.llm.common import span_hashes

#: Slots of the table, and what it may hold (entries; ids and bytes) before it starts anew. One step's chunks come on top.
SLOT_BITS = 22
MAX_ENTRIES = 1_500_000
MAX_VALUES = 48_000_000


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start:start+length] of every span, one after the other."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    past = np.cumsum(length)
    shift = np.repeat(start - (past - length), length)
    shift += np.arange(total)
    return pool[shift]


class _Pool:
    def __init__(self, dtype):
        self.data = np.zeros(1 << 16, dtype=dtype)
        self.used = 0

    def add(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(need, 2 * len(self.data)) - self.used, self.data.dtype)])
        self.data[self.used : need] = values
        self.used = need


class ChunkTable:
    """encode: distinct chunks (bytes) to their ids.

    The table keeps each chunk's bytes next to its ids and compares them at every hit, so two chunks of one hash stay two.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.entry = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.ids, self.bytes = _Pool(np.uint32), _Pool(np.uint8)
        self.spans = [_Pool(np.int64) for _ in range(4)]  # start and length of ids, of bytes

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of every chunk data[start:end]; valid until the next call."""
        if self.spans[0].used > MAX_ENTRIES or self.ids.used + self.bytes.used > MAX_VALUES:
            self._clear()
        h = span_hashes(data, start, end)
        h[h == 0] = 1  # 0 marks a free slot
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = self.entry[slot].astype(np.int64)
        known = self.keys[slot] == h
        at = np.flatnonzero(known)
        known[at] = self._same(found[at], data, start[at], end[at])
        miss = np.flatnonzero(~known)
        if len(miss):
            new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            base = self._add(data, start[miss[first]], end[miss[first]])
            at = (new >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.keys[at] = new
            self.entry[at] = base + np.arange(len(new))  # of two in one slot, numpy keeps the last in both arrays
            found[miss] = base + inverse
            other = miss[~self._same(found[miss], data, start[miss], end[miss])]  # another chunk of that hash came first
            if len(other):
                distinct: dict[bytes, int] = {}
                which = [distinct.setdefault(data[start[k] : end[k]].tobytes(), len(distinct)) for k in other]
                first = np.array([which.index(i) for i in range(len(distinct))])
                found[other] = self._add(data, start[other[first]], end[other[first]]) + np.array(which)
        return found

    def _same(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the bytes of each entry are those of its chunk."""
        ok = self.spans[3].data[entry] == end - start
        at = np.flatnonzero(ok)
        length = (end - start)[at]
        past = np.cumsum(length)
        differ = np.flatnonzero(gather(self.bytes.data, self.spans[2].data[entry[at]], length) != gather(data, start[at], length))
        ok[at[np.searchsorted(past, differ, side="right")]] = False
        return ok

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> int:
        """Stores chunks with their ids; the number of the first."""
        base = self.spans[0].used
        length = end - start
        raw = gather(data, start, length)
        past = np.cumsum(length)
        whole = raw.tobytes()
        ids = [np.asarray(x, dtype=np.uint32) for x in self.encode([whole[a:b] for a, b in zip((past - length).tolist(), past.tolist(), strict=True)])]
        n_ids = np.array([len(x) for x in ids], dtype=np.int64)
        for k, pool, size, values in ((0, self.ids, n_ids, np.concatenate(ids)), (2, self.bytes, length, raw)):
            self.spans[k].add(pool.used + np.cumsum(size) - size)
            self.spans[k + 1].add(size)
            pool.add(values)
        return base

    def take_ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids by position, and how many each chunk has."""
        length = self.spans[1].data[entry]
        return gather(self.ids.data, self.spans[0].data[entry], length), length
