"""Ids of pre-tokens by a hash table in arrays: a whole group of texts is cut, looked
up and written without a Python object per word.

For texts of Latin-1 characters only, one byte a character.  Words are told apart
by two independent 64-bit polynomial hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from . import textvec

_rng = np.random.default_rng(99)
_TABLES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_CHARS = [bytes([i]).decode("latin-1") for i in range(256)]


def _classes() -> np.ndarray:
    """0 white space, 1 letters, 2 numerals (each alone), 3 others."""
    kinds = np.full(256, 3, dtype=np.uint8)
    for i, c in enumerate(_CHARS):
        if c.isspace():
            kinds[i] = 0
        elif re.match(r"[\d²³¹¼½¾]", c):
            kinds[i] = 2
        elif re.match(r"[^\W\d_]", c):
            kinds[i] = 1
    return kinds


CLASSES = _classes()


class WordTable:
    """``encode`` gives the ids of each of a list of words as bytes of ``kind``."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kind: type, bits: int = 21, entries: int = 600_000):
        self.encode, self.kind, self.bits, self.entries = encode, kind, bits, entries
        self.reset()

    def reset(self) -> None:
        size = 1 << self.bits
        self.first, self.second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.at, self.size = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.used, self.count = np.zeros(size, bool), 0
        self.pool, self.filled = np.zeros(1 << 16, self.kind), 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1; linear probing."""
        mask = (1 << self.bits) - 1
        slot = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(a), -1, np.int64)
        live = np.arange(len(a))
        while len(live):
            s = slot[live]
            same = (self.first[s] == a[live]) & (self.second[s] == b[live]) & self.used[s]
            out[live[same]] = s[same]
            live = live[~same & self.used[s]]
            slot[live] = (slot[live] + 1) & mask
        return out

    def insert(self, a: np.ndarray, b: np.ndarray, ids: list[bytes]) -> None:
        """Words not in the table, each once."""
        mask = (1 << self.bits) - 1
        flat = np.frombuffer(b"".join(ids), dtype=self.kind)
        sizes = np.array([len(x) for x in ids]) // flat.itemsize
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        at = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(flat)
        self.count += len(a)
        slot = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        live = np.arange(len(a))
        while len(live):
            free = live[~self.used[slot[live]]]
            taken, who = np.unique(slot[free], return_index=True)
            won = free[who]
            self.first[taken], self.second[taken], self.at[taken], self.size[taken] = a[won], b[won], at[won], sizes[won]
            self.used[taken] = True
            done = np.zeros(len(a), bool)
            done[won] = True
            live = live[~done[live]]
            slot[live] = (slot[live] + 1) & mask

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (Latin-1, case folded), without an end id."""
        joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        pieces, sizes = [], np.zeros(len(texts), np.int64)
        for base, block in textvec.blocks(joined):
            start, end, a, b = self._scan(block)
            slot = self.find(a, b)
            if len(missing := np.flatnonzero(slot < 0)):
                if self.count + len(missing) > self.entries:
                    self.reset()
                    missing = np.arange(len(a))
                order = missing[np.lexsort((b[missing], a[missing]))]
                new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
                only = order[new]
                raw = block.tobytes()
                self.insert(a[only], b[only], self.encode([raw[x:y].decode("latin-1") for x, y in zip(start[only].tolist(), end[only].tolist(), strict=True)]))
                slot[missing] = self.find(a[missing], b[missing])
            n, at = self.size[slot].astype(np.int64), self.at[slot]
            before = np.cumsum(n) - n
            pieces.append(self.pool[np.repeat(at - before, n) + np.arange(int(n.sum()))])
            doc = np.searchsorted(bounds, start + base, side="right")
            sizes += np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
        flat = np.concatenate(pieces).tobytes() if pieces else b""
        wide = np.dtype(self.kind).itemsize
        edges = [0, *(np.cumsum(sizes) * wide).tolist()]
        return [flat[x:y] for x, y in zip(edges, edges[1:], strict=False)]

    @staticmethod
    def _scan(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of a block, and their hashes."""
        kind = CLASSES[block]
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(block)]])
        word = kind[start] != 0
        start, end = start[word], end[word]
        power, inverse = textvec._powers(len(block))
        hashes = []
        for table in _TABLES:
            run = np.empty(len(block) + 1, dtype=np.uint64)
            run[0] = 0
            np.cumsum(table[block] * power[: len(block)], out=run[1:])
            hashes.append(textvec.mix((run[end] - run[start]) * inverse[start]))
        return start, end, hashes[0], hashes[1]
