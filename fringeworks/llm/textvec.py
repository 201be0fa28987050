"""Vectorised word scanning over UTF-8 bytes: no Python object per word.

A word is a run of bytes outside space and 09-0D.  Its 64-bit hash is a
polynomial over a fixed random byte table, evaluated for all words of a block
by one running sum; arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240611)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _i in range(65, 91):
    _TABLE[_i] = _TABLE[_i + 32]  # A-Z hash as a-z
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BLOCK = 1 << 18
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) <= n:
        size = max(n + 1, BLOCK + 4096)
        _pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]), dtype=np.uint64)
        _inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE_INV)]), dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _scan(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, word hashes and the running sum for one block."""
    word = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    pw, inv = _powers(len(buf))
    run = np.empty(len(buf) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(_TABLE[buf] * pw[: len(buf)], out=run[1:])
    return starts, ends, mix((run[ends] - run[starts]) * inv[starts]), run


def blocks(buf: np.ndarray):
    """Cut a long buffer at white space, so that no word is split; a word longer
    than a block extends it."""
    at, n = 0, len(buf)
    while at < n:
        seen, end = at, min(n, at + BLOCK)
        while end < n:
            back = np.flatnonzero(SPACE[buf[seen:end]])
            if len(back):
                end = seen + int(back[-1]) + 1
                break
            seen, end = end, min(n, end + BLOCK)
        yield at, buf[at:end]
        at = end


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words of a buffer, ASCII letters folded."""
    found = [(s + at, e + at, h) for at, b in blocks(buf) for s, e, h, _ in [_scan(b)]]
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def prefix_hashes(buf: np.ndarray, lengths: tuple[int, ...], strip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, order number of the length) of the words' first n bytes for each n, and
    the number of words.  Length 0 stands for the whole word.  ``strip``: byte
    table; bytes marked there count as white space."""
    out, kinds, total = [], [], 0
    for _, b in blocks(buf):
        if strip is not None:
            b = np.where(strip[b], np.uint8(32), b)
        s, e, h, run = _scan(b)
        total += len(s)
        _, inv = _powers(len(b))
        for k, n in enumerate(lengths):
            if n == 0:
                out.append(h)
                kinds.append(np.full(len(h), k))
            else:
                ok = e - s >= n
                p = s[ok]
                g = mix((run[p + n] - run[p]) * inv[p] + np.uint64(n))
                out.append(g)
                kinds.append(np.full(len(g), k))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    return np.concatenate(out), np.concatenate(kinds), total


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string or binary array without nulls, no copy."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    return offsets.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
