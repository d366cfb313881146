"""Vectorised hashing of words and byte windows over UTF-8 buffers (numpy).

Everything here works on one *chunk*: the concatenated bytes of some whole documents with the
offsets of each.  A 64-bit polynomial prefix hash gives the hash of any byte range in O(1), so the
words, word n-grams and byte windows of a chunk are hashed without a Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = _SEED.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes 0x20 and 0x09 to 0x0D divide words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow = {"n": 0, "up": None, "down": None}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the result."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _pow[name] = np.multiply.accumulate(p)
        _pow["n"] = size
    return _pow["up"], _pow["down"]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the byte polynomial: n + 1 values."""
    up, _ = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=c[1:])
    return c


def ranges(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [start, end)."""
    _, down = _powers(len(c))
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64) * _GRAM[63])


def windows(c: np.ndarray, width: int) -> np.ndarray:
    """Hash of every byte window of the width, at each start of the buffer."""
    n = max(0, len(c) - width)
    _, down = _powers(len(c))
    return mix((c[width:] - c[:n]) * down[:n] + np.array([width], U64) * _GRAM[63])


def words(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words (white space is ``between`` them), and for each document its first word's index (+ total)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = between[buf]
    head = ~space
    head[1:] &= space[:-1]
    tail = ~space
    tail[:-1] &= space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    head[inner] = ~space[inner]  # words never cross documents
    tail[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes."""
    m = max(0, len(h) - n + 1)
    g = np.zeros(m, U64)
    for i in range(n):
        g += (h[i : i + m] ^ _GRAM[i]) * _GRAM[i + 20 if i < 40 else i]
        g = (g << U64(7)) ^ (g >> U64(57)) ^ g if i % 4 == 3 else g
    return mix(g)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    m, width = v, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < w:
        rest = w - width
        m = np.minimum(m[: len(m) - rest], m[rest:])
    return m


def anchors(h: np.ndarray, w: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Winnowing: ascending positions that hold the minimum of some window of w consecutive hashes.

    Only windows inside one document count: document i owns positions first[i] to last[i] (exclusive).
    Equal windows of hashes choose the same offset, wherever they stand.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    assert len(h) < 1 << 26
    packed = (h & ~U64((1 << 26) - 1)) | np.arange(len(h), dtype=U64)
    m = (sliding_min(packed, w) & U64((1 << 26) - 1)).astype(np.int64)
    ok = np.zeros(len(m) + 1, np.int32)
    wide = last - first >= w
    np.add.at(ok, first[wide], 1)
    np.add.at(ok, last[wide] - w + 1, -1)
    m = m[np.cumsum(ok[:-1]) > 0]
    return np.unique(m) if len(m) else m


def chunks(batch: pa.RecordBatch, column: str, size: int = 1 << 20):
    """Yields (row from, row to, bytes, offsets) over whole rows of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_string()) if not pa.types.is_null(col.type) else col.cast(pa.large_string()), "")
    if not len(col):
        return
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
