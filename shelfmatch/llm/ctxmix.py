"""Adaptive context-mixing range coder for token ids, vectorised over the lanes of a block.

A block of ids is cut into lanes of equal length that are coded in step, all by one model that
learns from every lane.  Each id is coded in one interval of a mixed distribution: the order-2
context's predicted id, the order-1 context's predicted id, and the adaptive order-0 distribution
share the range by weights that are learnt for the pair of prediction confidences.  The coder is a
carry-less range coder with 64-bit state and 32-bit output.  All tables start anew in each block, so
blocks decode independently; a crc32 guards the coded bytes and one the ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U64 = np.uint64
LANES, STEPS = 4096, 256
BLOCK = LANES * STEPS
_K2, _K0 = 24, 18  # bits of the mixture's range and of the order-0 table's
_ALL, _ORDER0 = 1 << _K2, 1 << _K0
_SLOTS = 18  # bits of the order-2 table
_MAGIC = b"CMX1"
_HEAD = struct.Struct("<4sIIIIII")
_TOP = U64(1) << U64(32)
_LOW = U64(0xFFFFFFFF)
_32, _24, _18 = U64(32), U64(_K2), U64(_K0)
#: Confidence after a miss and after a hit, and whether the slot keeps its id.
_DOWN, _UP = np.array([0, 0, 1, 1, 2, 2, 3, 3]), np.array([1, 2, 3, 4, 5, 6, 7, 7])
_NEXT = np.stack([_DOWN, _UP], 1).reshape(-1).astype(np.int64) << 16


class _Model:
    def __init__(self, vocab: int, lanes: int, decode: bool) -> None:
        self.vocab, self.decode = vocab, decode
        self.t2 = np.zeros(1 << _SLOTS, np.int64)
        self.t1 = np.zeros(vocab, np.int64)
        self.stats = np.ones((128, 3), np.int64)
        self.stats[:, 2] = 6
        self.count = np.zeros(vocab, np.int64)
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.recent: list[np.ndarray] = []
        self.base = np.arange(vocab + 1, dtype=np.int64)
        self.step = 0
        self.c0 = self.base.astype(U64)

    def begin(self) -> None:
        """Tables for the coming step, from what all lanes have seen."""
        s = self.step
        if s % 32 == 0 or s in (1, 2, 4, 8, 16):
            if self.recent:
                self.count += np.bincount(np.concatenate(self.recent), minlength=self.vocab)
                self.recent = []
            seen = np.cumsum(self.count)
            total = max(int(seen[-1]), 1)
            c0 = self.base.copy()
            c0[1:] += seen * (_ORDER0 - self.vocab) // total
            if not seen[-1]:  # nothing is known yet: all ids alike
                c0 = self.base * (_ORDER0 // self.vocab)
            c0[-1] = _ORDER0
            self.c0 = c0.astype(U64)
            if self.decode:
                self.find = np.repeat(np.arange(self.vocab), np.diff(c0))
        st = self.stats
        total = st.sum(1)
        scale = _ALL - 2 * _ORDER0
        self.f2 = (1 + st[:, 0] * scale // total).astype(U64)
        self.f12 = self.f2 + (1 + st[:, 1] * scale // total).astype(U64)
        self.h = ((self.p1 * 0x9E3779B1 + self.p2 * 0x85EBCA6B) >> 11) & ((1 << _SLOTS) - 1)
        s2, s1 = self.t2[self.h], self.t1[self.p1]
        self.c2, self.c1 = s2 & 0xFFFF, s1 & 0xFFFF
        self.n2, self.n1 = s2 >> 16, s1 >> 16
        self.ctx = self.n2 * 8 + self.n1 + ((self.c1 == self.c2) << 6)
        self.a2, self.a12 = self.f2[self.ctx], self.f12[self.ctx]
        self.rest = U64(_ALL) - self.a12

    def learn(self, t: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        outcome = np.where(hit2, 0, 2 - hit1)
        self.stats += np.bincount(self.ctx * 3 + outcome, minlength=384).reshape(128, 3)
        real1 = self.c1 == t
        self.t2[self.h] = np.where(hit2 | (self.n2 > 0), self.c2, t) | _NEXT[self.n2 * 2 + hit2]
        self.t1[self.p1] = np.where(real1 | (self.n1 > 0), self.c1, t) | _NEXT[self.n1 * 2 + real1]
        self.recent.append(t)
        self.p2, self.p1 = self.p1, t
        self.step += 1


def _narrow(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Lanes whose range is small, and their settled upper 32 bits; both states are shifted in place."""
    at = np.flatnonzero(rng < _TOP)
    if not len(at):
        return at, None
    lo, rg = low[at], rng[at]
    crosses = ((lo ^ (lo + rg - U64(1))) >> _32) != 0
    if crosses.any():
        rg = np.where(crosses, _TOP - (lo & _LOW), rg)
    low[at], rng[at] = lo << _32, rg << _32
    return at, lo >> _32


def encode(ids: np.ndarray, vocab: int = 1 << 16) -> bytes:
    """One block: at most BLOCK ids below vocab."""
    n = len(ids)
    if n > BLOCK or (n and int(ids.max()) >= vocab):
        raise ValueError("too many ids, or an id beyond the vocabulary")
    lanes = max(1, min(LANES, n >> 8))
    steps = -(-n // lanes)
    x = np.zeros(lanes * steps, np.int64)
    x[:n] = ids
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    m = _Model(vocab, lanes, False)
    low, rng = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    who: list[np.ndarray] = []
    what: list[np.ndarray] = []
    for s in range(steps):
        t = x[s]
        m.begin()
        hit2 = m.c2 == t
        hit1 = (m.c1 == t) & ~hit2
        a = m.c0[t] * m.rest >> _18
        b = m.c0[t + 1] * m.rest >> _18
        start = np.where(hit2, U64(0), np.where(hit1, m.a2, m.a12 + a))
        size = np.where(hit2, m.a2, np.where(hit1, m.a12 - m.a2, b - a))
        r = rng >> _24
        low += r * start
        rng = r * size
        at, words = _narrow(low, rng)
        if words is not None:
            who.append(at.astype(np.uint16))
            what.append(words.astype("<u4"))
        m.learn(t, hit2, hit1)
    last = ((low + _LOW) >> _32).astype("<u4")  # a value within the range whose lower 32 bits are 0
    # the decoder reads two words a lane at first and then one at each narrowing: put them in that order
    lane = np.concatenate(who) if who else np.zeros(0, np.uint16)
    word = np.concatenate(what) if what else np.zeros(0, "<u4")
    count = np.bincount(lane, minlength=lanes)
    size = count + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(lane, kind="stable")
    rank = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
    full = np.zeros(begin[-1], "<u4")
    full[begin[:-1][lane[order]] + rank] = word[order]
    full[begin[:-1] + count] = last
    later = np.zeros(len(lane), "<u4")
    later[order] = full[begin[:-1][lane[order]] + rank + 2]
    body = full[begin[:-1]].tobytes() + full[begin[:-1] + 1].tobytes() + later.tobytes()
    return _HEAD.pack(_MAGIC, n, lanes, vocab, len(body), zlib.crc32(body), zlib.crc32(np.ascontiguousarray(ids, "<u2").tobytes())) + body


def decode(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Ids (uint16) of the block at a byte, and the byte after it; ValueError where a checksum differs."""
    magic, n, lanes, vocab, size, check, ids_check = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    body = data[at : at + size]
    if magic != _MAGIC or len(body) != size or zlib.crc32(body) != check:
        raise ValueError("damaged block")
    steps = -(-n // lanes)
    words = np.frombuffer(body, "<u4").astype(U64)
    code = words[:lanes] << _32 | words[lanes : 2 * lanes]
    p = 2 * lanes
    m = _Model(vocab, lanes, True)
    low, rng = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    x = np.zeros((steps, lanes), np.int64)
    for s in range(steps):
        m.begin()
        r = rng >> _24
        v = np.minimum((code - low) // r, U64(_ALL - 1))
        miss = v >= m.a12
        w = np.where(miss, v - m.a12, U64(0))
        u = ((((w + U64(1)) << _18) - U64(1)) // m.rest).astype(np.int64)
        t = m.find[u]
        a = m.c0[t] * m.rest >> _18
        b = m.c0[t + 1] * m.rest >> _18
        first = v < m.a2
        t = np.where(miss, t, np.where(first, m.c2, m.c1))
        start = np.where(miss, m.a12 + a, np.where(first, U64(0), m.a2))
        size_ = np.where(miss, b - a, np.where(first, m.a2, m.a12 - m.a2))
        low += r * start
        rng = r * size_
        narrowed, gone = _narrow(low, rng)
        if gone is not None:
            code[narrowed] = code[narrowed] << _32 | words[p : p + len(narrowed)]
            p += len(narrowed)
        hit2 = m.c2 == t
        m.learn(t, hit2, (m.c1 == t) & ~hit2)
        x[s] = t
    ids = x.T.reshape(-1)[:n].astype("<u2")
    if zlib.crc32(ids.tobytes()) != ids_check:
        raise ValueError("decoded ids differ")
    return ids, at + size
