"""Repeated windows of bytes or words over a whole corpus, by radix passes over sampled suffixes.

Two windows of T units are equal only if the same gram of k units stands at the same place in both.
Winnowing chooses in every window such a gram (the smallest hash), so of all suffixes only those in
reach of a chosen gram that recurs need ordering, and only through T units:

1. Deal: chosen grams go to buckets by the leading bits of their hash, each with a print of its
   context, all units that windows around it can hold.  A gram of one document alone drops out.
   Places with equal contexts form one variant: all but its first are repeats in every window.  A
   map task tells this of its own documents at once and deals out only the first of them, so a
   passage that a third of all documents hold is one record for each few thousand documents.
2. Order: the first places of grams with several variants send their contexts.  The suffixes that
   start in them are ordered by most-significant-digit passes over their units (eight bytes a pass),
   the next digit only inside groups with more than one document.  Groups that are still equal after
   T units are exactly the repeated windows.
3. Merge: repeats of a document come together by its block and are merged into spans.

Identical documents are folded before.  Texts of more than ``LONG`` bytes are cut into pieces that
overlap by T - 1 units, so every window lies in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import _BASE, _BASE_INV, _GRAM, SPACE, U64, anchors, chunks, grams, mix, prefix, ranges, windows, words
from .runtime import join_by_size, released, ship, written

#: Variants of a gram above which its windows are grouped one by one; variants ordered at once.
HOT, ORDERED = 20_000, 20_000
#: Bytes of text hashed at once; of a text above which it is cut; of text between two deals; of a block's texts; of text for each bucket.
CHUNK, LONG, DEAL, BLOCK, BUCKET = 1 << 19, 1 << 20, 8 << 20, 4 << 20, 32 << 20
#: Buckets at least: so many at every small size, so that rows grow with the input alone.
BUCKETS = 1024
_MARK = [("doc", "<i8"), ("k", "<u2"), ("lo", "<u4"), ("end", "<u4")]
_RECORD = [("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("k", "<u2"), ("at", "<u4"), ("left", "u1"), ("right", "u1")]
_REQUEST = [("gram", "<u8"), ("doc", "<i8"), ("k", "<u2"), ("at", "<u4"), ("left", "u1"), ("right", "u1")]
_DEALT, _FOUND = "bucket int, block int, n int, data binary", "kind int, block int, n int, data binary"
MARKS, REQUESTS = 0, 1


class Bytes:
    """Windows of bytes; windows of one document never count for that document itself."""

    within = False

    def __init__(self, width: int, gram: int) -> None:
        if not 8 <= gram <= width:
            raise ValueError("a gram has 8 bytes at least, and no more than a window")
        self.width, self.gram, self.reach = width, gram, width - gram + 1

    def sequence(self, buf: np.ndarray, off: np.ndarray):
        """Hashes of all grams, first unit of each document (+ total), and what ``context`` needs."""
        c = prefix(buf)
        return windows(c, self.gram), off, c

    def context(self, state, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the units of the windows that start from lo to hi."""
        return ranges(state, lo, hi + self.width)

    def pieces(self, buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(units before, text) of the pieces of a long text."""
        for a in range(0, len(buf), CHUNK):
            yield a, buf[a : a + CHUNK + self.width - 1]

    def slices(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """The text of the windows that start from lo to hi, for places of one document."""
        return [buf[a : b + self.width].tobytes() for a, b in zip(lo.tolist(), hi.tolist())]

    def digits(self, content: list[bytes], shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable]:
        """Rows and columns (windows by their place at the gram) that exist, and digit d of some of them; None after the last."""
        size = self.width + self.reach - 1
        m = np.zeros((len(content), size), np.uint8)
        n = np.array([len(b) for b in content], np.int64)
        col = np.arange(size)
        m[(col >= shift[:, None]) & (col < (shift + n)[:, None])] = np.frombuffer(b"".join(content), np.uint8)
        eight = np.zeros((len(content), size - 7), U64)
        for i in range(8):
            eight = eight << U64(8) | m[:, i : size - 7 + i]
        row, col = np.nonzero((col[: self.reach] >= shift[:, None]) & (col[: self.reach] <= (shift + n)[:, None] - self.width))
        starts = [*range(0, self.width - 8, 8), self.width - 8]
        return row, col, lambda d, r, c: eight[r, c + starts[d]] if d < len(starts) else None

    def keys(self, content: list[bytes], shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Rows, columns and whole units of the windows."""
        row, col, out = [], [], []
        for i, (b, s) in enumerate(zip(content, shift.tolist())):
            for j in range(len(b) - self.width + 1):
                row.append(i)
                col.append(s + j)
                out.append(b[j : j + self.width])
        return np.array(row, np.int64), np.array(col, np.int64), out


class Words:
    """Windows of white-space words; an earlier place in the same document counts too."""

    within = True

    def __init__(self, width: int, gram: int) -> None:
        self.width, self.gram, self.reach = width, gram, width - gram + 1

    def sequence(self, buf: np.ndarray, off: np.ndarray):
        starts, ends, first = words(buf, off)
        h = ranges(prefix(buf), starts, ends)
        return grams(h, self.gram), first, self.sums(h)

    def sums(self, h: np.ndarray) -> np.ndarray:
        """What ``context`` needs of word hashes."""
        up, _ = _powers(len(h) + 1)
        return np.concatenate([np.zeros(1, U64), np.cumsum(mix(h) * up[: len(h)], dtype=U64)])

    def context(self, state, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        _, down = _powers(len(state) + 1)
        return mix((state[hi + self.width] - state[lo]) * down[lo] + (hi - lo).astype(U64) * _GRAM[62])

    def pieces(self, buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        a = base = 0
        while a < len(buf):
            b = space_after(buf, min(len(buf), a + CHUNK))
            tail, size = 0, 1 << 12
            while b + tail < len(buf):  # so many words more that every window that starts before b is whole
                starts, ends, _ = words(buf[b : b + size], np.array([0, min(size, len(buf) - b)]))
                if len(starts) >= self.width:
                    tail = int(ends[self.width - 2])
                    break
                tail = min(size, len(buf) - b)
                size *= 2
            yield base, buf[a : b + tail]
            base += len(words(buf[a:b], np.array([0, b - a]))[0])
            a = b

    def slices(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        starts, ends, _ = words(buf, np.array([0, len(buf)]))
        return [buf[a:b].tobytes() for a, b in zip(starts[lo].tolist(), ends[hi + self.width - 1].tolist())]

    def _hashes(self, content: list[bytes], shift: np.ndarray):
        buf = np.frombuffer(b"".join(content), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(b) for b in content])]).astype(np.int64)
        starts, ends, first = words(buf, off)
        g = grams(ranges(prefix(buf), starts, ends), self.width)
        n = np.maximum(np.diff(first) - self.width + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, nth + shift[row], g[first[row] + nth]

    def digits(self, content: list[bytes], shift: np.ndarray):
        row, col, g = self._hashes(content, shift)
        m = np.zeros((len(content), self.reach), U64)
        m[row, col] = g
        return row, col, lambda d, r, c: m[r, c] if d == 0 else None

    def keys(self, content: list[bytes], shift: np.ndarray):
        row, col, g = self._hashes(content, shift)
        return row, col, [x.to_bytes(8, "little") for x in g.tolist()]


def space_after(buf: np.ndarray, at: int) -> int:
    """The first white space from a place on, or the end."""
    while at < len(buf):
        some = SPACE[buf[at : at + 4096]]
        if some.any():
            return at + int(some.argmax())
        at += len(some)
    return at


_held: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(max(n, 1 << 18), base, U64)
            p[0] = 1
            _held[name] = np.multiply.accumulate(p)
    return _held["up"], _held["down"]


def packed(columns: list[np.ndarray], kinds: list) -> bytes:
    """Columns as planes of bytes, compressed."""
    planes = [np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, (_, t) in zip(columns, kinds)]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kinds: list) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for _, t in kinds]
    raw, at, out = np.frombuffer(pa.decompress(data, n * sum(sizes), "zstd"), np.uint8), 0, []
    for (_, t), size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


def merged(doc: np.ndarray, k: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of each document in order; those that meet are one."""
    by = np.lexsort((lo, k, doc))
    doc, k, lo, end = doc[by], k[by], lo[by].astype(np.int64), end[by].astype(np.int64)
    if not len(doc):
        return [doc, k, lo, end]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])])
    number = np.cumsum(other) << 33
    far = np.maximum.accumulate(end + number) - number
    head = other.copy()
    head[1:] |= lo[1:] > far[:-1]
    tail = np.append(head[1:], True)
    return [doc[head], k[head], lo[head], far[tail]]


def rows_of(columns: list[np.ndarray], key: np.ndarray, kinds: list) -> Iterator[tuple[int, int, bytes]]:
    """(key, n, packed) for each key."""
    by = np.argsort(key, kind="stable")
    columns, key = [c[by] for c in columns], key[by]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    for a, b in zip(heads, [*heads[1:], len(key)]):
        yield int(key[a]), int(b - a), packed([c[a:b] for c in columns], kinds)


def blocks_of(doc: np.ndarray, k: np.ndarray, blocks: int) -> np.ndarray:
    return (doc ^ k.astype(np.int64)) % blocks


def texts_of(batch: pa.RecordBatch, unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, units before, bytes, offsets) of some whole texts, or of a piece of a long one."""
    for i, j, buf, off in chunks(batch, "text", CHUNK):
        if j == i + 1 and len(buf) > LONG:
            for base, part in unit.pieces(buf):
                yield np.array([i]), np.array([base]), part, np.array([0, len(part)])
        else:
            yield np.arange(i, j), np.zeros(j - i, np.int64), buf, off


def records(ids: np.ndarray, ks: np.ndarray, base: np.ndarray, unit, h, first, state, at: np.ndarray) -> list[np.ndarray]:
    """The columns of _RECORD for grams at the given places of some texts."""
    doc = np.searchsorted(first, at, "right") - 1
    lo = np.maximum(at - unit.reach + 1, first[doc])
    hi = np.minimum(at, first[doc + 1] - unit.width)
    good = hi >= lo
    at, doc, lo, hi = at[good], doc[good], lo[good], hi[good]
    context = mix(unit.context(state, lo, hi) ^ (at - lo).astype(U64) * _GRAM[61])
    return [h[at], context, ids[doc], ks[doc], at - first[doc] + base[doc], at - lo, at - hi]


def chosen(unit, first: np.ndarray, h: np.ndarray) -> np.ndarray:
    return anchors(h, unit.reach, first[:-1], np.maximum(first[1:] - unit.gram + 1, first[:-1]))


def _joined(held: list) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*held)]


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _later(unit, group: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places of groups (heads of sorted runs) come after their group's first."""
    n = np.diff(np.append(group, len(doc)))
    least = np.repeat(np.minimum.reduceat(doc, group), n)
    if not unit.within:
        return doc > least
    place = np.where(doc == least, at.astype(np.int64), np.int64(1) << 40)
    return (doc > least) | (place > np.repeat(np.minimum.reduceat(place, group), n))


def deal(held: list, unit, buckets: int, blocks: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of _DEALT for a map task's records: marks of what is known to repeat, records of the rest."""
    if not held:
        return
    r = _joined(held)
    if not len(r[0]):
        return
    by = np.argsort(mix(r[0] ^ r[1] * _GRAM[60]), kind="stable")
    r = [c[by] for c in r]
    late = _later(unit, np.flatnonzero(_heads(r[0], r[1])), r[2], r[4])
    _, _, doc, k, at, left, right = [c[late] for c in r]
    m = merged(doc, k, at - left, at - right + unit.width)
    for block, n, data in rows_of(m, blocks_of(m[0], m[1], blocks), _MARK):
        yield block % buckets, block, n, data
    r = [c[~late] for c in r]
    by = np.argsort(r[0])
    r = [c[by] for c in r]
    bucket = ((r[0] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    for b, n, data in rows_of(r, bucket, _RECORD):
        yield b, -1, n, data


def dealt_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["bucket", "block", "n", "data"])


def _found_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["kind", "block", "n", "data"])


def deal_out(docs: DataFrame, unit, buckets: int, blocks: int) -> DataFrame:
    """Pass 1, map side: records of all chosen grams."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, ks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, base, buf, off in texts_of(batch, unit):
                h, first, state = unit.sequence(buf, off)
                held.append(records(ids[rows], ks[rows], base, unit, h, first, state, chosen(unit, first, h)))
                size += len(buf)
                if size >= DEAL:
                    if rows_ := list(deal(held, unit, buckets, blocks)):
                        yield dealt_batch(rows_)
                    held, size = [], 0
        if rows_ := list(deal(held, unit, buckets, blocks)):
            yield dealt_batch(rows_)
        released()

    return docs.select("doc_id", "k", "text").mapInArrow(run, _DEALT)


def by_bucket(batches, kinds: list) -> Iterator[tuple[list, list[np.ndarray]]]:
    """For rows of _DEALT in order of their buckets: rows of marks to pass on, and the joined records of each bucket."""
    bucket, held = None, []
    for batch in batches:
        passed = []
        for b, block, n, data in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
            if block >= 0:
                passed.append((MARKS, block, n, data.as_py()))
                continue
            if b != bucket:
                if held:
                    yield passed, _joined(held)
                    passed = []
                bucket, held = b, []
            held.append(unpacked(data.as_py(), n, kinds))
        if passed:
            yield passed, []
    if held:
        yield [], _joined(held)


def order(dealt: DataFrame, unit, blocks: int) -> DataFrame:
    """Pass 1, bucket side: marks of places that come after an equal context, requests of first places of grams with several contexts."""
    def run(batches):
        for passed, r in by_bucket(batches, _RECORD):
            rows = passed
            if r:
                by = np.argsort(r[0], kind="stable")
                gram, doc = r[0][by], r[2][by]
                head = np.flatnonzero(_heads(gram))
                n = np.diff(np.append(head, len(gram)))
                again = n > 1 if unit.within else np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
                r = [c[by[np.repeat(again, n)]] for c in r]
            if r and len(r[0]):
                by = np.lexsort((r[1], r[0]))
                gram, context, doc, k, at, left, right = [c[by] for c in r]
                new, variant = _heads(gram), _heads(gram, context)
                late = _later(unit, np.flatnonzero(variant), doc, at)
                m = merged(doc[late], k[late], at[late].astype(np.int64) - left[late], at[late].astype(np.int64) - right[late] + unit.width)
                rows += [(MARKS, *x) for x in rows_of(m, blocks_of(m[0], m[1], blocks), _MARK)]
                head = np.flatnonzero(new)
                several = np.repeat(np.add.reduceat(variant.astype(np.int64), head) > 1, np.diff(np.append(head, len(gram)))) & ~late
                ask = [c[several] for c in (gram, doc, k, at, left, right)]
                rows += [(REQUESTS, *x) for x in rows_of(ask, blocks_of(ask[1], ask[2], blocks), _REQUEST)]
            if rows:
                yield _found_batch(rows)
        released()

    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


def _by_block(batches, kinds: list) -> Iterator[list[np.ndarray]]:
    """The joined rows of each block, for rows of _FOUND in order of their blocks."""
    block, held = None, []
    for batch in batches:
        for b, n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if b != block and held:
                yield _joined(held)
                held = []
            block = b
            held.append(unpacked(data.as_py(), n, kinds))
    if held:
        yield _joined(held)


def _per_document(columns: list[np.ndarray], at: int, kinds: list) -> tuple[np.ndarray, np.ndarray, list[int], list[bytes]]:
    """doc_id, k, n and the packed other columns of each document; at: the first of the document's two columns."""
    by = np.lexsort((columns[at + 1], columns[at]))
    columns = [c[by] for c in columns]
    head = np.flatnonzero(_heads(columns[at], columns[at + 1]))
    ends = [*head[1:].tolist(), len(by)]
    rest = [c for i, c in enumerate(columns) if i not in (at, at + 1)]
    return columns[at][head], columns[at + 1][head], [b - a for a, b in zip(head.tolist(), ends)], [packed([c[a:b] for c in rest], kinds) for a, b in zip(head.tolist(), ends)]


def contents(docs: DataFrame, requests: DataFrame, unit) -> DataFrame:
    """gram, doc_id, k, at, shift (windows missing at the start) and content of the requested places."""
    kinds = [x for x in _REQUEST if x[0] not in ("doc", "k")]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def group(batches):
        for r in _by_block(batches, _REQUEST):
            d, k, n, data = _per_document(r, 1, kinds)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k.astype(np.int64)), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["doc_id", "k", "n", "places"])

    def run(batches):
        for batch in batches:
            out = []
            for d, k, text, n, data in zip(*(batch.column(c) for c in range(5))):
                gram, at, left, right = unpacked(data.as_py(), n.as_py(), kinds)
                at = at.astype(np.int64)
                raw = text.as_buffer()
                content = unit.slices(np.frombuffer(raw, np.uint8), at - left, at - right)
                out.append((gram.view(np.int64), np.full(len(at), d.as_py()), np.full(len(at), k.as_py()), at.astype(np.int32), (unit.reach - 1 - left.astype(np.int32)).astype(np.int32), content))
                if sum(len(x[5]) for x in out) > ORDERED:
                    yield _content_batch(out)
                    out = []
            if out:
                yield _content_batch(out)
        released()

    lists = requests.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(group, "doc_id long, k long, n int, places binary")
    found = docs.join(lists, ["doc_id", "k"])  # the lists grow with the input, so they are never broadcast
    return found.select("doc_id", "k", "text", "n", "places").mapInArrow(run, "gram long, doc_id long, k long, at int, shift int, content binary")


def _content_batch(out: list) -> pa.RecordBatch:
    cols = list(zip(*out))
    return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols[:5]), pa.array([b for c in cols[5] for b in c], pa.binary())], ["gram", "doc_id", "k", "at", "shift", "content"])


def equal_windows(gram: np.ndarray, doc: np.ndarray, content: list[bytes], shift: np.ndarray, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and groups of windows that are equal through all digits and stand in several documents (rows, where places count).

    Most significant digit first; a group of one document (row) leaves before the next digit.
    """
    row, col, digit = unit.digits(content, shift)
    number = np.cumsum(_heads(gram)) - 1
    group = number[row] * unit.reach + col
    by = np.argsort(group, kind="stable")
    row, col, group = row[by], col[by], group[by]
    d = 0
    while len(row) and (value := digit(d, row, col)) is not None:
        by = np.lexsort((value, group))
        row, col, group, value = row[by], col[by], group[by], value[by]
        head = _heads(group, value)
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(row)))
        live = n > 1 if unit.within else np.minimum.reduceat(doc[row], at) != np.maximum.reduceat(doc[row], at)
        keep = np.repeat(live, n)
        row, col, group = row[keep], col[keep], (np.cumsum(head) - 1)[keep]
        d += 1
    return row, col, group


def repeats(variants: DataFrame, unit, blocks: int) -> DataFrame:
    """Pass 2: marks (rows of _FOUND) of the windows of first places that occur earlier."""
    def marks(doc, k, at, col):
        lo = at.astype(np.int64) - unit.reach + 1 + col
        m = merged(doc, k, lo, lo + unit.width)
        return [(MARKS, *x) for x in rows_of(m, blocks_of(m[0], m[1], blocks), _MARK)]

    def ordered(t: pa.Table) -> list:
        gram, doc, k, at, shift = (t.column(c).to_numpy() for c in range(5))
        row, col, group = equal_windows(gram, doc, t.column(5).to_pylist(), shift.astype(np.int64), unit)
        if not len(row):
            return []
        late = _later(unit, np.flatnonzero(_heads(group)), doc[row], at[row])
        row, col = row[late], col[late]
        return marks(doc[row], k[row], at[row], col)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > ORDERED:
                t = pa.Table.from_batches(held).combine_chunks()
                gram = t.column(0).to_numpy()
                whole = int(np.flatnonzero(_heads(gram))[-1])  # the last gram may go on
                if whole and (rows := ordered(t.slice(0, whole))):
                    yield _found_batch(rows)
                held, n = t.slice(whole).to_batches(), t.num_rows - whole
        if held and (rows := ordered(pa.Table.from_batches(held).combine_chunks())):
            yield _found_batch(rows)
        released()

    def single(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                row, col, key = unit.keys(b.column(5).to_pylist(), b.column(4).to_numpy().astype(np.int64))
                cols = [b.column(c).to_numpy()[row] for c in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[row]), pa.array(col.astype(np.int32)), pa.array(key, pa.binary()), *map(pa.array, cols)], ["gram", "j", "window", "doc_id", "k", "at"])

    def mark(batches):
        for batch in batches:
            if rows := marks(*(batch.column(c).to_numpy() for c in range(4))):
                yield _found_batch(rows)

    variants = written(variants)
    hot = written(variants.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("gram"))
    tasks = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_gram = lambda v: v.repartition(tasks, "gram").sortWithinPartitions("gram").mapInArrow(run, _FOUND)
    if hot.isEmpty():
        return by_gram(variants)
    each = written(join_by_size(variants, hot, ["gram"], "left_semi", "8").mapInArrow(single, "gram long, j int, window binary, doc_id long, k long, at int"))
    place = F.struct("doc_id", "at") if unit.within else F.col("doc_id")
    first = written(each.groupBy("gram", "j", "window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    late = each.join(first, ["gram", "j", "window"]).where(place > F.col("first")).select("doc_id", "k", "at", "j").mapInArrow(mark, _FOUND)
    return by_gram(join_by_size(variants, hot, ["gram"], "left_anti", "8")).union(late)


def merge(marks: DataFrame) -> DataFrame:
    """Pass 3: (doc_id, k, whole, spans); spans are [from, to) pairs of units, int64."""
    def run(batches):
        for r in _by_block(batches, _MARK):
            doc, k, lo, end = merged(*r)
            head = np.flatnonzero(_heads(doc, k))
            pairs = np.stack([lo, end], 1).astype("<i8")
            spans = [pairs[a:b].tobytes() for a, b in zip(head, [*head[1:], len(doc)])]
            yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(k[head].astype(np.int64)), pa.array([False] * len(head), pa.bool_()), pa.array(spans, pa.binary())], ["doc_id", "k", "whole", "spans"])
        released()

    tasks = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marks.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, "doc_id long, k long, whole boolean, spans binary")


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Numbers of buckets and blocks for so many bytes of text; blocks are odd, so ids in steps spread."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(BUCKETS, -(-total // BUCKET)), total // BLOCK | 1


def repeated_spans(docs: DataFrame, unit, dealt: Callable = deal_out) -> DataFrame:
    """(doc_id, k, whole, spans): whole marks a copy of an earlier document; spans are [from, to) pairs of units, packed int64.

    docs: doc_id (not null), k, text.  dealt makes the records: deal_out from all chosen grams.
    """
    ship(docs.sparkSession)
    prints = docs.select("doc_id", "k", F.xxhash64("text").alias("f1"), F.xxhash64(F.lit(7), "text").alias("f2"), F.octet_length("text").alias("size"))
    firsts = written(prints.groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    copies = written(join_by_size(prints, firsts, ["f1", "f2", "size"], "inner", "16").where("doc_id > first").select("doc_id", "k").distinct())
    own = join_by_size(docs, copies, ["doc_id", "k"], "left_anti", "16")
    buckets, blocks = sizes(own)
    found = written(order(dealt(own, unit, buckets, blocks), unit, blocks))
    late = repeats(contents(own, found.where(f"kind = {REQUESTS}"), unit), unit, blocks)
    spans = merge(found.where(f"kind = {MARKS}").union(late))
    return written(spans.union(copies.select("doc_id", "k", F.lit(True), F.lit(None).cast("binary"))))


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, k, text and others of all rows; a null text is empty.  k tells different texts with the same doc_id apart: 0 for the first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *others)
    pairs = rows.select("doc_id", F.xxhash64("text").alias("f")).where("doc_id is not null")
    several = pairs.groupBy("doc_id").agg(F.min("f").alias("a"), F.max("f").alias("b")).where("a < b").select("doc_id")
    several = written(several)
    if several.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("k"), "text", *others)
    numbered = join_by_size(pairs, several, ["doc_id"], "left_semi", "8").distinct()
    nth = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("f")) - 1
    numbered = written(numbered.withColumn("k", nth.cast("long")))
    if (numbered.agg(F.max("k")).first()[0] or 0) >= 1 << 16:
        raise ValueError("a doc_id has more than 65,536 different texts")
    out = join_by_size(rows.withColumn("f", F.xxhash64("text")), numbered, ["doc_id", "f"], "left", "24")
    return out.select("doc_id", F.coalesce("k", F.lit(0)).alias("k"), "text", *others)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds whole and spans to keyed rows."""
    return join_by_size(rows, spans, ["doc_id", "k"], "left", "coalesce(length(spans), 0)")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
