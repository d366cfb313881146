"""Best-fit packing by minimum bin slack.

Pieces are packed by length only, so the histogram of lengths (at most ``capacity`` numbers) decides
the bins: the driver fills one bin after another, each with the longest length left and then the
fullest feasible combination of the lengths left, found by a subset-sum dynamic program over a bit
set; the same combination is repeated while its lengths last.  Spark then ranks the pieces of each
length (in salted groups, so a length that a third of all pieces share is no hot group) and gives
each rank its bin and offset.

Defined cases: null and empty texts are one piece of the end id alone; repeated doc_ids are told
apart by their row, so every row's pieces are packed; an empty table gives no rows; extra columns
are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ship, written
from .tokens import id_batches

CAPACITY, END = 2048, 0
#: Pieces in one salted group of a length, at least; a length's groups are as many as the root of its pieces at most.
GROUP = 2000


def fullest(left: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, copies) whose sum is the largest up to room; left: (length, copies there are), longest first."""
    bits, layers = 1, []
    for length, count in left:
        if length > room:
            continue
        before, k, n = bits, 1, min(count, room // length)
        while n:  # copies in powers of two, so any number up to n can be made
            k = min(k, n)
            bits |= bits << length * k
            n -= k
            k *= 2
        bits &= (1 << room + 1) - 1
        if bits != before:
            layers.append((length, count, before))
        if bits >> room & 1:
            break
    best, out = bits.bit_length() - 1, []
    for length, count, before in reversed(layers):
        k = 0
        while not before >> best & 1:
            best, k = best - length, k + 1
        if k:
            out.append((length, k))
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies in the bin)]) in the order of filling; every piece is used once."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    order = sorted(left, reverse=True)
    if order and (order[0] > capacity or order[-1] < 1):
        raise ValueError("a length is outside 1 to the capacity")
    while left:
        order = [k for k in order if k in left]
        seed = order[0]
        left[seed] -= 1
        chosen = dict(fullest([(k, left[k]) for k in order if left[k]], capacity - seed))
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, sorted(chosen.items(), reverse=True)))
    return out


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, copies in a bin, offset in the bin) in order of rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for times, chosen in bins:
        offset = 0
        for length, n in chosen:
            out.setdefault(length, []).append((used.get(length, 0), base, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, cut in id_batches(path, batches, end):
            wide, sizes = ids.astype("<u4"), np.diff(cut)
            per = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(per)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = cut[doc] + start
            sums = [zlib.crc32(wide[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(doc)), *(pa.array(c, t) for c, t in zip((piece, start, length, sums), types[1:]))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows of lengths 1 to capacity; the rows must be stored (they are read twice)."""
    ship(items.sparkSession)
    histogram = {r[length]: r["count"] for r in items.groupBy(length).count().collect()}  # at most ``capacity`` rows
    where = places(plan(histogram, capacity))
    names, salt, salts, n, inside, rank = items.columns, *(f"__pack_{x}" for x in ("salt", "salts", "n", "inside", "rank"))
    groups = [(k, -(-v // max(GROUP, math.isqrt(v)))) for k, v in histogram.items()]
    groups = items.sparkSession.createDataFrame(groups, f"`{length}` {items.schema[length].dataType.simpleString()}, {salts} long")
    salted = items.join(F.broadcast(groups), length).withColumn(salt, F.pmod(F.xxhash64(*order), F.col(salts)))
    before = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(length, salt).agg(F.count(F.lit(1)).alias(n)).withColumn(rank, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    within = F.row_number().over(Window.partitionBy(length, salt).orderBy(*order)) - 1
    ranked = salted.withColumn(inside, within.cast("long")).join(sizes, [length, salt]).select(*names, (F.col(inside) + F.col(rank)).alias(rank))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(length)).to_numpy().astype(np.int64)
            order_ = batch.column(batch.schema.get_field_index(rank)).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            by = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[by])) + 1
            for at in np.split(by, cuts) if len(by) else []:
                n = int(size[at[0]])
                table = where[n]
                row = table[np.searchsorted(table[:, 0], order_[at], "right") - 1]
                nth = order_[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, path, capacity, end)), capacity)
