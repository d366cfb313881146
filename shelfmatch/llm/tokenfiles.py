"""Binary token files: ids of all documents in ascending doc_id order, coded by ``ctxmix``.

A file holds blocks one after another.  A block has a header (magic, number of index entries, bytes
of the index, their crc32), an index of (doc_id, ids in this block, 1 if the document began in an
earlier block) and the coded ids with their own checksums, and decodes alone.  Documents are dealt
to buckets by quantiles of doc_id, a bucket's rows are sorted and written by one task, and a file is
closed at a document's end after ``FILE_IDS`` ids, so files stay small enough to be read whole.

Defined cases: null and empty texts are the end id alone; repeated doc_ids stand next to each other
in the order of their ids; a null doc_id counts as the smallest; an empty table gives no files and
no rows; extra columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ctxmix
from .runtime import shared_dir, ship, written
from .tokens import id_batches

VOCAB, END = 49_408, 1
FILE_IDS, BUCKET_DOCS = 8 << 20, 50_000
_MAGIC = b"TOKF"
_HEAD = struct.Struct("<4sIII")
_ENTRY = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("more", "u1"), ("null", "u1")])


def block(entries: list[tuple[int | None, int, int]], ids: np.ndarray, vocab: int = VOCAB) -> bytes:
    index = np.array([(d or 0, n, more, d is None) for d, n, more in entries], _ENTRY).tobytes()
    return _HEAD.pack(_MAGIC, len(entries), len(index), zlib.crc32(index)) + index + ctxmix.encode(ids, vocab)


def blocks(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, ids) of each block of a file; ValueError where a checksum differs."""
    at = 0
    while at < len(data):
        magic, n, size, check = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        index = data[at : at + size]
        if magic != _MAGIC or zlib.crc32(index) != check or n * _ENTRY.itemsize != size:
            raise ValueError("damaged index")
        ids, at = ctxmix.decode(data, at + size)
        yield np.frombuffer(index, _ENTRY), ids


class _Writer:
    """Files of one bucket; each is written under another name and then renamed, so a repeated task leaves whole files."""

    def __init__(self, folder: str, bucket: int) -> None:
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.bucket, self.part, self.done = bucket, 0, []
        self._new()

    def _new(self) -> None:
        self.coded, self.entries, self.ids, self.held, self.total, self.docs = [], [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = ids[at : at + ctxmix.BLOCK - self.held]
            self.entries.append((doc_id, len(take), int(at > 0)))
            self.ids.append(take)
            self.held += len(take)
            at += len(take)
            if self.held == ctxmix.BLOCK:
                self._block()
        self.total += len(ids)
        self.docs += 1
        if self.total >= FILE_IDS:
            self.close()

    def _block(self) -> None:
        if self.held:
            self.coded.append(block(self.entries, np.concatenate(self.ids)))
        self.entries, self.ids, self.held = [], [], 0

    def close(self) -> None:
        self._block()
        if self.total:
            name = f"{self.folder}/{self.bucket:08d}-{self.part:06d}.tok"
            source = f"{name}.{uuid.uuid4().hex}.part"
            with self.fs.open_output_stream(source) as out:
                for b in self.coded:
                    out.write(b)
                held = out.tell()
            # the same rows give the same bytes, so whichever attempt renames last leaves the same file
            self.fs.move(source, name)
            self.done.append((self.bucket, self.part, self.docs, self.total, held))
            self.part += 1
        self._new()


def write(docs: DataFrame, path: str, folder: str, end: int = END) -> DataFrame:
    """Writes the files; returns their list (bucket, part, docs, ids, bytes) as a written table."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_DOCS))
    bounds = np.array(sorted(set(docs.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets))) if n and buckets > 1 else [], float)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, cut in id_batches(path, batches, end):
            bucket = np.searchsorted(bounds, np.array([-np.inf if r is None else r for r in rows.to_pylist()]), "right")
            coded = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((cut * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), rows, coded], ["bucket", "doc_id", "ids"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, writer = ["bucket", "part", "docs", "ids", "bytes"], None
        for batch in batches:
            out = []
            for b, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if writer is None or writer.bucket != b:
                    if writer:
                        writer.close()
                        out += writer.done
                    writer = _Writer(folder, b)
                writer.add(i, np.frombuffer(x.as_py(), "<u2"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
        if writer:
            writer.close()
            if writer.done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*writer.done)], names)

    coded = docs.mapInArrow(encode, "bucket int, doc_id long, ids binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    return written(coded.mapInArrow(files, "bucket long, part long, docs long, ids long, bytes long"))


def read(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6
        names = ["bucket", "part", "doc_id", "at", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                bucket, part = map(int, name.rsplit("/", 1)[-1][:-4].split("-"))
                out, at = [], 0
                for index, ids in blocks(content.as_py()):
                    cut = np.concatenate([[0], np.cumsum(index["n"], dtype=np.int64)])
                    wide = ids.astype("<u4")
                    for k, e in enumerate(index):
                        x = wide[cut[k] : cut[k + 1]]
                        if e["more"]:
                            d, a, m, c = out[-1]
                            out[-1] = (d, a, m + len(x), zlib.crc32(x, c))
                        else:
                            out.append((None if e["null"] else int(e["doc_id"]), at, len(x), zlib.crc32(x)))
                        at += len(x)
                if out:
                    d, a, m, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([bucket] * len(out), [part] * len(out), d, a, m, c), types)], names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content").mapInArrow(run, "bucket long, part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # ids before a file: those of earlier groups of buckets, then those of earlier files in the group
    group = (F.col("bucket") / 1024).cast("long")
    grouped = listed.withColumn("group", group)
    totals = grouped.groupBy("group").agg(F.sum("ids").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.coalesce(F.sum("ids").over(Window.partitionBy("group").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = grouped.withColumn("inner", inner).join(totals, "group").select("bucket", "part", (F.col("inner") + F.col("earlier")).alias("before"))
    return found.join(offsets, ["bucket", "part"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes all documents' ids to files in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    listed = write(docs, path, folder)
    if listed.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, listed)
