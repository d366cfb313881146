"""Exact substring removal: suffixes ordered through 50 bytes by most-significant-digit passes (see ``repeats``).

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.

Defined cases: null and empty texts have no bytes; rows with the same doc_id don't count against each
other; a row with a null doc_id stays whole and takes nothing from others; an empty table gives no
rows; matches never cross documents; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Bytes, digest, keyed, repeated_spans, with_spans

WIDTH, GRAM = 50, 20


def removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Keyed rows (doc_id, k, text) with whole and spans."""
    rows = keyed(docs)
    return with_spans(rows, repeated_spans(rows.where("doc_id is not null"), Bytes(width, gram)))


def _cut(text: bytes, whole: bool, spans: bytes | None, width: int) -> tuple[bytes, int, int]:
    """What is left, bytes removed, spans removed."""
    if whole and len(text) >= width:
        return b"", len(text), 1
    if whole or spans is None:
        return text, 0, 0
    s = np.frombuffer(spans, "<i8").reshape(-1, 2)
    edges = [0, *s.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), int((s[:, 1] - s[:, 0]).sum()), len(s)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    def run(batches):
        for batch in batches:
            rows = []
            for t, w, s in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                text = t.as_py().encode()
                kept, n, m = _cut(text, bool(w), s.as_py(), width)
                rows.append((len(text), n, m, digest(kept)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed(docs, width, gram).select("doc_id", "text", "whole", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The rows of docs with what is left of each text (a cut inside a character drops its other bytes too); n_chars follows."""
    rows = keyed(docs.withColumn("__row", F.struct("*")), "__row")
    schema, counted = docs.schema, "n_chars" in docs.columns
    spans = repeated_spans(rows.where("doc_id is not null").drop("__row"), Bytes(width, gram))
    joined = with_spans(rows, spans).select(*(F.col("__row")[c].alias(c) for c in docs.columns), F.col("whole").alias("__repeat_whole"), F.col("spans").alias("__repeat_spans"))

    def run(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(f)) for f in schema.names]
            text, whole, found = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "__repeat_whole", "__repeat_spans"))
            out = [None if t.as_py() is None else _cut(t.as_py().encode(), bool(w), s.as_py(), width)[0].decode("utf-8", "ignore") for t, w, s in zip(text, whole.to_pylist(), found)]
            at = schema.names.index("text")
            cols[at] = pa.array(out, cols[at].type)
            if counted:
                at = schema.names.index("n_chars")
                cols[at] = pa.array([None if t is None else len(t) for t in out], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return joined.mapInArrow(run, schema)
