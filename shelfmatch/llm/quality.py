"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (slices of 400 bytes).  Every passage is encoded by a tanh layer,
gated attention weighs the passages, and a logistic unit scores the weighted representation; all
weights are learnt together from document labels (numpy, Adam) on at most ``SAMPLE`` labelled rows.

Defined cases: a null or empty text is one passage without content and gets a score like any other;
repeated doc_ids each get their row; labels with null or without a document teach nothing; without
labels of both kinds every score is the labels' mean (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, chunks, mix, prefix, ranges, words
from .runtime import crc32_of_id, ship

#: Bound of training: labelled rows, each with all passages of its whole text.
SAMPLE = 4000
PASSAGE, HIDDEN, THRESHOLD = 400, 16, 0.3
_GROUPS = [b" ", b"\n\t\r", b".", b",", b"!?", b"%", b"$", b"&", b"#", b"*", b"|", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"\"'`", b"=:;", b"/\\", b"<>{}[]()", b"_-+~^@", bytes(range(128, 192)), bytes(range(192, 256))]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
#: Buckets of words by hash: what a passage is about, beside its characters and the shape of its words.
TOPICS = 32
N_FEATURES = len(_GROUPS) + 1 + 5 + TOPICS


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of a chunk, and the first passage of each document (+ total)."""
    size = np.diff(off)
    per = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    n, k = int(first[-1]), len(_GROUPS) + 1
    doc = np.repeat(np.arange(len(size)), size)
    pid = first[doc] + (np.arange(len(buf)) - off[doc]) // PASSAGE
    x = np.zeros((n, N_FEATURES), np.float32)
    length = np.bincount(pid, minlength=n).astype(np.float32)
    x[:, :k] = np.bincount(pid * k + _CLASS[buf], minlength=n * k).reshape(n, k) / np.maximum(length, 1)[:, None]
    starts, ends, _ = words(buf, off)
    if len(starts):
        h, wp = ranges(prefix(buf), starts, ends), pid[starts]
        count = np.bincount(wp, minlength=n)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (wp[1:] == wp[:-1])
        key = mix(h ^ wp.astype(U64) * U64(0x9E3779B97F4A7C15))
        _, at, times = np.unique(key, return_index=True, return_counts=True)
        some = np.maximum(count, 1)
        x[:, k] = np.bincount(wp, same, n) / some
        x[:, k + 1] = np.bincount(wp[at], minlength=n) / some
        top = np.zeros(n)
        np.maximum.at(top, wp[at], times)
        x[:, k + 2] = top / some
        x[:, k + 3] = np.bincount(wp, ends - starts, n) / some / 10
        x[:, k + 5 :] = np.sqrt(np.bincount(wp * TOPICS + (h >> U64(40)).astype(np.int64) % TOPICS, minlength=n * TOPICS).reshape(n, TOPICS) / some[:, None])
    x[:, k + 4] = np.log1p(length) / 6
    return x, first


def _sum(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, first[:-1], axis=0)


def forward(m: dict, x: np.ndarray, first: np.ndarray) -> tuple:
    x = (x - m["mean"]) / m["std"]
    h = np.tanh(x @ m["w"] + m["b"])
    v, u = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (v * u) @ m["a"]
    size = np.diff(first)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
    a = e / np.repeat(_sum(e, first), size)
    z = _sum(a[:, None] * h, first)
    return x, h, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ m["o"] + m["c"], -30, 30)))


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 200, seed: int = 7) -> dict:
    """Full-batch Adam on the logistic loss of the documents."""
    rng = np.random.default_rng(seed)
    f, n = x.shape[1], HIDDEN
    m = {"mean": x.mean(0), "std": x.std(0) + 1e-3, "w": rng.normal(0, f**-0.5, (f, n)), "b": np.zeros(n), "v": rng.normal(0, n**-0.5, (n, n)), "u": rng.normal(0, n**-0.5, (n, n)), "a": rng.normal(0, n**-0.5, n), "o": rng.normal(0, n**-0.5, n), "c": np.zeros(1)}
    rate = float(y.mean())
    if not len(y) or rate in (0.0, 1.0):
        m["o"][:], m["c"][:] = 0, np.log((len(y) * rate + 0.5) / (len(y) * (1 - rate) + 0.5))
        return m
    keys = ("w", "b", "v", "u", "a", "o", "c")
    first_m, second_m = {k: 0.0 for k in keys}, {k: 0.0 for k in keys}
    size = np.diff(first)
    for t in range(1, rounds + 1):
        xs, h, v, u, a, z, p = forward(m, x, first)
        d = (p - y) / len(y)
        g = {"o": z.T @ d + 1e-4 * m["o"], "c": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * m["o"], size, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(_sum(a * da, first), size))
        g["a"] = (v * u).T @ de
        dg = de[:, None] * m["a"]
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        g["v"], g["u"] = h.T @ dv, h.T @ du
        dh = (a[:, None] * dz + dv @ m["v"].T + du @ m["u"].T) * (1 - h * h)
        g["w"], g["b"] = xs.T @ dh + 1e-4 * m["w"], dh.sum(0)
        for k in keys:
            first_m[k] = 0.9 * first_m[k] + 0.1 * g[k]
            second_m[k] = 0.999 * second_m[k] + 0.001 * g[k] ** 2
            m[k] = m[k] - 0.02 * (first_m[k] / (1 - 0.9**t)) / (np.sqrt(second_m[k] / (1 - 0.999**t)) + 1e-8)
    return m


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, y, and the features (float32 bytes) of all passages."""
    def run(batches):
        for batch in batches:
            ids, ys = batch.column(0), batch.column(2)
            for i, j, buf, off in chunks(batch, "text"):
                x, first = passages(buf, off)
                out = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), ys.slice(i, j - i), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    return docs.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rest: int = 5, not_at: int = 0) -> dict:
    """Learns from at most ``sample`` labelled rows whose crc32(doc_id) mod ``rest`` isn't ``not_at``; an id labelled both ways teaches nothing."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_of_id("doc_id") % rest != not_at))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by the parameter, so small enough to broadcast
    rows = bags(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")).orderBy("doc_id").limit(2 * sample).collect()
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(int)
    return train(np.concatenate(xs) if xs else np.zeros((1, N_FEATURES), np.float32), first if xs else np.array([0, 1]), np.array([r.y for r in rows], float) if xs else np.array([0.5]))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """doc_id and the score of every whole text."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch, "text"):
                p = forward(model, *passages(buf, off))[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p.astype(float))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good) of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", (crc32_of_id("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    model, schema = fit(docs, labels), docs.schema

    def run(batches):
        for batch in batches:
            keep = [forward(model, *passages(buf, off))[-1] >= threshold for _, _, buf, off in chunks(batch, "text")]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, schema)
