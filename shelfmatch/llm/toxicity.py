"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A passage (4 words) is the mean of the embeddings of its words' character n-grams (3 to 5 bytes,
with word ends) and whole words, hashed into a table; a linear softmax over it gives toxic or not,
and a document is as toxic as its most toxic passage.  Embeddings and softmax are learnt together
from document labels.  As the softmax is linear, a trained model is one weight for each subword, so
scoring reads one number for each subword.  Misspelt and compounded words share n-grams.

Defined cases: null and empty texts have no subword and get the model's bias as their score; tables
without labels of both kinds give the labels' share (0.5 without any); repeated rows each get a row.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, SPACE, U64, chunks, prefix, ranges, words
from .runtime import crc32_of_id, ship, written

#: Bound of training: labelled texts of each kind, each whole.
SAMPLE = 700
BITS, DIM, WORDS, SIZES, THRESHOLD = 18, 8, 4, (3, 4, 5), 0.7


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and passages of all subwords, and the first passage of each document (+ total)."""
    low = LOWER[buf]
    space = SPACE[low]
    low = np.where(space, np.uint8(32), low)
    starts, ends, wf = words(low, off)
    count = np.diff(wf)
    per = np.maximum(1, -(-count // WORDS))
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(count)), count)
    wp = first[doc] + (np.arange(len(starts)) - wf[doc]) // WORDS
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, first
    # one buffer of the words with a blank at either end: n-grams that hold an inner blank don't count
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)]) + 1
    flat = np.full(to[-1] + 8, 32, np.uint8)
    inner = np.arange(int(size.sum()))
    lead = np.repeat(np.arange(len(size)), size)
    flat[inner + lead + 1] = low[inner - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)]
    owner = np.zeros(len(flat), np.int64)
    owner[to[:-1] - 1] = 1
    owner = np.minimum(np.cumsum(owner) - 1, len(size) - 1)
    blank = flat == 32
    wide = flat.astype(U64)
    n = len(flat) - 8
    out, who = [ranges(prefix(low), starts, ends) >> U64(64 - BITS)], [wp]
    for k in SIZES:
        g, bad = np.zeros(n, U64), np.zeros(n, bool)
        for i in range(k):
            g |= wide[i : i + n] << U64(8 * i)
            if 0 < i < k - 1:
                bad |= blank[i : i + n]
        ok = np.flatnonzero(~bad)
        out.append((g[ok] * U64(0x9E3779B97F4A7C15) + U64(k * 0xD6E8FEB86659FD93 % 2**64)) * U64(0xBF58476D1CE4E5B9) >> U64(64 - BITS))
        who.append(wp[owner[ok]])
    return np.concatenate(out).astype(np.int64), np.concatenate(who), first


class Lessons:
    """The training texts' subwords as int32 buckets, passage by passage, in a temporary file of the driver; only counts stay in memory."""

    def __init__(self) -> None:
        self._file, self._many, self._per, self._y = tempfile.TemporaryFile(), [], [], []

    def add(self, texts: list[str], ys: list[int]) -> None:
        for i, j, buf, off in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text", 1 << 18):
            bucket, passage, first = subwords(buf, off)
            bucket[np.argsort(passage, kind="stable")].astype(np.int32).tofile(self._file)
            self._many.append(np.bincount(passage, minlength=int(first[-1])).astype(np.int32))
            self._per.append(np.diff(first))
            self._y += ys[i:j]

    @property
    def y(self) -> np.ndarray:
        return np.array(self._y, float)

    def slices(self):
        """(documents from, to, subwords from, to, subwords of each passage, passages of each document) of runs of whole documents."""
        d = at = 0
        for many, per in zip(self._many, self._per):
            n = int(many.sum())
            yield d, d + len(per), at, at + n, many, per
            d, at = d + len(per), at + n

    def buckets(self, a: int, b: int) -> np.ndarray:
        self._file.seek(4 * a)
        return np.fromfile(self._file, np.int32, b - a)


def train(lessons: Lessons, rounds: int = 80, seed: int = 11, use: np.ndarray | None = None) -> dict:
    """Embeddings E and softmax W together: the first rounds learn from all passages, later ones mostly from each document's most toxic one.

    Gradients are those of all texts at once, summed over slices of whole documents.  use: 0 leaves a text out.
    """
    y = lessons.y
    use = np.ones(len(y)) if use is None else use
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2)
    rate = float(y[use > 0].mean()) if use.sum() else 0.5
    if rate in (0.0, 1.0) or not len(y):
        p = (len(y) * rate + 0.5) / (len(y) + 1)
        return {"z": np.zeros(1 << BITS, np.float32), "bias": float(np.log(p / (1 - p)))}
    e_sq, w_sq, b_sq = np.full(1 << BITS, 1e-6, np.float32), 1e-6, 1e-6
    for t in range(rounds):
        weight = w[:, 1] - w[:, 0]
        z = e @ weight
        hard = min(80.0, 2.0 + 3.0 * t)  # the pool over passages turns from mean to maximum
        by, gb = np.zeros(1 << BITS), 0.0  # dL/dz of each bucket, dL/db
        for d0, d1, s0, s1, many, per in lessons.slices():
            bucket, passage = lessons.buckets(s0, s1), np.repeat(np.arange(len(many)), many)
            head, many = np.cumsum(per) - per, np.maximum(many, 1)
            s = np.bincount(passage, z[bucket], len(many)) / many
            q = np.exp(hard * (s - np.repeat(np.maximum.reduceat(s, head), per)))
            q /= np.repeat(np.add.reduceat(q, head), per)
            pooled = np.add.reduceat(q * s, head) + b[1] - b[0]
            d = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - y[d0:d1]) * use[d0:d1] / use.sum()
            g = q * np.repeat(d, per) / many  # for each subword of the passage
            rows = (np.abs(g) > 1e-9)[passage]
            by += np.bincount(bucket[rows], g[passage[rows]], 1 << BITS)
            gb += float(d.sum())
        ge = by[:, None] * weight
        gw = e.T @ by
        e_sq += (ge * ge).mean(1)
        e -= (0.6 * ge / np.sqrt(e_sq)[:, None]).astype(np.float32)
        w_sq += float(gw @ gw) / DIM
        step = (0.2 * gw / w_sq**0.5).astype(np.float32)
        w[:, 1] -= step / 2
        w[:, 0] += step / 2
        b_sq += gb * gb
        b += np.array([1, -1]) * 0.1 * gb / b_sq**0.5
    return {"z": e @ (w[:, 1] - w[:, 0]), "bias": float(b[1] - b[0])}


def logits(lessons: Lessons, model: dict) -> np.ndarray:
    """Of every training text."""
    out = [np.zeros(0)]
    for _, _, s0, s1, many, per in lessons.slices():
        s = np.bincount(np.repeat(np.arange(len(many)), many), model["z"][lessons.buckets(s0, s1)], len(many)) / np.maximum(many, 1)
        out.append(np.maximum.reduceat(s, np.cumsum(per) - per) + model["bias"])
    return np.concatenate(out)


def calibrated(lessons: Lessons, threshold: float = THRESHOLD, folds: int = 2) -> dict:
    """A model whose bias puts the threshold where texts that a fold's model hasn't seen are told apart best (by F1).

    A rare kind and short training leave plain scores of toxic texts low.
    """
    model, y = train(lessons), lessons.y
    fold = np.arange(len(y)) % folds
    if len(y) < 2 * folds or min(y.sum(), (1 - y).sum()) < 5 * folds:
        return model
    unseen = np.zeros(len(y))
    for f in range(folds):
        unseen[fold == f] = logits(lessons, train(lessons, rounds=40, use=(fold != f).astype(float)))[fold == f]
    by = np.argsort(-unseen, kind="stable")
    hits = np.cumsum(y[by])
    f = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f))
    cut = float(unseen[by[k : k + 2]].mean())
    return {**model, "bias": model["bias"] + float(np.log(threshold / (1 - threshold))) - cut}


def lessons_of(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, rest: int = 3, not_at: int = 1) -> DataFrame:
    """doc_id, text and y of at most ``sample`` texts of either label whose crc32(doc_id) mod ``rest`` isn't ``not_at``, whole and of any length.

    Chosen are labelled texts that documents hold (not null), equal rows once, so no place goes to a row that can't teach; a
    doc_id that is labelled both ways teaches nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_of_id("doc_id") % rest != not_at)).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("h", F.xxhash64("text"))
    there = written(texts.select("doc_id", "h").distinct().join(known, "doc_id"))
    first = lambda y: there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)
    return texts.join(F.broadcast(first(1).union(first(0))), ["doc_id", "h"]).select("doc_id", "text", "y").distinct()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, rest: int = 3, not_at: int = 1) -> dict:
    """Learns from the texts of lessons_of, which come to the driver one partition after another."""
    ship(docs.sparkSession)
    lessons, texts, ys = Lessons(), [], []
    for r in written(lessons_of(docs, labels, label, sample, rest, not_at)).orderBy("doc_id", "text").toLocalIterator():
        texts.append(r.text)
        ys.append(r.y)
        if sum(map(len, texts)) > 1 << 18:
            lessons.add(texts, ys)
            texts, ys = [], []
    lessons.add(texts, ys)
    return calibrated(lessons)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the score of every whole text."""
    ship(docs.sparkSession)
    z, bias = model["z"].astype(np.float32), model["bias"]

    def run(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch, "text", 1 << 19):
                bucket, passage, first = subwords(buf, off)
                n = int(first[-1])
                s = np.bincount(passage, z[bucket], n) / np.maximum(np.bincount(passage, minlength=n), 1)
                p = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(s, first[:-1]) + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: toxic) of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", (crc32_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
