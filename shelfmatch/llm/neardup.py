"""Near duplicates by bottom-k sketches from one hash function.

Every document keeps the K smallest hashes of its distinct word shingles.  Inverted lists of the
retained values generate overlaps: two sketches of similar documents share at least NEED of their
values, so a document is listed only under the rarest values of which one must be shared (none, where
too few of its values occur elsewhere).  Pairs from the lists pass an estimate on the union's sketch
and are confirmed by the exact Jaccard similarity of the full sets.

Only components are asked for, so the lists are worked off in rounds: each list's pivot is compared with
its other members, twice with other pivots.  A group of thousands of copies costs a few pairs for each
of them.  What is left are members of lists that still hold several components.  Their pairs would be
quadratic in a list, so these members are listed anew by their full sets, rarest shingles first, and
meet only where a common shingle stands as early in both as the pair's sizes call for; that loses no
pair of them.  Identical sets are folded before.

Defined cases: a document without words (or null) has 0 shingles and is linked with nothing; with
fewer words than a shingle, the whole sequence is one; rows with the same doc_id each get the
component of their own text; a null doc_id is linked with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import LOWER, U64, chunks, grams, mix, prefix, ranges, words
from .runtime import join_small, ship, written

SHINGLE, SIMILARITY, K = 4, 0.8, 48
#: Words of a shingle where no contract names another size; SHINGLE is op7's.
STAGE_SHINGLE = 5
#: An estimate below this (at SIMILARITY; it goes down with the similarity) is five standard deviations under it.
NEED, ESTIMATE = K // 2, 0.5


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int):
    """The sorted distinct shingle hashes (int64) of each document of a chunk."""
    low = LOWER[buf]
    starts, ends, wf = words(low, off)
    h = ranges(prefix(low), starts, ends)
    g = grams(h, size).view(np.int64)
    for a, b in zip(wf[:-1], wf[1:]):
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            yield grams(h[a:b], int(b - a)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def sketches(docs: DataFrame, size: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, n (distinct shingles), f1 and f2 (a 128-bit print of the set) and the sketch."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch, "text"):
                n, f1, f2, sk = [], [], [], []
                for s in shingle_sets(buf, off, size):
                    m = mix(s.view(U64))
                    n.append(len(s))
                    f1.append(m.sum(dtype=U64))
                    f2.append(np.bitwise_xor.reduce(m * U64(0x9E3779B97F4A7C15) ^ m >> U64(17)) if len(s) else U64(0))
                    sk.append(s[:k])
                cut = np.concatenate([[0], np.cumsum([len(s) for s in sk])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.array(f1, U64).view(np.int64)), pa.array(np.array(f2, U64).view(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sk)))], ["doc_id", "n", "f1", "f2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def postings(reps: DataFrame, k: int = K, need: int = NEED, similarity: float = SIMILARITY) -> DataFrame:
    """(v, node, n, s): the values under which each node (node, n, sketch) is listed, each value at least twice; s: the share of its values that occur elsewhere."""
    values = reps.select("node", "n", F.explode("sketch").alias("v"))
    frequent = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(frequent, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by"))  # at most k values
    held = f"least(n, {k})"
    listed = f"{held} - least(cast(ceil({similarity} * n) as int), {need}) + 1 - ({held} - size(by))"
    return shared.select("node", "n", F.expr(f"size(by) / {held}").alias("s"), F.expr(f"explode(slice(by, 1, greatest(cast({listed} as int), 0)))").alias("p")).select("p.v", "node", "n", "s")


def confirmed(pairs: DataFrame, sketch: DataFrame, texts: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; sketch: node, sketch; texts: node, text."""
    of = lambda t, x: t.select(F.col("node").alias(x), F.col(t.columns[-1]).alias(f"{t.columns[-1]}_{x}"))
    both = pairs.join(of(sketch, "b"), "b").join(of(sketch, "a"), "a")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    near = both.withColumn("u", union).where(F.size(F.array_intersect("u", F.array_intersect("sketch_a", "sketch_b"))) >= ESTIMATE * similarity / SIMILARITY * F.size("u")).select("a", "b")
    ready = near.join(of(texts, "b"), "b").join(of(texts, "a"), "a").select("a", "b", "text_a", "text_b")
    least, scale = int(round(similarity * 1000)), 1000

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            a_ids = batch.column(0).to_pylist()
            for r in range(batch.num_rows):
                if a_ids[r] != last:
                    last, held = a_ids[r], _set(batch.column(2)[r].as_buffer(), size)
                other = _set(batch.column(3)[r].as_buffer(), size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(scale * both >= least * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ready.mapInArrow(run, "a long, b long")


def _set(data, size: int) -> np.ndarray:
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return next(shingle_sets(buf, np.array([0, len(buf)]), size))


def prefix_lists(texts: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """v, node, n, s, rank: the listed documents' full sets, rarest values first, as far as a similar set must share one.

    n: shingles of the set; s: those that another listed document has too; rank: place of v in the order.
    """
    def run(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch, "text"):
                sets = list(shingle_sets(buf, off, size))
                n = np.array([len(x) for x in sets])
                nodes = np.repeat(batch.column(0).to_numpy()[i:j], n)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], ["node", "n", "v"])

    values = texts.mapInArrow(run, "node long, n long, v long").distinct()
    again = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by = values.join(again, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by")).withColumn("s", F.size("by").cast("long"))
    most = F.expr(f"cast(n - ceil({similarity} * n) + 1 - (n - s) as int)")
    placed = by.select("node", "n", "s", F.posexplode(F.slice("by", 1, F.greatest(most, F.lit(0)))).alias("p", "b"))
    return placed.select("b.v", "node", "n", "s", (F.col("n") - F.col("s") + F.col("p") + 1).alias("rank"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, stars: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    if not 0 < similarity <= 1 or similarity < 0.7:
        raise ValueError("the sketch's bounds hold for similarities from 0.7 to 1")
    k, need = K, math.floor(NEED * similarity / SIMILARITY)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_rows = written(sketches(docs, size, k))
    real = all_rows.where("n > 0 and doc_id is not null")
    sets = written(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("node")))
    reps = join_small(real, sets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", "sketch")
    listed = written(postings(reps, k, need, similarity))
    nodes = listed.select("node").distinct()
    sketch = written(join_small(reps.select("node", "sketch"), nodes, "node", "left_semi"))
    texts = written(join_small(docs.select(F.col("doc_id").alias("node"), "text"), nodes, "node", "left_semi"))
    links, labels = None, None

    def labelled(lists: DataFrame) -> DataFrame:
        q = lists.withColumn("label", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = q.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
        return q.join(several, "v", "left_semi")

    for r in range(stars):
        q = written(labelled(listed))
        # first the member with the fewest values of its own, which copies are nearest to, then any
        rank = -F.col("s") if r == 0 else F.xxhash64("node", F.lit(r)).cast("double")
        pivots = q.groupBy("v").agg(F.min(F.struct(rank.alias("h"), "node", "label", "n")).alias("p"))
        alike = F.least("n", "p.n") >= similarity * F.greatest("n", "p.n") - 1e-9
        met = q.join(pivots, "v").where((F.col("label") != F.col("p.label")) & alike).select(F.col("p.node").alias("a"), F.col("node").alias("b"))
        found = written(confirmed(written(met.distinct()), sketch, texts, size, similarity, k))
        links = found if links is None else links.union(found)
        labels = components(links)
    rest = written(labelled(listed).select("node").distinct())
    if not rest.isEmpty():
        # of the pair's sizes follows how many values it must share, and so where in both orders a common one must stand
        need_ = lambda o: similarity / (1 + similarity) * (F.col("n") + F.col(f"{o}n")) - 1e-6
        may = lambda o: (F.least("s", f"{o}s") >= need_(o)) & (F.col("rank") <= F.col("n") - need_(o) + 1) & (F.col(f"{o}rank") <= F.col(f"{o}n") - need_(o) + 1)
        q = written(labelled(written(prefix_lists(join_small(texts, rest, "node", "left_semi"), size, similarity))))
        other = q.select("v", F.col("node").alias("b"), F.col("label").alias("other"), F.col("n").alias("on"), F.col("s").alias("os"), F.col("rank").alias("orank"))
        met = q.join(other, "v").where((F.col("label") < F.col("other")) & may("o")).select(F.col("node").alias("a"), "b")
        links = links.union(written(confirmed(written(met.distinct()), sketch, texts, size, similarity, k)))
        labels = components(links)
    every = join_small(all_rows.select("doc_id", "n", "f1", "f2"), sets, ["f1", "f2"], "left", width=48)
    every = join_small(every, labels, "node", "left", width=32)
    component = F.when(F.col("n") > 0, F.coalesce("label", "node", "doc_id")).otherwise(F.col("doc_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id; rows that share a doc_id stay if one of them does."""
    found = near_duplicates(docs, size, similarity)
    gone = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"))
    return join_small(docs, gone, "doc_id", "left_anti")
