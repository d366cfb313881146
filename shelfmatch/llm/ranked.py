"""Ranked lexical search by best positions over impact lists.

Every item of the query table is a set of terms.  A document's score for an item sums, over the
item's terms that it holds, the term's weight times a saturated frequency; all of it is integer
arithmetic but the weight.  The k highest documents of each item are found by the Best Position
Algorithm, block by block:

* One pass over the texts notes each document's length and the places' counts of the terms that are
  asked for (``noted``).  Counts over all documents give the weights.
* A block of documents becomes one impact list a term, highest first.  The lists of an item are read
  in parallel from the top.  Each document met is looked up in all the other lists at once (direct
  access), which scores it whole and marks its position in every list.  A list's best position ends
  the run of positions from the top that are all marked, by whatever way.  No unmarked document can
  beat the sum of the impacts that follow the best positions, and reading stops once that sum is
  strictly below the k-th score; at a tie an unmarked document of smaller id could still come in.
* A task carries its k highest of each item from block to block, so later blocks stop earlier.  What
  the tasks kept is ranked by a window, k rows an item and task.

Items are taken in blocks of about TERMS terms, each against all documents, so what a task is given
does not grow with the query table.

Defined cases: a null text has no terms, is no document of the counts and is never found; an item
without terms has no rows; rows of items that share an item_id are one item with all their terms, a
null item_id among them; each row of documents is a document of its own, with a null or repeated doc_id,
too; of equal scores the smaller doc_id comes first, null last; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import LOWER, chunks, prefix, ranges, words
from .runtime import ship, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of an item; terms of a block of items; postings of a block of documents.
TOP, TERMS, POSTINGS = 50, 400_000, 2_000_000
#: Positions that a list is read on by at first; later reads grow with what has been read.
STEP = 16
_LAST = np.iinfo(np.int64).max

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    t = "coalesce(cast(text as string), '')"
    folded = F.expr(f"translate({t}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")
    return items.select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), 0)).alias("term")).distinct()


def _hashed(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw])
    return ranges(prefix(np.frombuffer(b"".join(raw), np.uint8)), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def noted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), and of the terms asked for that occur: ids (places in ``terms``) and tf."""
    ship(docs.sparkSession)
    h = _hashed(terms)
    order = np.argsort(h).astype(np.int32)
    h = h[order]

    def run(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch, "text"):
                low = LOWER[buf]
                starts, ends, first = words(low, off, _BETWEEN)
                n = np.diff(first)
                v = ranges(prefix(low), starts, ends)
                at = np.minimum(np.searchsorted(h, v), len(h) - 1)
                asked = np.flatnonzero(h[at] == v)
                doc = np.searchsorted(first, asked, "right") - 1
                key, tf = np.unique(doc * len(h) + order[at[asked]], return_counts=True)
                cut = np.searchsorted(key, np.arange(j - i + 1) * len(h)).astype(np.int32)
                ids, tf = pa.array((key % len(h)).astype(np.int32)), pa.array(tf.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), ids), pa.ListArray.from_arrays(pa.array(cut), tf)], ["doc_id", "n", "ids", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, ids array<int>, tf array<int>")


class Lists:
    """The impact lists of a block: entries by document (row, term, impact), each with its position in its term's list."""

    def __init__(self, cut: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: np.ndarray):
        self.cut, self.term, self.impact, self.docs = cut, term, impact, docs
        self.row = np.repeat(np.arange(len(docs)), np.diff(cut))
        self.order = np.lexsort((docs[self.row], -impact, term))
        self.position = np.empty(len(term), np.int64)
        self.position[self.order] = np.arange(len(term))
        self.sorted_terms = term[self.order]
        self.falling = impact[self.order]

    def spans(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last position (exclusive) of each term's list."""
        return np.searchsorted(self.sorted_terms, terms), np.searchsorted(self.sorted_terms, terms, "right")

    def entries(self, rows: np.ndarray) -> np.ndarray:
        """All entries of the rows: the direct access to the other lists."""
        n = self.cut[rows + 1] - self.cut[rows]
        return np.repeat(self.cut[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def best_positions(lists: Lists, terms: np.ndarray, k: int, kept: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k highest (score, doc) of those kept and of the block, by score and then by doc."""
    start, stop = lists.spans(terms)
    start, stop = start[stop > start], stop[stop > start]
    mine = np.zeros(int(terms.max()) + 2, bool)
    mine[terms] = True
    marked = np.zeros(len(lists.term), bool)
    best = start.copy()
    score, docs = kept
    step = STEP
    while len(start):
        bound = lists.falling[best[best < stop]].sum()
        if bound == 0 or (len(score) == k and bound < score[-1]):
            break
        n = np.minimum(step, stop - best)
        at = np.repeat(best - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows = np.unique(lists.row[lists.order[at[~marked[at]]]])
        entry = lists.entries(rows)
        entry = entry[mine[np.minimum(lists.term[entry], len(mine) - 1)]]
        marked[lists.position[entry]] = True
        total = np.add.reduceat(lists.impact[entry], np.searchsorted(lists.row[entry], rows))
        score, docs = np.concatenate([score, total]), np.concatenate([docs, lists.docs[rows]])
        first = np.lexsort((docs, -score))[:k]
        score, docs = score[first], docs[first]
        for i in np.flatnonzero(best < stop):  # on to the first position that isn't marked
            seen = marked[best[i] : stop[i]]
            gap = int(seen.argmin())
            best[i] = stop[i] if seen[gap] else best[i] + gap
        step *= 2
    positive = score > 0
    return score[positive], docs[positive]


def highest(rows: DataFrame, items: list[np.ndarray], weights: np.ndarray, total: int, length: int, k: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """item (place in ``items``), doc_id and score: at least the k highest documents of each item, from each task its own k highest.

    rows: of ``noted``; weights: of all terms; total, length: documents with terms and all their terms.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def block(held: list[pa.RecordBatch]) -> Lists:
        t = pa.Table.from_batches(held)
        n = t.column("n").to_numpy()
        ids, tf = t.column("ids").combine_chunks(), t.column("tf").combine_chunks()
        term, tf = ids.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        size = np.asarray(ids.value_lengths())
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        m = np.repeat(100 - 50 + (50 * n * total) // length, size)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        # a missing id stands behind all others
        return Lists(cut, term, impact, t.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy())

    def run(batches):
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        held, size = [], 0

        def work():
            lists = block(held)
            for i, terms in enumerate(items):
                kept[i] = best_positions(lists, terms, k, kept[i])

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= postings:
                work()
                held, size = [], 0
        if size:
            work()
        for i, (score, docs) in enumerate(kept):
            if len(score):
                ids = pa.array(docs, mask=docs == _LAST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), ids, pa.array(score)], ["item", "doc_id", "score"])

    return rows.where("size(ids) > 0").mapInArrow(run, "item int, doc_id long, score long").withColumn("doc_id", F.col("doc_id").cast(kind))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, terms: int = TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k highest documents with a score above 0."""
    asked = written(item_terms(items))
    blocks = max(1, -(-asked.count() // terms))
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        mine: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator():  # a block of the query table
            mine.setdefault(r["item_id"], []).append(r["term"])
        vocabulary = sorted({t for ts in mine.values() for t in ts})
        place = {t: i for i, t in enumerate(vocabulary)}
        if not vocabulary:
            continue
        rows = written(noted(docs, vocabulary))
        total, length = rows.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        held = rows.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator()  # a row for each term of the block
        weights = np.zeros(len(vocabulary), np.int64)
        for r in held:
            weights[r["id"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["count"] + 1)))
        names = list(mine)
        found = highest(rows, [np.array(sorted(place[t] for t in mine[i])) for i in names], weights, total or 0, length or 1, k)
        ids = docs.sparkSession.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        found = found.join(F.broadcast(ids), "item").drop("item")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long, item_id {kind}")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
