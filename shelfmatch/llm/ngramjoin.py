"""Similarity join of word-shingle sets by adaptive multi-match prefixes.

Documents link when their shingle sets have a Jaccard similarity of SIMILARITY or more.  A set's values are
in one order for all documents (that of their hashes).  A document of n values shares at least
t = ceil(SIMILARITY * n) of them with any partner, so the first n - t + l values of both hold l common
ones, for every l from 1 to t.

* Level 0 takes a small l.  How many values of other works stand in a document's lists is what it would
  cost to look at its candidates; a document that costs over COST goes on to the next level, where its
  prefix is longer and more common values are asked for, up to the whole set.  What remains at a
  level meets all that got as far, so a pair meets at the level where the first of the two remains.
* Of a prefix that must share l values the l - 1 commonest needn't be listed: one of the others is shared.
  So a longer prefix keeps the frequent values out of the lists, and many documents have none left.
* The sizes of a pair say more: it must share c values in all, so its prefixes share c less what the
  longer set's prefix leaves out.  That bounds how far down the first common value may stand in both,
  and a pair is verified only if its prefixes share that many, then by full sets.
* Each set has a bitmap of parities, whose bits each value turns over.  Two sets differ in at least as many
  values as their bitmaps in bits, so pairs that differ in too many are never formed.

Components alone are asked for.  Identical sets are folded.  Then two pivots of a list, the most central
member and any, are compared with the others, which takes a few pairs for each of thousands of near copies; after
that, only pairs of different components are formed: in each list the members outside its largest
component with the others.

Defined cases: a document without words (or null) has 0 shingles and is linked with nothing; with fewer
words than a shingle, the whole sequence is one; rows that share a doc_id are one document, which has the
largest of their sets (of equally large ones, that of the greatest print); a null doc_id is linked with
nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import U64, chunks, mix
from .neardup import shingle_sets
from .runtime import join_small, ship, written

#: Words of a shingle and percent of similarity where no contract names others; SHINGLE and SIMILARITY are op12's.
SHINGLE, SIMILARITY = 3, 90
#: Shares of t - 1 that the levels ask for beyond one value.
LEVELS = (0.05, 0.25, 1.0)
#: Candidates of a document above which it goes on to the next level.
COST = 64
#: Words of 64 bits of a set's bitmap.
BITMAP = ("b0", "b1", "b2", "b3")
#: Lists of a document whose pivots it is compared with at first.
STAR_LISTS = 4


_MAP = ", ".join(f"{b} long" for b in BITMAP)


def least_shared(n: Column | int, similarity: int):
    """Values that a set of n shares with any partner."""
    if isinstance(n, Column):
        return F.floor((n * similarity + 99) / 100).cast("int")
    return (n * similarity + 99) // 100


def left_out(n: Column, level: int, similarity: int) -> Column:
    """Values of a set of n that its prefix of a level lacks: t - l."""
    t = least_shared(n, similarity)
    return (t - 1 - F.floor((t - 1) * LEVELS[level] + 1e-9)).cast("int")


def common(n: Column, m: Column, level: int, similarity: int) -> Column:
    """Values that the prefixes of similar sets of n and m share."""
    whole = F.floor((similarity * (n + m) + 99 + similarity) / (100 + similarity))
    return (whole - F.greatest(left_out(n, level, similarity), left_out(m, level, similarity))).cast("int")


def parities(values: np.ndarray) -> np.ndarray:
    """The bitmap of a set."""
    bits = np.bincount((mix(values.view(U64)) >> U64(56)).astype(np.int64), minlength=64 * len(BITMAP)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def few_bits(x, y, n: Column, m: Column, similarity: int) -> Column:
    """Whether bitmaps (functions from a word's name to its column) leave room for similar sets of n and m."""
    differ = sum((F.bit_count(x(b).bitwiseXOR(y(b))) for b in BITMAP), F.lit(0))
    return differ * (100 + similarity) <= (100 - similarity) * (n + m)


def cut_off(n: int, level: int, similarity: int) -> int:
    """Length of the prefix of a level."""
    t = least_shared(n, similarity)
    return n - (t - 1 - int((t - 1) * LEVELS[level] + 1e-9))


def sets(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n, f1 and f2 (a 128-bit print of the set), k (a print of the text), the bitmap and head: the prefix of the first level, ascending."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch, "text"):
                n, f1, f2, head, bits = [], [], [], [], []
                for s in shingle_sets(buf, off, size):
                    m = mix(s.view(U64))
                    n.append(len(s))
                    bits.append(parities(s))
                    f1.append(m.sum(dtype=U64))
                    f2.append(np.bitwise_xor.reduce(mix(m ^ U64(0x9E3779B97F4A7C15))) if len(s) else U64(0))
                    head.append(s[: cut_off(len(s), 0, similarity)] if len(s) else s)
                cut = np.concatenate([[0], np.cumsum([len(h) for h in head])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.array(f1, U64).view(np.int64)), pa.array(np.array(f2, U64).view(np.int64)), batch.column(2).slice(i, j - i), *map(pa.array, np.stack(bits, 1)), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(head)))], ["doc_id", "n", "f1", "f2", "k", *BITMAP, "head"])

    return docs.select("doc_id", "text", "k").mapInArrow(run, f"doc_id long, n long, f1 long, f2 long, k long, {_MAP}, head array<long>")


def prefixes_of(texts: DataFrame, level: int, size: int, similarity: int) -> DataFrame:
    """node, n, the bitmap and values (the prefix of a level, ascending) of texts (node, text)."""

    def run(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch, "text"):
                each = list(shingle_sets(buf, off, size))
                n, bits = [len(s) for s in each], np.stack([parities(s) for s in each], 1)
                each = [s[: cut_off(len(s), level, similarity)] for s in each]
                cut = np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), *map(pa.array, bits), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(each)))], ["node", "n", *BITMAP, "values"])

    return texts.mapInArrow(run, f"node long, n long, {_MAP}, values array<long>")


def lists(prefixes: DataFrame, level: int, similarity: int) -> DataFrame:
    """(v, node, n, rank, mid and the bitmap): the rarest values of each prefix (node, n, values) that one must be shared of, each held by two at least.

    rank: place in the prefix, rarest first; mid: how common the prefix's values are (mean logarithm), so how central it is.
    """
    each = prefixes.select("node", F.explode("values").alias("v"))
    again = each.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by = each.join(again, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by"))  # a set's own values
    by = by.join(prefixes.select("node", "n", *BITMAP, F.size("values").alias("p")), "node").withColumns({"alone": F.col("p") - F.size("by"), "mid": F.aggregate("by", F.lit(0.0), lambda t, x: t + F.log(x["df"])) / F.col("p")})
    # any partner shares at least as many as this set's level asks for
    most = F.greatest(F.lit(0), (F.col("n") - least_shared(F.col("n"), similarity) + 1 - F.col("alone")).cast("int"))
    placed = by.select("node", "n", *BITMAP, "alone", "mid", F.posexplode(F.slice("by", F.lit(1), most)).alias("at", "b"))
    return placed.select("b.v", "node", "n", (F.col("alone") + F.col("at") + 1).cast("int").alias("rank"), "mid", *BITMAP)


def _near(n: Column, m: Column, similarity: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * similarity


def verified(pairs: DataFrame, prefixes: DataFrame, texts: DataFrame, level: int, size: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share what the level asks for and whose full sets are similar enough."""
    of = lambda x: prefixes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"v{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    enough = both.where(F.size(F.array_intersect("va", "vb")) >= common(F.col("na"), F.col("nb"), level, similarity)).select("a", "b")
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    ready = enough.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")

    def one(data) -> np.ndarray:
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return next(shingle_sets(buf, np.array([0, len(buf)]), size))

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for r, a in enumerate(batch.column(0).to_pylist()):
                if a != last:
                    last, held = a, one(batch.column(2)[r].as_buffer())
                other = one(batch.column(3)[r].as_buffer())
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= similarity * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ready.mapInArrow(run, "a long, b long")


def labelled(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with a node and their component so far."""
    if labels is None:
        return found.withColumn("label", F.col("node"))
    return found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def open_lists(listed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists that hold several components: v, node, n, rank, label."""
    q = labelled(listed, labels)
    several = q.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
    return q.join(several, "v", "left_semi")


def costs(q: DataFrame) -> DataFrame:
    """node, cost: members of other components in all of a node's lists; q: of ``open_lists``."""
    own = q.groupBy("v", "label").agg(F.count(F.lit(1)).alias("own"))
    df = own.groupBy("v").agg(F.sum("own").alias("df"))
    return q.join(own, ["v", "label"]).join(df, "v").groupBy("node").agg(F.sum(F.col("df") - F.col("own")).alias("cost"))


def met(q: DataFrame, level: int, similarity: int) -> DataFrame:
    """Pairs (a, b) of different components of a list, one of them remaining at this level; q: v, node, n, rank, label, remains.

    In each list the largest component is only met by the others, so its members' pairs are never formed.
    """
    sizes = q.groupBy("v", "label").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.groupBy("v").agg(F.max_by("label", F.struct("m", "label")).alias("large"))
    last = F.col("n") - left_out(F.col("n"), level, similarity) + 1 - F.col("rank")  # that many values follow, with this one
    q = q.join(large, "v").select("v", "node", "n", "label", "remains", "large", last.cast("int").alias("follow"), *BITMAP)
    side = lambda d, x: d.select("v", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "label", "remains", "follow", *BITMAP)), (F.col("label") == F.col("large")).alias(f"large_{x}"))
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    other = b("large") | (a("label") < b("label"))
    enough = few_bits(a, b, a("n"), b("n"), similarity) & (F.least(a("follow"), b("follow")) >= common(a("n"), b("n"), level, similarity))
    pairs = side(q.where("label <> large"), "a").join(side(q, "b"), "v").where(other & (a("remains") | b("remains")) & _near(a("n"), b("n"), similarity) & enough)
    return pairs.select(F.least(a("node"), b("node")).alias("a"), F.greatest(a("node"), b("node")).alias("b")).distinct()


def ngram_components(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, cost: int = COST, stars: bool = True) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    if not 50 < similarity <= 100:
        raise ValueError("similarity is in percent, over 50")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    all_rows = written(sets(docs, size, similarity))
    chosen = all_rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2", "k")).alias("s"))
    chosen = written(chosen.select("doc_id", "s.*"))
    folded = written(chosen.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "k")).alias("s")).select("f1", "f2", F.col("s.doc_id").alias("node"), "s.n", "s.k"))
    # of sets so small that a partner must be equal, all links are folded
    smallest = next(n for n in range(1, 102) if 100 * n >= similarity * (n + 1)) if similarity < 100 else None
    able = folded.where(f"n >= {smallest}" if smallest else "false").select(F.col("node").alias("doc_id"), "k")
    heads = join_small(all_rows.select("doc_id", "k", "n", *BITMAP, "head"), able, ["doc_id", "k"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "n", *BITMAP, F.col("head").alias("values"))

    listed = written(lists(heads, 0, similarity))
    alive = written(listed.select(F.col("node").alias("doc_id")).distinct().join(able, "doc_id"))
    heads = written(join_small(heads, alive.select(F.col("doc_id").alias("node")), "node", "left_semi"))
    texts = written(join_small(docs, alive, ["doc_id", "k"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "text"))
    links, labels = [], None

    def linked(pairs: DataFrame, prefixes: DataFrame, level: int) -> bool:
        found = written(verified(pairs, prefixes, texts, level, size, similarity))
        if found.isEmpty():
            return False
        links.append(found)
        return True

    prefixes, new = heads, False
    if stars:
        first = F.row_number().over(Window.partitionBy("node").orderBy("v"))
        few = written(listed.withColumn("at", first).where(F.col("at") <= STAR_LISTS).select("v", "node", "n", "mid", *BITMAP))
        member = F.struct("node", "n", *BITMAP)
        pivots = few.groupBy("v").agg(F.max_by(member, F.struct("mid", "node")).alias("p"), F.min_by(member, F.xxhash64("node")).alias("q"))
        near = few_bits(F.col, lambda c: F.col(f"p.{c}"), F.col("n"), F.col("p.n"), similarity) & _near(F.col("n"), F.col("p.n"), similarity)
        met_ = few.join(pivots, "v").select("node", "n", *BITMAP, F.explode(F.array("p", "q")).alias("p")).where((F.col("node") != F.col("p.node")) & near)
        if linked(met_.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct(), heads, 0):
            labels = components(links[0])
    for level in range(len(LEVELS)):
        q = written(open_lists(listed, labels))
        if q.isEmpty():
            break
        last = level == len(LEVELS) - 1
        dear = written(costs(q).where(F.lit(not last) & (F.col("cost") > cost)).select("node"))
        q = join_small(q, dear.withColumn("dear", F.lit(True)), "node").select("v", "node", "n", "rank", "label", F.col("dear").isNull().alias("remains"), *BITMAP)
        new |= linked(met(q, level, similarity), prefixes, level)
        if last or dear.isEmpty():
            break
        prefixes = written(prefixes_of(join_small(texts, dear, "node", "left_semi"), level + 1, size, similarity))
        listed = written(lists(prefixes, level + 1, similarity))
    if new:
        every_link = links[0]
        for d in links[1:]:
            every_link = every_link.union(d)
        labels = components(every_link)
    found = join_small(chosen.select("doc_id", "n", "f1", "f2"), folded.select("f1", "f2", "node"), ["f1", "f2"], "left", width=48)
    found = found if labels is None else join_small(found, labels, "node", "left", width=32).withColumn("node", F.coalesce("label", "node"))
    every = join_small(all_rows.select("doc_id", F.col("n").alias("own")), found.select("doc_id", "n", "node"), "doc_id", "left", width=48)
    return every.select("doc_id", F.coalesce("n", "own").alias("n_shingles"), F.coalesce("node", "doc_id").alias("component_id"))
