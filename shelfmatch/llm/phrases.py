"""Repeated phrases: recurring passages confirmed, compiled into Aho-Corasick automata, located in all texts.

A window is 20 words; a word goes if a window that covers it has the same words as one that starts
earlier (smaller doc_id, or the same document before).

1. Confirm: winnowed 8-word phrases are dealt out by hash; those that occur twice in the corpus are
   confirmed, and each block of documents that holds one learns of one place of it.
2. Compile: the phrases are sharded by block.  A shard has the phrases confirmed for its block alone,
   so it is bounded by the block's text and no document runs through phrases that it cannot hold; with
   shards of all phrases the work would grow with phrases times documents.
3. Stream: all documents of a block run through its automaton, which finds every occurrence.  The
   windows around the occurrences are then compared as in ``repeats``; places come from the automata alone.

Defined cases: null and wordless texts have no words; rows with the same doc_id count as one place
apart from their words' order; a null doc_id stays whole and takes nothing from others; an empty
table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, grams, prefix, ranges, words
from .repeats import DEAL, LONG, Words, blocks_of, by_bucket, chosen, deal, dealt_batch, digest, keyed, records, repeated_spans, rows_of, space_after, texts_of, unpacked, with_spans
from .runtime import released, written

WIDTH, GRAM = 20, 8


_PLACE = [("gram", "<u8"), ("block", "<u4"), ("doc", "<i8"), ("k", "<u2"), ("at", "<u4"), ("more", "u1")]
_PHRASE = [("doc", "<i8"), ("k", "<u2"), ("at", "<u4")]


def confirmed(docs: DataFrame, unit: Words, buckets: int, blocks: int) -> DataFrame:
    """block, n, data: one place in the block of every phrase that occurs there and at another place of the corpus."""
    def deal(held):
        r = [np.concatenate(c) for c in zip(*held)]
        by = np.lexsort((r[1], r[0]))
        r = [c[by] for c in r]
        new = np.concatenate([[True], (r[0][1:] != r[0][:-1]) | (r[1][1:] != r[1][:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        r = [*(c[new] for c in r), size > 1]
        bucket = ((r[0] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        return dealt_batch([(b, -1, n, data) for b, n, data in rows_of(r, bucket, _PLACE)])

    def choose(batches):
        held, size = [], 0
        for batch in batches:
            ids, ks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, base, buf, off in texts_of(batch, unit):
                h, first, _ = unit.sequence(buf, off)
                at = chosen(unit, first, h)
                if len(at):
                    doc = np.searchsorted(first, at, "right") - 1
                    d, k = ids[rows][doc], ks[rows][doc]
                    held.append((h[at], blocks_of(d, k, blocks), d, k, at - first[doc] + base[doc]))
                size += len(buf)
                if size >= DEAL and held:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)
        released()

    def confirm(batches):
        for _, r in by_bucket(batches, _PLACE):
            by = np.lexsort((r[1], r[0]))
            gram, block, doc, k, at, more = [c[by] for c in r]
            head = np.concatenate([[True], gram[1:] != gram[:-1]])
            starts = np.flatnonzero(head)
            n = np.diff(np.append(starts, len(gram)))
            keep = np.repeat((n > 1) | (np.maximum.reduceat(more, starts) > 0), n)
            one = keep & (head | np.concatenate([[True], block[1:] != block[:-1]]))
            rows = list(rows_of([c[one] for c in (doc, k, at)], block[one].astype(np.int64), _PHRASE))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["block", "n", "data"])
        released()

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "k", "text").mapInArrow(choose, "bucket int, block int, n int, data binary")
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(confirm, "block int, n int, data binary")


def located(docs: list[np.ndarray], phrases: list[np.ndarray], gram: int) -> list[np.ndarray]:
    """The places in each document (word hashes) of every phrase (gram word hashes): all run through one automaton."""
    import ahocorasick

    if not phrases:
        return [np.zeros(0, np.int64) for _ in docs]
    _, code = np.unique(np.concatenate([*docs, *phrases]), return_inverse=True)
    ends = np.cumsum([len(d) for d in docs])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in code[ends[-1] :].reshape(-1, gram).tolist():
        automaton.add_word(tuple(p), 1)
    automaton.make_automaton()
    out = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        found = [e for e, _ in automaton.iter(tuple(code[a:b].tolist()))] if b - a >= gram else []
        out.append(np.array(found, np.int64) - (gram - 1))
    return out


def word_hashes(buf: np.ndarray, unit: Words) -> np.ndarray:
    """Hashes of all words of a text, a piece at a time."""
    out, at = [np.zeros(0, U64)], 0
    while at < len(buf):
        end = len(buf) if len(buf) - at <= LONG else space_after(buf, at + LONG)
        part = buf[at:end]
        starts, ends, _ = words(part, np.array([0, len(part)]))
        out.append(ranges(prefix(part), starts, ends))
        at = end
    return np.concatenate(out)


def streamed(docs: DataFrame, phrases: DataFrame, unit: Words, buckets: int, blocks: int) -> DataFrame:
    """Records of every occurrence: all documents of a block run through the automaton of the block's phrases."""
    def block_records(found, texts):
        """found: columns of _PHRASE; texts: (doc_id, k, word hashes)."""
        place = {(d, k): i for i, (d, k, _) in enumerate(texts)}
        which = [(place.get((d, k)), at) for d, k, at in zip(*(c.tolist() for c in found))]
        hashes = [h for _, _, h in texts]
        at = located(hashes, [hashes[i][a : a + unit.gram] for i, a in which if i is not None], unit.gram)
        first = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        h = np.concatenate(hashes)
        ids, ks = np.array([d for d, _, _ in texts], np.int64), np.array([k for _, k, _ in texts], np.int64)
        everywhere = np.concatenate([x + a for x, a in zip(at, first[:-1])])
        return records(ids, ks, np.zeros(len(texts), np.int64), unit, grams(h, unit.gram), first, unit.sums(h), everywhere)

    def run(batches):
        block, found, texts, held, size = None, [], [], [], 0

        def close():
            nonlocal found, texts, size
            if found and texts:
                held.append(block_records([np.concatenate(c) for c in zip(*found)], texts))
            found, texts = [], []

        for batch in batches:
            for b, kind, d, k, n, data, text in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5), batch.column(6)):
                if b != block:
                    close()
                    block = b
                    if size >= DEAL and held:
                        yield dealt_batch(list(deal(held, unit, buckets, blocks)))
                        held, size = [], 0
                if kind:
                    raw = text.as_buffer()
                    buf = np.frombuffer(raw, np.uint8) if raw.size else np.zeros(0, np.uint8)
                    texts.append((d, k, word_hashes(buf, unit)))
                    size += len(buf)
                else:
                    found.append(unpacked(data.as_py(), n, _PHRASE))
        close()
        if held and (rows := list(deal(held, unit, buckets, blocks))):
            yield dealt_batch(rows)
        released()

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.pmod(F.col("doc_id").bitwiseXOR(F.col("k")), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "doc_id", "k", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("data"), "text")
    lists = phrases.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("k"), "n", "data", F.lit(None).cast("string").alias("text"))
    return texts.union(lists).repartition(tasks, "block").sortWithinPartitions("block", "kind", "doc_id", "k").mapInArrow(run, "bucket int, block int, n int, data binary")


def deal_located(docs: DataFrame, unit: Words, buckets: int, blocks: int) -> DataFrame:
    """The records of all occurrences of the confirmed phrases."""
    return streamed(docs, written(confirmed(docs, unit, buckets, blocks)), unit, buckets, blocks)


def phrase_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    rows = keyed(docs)
    spans = repeated_spans(rows.where("doc_id is not null"), Words(width, gram), deal_located)

    def run(batches):
        for batch in batches:
            out = []
            for t, w, s in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                text = t.as_py().encode()
                buf = np.frombuffer(text, np.uint8)
                starts, ends, _ = words(buf, np.array([0, len(buf)]))
                n, keep = len(starts), np.ones(len(starts), bool)
                if w and n >= width:
                    keep[:] = False
                elif not w and s.as_py() is not None:
                    for a, b in np.frombuffer(s.as_py(), "<i8").reshape(-1, 2).tolist():
                        keep[a:b] = False
                kept = b" ".join([text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])
                out.append((n, n - int(keep.sum()), digest(kept)))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(rows, spans).select("doc_id", "text", "whole", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
