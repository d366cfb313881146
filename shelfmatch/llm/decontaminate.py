"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

A window is 10 consecutive words of a benchmark item (a shorter item is one window).  Of every 6
consecutive hashes of 5-grams the smallest is kept as a fingerprint, so any 10 shared words share a
fingerprint at the same place.  Fingerprints of documents and items are joined, and every hit is
extended: the up to 6 windows around it are compared word for word with the items' windows.  Items
of L < 10 words use all their L-grams, which is the same scheme with windows of one hash.

Defined cases: a null or wordless text has no words and no hits, a null or wordless item no windows;
repeated rows each get their own row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import join_by_size, join_small, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
#: A fingerprint is 33 bits of hash and, below, the word position in 30 bits.
_BITS = 30
_MASK = (1 << 63) - (1 << _BITS)


def words_of(text: str) -> Column:
    """Array of words after folding A-Z only."""
    t = f"coalesce(cast({text} as string), '')"
    folded = f"case when octet_length({t}) = char_length({t}) then lower({t}) else translate({t}, '{string.ascii_uppercase}', '{string.ascii_lowercase}') end"
    return F.regexp_extract_all(F.expr(folded), F.lit(WORD), 0)


def _fingerprints(hashes: str, n: str, gram: int, window: int) -> tuple[str, str]:
    """SQL of the packed n-gram hashes, and of the winnowed ones over a column ``g`` of them."""
    grams = f"case when {n} >= {gram} then transform(sequence(0, {n} - {gram}), i -> (xxhash64({gram}, {', '.join(f'{hashes}[i + {k}]' for k in range(gram))}) & {_MASK}L) | i) else cast(array() as array<bigint>) end"
    least = f"case when size(g) >= {window} then array_distinct(transform(sequence(0, size(g) - {window}), i -> least({', '.join(f'g[i + {k}]' for k in range(window))}))) else cast(array() as array<bigint>) end"
    return grams, least if window > 1 else "g"


def fingerprints(df: DataFrame, lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds n_words and ``prints`` (array of packed fingerprints) to rows with a column ``words``; lengths: of short items."""
    df = df.select("*", F.size("words").cast("long").alias("n_words"), F.expr("transform(words, w -> xxhash64(w))").alias("h")).drop("words")
    every = []
    for k, w in [(gram, window - gram + 1), *((n, 1) for n in lengths)]:
        grams, least = _fingerprints("h", "cast(n_words as int)", k, w)
        df = df.select("*", F.expr(grams).alias("g"))
        df = df.select(*(c for c in df.columns if c != "g"), F.expr(least).alias(f"p{k}_{w}"))
        every.append(f"p{k}_{w}")
    return df.select(*(c for c in df.columns if c not in {*every, "h"}), F.concat(*every).alias("prints"))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: wtext (words joined by blanks), wlen, items (sorted strings)."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0)
    starts = F.expr(f"explode(sequence(0, greatest(size(words) - {window}, 0)))")
    each = items.select("item_id", "words", starts.alias("s"))
    each = each.select("item_id", F.expr(f"array_join(slice(words, s + 1, {window}), ' ')").alias("wtext"), F.expr(f"least(size(words), {window})").alias("wlen"))
    return each.groupBy("wtext", "wlen").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    inner = window - gram
    items = bench.select(words_of("text").alias("words")).where(F.size("words") > 0)
    lengths = [r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().orderBy(F.size("words")).collect()]  # window - 1 numbers at most
    hashed = lambda v: F.shiftright(F.col(v), _BITS)
    kinds = []
    for n in [0, *lengths]:  # the items that are long enough, then those of each short length
        own = items.where(F.size("words") >= window if not n else F.size("words") == n)
        made = fingerprints(own, [] if not n else [n], window, gram).select(F.explode_outer("prints").alias("v")).select(hashed("v").alias("f"), F.lit(n).alias("short"))
        kinds.append(made.where("f is not null").distinct())
    prints = kinds[0]
    for k in kinds[1:]:
        prints = prints.union(k)
    prints = written(prints.groupBy("f").agg(F.collect_set("short").alias("shorts")))

    base = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("k"), words_of("text").alias("words"))
    marked = fingerprints(base, lengths, window, gram).select("doc_id", "k", "n_words", F.explode_outer(F.concat(F.array(-1 - F.expr("k & 4611686018427387903L")), F.col("prints"))).alias("v"))  # explode_outer: no filter on the whole chain of expressions is inferred; the negative entry keeps documents without hits
    marked = marked.select("*", F.when(F.col("v") < 0, F.col("v")).otherwise(hashed("v")).alias("f"))
    found = join_by_size(marked, prints, ["f"], "left", "32 + 8 * size(shorts)").where("v < 0 or shorts is not null")
    found = written(found.select("doc_id", "k", "n_words", F.when(F.col("v") >= 0, F.col("v").bitwiseAND((1 << _BITS) - 1)).cast("int").alias("at"), F.explode_outer("shorts").alias("short")))

    spans = found.where("at is not null").select("doc_id", "k", F.expr(f"explode(case when short = 0 then transform(sequence(greatest(at - {inner}, 0), least(at, cast(n_words as int) - {window})), s -> struct(s as s, {window} as wlen)) else array(struct(at as s, short as wlen)) end)").alias("w"))
    near = written(spans.select("doc_id", "k", "w.s", "w.wlen").distinct().groupBy("doc_id", "k").agg(F.collect_list(F.struct("s", "wlen")).alias("near")))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("d", "text"))
    hit = join_by_size(texts, near.select("k", "doc_id", "near"), ["k"], "inner", "40 + 24 * size(near)").where(F.col("d").eqNullSafe(F.col("doc_id")))
    # words is used twice, so that it is computed once for a row and not once for a window
    each = hit.select("doc_id", "k", words_of("text").alias("words"), "near").select("doc_id", "k", F.size("words").alias("n"), F.expr("transform(near, w -> struct(w.s as s, w.wlen as wlen, array_join(slice(words, w.s + 1, w.wlen), ' ') as wtext))").alias("near"))
    each = each.select("doc_id", "k", "n", F.explode_outer("near").alias("w")).where("w.s + w.wlen <= n").select("doc_id", "k", "w.*").distinct()
    real = join_by_size(each, written(benchmark_windows(bench, window)), ["wtext", "wlen"], "inner", "40 + length(wtext) + 40 * size(items)")
    # words covered by windows in order of their start: each adds what lies beyond all earlier ends
    earlier = F.max(F.col("s") + F.col("wlen")).over(Window.partitionBy("doc_id", "k").orderBy("s", "wlen").rowsBetween(Window.unboundedPreceding, -1))
    covered = real.withColumn("seen", F.coalesce(earlier, F.lit(0))).withColumn("adds", F.greatest(F.lit(0), F.col("s") + F.col("wlen") - F.greatest("s", "seen")))
    total = covered.groupBy("doc_id", "k").agg(F.sum("adds").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    total = total.select(F.col("doc_id").alias("hit_id"), F.col("k"), "n_hit", "items")
    rows = found.where("at is null").select("doc_id", "k", "n_words")
    joined = rows.join(total, (rows["k"] == total["k"]) & rows["doc_id"].eqNullSafe(total["hit_id"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(rows["doc_id"], "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs without documents that hold a benchmark window."""
    hit = contamination(docs, bench, window, gram).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return join_small(docs, written(hit), "doc_id", "left_anti")
