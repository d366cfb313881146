"""A stored index of words: built once, read by many lookups.

Three tables: the dictionary (each word once, numbered in its order, with the number of its rows and its
first four characters), the postings (a word's rows in blocks), and the rows with all their words.  Words
that begin with a query's word are neighbours in the dictionary, so nothing is listed under its beginnings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.collections import dense_index
from .components import stored

#: Characters from which a query's word also begins longer ones; rows of a block of postings.
BEGINS, BLOCK = 4, 1024
NAMES = ("words", "postings", "rows")


@dataclass
class TokenIndex:
    """words: token, ix, n, head; postings: ix, block, row_ids; rows: row_id, tokens."""

    words: DataFrame
    postings: DataFrame
    rows: DataFrame


def build(tokens: DataFrame) -> TokenIndex:
    """The index of distinct (row_id, token)."""
    tokens = stored(tokens.select("row_id", "token").distinct())
    numbered = stored(dense_index(tokens.select("token").distinct(), "token"))
    each = tokens.join(numbered, "token").select("ix", "row_id")
    # blocks by the row's hash, so that a word of a third of all rows is many groups
    sizes = stored(each.groupBy("ix").agg(F.count(F.lit(1)).alias("n")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = each.join(sizes, "ix").select("ix", F.pmod(F.xxhash64("row_id"), blocks).alias("block"), "row_id")
    postings = dealt.groupBy("ix", "block").agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"))
    words = numbered.join(sizes, "ix").select("token", "ix", "n", F.substring("token", 1, BEGINS).alias("head"))
    rows = tokens.groupBy("row_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    ranged = lambda d, *by: d.repartitionByRange(*by).sortWithinPartitions(*by)
    return TokenIndex(ranged(words, "token"), ranged(postings, "ix", "block"), ranged(rows, "row_id"))


def save(index: TokenIndex, path: str) -> None:
    """Writes the tables in their order, so that a range of words or rows is read from few row groups."""
    for name in NAMES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> TokenIndex:
    return TokenIndex(*(spark.read.parquet(f"{path}/{name}") for name in NAMES))


def _fits(w: Column, token: Column) -> Column:
    return (w == token) | ((F.length(w) >= BEGINS) & token.startswith(w))


def search(queries: DataFrame, index: TokenIndex, limit: int = 12) -> DataFrame:
    """query_id, row_id, rank: as ``search.token_search``, from a stored index.

    Only the postings of each query's rarest word are read, and the words of the rows that they name.
    """
    asked = stored(queries.select("query_id", tokenize("query").alias("words")).where(F.size("words") > 0))
    each = asked.select("query_id", F.explode("words").alias("w"))
    distinct = each.select("w").distinct().withColumn("head", F.substring("w", 1, BEGINS))
    meant = stored(distinct.join(index.words, "head").where(_fits(F.col("w"), F.col("token"))).select("w", "ix", "n"))
    total = meant.groupBy("w").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "w"))
    rarest = each.join(total, "w", "left").withColumn("place", place).where("place = 1").select("query_id", "w")
    found = rarest.join(meant, "w").join(index.postings, "ix").select("query_id", F.explode("row_ids").alias("row_id")).distinct()
    hits = found.join(asked, "query_id").join(index.rows, "row_id").where(F.forall("words", lambda w: F.exists("tokens", lambda t: _fits(w, t))))
    later = (F.size("words") == 1) & ~F.array_contains("tokens", F.get("words", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(later, "row_id")
    return hits.select("query_id", "row_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= limit)
