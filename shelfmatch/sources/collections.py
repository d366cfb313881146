"""Exclusion rules, stored collections and the dictionary-encoded form of holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cell
from ..operators.components import stored

RULES = "title string, author string, hideFromDesk boolean, matchAuthor boolean, aliases array<string>"


def load_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Rules (title, author, hide, match_author, aliases) from JSON: a list, or an object with postedTitles."""
    raw = spark.read.option("multiLine", True).schema(f"{RULES}, postedTitles array<struct<title:string,author:string,hideFromDesk:boolean,matchAuthor:boolean,aliases:array<string>>>").json(path)
    own = F.struct("title", "author", "hideFromDesk", "matchAuthor", "aliases")
    each = raw.select(F.explode(F.when(F.col("postedTitles").isNull(), F.array(own)).otherwise(F.col("postedTitles"))).alias("r"))
    aliases = F.filter(F.transform(F.coalesce("r.aliases", F.array().cast("array<string>")), cell), lambda a: a != "")
    rules = each.select(cell("r.title").alias("title"), cell("r.author").alias("author"), F.coalesce("r.hideFromDesk", F.lit(False)).alias("hide"), F.coalesce("r.matchAuthor", F.lit(False)).alias("match_author"), aliases.alias("aliases"))
    return rules.where("title <> '' and author <> ''")


#: Cards of a shard where no number of shards is given.
SHARD_ROWS = 50_000


def _shard(key: str, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def write_collection(cards: DataFrame, facets: DataFrame, stats: DataFrame, path: str, shards: int | None = None) -> None:
    """Cards in folders by a hash of their key, so that a key is found by reading one; facets and counters beside them.

    The number of shards follows the number of cards and is kept with them.
    """
    spark = cards.sparkSession
    shards = shards or max(1, -(-cards.count() // SHARD_ROWS))
    cards.withColumn("shard", _shard("key", shards)).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/cards")
    spark.createDataFrame([(shards,)], "shards int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    _beside(facets, stats, path)


def _beside(facets: DataFrame, stats: DataFrame, path: str) -> None:
    facets.coalesce(1).write.mode("overwrite").parquet(f"{path}/facets")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def shards_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/layout").first()["shards"]


def _pruned(cards: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Stored cards of the shards that hold the keys; their numbers are in the plan, so other folders aren't listed or read."""
    wanted = [r[0] for r in keys.select(_shard("key", shards)).distinct().collect()]  # shards at most
    return cards.where(F.col("shard").isin(wanted))


def update_collection(changed: DataFrame, gone: DataFrame, facets: DataFrame, stats: DataFrame, path: str) -> None:
    """Puts changed cards in place of those with their keys and takes out the keys of gone (column key); only touched shards are written.

    A shard that loses its last card stays as an empty folder.
    """
    spark = changed.sparkSession
    shards = shards_of(spark, path)
    keys = stored(changed.select("key").union(gone.select("key")).distinct())
    old = _pruned(spark.read.parquet(f"{path}/cards"), keys, shards)
    kept = old.join(keys, "key", "left_anti")
    # written elsewhere first: a table can't be overwritten while it is read
    now = stored(kept.unionByName(changed.withColumn("shard", _shard("key", shards))))
    now.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/cards")
    left = {r["shard"] for r in now.select("shard").distinct().collect()}
    emptied = [r["shard"] for r in old.select("shard").distinct().where(~F.col("shard").isin(list(left))).collect()] if left else [r["shard"] for r in old.select("shard").distinct().collect()]
    for shard in emptied:  # dynamic overwriting leaves a shard alone that nothing is written to
        now.limit(0).drop("shard").write.mode("overwrite").parquet(f"{path}/cards/shard={shard}")
    _beside(facets, stats, path)


def read_cards(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Stored cards; with ``keys`` (column key) only those, from their shards."""
    cards = spark.read.parquet(f"{path}/cards")
    if keys is not None:
        cards = _pruned(cards, keys, shards_of(spark, path)).join(keys.select("key").distinct(), "key", "left_semi")
    return cards.drop("shard")


def dense_index(values: DataFrame, column: str) -> DataFrame:
    """Adds ix from 0 in the order of a distinct column, without sorting everything in one task."""
    # stored, as it is read twice and a range partitioning samples anew each time
    parts = stored(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    inside = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_i")))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return inside.join(F.broadcast(before), "_p").select(column, (F.col("_before") + F.col("_n") - 1).alias("ix"))  # one row a partition


def encode_holdings(holdings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Authors and labels (value, ix; ix 0 is empty) and rows (isbn13, isbn_number, author_ix, label_ix, format, extras) in the order of their numbers."""
    label = F.coalesce(F.nullif(cell("title"), F.lit("")), cell("series"))
    h = holdings.select("isbn13", cell("author").alias("author"), label.alias("label"), "format", "extras")
    tables = []
    for c in ("author", "label"):
        values = h.select(F.col(c).alias("value")).where("value <> ''").distinct()
        tables.append(dense_index(values, "value").select("value", (F.col("ix") + 1).alias("ix")).unionByName(h.sparkSession.createDataFrame([("", 0)], "value string, ix long")))
    a, s = tables
    coded = h.join(a.withColumnsRenamed({"value": "author", "ix": "author_ix"}), "author").join(s.withColumnsRenamed({"value": "label", "ix": "label_ix"}), "label")
    return a, s, coded.select("isbn13", F.col("isbn13").try_cast("long").alias("isbn_number"), "author_ix", "label_ix", "format", "extras").orderBy("isbn_number", "isbn13")


def decode_holdings(authors: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(authors.withColumnsRenamed({"value": "author", "ix": "author_ix"}), "author_ix").join(labels.withColumnsRenamed({"value": "label", "ix": "label_ix"}), "label_ix").select("isbn13", "author", "label", "format", "extras")


#: Numbers up to which a lookup is a filter in the scan; more are joined.
POINTS = 1000


def write_compact_holdings(holdings: DataFrame, path: str) -> None:
    """Authors, labels and rows as files: rows sorted by number over all files, numbers and places in tables stored as differences.

    The files' own statistics are the index: what holds a number is found without reading the rest.
    """
    authors, labels, rows = encode_holdings(holdings)
    text = F.when(F.col("isbn_number").isNull() | (F.lpad(F.col("isbn_number").cast("string"), 13, "0") != F.col("isbn13")), F.col("isbn13"))
    rows = rows.select("isbn_number", text.alias("isbn_text"), "author_ix", "label_ix", "format", "extras")
    delta = lambda d: d.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("compression", "zstd")
    for name, table in (("authors", authors.orderBy("ix")), ("labels", labels.orderBy("ix")), ("rows", rows)):
        delta(table).parquet(f"{path}/{name}")


def read_compact_holdings(spark: SparkSession, path: str, isbns: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """isbn13, author, label, format and extras of stored holdings; with isbns (column isbn13) of those alone; ordered: by number."""
    authors, labels, rows = (spark.read.parquet(f"{path}/{name}") for name in ("authors", "labels", "rows"))
    if isbns is not None:
        wanted = isbns.select(F.col("isbn13").try_cast("long").alias("isbn_number"), "isbn13").distinct()
        few = [r[0] for r in wanted.limit(POINTS + 1).select("isbn_number").collect()]
        if len(few) <= POINTS and None not in few:
            rows = rows.where(F.col("isbn_number").isin(few))
    number = F.coalesce("isbn_text", F.lpad(F.col("isbn_number").cast("string"), 13, "0"))
    rows = rows.withColumn("isbn13", number)
    if isbns is not None:
        rows = rows.join(wanted.select("isbn13"), "isbn13", "left_semi")
    out = decode_holdings(authors, labels, rows.select("isbn_number", "isbn13", "author_ix", "label_ix", "format", "extras"))
    return out.orderBy(F.col("isbn13").try_cast("long"), "isbn13") if ordered else out
