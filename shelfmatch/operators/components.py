"""Groups that share an ISBN and look alike, and the connected components of such pairs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import titles_related
from ..functions.text import folded_key, significant_tokens

_own: list[str] = []


def workspace(spark: SparkSession) -> str:
    """A new folder in the shared folder (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # tests and local sessions
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="shelfmatch-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again, so that plans stay short."""
    path = workspace(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: Spark takes what is exploded from a small file for as small as the file."""
    return df.hint("merge")


#: Titled groups of an ISBN up to which all their pairs are compared; the pairs found are the same for any value.
HOT = 8
#: Lengths of the parts by which titles without blanks meet, by the shorter one's length: from 5, 8 and 24 characters.
PART, LONG_PART, WINDOW = {2: 5, 3: 8}, 16, 9
#: Parts of a title among which the rarest is taken.
TRIED = 4


def _mark(kind: int, g: Column) -> Column:
    """A part or word of a title of an ISBN as 64 bits; equal marks of unlike ones add pairs to compare and lose none."""
    return F.xxhash64(F.lit(kind), "isbn", g)


def _grams(kind: int, c: Column, n: int) -> Column:
    """Marks of all parts of n characters; none where the text is shorter."""
    marks = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: _mark(kind, F.substring(c, i, F.lit(n))))
    return F.when(F.length(c) >= n, F.array_distinct(marks)).otherwise(F.array().cast("array<bigint>"))


def _minimizers(kind: int, c: Column, n: int, window: int) -> Column:
    """Of every run of ``window`` parts the least mark; a text inside another one has some of the other's, its own all among them."""
    marks = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: _mark(kind, F.substring(c, i, F.lit(n))))
    least = lambda m: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(m) - window + 1), lambda i: F.array_min(F.slice(m, i, window))))
    return F.when(F.length(c) >= n + window - 1, F.get(F.transform(F.array(marks), least), F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def _without_one(w: Column) -> Column:
    """A word, and what it is without each of its letters in turn where it has five or more."""
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.when(F.length(w) >= 5, F.array_distinct(F.concat(F.array(w), cut))).otherwise(F.array(w))


def related_candidates(owners: DataFrame) -> DataFrame:
    """Pairs a < b of ids of one ISBN's titles, among them all related ones, without pairing all: owners: isbn, id (long), fk (folded title).

    Titles meet by marks of 64 bits, so what is shuffled are numbers; each title asks by few of its marks, the rarest
    of them, and is listed under all of its marks that any title of its ISBN may ask for.

    * A title inside another or the beginning of one, without blanks: shorter than five characters they are equal; a title
      of less than eight characters in all can only be the beginning, so it asks by its first five; else it asks by a part of
      5, 8 or (from 24 characters) 16, of which the longest are listed by minimizers.
    * A title whose words (two or more, of three letters or more) are all in another asks by its rarest word.
    * Where at least three and three quarters of the words are alike but for one edit, one of any n - h + 1 words is, so these
      are asked for; alike words are equal, or become so when one or each of them loses a letter.
    """
    c, n = F.col("compact"), F.length("compact")
    o = owners.withColumns({"compact": F.regexp_replace("fk", " ", ""), "words": significant_tokens(F.col("fk"))})
    o = o.withColumns({"row": F.xxhash64("isbn", "id", "fk"), "class": F.when(n < 5, 0).when((n < 8) & (F.length("fk") < 8), 1).when(n < 8, 2).when(n < 24, 3).otherwise(4)})
    asked_for = o.groupBy("isbn").agg(*(F.max(F.col("class") == k).alias(f"any{k}") for k in PART))
    o = stored(o.join(asked_for, "isbn"))
    none = F.array().cast("array<bigint>")
    start = _mark(1, F.substring(c, 1, 5))
    listed = [F.when(n < 5, F.array(_mark(0, c))).otherwise(F.array(start)), *(F.when(F.col(f"any{k}"), _grams(k, c, size)).otherwise(none) for k, size in PART.items()), _minimizers(4, c, LONG_PART, WINDOW)]
    few = lambda m: F.slice(F.array_sort(m), 1, TRIED)
    asks = F.when(F.col("class") == 0, F.array(_mark(0, c))).when(F.col("class") == 1, F.array(start))
    for k, size in PART.items():
        asks = asks.when(F.col("class") == k, few(_grams(k, c, size)))
    # a mark of one title alone has no other; most are, so all are shuffled once and only the others are kept
    parts = o.select("id", F.explode(F.concat(*listed)).alias("h")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h")))
    parts = stored(parts.where("df > 1").select("id", "h"))
    asked = o.select("row", "id", F.explode(asks.otherwise(few(_minimizers(4, c, LONG_PART, WINDOW)))).alias("h"))
    rarest = shuffled(asked).join(parts.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h", "left").groupBy("row", "id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h")).alias("m"))
    pairs = [rarest.where("m.df > 1").select("id", "m.h").join(parts.withColumnRenamed("id", "other"), "h")]
    # words
    spoken = o.where(F.size("words") >= 2).select("row", "id", "isbn", F.size("words").alias("n"), F.posexplode("words").alias("p", "w")).withColumn("h", _mark(5, F.col("w")))
    known = stored(o.select("id", "isbn", F.explode(F.array_distinct("words")).alias("w")).select("id", _mark(5, F.col("w")).alias("h")))
    df = known.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    by_df = stored(shuffled(spoken).join(df, "h").groupBy("row", "id", "isbn", "n").agg(F.array_sort(F.collect_list(F.struct("df", "p", "h", "w"))).alias("ws")))  # a title's words
    one = F.get("ws", F.lit(0))
    pairs.append(by_df.where(one["df"] > 1).select("id", one["h"].alias("h")).join(known.withColumnRenamed("id", "other"), "h"))
    form = lambda w: F.transform(_without_one(w), lambda g: _mark(6, g))
    most = F.col("n") - F.greatest(F.lit(3), F.ceil(0.75 * F.col("n") - 1e-9)) + 1
    alike = o.where(F.size("words") >= 3).select(F.col("id").alias("other"), F.explode(F.array_distinct(F.flatten(F.transform("words", form)))).alias("h"))
    pairs.append(by_df.where("n >= 3").select("id", F.explode(F.array_distinct(F.flatten(F.transform(F.slice("ws", 1, most.cast("int")), lambda x: form(x["w"]))))).alias("h")).join(shuffled(alike), "h"))
    out = pairs[0].select("id", "other")
    for d in pairs[1:]:
        out = out.union(d.select("id", "other"))
    return out.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def shared_isbn_pairs(isbns: DataFrame, titles: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs a < b of groups with a common ISBN whose titles look related.

    isbns: key, isbn; titles: key, title (none for untitled groups).  Untitled groups go with any
    owner of their ISBN; they are linked to one owner of each ISBN instead of to all of them, which
    gives the same components.  ISBNs with more than ``hot``
    titled groups are compared by blocks (``related_candidates``) instead of all with all.  Keys are told apart by
    64-bit hashes until the related pairs are known.
    """
    ident = F.xxhash64("key").alias("id")
    # blank ones go after storing: that filter would be worked out for each row, before the titles are made distinct
    folded = stored(titles.select("key", "title").distinct().select("key", folded_key("title").alias("fk")).distinct().select(ident, "key", "fk")).where("fk <> ''")
    titled = titles.select("key").distinct().withColumn("titled", F.lit(True))
    owners = isbns.select("key", "isbn").where("isbn <> ''").distinct()
    shared = owners.groupBy("isbn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("isbn")
    owners = stored(owners.join(shared, "isbn").join(titled, "key", "left").withColumn("titled", F.coalesce("titled", F.lit(False))))
    named = owners.where("titled").select("isbn", ident)
    crowd = stored(named.groupBy("isbn").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("isbn", (F.col("m") > hot).alias("many")))
    named = named.join(crowd, "isbn")
    few = named.where("not many").select("isbn", "id")
    met = few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), "isbn").where("a < b").select("a", "b")
    if not crowd.where("many").isEmpty():
        met = met.union(related_candidates(named.where("many").join(folded, "id").select("isbn", "id", "fk")))
    side = lambda x: folded.select(F.col("id").alias(x), F.struct("key", "fk").alias(f"s{x}"))
    both = met.distinct().join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").select(F.least("sa", "sb").alias("x"), F.greatest("sa", "sb").alias("y"))
    pairs = both.where(titles_related(F.col("x.fk"), F.col("y.fk"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()  # of titles of one length the first by key is the shorter one
    hub = owners.groupBy("isbn").agg(F.min("key").alias("hub"), F.min(F.when(~F.col("titled"), F.col("key"))).alias("open")).where("open is not null")
    stars = owners.join(hub, "isbn").where("key <> open").select(F.least("key", "open").alias("a"), F.greatest("key", "open").alias("b"))
    return pairs.union(stars).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """key, label (the smallest key of the component) of every key in a pair; large and small stars until all edges lead to labels.

    A node with very many neighbours holds nothing up: minima are combined before they are shuffled, and its part of
    the joins is split by the adaptive skew join, as the other side has one row for each node.
    """
    e = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not e.isEmpty():
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends: Column = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
        e = stored(large.join(low, "u").select(ends.alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        # done when each node has one edge, to a label that has none
        lasting = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("v").union(e.groupBy("u").count().where("count > 1").select("u"))
        if lasting.isEmpty():
            break
    return e.select(F.col("u").alias("key"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
