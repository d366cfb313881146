"""Cards that are one work on the desk: by title key or first ISBN, then over shared ISBNs of related titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import sort_isbns
from ..functions.text import loose_key, title_key
from ..sources.listings import REVIEWS
from .cards import browse
from .components import components, shared_isbn_pairs


def title_group_key() -> Column:
    """``title:`` and the key, else ``isbn:`` and the first ISBN of ten characters or more, the first ISBN, or the id."""
    key = title_key("title")
    isbn = F.coalesce(F.get(F.filter("isbn_digits", lambda d: F.length(d) >= 10), F.lit(0)), F.get("isbn_digits", F.lit(0)), F.col("id"))
    return F.when(key != "", F.concat(F.lit("title:"), key)).otherwise(F.concat(F.lit("isbn:"), isbn))


def _titled(c: DataFrame, key: str = "group_key") -> DataFrame:
    """key, title of the groups that have a title's letters or digits; the others go with any owner of their ISBNs."""
    return c.where(title_key("title") != "").select(F.col(key).alias("key"), "title").distinct()


def collapse_labels(cards: DataFrame) -> DataFrame:
    """id, group_key and group (label of the component) of every card; an untitled card joins all that share an ISBN with it."""
    c = cards.withColumn("group_key", title_group_key())
    isbns = c.select(F.col("group_key").alias("key"), F.explode("isbn_digits").alias("isbn"))
    labels = components(shared_isbn_pairs(isbns, _titled(c))).select(F.col("key").alias("group_key"), "label")
    return c.select("id", "group_key").join(labels, "group_key", "left").select("id", "group_key", F.coalesce("label", "group_key").alias("group"))


def merge_records(cards: DataFrame, by: str = "group") -> DataFrame:
    """One card for each value of ``by``: the best base first, lists and reviews joined in that order, flags or-ed, rows added.

    Values of lists are aggregated each with its first place, so what is gathered is as long as the result, not as the group.
    """
    score = _base_score((F.col("title") != "") & ~F.coalesce("title_unknown", F.lit(False)))
    empty = F.array().cast("array<string>")
    place = F.struct((-score).alias("s"), "id")
    lists = {"authors": loose_key, "isbn_digits": lambda v: v, **dict.fromkeys(("batches", "posted_batches", "holdings_batches", "levels", "audiences", "editions"), F.lower)}
    columns = {c: (F.coalesce(c, empty), fold) for c, fold in lists.items()}
    if "reviews" in cards.columns:
        columns |= {f"review_{c}": (F.coalesce(F.col("reviews")[c], empty), F.lower) for c in REVIEWS}

    def told(name: str, values: Column, fold) -> Column:
        return F.transform(values, lambda v, at: F.struct(F.lit(name).alias("kind"), fold(v).alias("fold"), at.alias("at"), v.alias("value")))

    each = cards.select(by, place.alias("place"), F.explode(F.concat(*(told(n, v, f) for n, (v, f) in columns.items()))).alias("e"))
    firsts = each.groupBy(by, "e.kind", "e.fold").agg(F.min(F.struct("place", "e.at", "e.value")).alias("f"))
    values = firsts.groupBy(by).agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == n, F.col("f")))), lambda s: s["value"]).alias(n) for n in columns))
    title = F.coalesce(F.min_by(F.nullif("title", F.lit("")), F.when(F.col("title") != "", place)), F.lit(""))
    g = cards.groupBy(by).agg(
        F.min_by(F.struct("id", "key"), place).alias("base"), title.alias("title"), F.count_distinct(F.nullif("title", F.lit(""))).alias("titles"),
        F.struct(*(F.max(f"formats.{f}").alias(f) for f in ("book", "ebook", "audio"))).alias("formats"),
        F.max(F.coalesce("posted", F.lit(True))).alias("posted"), F.max(F.coalesce("in_collection", F.lit(False))).alias("in_collection"),
        F.max("possible_duplicate").alias("flagged"), F.sum("row_count").alias("row_count"),
    ).withColumnRenamed(by, "_by")
    g = g.join(values, F.col("_by").eqNullSafe(F.col(by)), "left")
    of = lambda c: F.coalesce(c, empty)
    reviews = [F.map_filter(F.map_from_arrays(F.array(*map(F.lit, REVIEWS)), F.array(*(of(f"review_{c}") for c in REVIEWS))), lambda k, v: F.size(v) > 0).alias("reviews")] if "reviews" in cards.columns else []
    return g.select(F.col("base.id").alias("id"), F.col("base.key").alias("key"), "title", (F.col("title") == "").alias("title_unknown"), of("authors").alias("authors"), sort_isbns(of("isbn_digits")).alias("isbn_digits"), *(of(c).alias(c) for c in list(lists)[2:]), "formats", "posted", "in_collection", (F.col("flagged") | (F.col("titles") > 1)).alias("possible_duplicate"), *reviews, "row_count")


def _base_score(known: Column) -> Column:
    """How good a card is as the base of a work: a known title, then posted, then held."""
    return F.when(known, 4).otherwise(0) + F.when(F.coalesce("posted", F.lit(True)), 2).otherwise(0) + F.when(F.coalesce("in_collection", F.lit(False)), 1).otherwise(0)


def collapse_cards(cards: DataFrame) -> DataFrame:
    return merge_records(cards.join(collapse_labels(cards).select("id", "group"), "id"))


def browse_works(cards: DataFrame, batch: str = "all", level: str = "all") -> DataFrame:
    """The works of a batch and level: cards are chosen first and collapsed among themselves."""
    return collapse_cards(browse(cards, batch, level))


def collapse_scored(hits: DataFrame) -> DataFrame:
    """query_id, id, title, score, reason: each query's hits with one for each work, at its best score and that one's reason.

    hits: query_id, id, title, isbn_digits, posted, in_collection, score, reason.  Works are those of
    title_group_key and of shared ISBNs, among the hits of one query; id is that of the best base, title the first there is.
    """
    h = hits.withColumn("key", F.concat_ws("\x01", "query_id", title_group_key()))
    isbns = h.select("key", F.explode("isbn_digits").alias("d")).where("d <> ''").select("key", F.concat_ws("\x01", F.substring_index("key", "\x01", 1), "d").alias("isbn"))
    labels = components(shared_isbn_pairs(isbns, _titled(h, "key")))
    base = F.struct((-_base_score(F.col("title") != "")).alias("s"), "id")
    g = h.join(labels, "key", "left").groupBy("query_id", F.coalesce("label", "key").alias("group")).agg(F.min_by("id", base).alias("id"), F.coalesce(F.min_by(F.nullif("title", F.lit("")), F.when(F.col("title") != "", base)), F.lit("")).alias("title"), F.min_by(F.struct("score", "reason"), F.struct(-F.col("score"), "id")).alias("best"))
    return g.select("query_id", "id", "title", "best.score", "best.reason")
