"""One card for each work: groups by key, joined over shared ISBNs, with display title, authors and sorted lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import sort_isbns
from ..functions.text import audience_value, canonical_authors, cell, is_holdings_batch, normalize_level, review_value, sort_batches, sort_levels, title_key, truthy
from ..sources.listings import REVIEWS
from .components import components, shared_isbn_pairs, stored

PLACE = ("source_seq", "row_seq")


def title_groups(rows: DataFrame) -> DataFrame:
    """Groups of accepted rows by their key: group_key, rows, titles (distinct raw titles), posted, in_collection."""
    r = rows.where("group_key <> ''")
    return r.groupBy("group_key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.nullif("title", F.lit(""))).alias("titles"), F.max(~_held()).alias("posted"), F.max(_held()).alias("in_collection"))


def _held() -> Column:
    return (F.col("presence") == "holdings") | is_holdings_batch("source_batch")


def display_titles(rows: DataFrame, by: str = "group_key") -> DataFrame:
    """by, display_title: no mark of abridgement, then most rows, then longest, then first; posted titles if there are any."""
    place = F.struct(*PLACE)
    counts = rows.where("title <> ''").groupBy(by, "title").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("presence") != "holdings").cast("int")).alias("posted"), F.min(place).alias("first"), F.min(F.when(F.col("presence") != "holdings", place)).alias("first_posted"))
    plain = (~F.col("title").rlike(r"(?i)\((un)?abridged\)")).cast("int")

    def best(n: str, first: str) -> Column:
        rank = F.struct(plain, F.col(n), F.length("title"), -F.col(f"{first}.source_seq"), -F.col(f"{first}.row_seq"))
        return F.max_by("title", F.when(F.col(n) > 0, rank))

    each = counts.groupBy(by).agg(best("posted", "first_posted").alias("p"), best("n", "first").alias("a"), F.sum("posted").alias("any_posted"))
    return each.select(by, F.when(F.col("any_posted") > 0, F.col("p")).otherwise(F.col("a")).alias("display_title"))


def ordered_values(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """by, and the distinct values in the order of their first place; the first aggregate bounds the lists."""
    firsts = rows.select(by, value.alias("v"), *PLACE).where("v <> ''").groupBy(by, "v").agg(F.min(F.struct(*PLACE)).alias("first"))
    return firsts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda s: s["v"]).alias(name))


def card_labels(rows: DataFrame) -> DataFrame:
    """group_key, label of the groups that share ISBNs with related ones."""
    r = rows.where("group_key <> ''")
    isbns = r.select(F.col("group_key").alias("key"), F.explode("isbns").alias("isbn"))
    titles = r.select(F.col("group_key").alias("key"), "title").where("title <> ''").distinct()
    return components(shared_isbn_pairs(isbns, titles)).withColumnRenamed("key", "group_key")


def build_cards(rows: DataFrame, levels: Sequence[str] | None = None, labels: DataFrame | None = None, with_group: bool = False) -> DataFrame:
    """Cards of accepted rows. Member rows are aggregated once by their component; groups are never merged as objects.

    labels: group_key, label where components are known; with_group: keeps gid, the component.
    """
    r = rows.where("group_key <> ''").join(card_labels(rows) if labels is None else labels, "group_key", "left").withColumn("gid", F.coalesce("label", "group_key"))
    r = stored(r.withColumns({"batch": cell("source_batch"), "held": _held(), "holdings_batch": is_holdings_batch("source_batch") | (F.col("presence") == "holdings"), "audience_v": audience_value("audience"), "level_v": normalize_level("level"), "edition_v": cell("edition"), **{f"{c}_v": review_value(c) for c in REVIEWS}}))
    some = lambda c: F.collect_set(F.nullif(c, F.lit("")))
    # values of equal rows are gathered once, and counts come from their own rows: sets beside distinct counts would be carried through each of their steps
    flags = {**{f"has_{f}": truthy(f) for f in ("book", "ebook", "audio")}, "flagged": truthy("possible_duplicate")}
    each = r.select("gid", "isbns", "batch", "held", "holdings_batch", "level_v", "audience_v", "edition_v", *(f"{c}_v" for c in REVIEWS), *(v.alias(n) for n, v in flags.items())).distinct()
    agg = each.groupBy("gid").agg(
        F.array_distinct(F.flatten(F.collect_set("isbns"))).alias("isbns"),
        some("batch").alias("batches"),
        F.collect_set(F.when(~F.col("holdings_batch"), F.nullif("batch", F.lit("")))).alias("posted_batches"),
        F.collect_set(F.when(F.col("holdings_batch"), F.nullif("batch", F.lit("")))).alias("holdings_batches"),
        some("level_v").alias("levels"),
        F.array_sort(some("audience_v")).alias("audiences"),
        F.array_sort(some("edition_v")).alias("editions"),
        F.struct(*(F.max(f"has_{f}").alias(f) for f in ("book", "ebook", "audio"))).alias("formats"),
        F.max(~F.col("held")).alias("posted"),
        F.max("held").alias("in_collection"),
        F.max("flagged").alias("flagged"),
        F.struct(*(F.array_sort(F.collect_set(f"{c}_v")).alias(c) for c in REVIEWS)).alias("review_lists"),
    )
    told = r.groupBy("gid", "group_key", "title").agg(F.count(F.lit(1)).alias("n"))
    counts = told.groupBy("gid").agg(F.sum("n").alias("row_count"), F.count_distinct("group_key").alias("groups"), F.count_distinct(F.nullif("title", F.lit(""))).alias("titles"))
    agg = agg.join(counts, "gid").join(r.groupBy("gid").agg(F.min_by("group_key", F.struct(*PLACE)).alias("base_key")), "gid")
    cards = agg.join(display_titles(r, "gid"), "gid", "left").join(ordered_values(r, "gid", F.col("author"), "names"), "gid", "left")
    title = F.coalesce("display_title", F.lit(""))
    key = F.coalesce(F.nullif(title_key(title), F.lit("")), F.col("base_key"))
    order = (lambda c: sort_levels(c, levels)) if levels else sort_levels
    reviews = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, REVIEWS)), F.array(*(F.col(f"review_lists.{c}") for c in REVIEWS))), lambda k, v: F.size(v) > 0)
    return cards.select(
        *(["gid"] if with_group else []), F.substring(F.sha1(key), 1, 12).alias("id"), key.alias("key"), title.alias("title"), (title == "").alias("title_unknown"),
        canonical_authors(F.coalesce("names", F.array().cast("array<string>"))).alias("authors"), sort_isbns("isbns").alias("isbn_digits"),
        sort_batches("batches").alias("batches"), sort_batches("posted_batches").alias("posted_batches"), sort_batches("holdings_batches").alias("holdings_batches"),
        order("levels").alias("levels"), "audiences", "editions", "formats", "posted", "in_collection",
        (F.col("flagged") | (F.col("groups") > 1) | (F.col("titles") > 1)).alias("possible_duplicate"), reviews.alias("reviews"), "row_count",
    )


def presence() -> Column:
    """both, holdings or posted; a missing posted flag counts as true, a missing in_collection flag as false."""
    posted, held = F.coalesce("posted", F.lit(True)), F.coalesce("in_collection", F.lit(False))
    return F.when(posted & held, "both").when(held, "holdings").otherwise("posted")


def facets(cards: DataFrame) -> DataFrame:
    """kind (batch or level), value, titles."""
    each = cards.select(F.explode(F.concat(F.transform("batches", lambda v: F.struct(F.lit("batch").alias("kind"), v.alias("value"))), F.transform("levels", lambda v: F.struct(F.lit("level").alias("kind"), v.alias("value"))))).alias("f"))
    return each.groupBy("f.kind", "f.value").agg(F.count(F.lit(1)).alias("titles"))


def row_facets(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``facets`` of the cards of accepted rows, counted from the rows and their components: nothing else of a card is built."""
    r = rows.where("group_key <> ''").join(card_labels(rows) if labels is None else labels, "group_key", "left")
    values = F.array(F.struct(F.lit("batch").alias("kind"), cell("source_batch").alias("value")), F.struct(F.lit("level").alias("kind"), normalize_level("level").alias("value")))
    each = r.select(F.coalesce("label", "group_key").alias("gid"), F.explode(values).alias("f")).select("gid", "f.*").where("value <> ''").distinct()
    return each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("titles"))


def catalog_stats(status: DataFrame, cards: DataFrame) -> DataFrame:
    """name, value: accepted rows, cards and skipped rows by cause; status: status, n."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0))
    rows = status.agg(of("accepted").alias("rows"), of("duplicate").alias("skipped_duplicate"), of("excluded").alias("skipped_excluded"), of("empty").alias("skipped_empty"))
    made = cards.agg(F.count(F.lit(1)).alias("unique_titles"), F.count_if("posted").alias("posted_titles"), F.count_if(F.col("posted") & F.col("in_collection")).alias("in_collection_posted"))
    pivot = lambda d: d.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, d.columns)), F.array(*(F.col(c).cast("long") for c in d.columns)))).alias("name", "value"))
    return pivot(rows).union(pivot(made))


def browse(cards: DataFrame, batch: str = "all", level: str = "all") -> DataFrame:
    """Cards with the batch and the level; ``all`` is no filter."""
    if batch != "all":
        cards = cards.where(F.array_contains("batches", batch))
    return cards.where(F.array_contains("levels", level)) if level != "all" else cards


def sorted_cards(cards: DataFrame) -> DataFrame:
    """By title or first ISBN, without regard to case and accents; then by id."""
    return cards.orderBy(F.collate(F.coalesce(F.nullif("title", F.lit("")), F.get("isbn_digits", F.lit(0)), F.lit("")), "en_CI_AI"), "id")
