"""Holdings: one record for each ISBN, linked onto cards by ISBN and then by title; what is left is grouped by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import isbn_sort_key, parse_isbns, sort_isbns
from ..functions.text import AUDIO, MATERIALS, author_tokens, authors_compatible, canonical_authors, cell, format_bit, sort_batches, title_key
from ..sources.listings import BATCHES
from .ingest import matching_rows


def with_status(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds isbn13, isbn10, title, author, series and status: type, no_isbn, hidden or accepted."""
    first = F.get(parse_isbns("isbn"), F.lit(0))
    r = rows.withColumns({"p": first, "title": cell("title"), "author": cell("author"), "series": cell("series_title"), "material": cell("material_type")})
    r = r.withColumns({"isbn13": F.col("p.isbn13"), "isbn10": F.coalesce("p.isbn10", F.lit("")), "key": title_key(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("series")))}).drop("p")
    status: Column = F.when(~F.col("material").isin(*MATERIALS), "type").when(F.col("isbn13").isNull(), "no_isbn")
    r = r.withColumn("status", status)
    if rules is not None:
        hits = matching_rows(r.where("status is null").select(F.col("row_seq").alias("id"), "key", "author"), rules).select(F.col("id").alias("row_seq"), F.lit(True).alias("_hit"))
        r = r.join(hits, "row_seq", "left").withColumn("status", F.coalesce("status", F.when(F.col("_hit"), "hidden"))).drop("_hit")
    return r.withColumn("status", F.coalesce("status", F.lit("accepted")))


def by_isbn(rows: DataFrame) -> DataFrame:
    """A record for each isbn13 of accepted rows: first cells that aren't blank, format bits, counts and titles."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("row_seq"))), F.lit("")).alias(c)
    r = rows.where("status = 'accepted'")
    return r.groupBy("isbn13").agg(first("isbn10"), first("author"), first("title"), first("series"), F.bit_or(format_bit("material")).alias("format"), F.count(F.lit(1)).alias("rows"), F.min("row_seq").alias("place"))


def link(records: DataFrame, cards: DataFrame) -> DataFrame:
    """Adds card (id) and how (isbn, title, series or null) to records.

    Of several cards with an ISBN the last by title counts; of several with a title the first.  Titles
    are tried for what ISBNs leave over, with the title a card gets from its linked holdings where it had none.
    """
    order = F.struct(F.collate(F.coalesce(F.nullif("title", F.lit("")), F.get("isbn_digits", F.lit(0)), F.lit("")), "UNICODE_CI_AI"), "id")
    placed = cards.select("id", "title", "authors", "isbn_digits", order.alias("place"))
    index = placed.select(F.explode("isbn_digits").alias("isbn"), "id", "place").groupBy("isbn").agg(F.max_by("id", "place").alias("card"))
    r = records.join(index.withColumnsRenamed({"isbn": "isbn13", "card": "c13"}), "isbn13", "left")
    r = r.join(index.withColumnsRenamed({"isbn": "isbn10", "card": "c10"}), "isbn10", "left").withColumn("by_isbn", F.coalesce("c13", "c10")).drop("c13", "c10")
    named = r.where("by_isbn is not null").groupBy(F.col("by_isbn").alias("id")).agg(F.min_by(F.coalesce(F.nullif("title", F.lit("")), F.nullif("series", F.lit(""))), F.when((F.col("title") != "") | (F.col("series") != ""), F.col("place"))).alias("new_title"), F.collect_set(F.nullif("author", F.lit(""))).alias("more"))
    full = placed.join(named, "id", "left").select("id", "place", F.coalesce(F.nullif("title", F.lit("")), "new_title", F.lit("")).alias("title"), F.array_union("authors", F.coalesce("more", F.array().cast("array<string>"))).alias("authors"))
    keyed = full.select("id", "place", "authors", title_key("title").alias("ckey")).where("ckey <> ''")
    first = keyed.groupBy("ckey").agg(F.min_by("id", "place").alias("by_title"))
    rest = r.where("by_isbn is null")
    titled = rest.where("title <> ''").withColumn("ckey", title_key("title")).join(first, "ckey", "left").drop("ckey").withColumn("by_series", F.lit(None).cast("string"))
    audio = rest.where(f"title = '' and (format & {AUDIO}) > 0 and author <> '' and series <> ''").withColumn("ckey", title_key("series"))
    met = audio.join(keyed.withColumnRenamed("place", "card_place"), "ckey").where(F.exists("authors", lambda a: authors_compatible(author_tokens(a), author_tokens(F.col("author")))))
    found = met.groupBy("isbn13").agg(F.min_by("id", "card_place").alias("by_series"))
    untitled = rest.where("title = ''").join(found, "isbn13", "left").withColumn("by_title", F.lit(None).cast("string"))
    out = r.where("by_isbn is not null").withColumns({"by_title": F.lit(None).cast("string"), "by_series": F.lit(None).cast("string")}).unionByName(titled).unionByName(untitled)
    how = F.when(F.col("by_isbn").isNotNull(), "isbn").when(F.col("by_title").isNotNull(), "title").when(F.col("by_series").isNotNull(), "series")
    return out.withColumns({"card": F.coalesce("by_isbn", "by_title", "by_series"), "how": how}).drop("by_isbn", "by_title", "by_series")


def apply(cards: DataFrame, linked: DataFrame, batch: str = BATCHES["follett"]) -> DataFrame:
    """Cards with their linked holdings: batch, formats, ISBNs, authors, rows, and a title where there was none."""
    empty = F.array().cast("array<string>")
    label = F.coalesce(F.nullif("title", F.lit("")), F.nullif("series", F.lit("")))
    per = linked.where("card is not null").groupBy(F.col("card").alias("id")).agg(F.bit_or("format").alias("bits"), F.sum("rows").alias("more"), F.array_distinct(F.flatten(F.collect_list(F.array("isbn13", "isbn10")))).alias("digits"), F.transform(F.array_sort(F.collect_set(F.struct("place", "author"))), lambda s: s["author"]).alias("names"), F.min_by(label, F.when(label.isNotNull(), F.col("place"))).alias("new_title"))
    c = cards.join(per, "id", "left")
    held = F.col("bits").isNotNull()
    fmt = lambda n, bit: (F.col(f"formats.{n}") | F.coalesce(F.col("bits").bitwiseAND(bit) > 0, F.lit(False))).alias(n)
    title = F.coalesce(F.nullif("title", F.lit("")), "new_title", F.lit(""))
    known = F.transform("authors", lambda a: F.lower(a))
    added = F.filter(F.coalesce("names", empty), lambda a: (a != "") & ~F.array_contains(known, F.lower(a)))
    plus = lambda c: sort_batches(F.when(held, F.array_union(c, F.array(F.lit(batch)))).otherwise(F.col(c)))
    return c.withColumns({"batches": plus("batches"), "holdings_batches": plus("holdings_batches"), "formats": F.struct(fmt("book", 1), fmt("ebook", 2), fmt("audio", 4)), "isbn_digits": sort_isbns(F.filter(F.array_union("isbn_digits", F.coalesce("digits", empty)), lambda d: d != "")), "authors": F.concat("authors", F.array_distinct(added)), "title": title, "title_unknown": title == "", "in_collection": F.coalesce("in_collection", F.lit(False)) | held, "row_count": F.col("row_count") + F.coalesce("more", F.lit(0))}).drop("bits", "more", "digits", "names", "new_title")


#: Further ISBNs of a title in one row of the side table.
CHUNK = 10_000


def _titled(linked: DataFrame) -> DataFrame:
    return linked.where("card is null").withColumn("key", title_key("title")).where("key <> ''")


def _alone(linked: DataFrame) -> DataFrame:
    """Records without a title that linked nowhere."""
    return linked.where("card is null").withColumn("key", title_key("title")).where("key = ''").select("isbn13", "isbn10", "author", "title", "series", "format", "rows")


def _groups(linked: DataFrame) -> DataFrame:
    """key, isbn13 (the first), n (ISBNs), isbn10, author, title, series, format and rows of titles; no list is as long as a title has records."""
    titled = _titled(linked)
    # rows of a title, and those of the first record once more
    first = titled.groupBy("key").agg(F.min("place").alias("_first"))
    counted = titled.join(first, "key").withColumn("weight", F.col("rows") + F.when(F.col("place") == F.col("_first"), F.col("rows")).otherwise(0))
    plain = (~F.col("title").rlike(r"(?i)\((un)?abridged\)")).cast("int")
    names = counted.groupBy("key", "title").agg(F.sum("weight").alias("n"), F.min("place").alias("p")).groupBy("key").agg(F.max_by("title", F.struct(plain, "n", F.length("title"), -F.col("p"))).alias("display"))
    # only an author's first place counts, so the list is as long as the title has authors, not records
    authors = titled.groupBy("key", "author").agg(F.min("place").alias("place")).groupBy("key").agg(canonical_authors(F.transform(F.array_sort(F.collect_list(F.struct("place", "author"))), lambda s: s["author"])).alias("authors"))
    some = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("place"))), F.lit("")).alias(c)
    g = titled.groupBy("key").agg(F.min_by("isbn13", isbn_sort_key("isbn13")).alias("isbn13"), F.count(F.lit(1)).alias("n"), some("isbn10"), some("series"), F.bit_or("format").alias("format"), F.sum("rows").alias("rows"))
    return g.join(names, "key").join(authors, "key").select("key", "isbn13", "n", "isbn10", F.array_join("authors", "; ").alias("author"), F.col("display").alias("title"), "series", "format", "rows")


def leftover_tables(linked: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """What linked nowhere as two tables, for titles of any number of ISBNs.

    Titles, and records without one: key (of a title, else null), isbn13, isbn10, author, title, series, format, rows.
    Further ISBNs: key, chunk, isbns (about ``chunk`` at most), so that a title of a third of all records is many rows.
    """
    groups = _groups(linked)
    titles = groups.drop("n").unionByName(_alone(linked).withColumn("key", F.lit(None).cast("string")))
    parts = groups.where("n > 1").select("key", F.col("isbn13").alias("_first"), F.ceil(F.col("n") / chunk).cast("long").alias("_parts"))
    rest = _titled(linked).select("key", "isbn13").join(parts, "key").where("isbn13 <> _first")
    dealt = rest.select("key", F.pmod(F.xxhash64("isbn13"), F.col("_parts")).alias("chunk"), "isbn13")
    return titles, dealt.groupBy("key", "chunk").agg(sort_isbns(F.collect_list("isbn13")).alias("isbns"))


def leftovers(linked: DataFrame) -> DataFrame:
    """Records that linked nowhere, those with a title grouped by its key: isbn13, isbn10, extras, author, title, series, format, rows.

    A title has its further ISBNs in its row; ``leftover_tables`` keeps them apart.
    """
    empty = F.array().cast("array<string>")
    groups = _groups(linked)
    every = _titled(linked).groupBy("key").agg(sort_isbns(F.collect_set("isbn13")).alias("all13"))
    grouped = groups.join(every, "key").select("isbn13", "isbn10", F.slice("all13", F.lit(2), F.size("all13")).alias("extras"), "author", "title", "series", "format", "rows")
    return grouped.unionByName(_alone(linked).withColumn("extras", empty))


def counters(status: DataFrame, linked: DataFrame, left: DataFrame) -> DataFrame:
    """name, value: accepted rows and those with a title, distinct ISBNs, records linked to cards, titles and ISBNs of what is left.

    status: rows of with_status.
    """
    rows = status.where("status = 'accepted'").agg(F.count(F.lit(1)).alias("holdings_rows"), F.count_if(F.col("title") != "").alias("holdings_titled_rows"))
    records = linked.agg(F.count(F.lit(1)).alias("holdings_unique_isbns"), F.count_if(F.col("card").isNotNull()).alias("holdings_linked"), F.count_if(F.col("card").isNull()).alias("holdings_only_isbns"))
    titles = left.agg(F.count(F.lit(1)).alias("holdings_only"))
    pivot = lambda d: d.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, d.columns)), F.array(*(F.col(c).cast("long") for c in d.columns)))).alias("name", "value"))
    return pivot(rows).union(pivot(records)).union(pivot(titles))
