"""Cases in which the catalogue once did less than the whole job."""

from pyspark.sql import functions as F

from shelfmatch.operators import collapse, holdings, search

A, B = "9780064400558", "9780142410318"


def test_scored_copies_of_a_work_are_one_hit(spark):
    shape = "query_id long, id string, title string, isbn_digits array<string>, posted boolean, in_collection boolean, score double, reason string"
    hits = spark.createDataFrame(
        [
            (1, "c1", "Dog Man", [A], True, False, 0.95, "title"), (1, "c2", "Dogman", [A], True, True, 0.96, "author"), (1, "c3", "Heidi", [A], True, False, 0.5, "title"),
            (1, "c4", "", [A], False, True, 0.7, "author"), (1, "h1", "Dog man!", [B], False, True, 0.9, "title"), (2, "c1", "Dog Man", [A], True, False, 0.6, "title"), (3, "c5", "", [], True, False, 0.6, "author"),
        ],
        shape,
    )
    one = collapse.collapse_scored(hits.where("id <> 'c4'"))
    assert {(r.query_id, r.id): (r.title, r.score, r.reason) for r in one.collect()} == {(1, "c2"): ("Dogman", 0.96, "author"), (1, "c3"): ("Heidi", 0.5, "title"), (2, "c1"): ("Dog Man", 0.6, "title"), (3, "c5"): ("", 0.6, "author")}
    sure = lambda h: search.classify(search.top_k(h)).where("query_id = 1").first().match
    assert sure(hits.select("query_id", "id", "title", "score", "reason")) is None and sure(one) == "c2"  # copies leave no lead
    assert collapse.collapse_scored(hits).where("query_id = 1 and title = ''").count() == 0  # untitled ones go with an owner of their ISBN


def test_leftovers_keep_every_isbn_of_a_title(spark):
    """A title of more than a million ISBNs, and authors in the order of their first places."""
    n = 1_000_005
    linked = spark.range(n).select(
        F.lit(None).cast("string").alias("card"), F.format_string("978%010d", "id").alias("isbn13"), F.lit("").alias("isbn10"), F.when(F.col("id") % 2 == 0, "Zoe, B.").otherwise("Al").alias("author"),
        F.lit("Same").alias("title"), F.lit("").alias("series"), F.lit(1).alias("format"), F.lit(1).cast("long").alias("rows"), F.col("id").alias("place"),
    )
    r = holdings.leftovers(linked).select("isbn13", F.size("extras").alias("n"), F.try_element_at("extras", F.lit(-1)).alias("last"), "author", "rows").first()
    assert r.asDict() == {"isbn13": "9780000000000", "n": n - 1, "last": f"978{n - 1:010d}", "author": "Zoe, B.; Al", "rows": n}


def test_leftovers_in_chunks_are_the_leftovers(spark):
    """Titles and their further ISBNs apart hold what one row a title holds, and no row is long."""
    linked = spark.range(600).select(
        F.when(F.col("id") % 10 == 9, "c").alias("card"), F.when(F.col("id") % 2 == 0, F.format_string("978%010d", "id")).otherwise(F.format_string("979%010d", "id")).alias("isbn13"), F.lit("").alias("isbn10"), F.concat(F.lit("A"), F.col("id") % 3).alias("author"),
        F.when(F.col("id") % 5 < 3, "Hot title").when(F.col("id") % 5 == 3, F.concat(F.lit("T"), F.col("id"))).otherwise("").alias("title"), F.lit("").alias("series"), F.lit(1).alias("format"), F.lit(1).cast("long").alias("rows"), F.col("id").alias("place"),
    )
    whole = {r.isbn13: (r.title, r.author, r.rows, set(r.extras)) for r in holdings.leftovers(linked).collect()}
    titles, extras = holdings.leftover_tables(linked, 20)
    parts = extras.collect()
    assert max(len(r.isbns) for r in parts) < 60 and len(parts) > 10 and all(r.isbns == sorted(r.isbns) for r in parts)
    more = {}
    for r in parts:
        more.setdefault(r.key, set()).update(r.isbns)
    assert {r.isbn13: (r.title, r.author, r.rows, more.get(r.key, set())) for r in titles.collect()} == whole
    assert sum(len(r.isbns) for r in parts) == sum(len(v[3]) for v in whole.values())
