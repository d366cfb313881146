"""Steps whose shuffled rows, tries or pairs must not outgrow the input, against plain ways."""

import random

from pyspark.sql import functions as F

from shelfmatch.operators.components import related_candidates, shared_isbn_pairs


def test_titles_of_a_crowded_isbn_meet_by_numbers(spark):
    """Parts of every length class lose no pair; what related titles are looked for by are numbers, never texts."""
    rng = random.Random(11)
    words = ["hatthedend", "ontiontion", "rewhsting", "oredatthe", "is", "an", "reand", "eabler", "thonenat", "quorum", "velvet"]
    titles = {f"k{i:03d}": " ".join(rng.choices(words, k=rng.randint(1, 12))) for i in range(90)}
    for i in range(40):  # parts of others, from any place on
        whole = titles[f"k{i:03d}"]
        at = rng.randrange(len(whole))
        titles[f"p{i:03d}"] = whole[at : at + rng.choice([6, 7, 8, 9, 12, 23, 24, 25, 26, 40])]
    titles |= {f"e{i}": t for i, t in enumerate(["moon river moon river", "stones moon and river", "rivers lake and stone", "lake stone lake stone"])}  # of one length: the first by key is the shorter
    isbns = spark.createDataFrame([(k, f"978000000000{int(k[1:]) // 50}") for k in titles], "key string, isbn string")
    named = spark.createDataFrame(list(titles.items()), "key string, title string")
    pairs = lambda hot: sorted(map(tuple, shared_isbn_pairs(isbns, named, hot=hot).collect()))
    assert len(plain := pairs(1000)) > 20 and pairs(1) == plain
    assert ("e0", "e1") in plain and ("e2", "e3") not in plain
    owners = isbns.join(named, "key").select("isbn", F.xxhash64("key").alias("id"), F.col("title").alias("fk"))
    assert related_candidates(owners).dtypes == [("a", "bigint"), ("b", "bigint")]


def test_isbn_cells_are_read_once(spark):
    """What a number is made of is worked out once: the expression names the text's pattern a few times, not dozens of times."""
    from shelfmatch.functions.isbn import collect_isbns

    plan = spark.range(1).select(F.col("id").cast("string").alias("isbn")).select(collect_isbns(["isbn"]))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[^0-9Xx]") <= 4


def test_equal_queries_are_ranked_once(spark):
    from shelfmatch.operators import search

    cards = spark.createDataFrame([("a", "River Tale", ["Ann Poe"], ["9780000000019"]), ("b", "River Tales", ["Bo Lee"], []), ("c", "Stone", ["Ann Poe"], ["9780000000019"])], "id string, title string, authors array<string>, isbn_digits array<string>")
    queries = spark.createDataFrame([(1, "river tale"), (2, " river tale "), (3, "9780000000019"), (4, "9780000000019"), (5, "river tale"), (6, "")], "query_id long, query string")
    assert search.asked_once(queries)[0].count() == 3
    found = sorted(map(tuple, search.search_top(queries, cards).select("query_id", "id", "score", "rank").collect()))
    plain = [("a", 1.0, 1), ("b", 0.96, 2)]
    assert found == [(q, *h) for q in (1, 2) for h in plain] + [(q, "a", 1.0, 1) for q in (3, 4)] + [(5, *h) for h in plain]


def test_relation_without_misspelt_words(spark):
    from shelfmatch.functions.similarity import titles_related

    a, b = F.lit("garden stone river"), F.lit("river gardan stone")
    assert tuple(spark.range(1).select(titles_related(a, b), titles_related(a, b, misspelt=False)).first()) == (True, False)


def test_exploded_tables_are_not_broadcast(spark):
    """What is exploded from a small file may be very large: Spark takes it for as small as the file."""
    owners = spark.createDataFrame([("978", i, t) for i, t in enumerate(["moon river light", "river moon lights", "garden stone", "the moon river lights"])], "isbn string, id long, fk string")
    lines = related_candidates(owners)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    inside = [y for i, x in enumerate(lines) if "BroadcastExchange" in x for y in lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(x)), len(lines))]]
    assert any("Generate" in x for x in lines) and not any("Generate" in x for x in inside)


def test_pairs_of_titles_come_once(spark):
    """Parts of a crowded ISBN and titles of many ISBNs give the pairs of the plain join, each once."""
    from shelfmatch.plans.queries import title_pairs

    rng = random.Random(5)
    rows = sorted({(f"t{rng.randrange(25):02d}", f"i{rng.randrange(12):02d}") for _ in range(110)} | {("t99", f"i{i:02d}") for i in range(12)})
    owners = spark.createDataFrame([*rows, *rows[:9]], "k string, isbn string")
    plain = sorted({(a, b, a + "!", b + "!") for a, i in rows for b, j in rows if i == j and a < b})
    for part, many in ((2000, 64), (2, 64), (3, 4), (1, 0)):
        found = title_pairs(owners, lambda k: F.concat(k, F.lit("!")), part, many)
        assert sorted(map(tuple, found.collect())) == plain
    assert "HashAggregate" not in title_pairs(owners, lambda k: k)._jdf.queryExecution().executedPlan().toString()  # pairs aren't shuffled to be made distinct


def test_marks_of_one_title_alone_are_not_kept(spark, monkeypatch):
    """Most parts of a title are in no other one: they are shuffled once to be counted, neither written nor looked up."""
    from shelfmatch.operators import components as K

    kept, real = [], K.stored
    monkeypatch.setattr(K, "stored", lambda df: kept.append(real(df)) or kept[-1])
    titles = ["moon river light of the garden", "the moon river light", "stones and velvet in a quorum of lakes", "velvet", "riverbed stones"]
    owners = spark.createDataFrame([("978", i, t) for i, t in enumerate(titles)], "isbn string, id long, fk string")
    assert (0, 1) in set(map(tuple, K.related_candidates(owners).collect()))
    parts = next(d for d in kept if d.columns == ["id", "h"])
    assert 0 < parts.count() < 60 and parts.groupBy("h").count().where("count < 2").isEmpty()


def test_best_of_each_query_need_few_pairs(spark):
    """With a limit a query's best hits, ties too, are found among few pairs, and the bounds hold for each pair."""
    import numpy as np
    import pandas as pd

    from shelfmatch.operators import search, titleblocks

    rng = random.Random(9)
    words = ["river", "rivers", "stone", "garden", "gardan", "moon", "light", "a", "of", "12", "tale", "the"]
    make = lambda n=6: " ".join(rng.choices(words, k=rng.randint(1, n)))
    cards = spark.createDataFrame([(f"c{i:03d}", make() if i % 9 else "", [f"Writer {make(3)}"], []) for i in range(150)], "id string, title string, authors array<string>, isbn_digits array<string>")
    queries = spark.createDataFrame([(i, make()) for i in range(20)] + [(90, "writer"), (91, "rivr ston"), (92, "x"), (93, ""), (94, make(90)), (95, "The moon (unabridged) & stone"), (96, "(unabridged)")], "query_id long, query string")
    q, t = search.prepare_queries(queries), search.prepare_cards(cards)
    plain = q.crossJoin(t).withColumn("s", search.title_score("q", "t")).select("query_id", "id", "title", search.rounded(F.col("s.score")).alias("score"), "s.reason").cache()
    best = lambda d: sorted(map(tuple, search.top_k(d, 5).select("query_id", "id", "score", "reason", "rank").collect()))
    assert best(search.score(queries, cards, limit=5)) == best(plain.where("score >= 0.42"))
    n = q.where("q.text <> ''").count()
    assert search.candidates(q, t, limit=5).count() <= 5 * n < search.candidates(q, t).count()
    asked, held = (d.toPandas() for d in (q.where("q.text <> ''").select("query_id", "q.key", "q.loose", "q.text"), t.select("id", "title", "t.key", "t.loose", "t.authors")))
    found = titleblocks.bounded(0.0, None)(asked, held).merge(plain.toPandas(), on=["query_id", "id"])
    score = np.floor(found["score"] * 1e6 + 0.5)
    assert len(found) == n * 150 and (found["least"] <= score).all() and (score <= found["most"]).all() and (found["least"] == score).mean() > 0.5
    assert titleblocks.edit_distances("moon river", ["", "moon river", "mon rivers", "a"]).tolist() == [10, 0, 2, 10]
    assert len(titleblocks.bounded(0.4, 5)(asked[:0], held)) == 0 == len(titleblocks.bounded(0.4, None)(asked, pd.DataFrame(columns=held.columns)))


def test_best_works_need_few_hits(spark):
    """Works of several cards, untitled cards and holdings that fold in: the best works are those of all hits."""
    from shelfmatch.operators import search

    rng = random.Random(12)
    words = ["river", "rivers", "stone", "garden", "moon", "light", "tale"]
    make = lambda n=3: " ".join(rng.choices(words, k=rng.randint(1, n)))
    rows = [(f"c{i:02d}", make() if i % 7 else "", [f"Writer {make(2)}"], [f"97800000000{rng.randrange(90):02d}"] * (i % 3 > 0), bool(i % 2), not i % 2) for i in range(70)]
    cards = spark.createDataFrame(rows, "id string, title string, authors array<string>, isbn_digits array<string>, posted boolean, in_collection boolean")
    held = [(f"97811111111{i:02d}", [f"97800000000{rng.randrange(90):02d}"], make(), "Ann", "") for i in range(25)]
    left = search.leftover_cards(spark.createDataFrame(held, "isbn13 string, extras array<string>, title string, author string, series string"))
    queries = spark.createDataFrame([(i, make()) for i in range(15)] + [(90, "writer"), (91, "9780000000011"), (92, "97800000000"), (93, "")], "query_id long, query string")
    best = lambda d: sorted(map(tuple, search.top_k(d, 4).select("query_id", "id", "title", "score", "reason", "rank").collect()))
    whole, few = search.enriched(queries, cards, left), search.enriched(queries, cards, left, 4)
    assert best(few) == best(whole) and few.count() < whole.count()


def test_names_are_folded_once(spark):
    """Of a card's authors each name is folded once, not once for each other name."""
    from shelfmatch.functions.text import canonical_authors

    names = spark.createDataFrame([(["Ann Poe", "Poe, Ann", " ann  poe", "", "Bo", "BO", "Cy Day Lee", "lee, cy day", "Di Fox"],), (None,), ([],)], "names array<string>")
    made = names.select(canonical_authors("names"))
    assert [r[0] for r in made.collect()] == [["Poe, Ann", "Bo", "lee, cy day", "Di Fox"], None, []]
    assert made._jdf.queryExecution().analyzed().toString().count("lower(") <= 8


def test_bulk_facets_build_no_cards(spark, monkeypatch):
    """Counts of batches need rows and components alone; the marks of repeats don't shuffle whole rows."""
    from shelfmatch.operators import cards, ingest
    from shelfmatch.plans import queries

    rows = [(1, k, "b", "master", t, "A", b, "high", "", "", "", i) for k, (t, b, i) in enumerate([("Moon tale", "Sep 2025", "9780028653785"), ("The moon tale!", "Sep 2025", "9780028653785"), ("Moon tales", "Jan 2026", "9780028653785"), ("Stone", "Jan 2026", ""), ("Stone", "Jan 2026", "")])]
    listed = spark.createDataFrame(rows, "source_seq int, row_seq long, source_label string, kind string, title string, author string, source_batch string, level string, format string, book string, audience string, isbn string")
    monkeypatch.setattr(queries, "_v", lambda *a: listed)
    monkeypatch.setattr(cards, "build_cards", lambda *a, **k: 1 / 0)
    assert {tuple(r) for r in queries.bulk_facets(spark, "").collect()} == {("Sep 2025", 1), ("Jan 2026", 2)}
    marked = ingest.with_status(ingest.prepare(listed))
    assert sorted((r.row_seq, r.status) for r in marked.collect()) == [(0, "accepted"), (1, "duplicate"), (2, "accepted"), (3, "accepted"), (4, "duplicate")]
    assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()


def test_each_title_is_folded_once(spark, monkeypatch):
    """Titles are made distinct before they are folded: no filter on the folded text is moved to the rows."""
    from shelfmatch.operators import components as K

    asked, real = [], K.stored
    monkeypatch.setattr(K, "stored", lambda df: asked.append(df) or real(df))
    titles = spark.createDataFrame([("a", "Moon tale"), ("a", "Moon tale"), ("b", "Moon tales"), ("c", "!!")], "key string, title string")
    isbns = spark.createDataFrame([(k, "9780028653785") for k in "abc"], "key string, isbn string")
    assert [tuple(r) for r in K.shared_isbn_pairs(isbns, titles).collect()] == [("a", "b")]
    folded = next(d for d in asked if d.columns == ["id", "key", "fk"])
    assert "Filter" not in folded._jdf.queryExecution().optimizedPlan().toString()
