"""Operators on small tables: acceptance, cards, holdings, search, sources, incremental import."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmatch.operators import cards as C
from shelfmatch.operators import collapse, components, holdings, incremental, ingest, search
from shelfmatch.plans.workloads import attach_holdings, build_catalogue, lookup
from shelfmatch.sources import collections, listings

SCHEMA = "source_seq int, row_seq long, kind string, title string, author string, source_batch string, level string, format string, isbn string, material_type string"


def rows(spark, *cells):
    full = [(c.get("s", 0), i, c.get("kind", "master"), c.get("title"), c.get("author"), c.get("batch", "Sep 2025"), c.get("level"), c.get("format"), c.get("isbn"), c.get("material")) for i, c in enumerate(cells)]
    return spark.createDataFrame(full, SCHEMA)


def rules(spark, *cells):
    return spark.createDataFrame([(c["title"], c["author"], c.get("hide", False), c.get("match", False), c.get("aliases", [])) for c in cells], "title string, author string, hide boolean, match_author boolean, aliases array<string>")


A, B = "9780028653785", "9781516080236"


def test_status_order(spark):
    d = rows(
        spark, {"title": "Cats", "isbn": A}, {"title": "Cats", "isbn": A}, {"title": "Total"}, {"title": ""}, {"title": "Forever", "author": "Ann Lee"}, {"title": "Forever", "author": "Bo"},
        {"title": "Forever Guide", "author": "Bo"}, {"title": "Foreverness", "author": "Bo"}, {"kind": "sora", "title": "X", "level": "Staff only", "format": "ebook"}, {"kind": "sora", "title": "Y", "format": "Magazine"}, {"title": "Z", "material": "Video"},
    )
    r = rules(spark, {"title": "Forever", "author": "Lee, Ann"}, {"title": "Forever", "author": "Bo", "hide": True, "match": True})
    got = [x.status for x in ingest.with_status(ingest.prepare(d), r).orderBy("row_seq").select("status").collect()]
    assert got == ["accepted", "duplicate", "empty", "empty", "excluded", "excluded", "excluded", "accepted", "staff_only", "format", "material"]


def test_cards_merge_only_related_titles(spark):
    d = rows(spark, {"title": "Dog Man", "isbn": A}, {"title": "Dogman", "isbn": A, "batch": "Jan 2026"}, {"title": "Quiet rivers", "isbn": A}, {"title": "", "isbn": B}, {"title": "Heidi", "isbn": B, "level": "HIGH"})
    c = build_catalogue(d).cards
    got = {r.title: r for r in c.collect()}
    assert set(got) == {"Dog Man", "Quiet rivers", "Heidi"}
    assert got["Dog Man"].row_count == 2 and got["Dog Man"].possible_duplicate and got["Dog Man"].batches == ["Sep 2025", "Jan 2026"]
    assert got["Heidi"].row_count == 2 and got["Heidi"].levels == ["High"] and got["Heidi"].isbn_digits == [B, "1516080238"]
    assert {(r.kind, r.value): r.titles for r in C.facets(c).collect()}[("batch", "Sep 2025")] == 3


def test_twice_is_once(spark):
    cells = [{"title": "Dog Man", "isbn": A}, {"title": "Dogman", "isbn": A}, {"title": "Heidi"}]
    once, twice = build_catalogue(rows(spark, *cells)), build_catalogue(rows(spark, *cells, *({**c, "s": 1} for c in cells)))
    key = lambda d: sorted(map(str, d.drop("reviews").collect()))
    assert key(once.cards) == key(twice.cards)
    assert {r.status: r.n for r in twice.status.collect()} == {"accepted": 3, "duplicate": 3}


def test_incremental_equals_rebuild(spark):
    first = rows(spark, {"title": "Dog Man", "isbn": A}, {"title": "Heidi"})
    both = first.union(rows(spark, {"title": "Dogman", "isbn": A, "s": 1}, {"title": "Heidi", "s": 1}).withColumn("row_seq", F.col("row_seq") + 10))
    stored = ingest.accepted(first)
    assert {r.title for r in incremental.incremental_import(stored, both).collect()} == {"Dog Man", "Heidi", "Dogman"}
    added = incremental.new_rows(stored, both)
    assert [r.title for r in added.collect()] == ["Dogman"]


def test_imports_in_parts_equal_one_import(spark, tmp_path):
    """Whatever the order of arrival: works join over later rows, untitled rows find owners, seen rows change nothing."""
    import random

    rng = random.Random(5)
    numbers = [f"97800286{k:04}5" for k in range(12)]
    names = ["Dog Man", "Dogman", "Dog Man returns", "Heidi", "Quiet rivers", "Rivers quiet", "", "", "The sea", "Sea, the"]
    cells = [{"title": rng.choice(names) + rng.choice(["", "", " 2"]), "author": rng.choice(["Ann Lee", "Bo"]), "isbn": rng.choice([*numbers, ""]), "batch": rng.choice(["Sep 2025", "Jan 2026"])} for _ in range(60)]
    every = rows(spark, *cells)
    state = None
    for part in (F.col("row_seq") % 3 == 0, F.col("row_seq") % 3 == 1, F.col("row_seq") >= 0):
        arrived = every.where(part)
        state = incremental.begin(ingest.accepted(arrived).cache()) if state is None else incremental.add_listings(state, arrived)
    whole = C.build_cards(ingest.accepted(every))
    # an import keeps the row that it saw first, so cards are compared by what doesn't hang on that
    key = lambda d: sorted((r.title.lower() if r.title else "", sorted(r.isbn_digits), sorted(r.batches), r.row_count) for r in d.collect())
    assert [x[1:] for x in key(state.cards)] == [x[1:] for x in key(whole)]
    incremental.save(state, str(tmp_path / "state"))
    again = incremental.add_listings(incremental.load(spark, str(tmp_path / "state")), every)
    assert again.rows.count() == state.rows.count() and key(again.cards) == key(state.cards)


def test_imports_read_what_they_touch(spark):
    d = rows(spark, *({"title": f"Title number {k}", "isbn": f"97800286{k:04}5"} for k in range(40)))
    state = incremental.begin(ingest.accepted(d))
    after = incremental.add_listings(state, rows(spark, {"title": "Title number 7 more", "isbn": "9780028600075", "s": 1}, {"title": "Title number 3", "author": "new", "s": 1}))
    changed = after.cards.join(state.cards, ["gid", "row_count"], "left_anti")
    assert {r.gid for r in changed.collect()} == {"title number 7", "title number 3"}
    assert after.cards.count() == 40


def test_untitled_cards_join_their_owners(spark):
    shape = "id string, key string, title string, isbn_digits array<string>, authors array<string>, batches array<string>, posted_batches array<string>, holdings_batches array<string>, levels array<string>, audiences array<string>, editions array<string>, formats struct<book:boolean,ebook:boolean,audio:boolean>, posted boolean, in_collection boolean, possible_duplicate boolean, reviews map<string,array<string>>, row_count long, title_unknown boolean"
    card = lambda i, title, isbns, authors, held=False: (i, i, title, isbns, authors, ["b", "B"], [], None, [], [], [], (True, False, held), not held, held, False, {"pw": ["good", "Good", f"r{i}"]}, 1, title == "")
    cards = spark.createDataFrame([card("c1", "Dog Man", [A], ["Pilkey, Dav"]), card("c2", "", [A, B], ["pilkey dav", "Bo"], True), card("c3", "Quiet rivers", [B], ["Cy"]), card("c4", "!?", [A], []), card("c5", "Heidi", [], ["Spyri"])], shape)
    assert {frozenset(r.ids) for r in collapse.collapse_labels(cards).groupBy("group").agg(F.collect_set("id").alias("ids")).collect()} == {frozenset({"c1", "c2", "c3", "c4"}), frozenset({"c5"})}
    got = {r.id: r for r in collapse.collapse_cards(cards).collect()}
    one = got["c1"]
    assert set(got) == {"c1", "c5"} and one.title == "Dog Man" and one.authors == ["Pilkey, Dav", "Cy", "Bo"] and one.isbn_digits == [A, B] and one.row_count == 4
    assert one.reviews == {"pw": ["good", "rc1", "rc3", "rc4", "rc2"]} and one.batches == ["b"] and one.holdings_batches == [] and one.formats.audio and one.in_collection and one.possible_duplicate
    assert {(r.title, r.score) for r in collapse.collapse_scored(cards.where("id <> 'c3'").select(F.lit(1).alias("query_id"), "id", "title", "isbn_digits", "posted", "in_collection", F.lit(0.5).alias("score"), F.lit("title").alias("reason"))).collect()} == {("Dog Man", 0.5), ("Heidi", 0.5)}


def test_holdings_link_and_leftovers(spark):
    cards = build_catalogue(rows(spark, {"title": "Heidi", "author": "Spyri, Johanna", "isbn": A}, {"title": "Black Beauty", "author": "Anna Sewell"}, {"title": "", "isbn": B})).cards
    h = spark.createDataFrame(
        [
            (1, A, "Heidi", "Spyri", "Book", ""), (2, A, "Heidi", "", "Sound", ""), (3, B, "The Jungle", "Kipling", "eBook", ""), (4, "9780140324501", "Black beauty!", "Sewell", "Book", ""), (5, "9780140324518", "", "Sewell", "Sound", "Black Beauty"),
            (6, "9780140324525", "Other", "X", "Book", ""), (7, "9780140324532", "Other", "Y", "eBook", ""), (8, "9780140324549", "Film", "Z", "Video", ""), (9, "", "None", "Z", "Book", ""),
        ],
        "row_seq long, isbn string, title string, author string, material_type string, series_title string",
    )
    got = attach_holdings(cards, h)
    assert {r.status: r.n for r in got.status.collect()} == {"accepted": 7, "type": 1, "no_isbn": 1}
    how = {r.isbn13: r.how for r in got.linked.collect()}
    assert how == {A: "isbn", B: "isbn", "9780140324501": "title", "9780140324518": "series", "9780140324525": None, "9780140324532": None}
    done = {r.title: r for r in got.cards.collect()}
    assert set(done) == {"Heidi", "Black Beauty", "The Jungle"} and all(r.in_collection for r in done.values())
    assert done["Heidi"].formats.book and done["Heidi"].formats.audio and done["Heidi"].row_count == 3
    left = got.leftovers.collect()
    assert [(r.isbn13, r.extras, r.title, r.author, r.format) for r in left] == [("9780140324525", ["9780140324532"], "Other", "X; Y", 3)]
    a, s, coded = collections.encode_holdings(got.leftovers)
    assert [(r.author, r.label, r.format) for r in collections.decode_holdings(a, s, coded).collect()] == [("X; Y", "Other", 3)]


def test_lookup(spark):
    cards = build_catalogue(rows(spark, {"title": "Charlotte's Web", "author": "White, E. B.", "isbn": A}, {"title": "Stuart Little", "author": "White, E. B."}, {"title": "Heidi"})).cards
    q = spark.createDataFrame([(1, "charlotes web"), (2, A), (3, "white"), (4, "zzzz qqqq"), (5, ""), (6, "!!"), (7, "heidi")], "query_id long, query string")
    ranked, verdict = lookup(q, cards)
    top = {r.query_id: (r.title, r.reason) for r in ranked.where("rank = 1").collect()}
    assert top[1][0] == "Charlotte's Web" and top[2] == ("Charlotte's Web", "isbn") and top[3][1] == "author" and top[7] == ("Heidi", "title")
    assert {r.query_id: r.verdict for r in verdict.collect()} == {1: "matches", 2: "have_posted", 3: "matches", 4: "dont_have", 5: "dont_have", 6: "dont_have", 7: "have_posted"}


def test_blocking_loses_nothing(spark):
    titles = ["Charlotte's Web", "The Web of Lies", "Stuart", "Go", "A B", "Ocean deep blue", "Oceans"]
    cards = build_catalogue(rows(spark, *({"title": t, "author": a} for t, a in zip(titles, ["Ann Lee", "Bo", "", "Al", "Xu", "Lee", "O"])))).cards
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["web", "ocean", "go", "lee", "stuart litle", "b", "deep blue", "oceans", "e", "The A"])], "query_id long, query string")
    pq, pc = search.prepare_queries(q), search.prepare_cards(cards)
    every = pq.join(pc, F.lit(True)).withColumn("s", search.title_score("q", "t")).where("s.score >= 0.42").select("query_id", "id")
    found = search.candidates(pq, pc)
    assert every.join(found, ["query_id", "id"], "left_anti").count() == 0


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(f"k{i:02d}", f"k{i + 1:02d}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r.key: r.label for r in components.components(pairs).collect()}
    assert set(got.values()) == {"k00", "x"} and len(got) == 23
    assert components.components(pairs.limit(0)).count() == 0


def test_collapse(spark):
    cards = build_catalogue(rows(spark, {"title": "Dog Man", "isbn": A}, {"title": "Heidi"})).cards
    assert collapse.collapse_cards(cards).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Book Title,Authors,ISBN13,Title/Subtitle\nCats,Ann,9780028653785,\n,Bo,,Dogs\n")
    (tmp_path / "ebook-list.csv").write_text("QTY,Title,Author,ISBN,Edition\n1,Birds,Cy,,2nd\n")
    d = listings.read_listings(spark, [str(tmp_path / "a.csv"), str(tmp_path / "ebook-list.csv")])
    assert [(r.source_seq, r.kind, r.title, r.author) for r in d.orderBy("source_seq", "row_seq").collect()] == [(0, "master", "Cats", "Ann"), (0, "master", "Dogs", "Bo"), (1, "ebook-order", "Birds", "Cy")]
    (tmp_path / "r.json").write_text(json.dumps({"postedTitles": [{"title": " T ", "author": "A", "hideFromDesk": True, "aliases": ["", "U"]}, {"title": "", "author": "A"}]}))
    assert [tuple(r) for r in collections.load_exclusions(spark, str(tmp_path / "r.json")).collect()] == [("T", "A", True, False, ["U"])]
    files = spark.createDataFrame([("in/a.csv",), ("in/~$a.csv",), ("in/a.txt",), ("in/a.csv",)], "path string")
    assert [r.path for r in listings.list_inputs(files).collect()] == ["in/a.csv"]
    sheets = spark.createDataFrame([("x/report.xlsx", n, i) for i, n in enumerate(["Summary", "Data"])] + [("x/all-campuses.xlsx", n, i) for i, n in enumerate(["A", "Notes", "B"])], "path string, sheet string, sheet_no int")
    assert {(r.path, r.sheet) for r in listings.select_sheets(sheets).collect()} == {("x/report.xlsx", "Data"), ("x/all-campuses.xlsx", "A"), ("x/all-campuses.xlsx", "B")}
    h = spark.createDataFrame([("a", ""), ("b", "T"), ("b", "")], "source_label string, title string")
    assert {r.source_label for r in listings.pick_holdings_sources(h).collect()} == {"b"}
    assert listings.pick_holdings_sources(h.where("title = ''")).count() == 2


def test_holdings_status_hides(spark):
    h = spark.createDataFrame([(1, A, "", "Bo", "Book", "Forever young")], "row_seq long, isbn string, title string, author string, material_type string, series_title string")
    assert holdings.with_status(h, rules(spark, {"title": "Forever", "author": "X", "hide": True})).first().status == "hidden"


def test_token_search(spark):
    index = spark.createDataFrame([(1, "ocean"), (1, "deep"), (2, "oceans"), (3, "deep")], "row_id long, token string")
    q = spark.createDataFrame([(1, "ocean"), (2, "ocean deep"), (3, "oce")], "query_id long, query string")
    assert {(r.query_id, r.row_id) for r in search.token_search(q, index).collect()} == {(1, 1), (1, 2), (2, 1)}


@pytest.mark.parametrize("name", ["title_keys", "levels_clean", "batch_order", "title_groups"])
def test_registered_queries_have_oracles(name):
    import __spark_entry__ as e

    assert name in e.queries() and name in e.oracle_sql()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_enrich_and_empty_query(spark):
    shape = "id string, title string, authors array<string>, isbn_digits array<string>"
    cards = spark.createDataFrame([("c1", "Ocean deep", ["Lee"], [A]), ("c2", "Heidi", [], [])], shape)
    left = spark.createDataFrame([(1, "h1", "Ocean Deep!", ["Lee"], [B]), (2, "h2", "Oceans of time", ["Bo"], ["9780140324501"]), (3, "h3", "", ["Ocean, Ann"], ["9780140324518"])], "row_id long, " + shape)
    q = spark.createDataFrame([(1, "ocean")], "query_id long, query string")
    hits = spark.createDataFrame([(1, "c1", "Ocean deep", 0.96, "title")], "query_id long, id string, title string, score double, reason string")
    found = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, row_id long")
    got = {r.id: (r.score, r.reason) for r in search.enrich(hits, found, q, cards, left).collect()}
    assert got == {"c1": (0.96, "title"), "h2": (0.96, "title"), "h3": (0.72, "author")}
    assert [r.id for r in search.empty_query(cards, 1).collect()] == ["c2"]
