"""Ways for hot keys, incremental builds, stored cards and merged lists, on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmatch.functions import isbn as I
from shelfmatch.functions import text as T
from shelfmatch.operators import cards as C
from shelfmatch.operators import collapse, ingest, search, tokenindex
from shelfmatch.operators.components import components, shared_isbn_pairs, stored
from shelfmatch.sources import collections as S
from shelfmatch.sources.listings import split_sources


def test_hot_isbns_give_the_same_pairs(spark):
    """Blocks of a placeholder ISBN lose no related pair."""
    rng = random.Random(4)
    words = ["river", "rivers", "stone", "stones", "garden", "gardan", "moon", "light", "a", "of", "tale", "dog", "man"]
    titles = {f"k{i:03d}": " ".join(rng.choices(words, k=rng.randint(1, 6))) for i in range(120)}
    titles |= {"x1": "Dog Man", "x2": "dogman", "x3": "dogman unleashed", "x4": "ab c d e", "x5": "zz ab c d e zz"}
    isbns = spark.createDataFrame([(k, "9780000000002") for k in titles], "key string, isbn string")
    named = spark.createDataFrame(list(titles.items()), "key string, title string")
    pairs = lambda hot: sorted(map(tuple, shared_isbn_pairs(isbns, named, hot=hot).collect()))
    plain = pairs(1000)
    assert len(plain) > 100 and pairs(2) == plain


def test_candidates_hold_every_scored_pair(spark):
    rng = random.Random(8)
    words = ["river", "rivers", "stone", "garden", "gardan", "moon", "light", "a", "of", "12", "tale", "x"]
    make = lambda: " ".join(rng.choices(words, k=rng.randint(1, 5)))
    cards = spark.createDataFrame([(f"c{i}", make(), [f"Writer {make()}"], [f"97800000000{i:02d}"]) for i in range(60)], "id string, title string, authors array<string>, isbn_digits array<string>")
    far = [(" ".join(rng.choices(words, k=90)) + " " * 0)[:n] for n in (349, 350, 353, 354, 357, 360, 362, 370)]
    cards = cards.union(spark.createDataFrame([(f"f{i}", t, ["Far"], []) for i, t in enumerate(far)], cards.schema))
    queries = spark.createDataFrame([(900, far[5][:-3] + "zz"), (901, far[7][9:]), (902, far[0])] + [(i, make() if i % 3 else rng.choice(["rivr ston", "x", "9780000000012", "garden moon lihgt", "", "writer"])) for i in range(40)], "query_id long, query string")
    for least in (0.42, 0.18):
        q, t = search.prepare_queries(queries), search.prepare_cards(cards)
        every = q.crossJoin(t).withColumn("s", search.title_score("q", "t")).where(F.col("s.score") >= least).select("query_id", "id")
        assert every.exceptAll(every.intersect(search.candidates(q, t, least))).count() == 0


def test_isbn_fallback(spark):
    cards = spark.createDataFrame([("c1", "River Tale", ["Ann Poe"], ["9780000000019"]), ("c2", "Moon", ["Bo Lee"], [])], "id string, title string, authors array<string>, isbn_digits array<string>")
    held = spark.createDataFrame([(1, "9781111111113", ["9782222222222"], "Poe, Ann; Other", "River Tale"), (2, "9783333333335", [], "Nobody", "Moon"), (3, "9784444444444", ["9780000000019"], "", "")], "row_id long, isbn13 string, extras array<string>, author string, title string")
    queries = spark.createDataFrame([(1, "9782222222222"), (2, "9783333333335"), (3, "9784444444444"), (4, "9780000000019"), (5, "9785555555555"), (6, "river")], "query_id long, query string")
    assert {tuple(r) for r in search.isbn_fallback(queries, cards, held).collect()} == {(1, "h:9781111111113", "c1"), (2, "h:9783333333335", None), (3, "h:9784444444444", "c1")}


def test_merged_reviews_and_works(spark):
    rows = [
        ("b", "k", "Moon", ["Bo Lee"], ["9780000000019"], {"kirkus": ["Starred", "yes"]}, True, False),
        ("a", "k", "Moon", ["bo lee"], ["9780000000019"], {"kirkus": ["STARRED", "no"], "pw": ["ok"]}, True, True),
    ]
    cards = spark.createDataFrame(rows, "id string, key string, title string, authors array<string>, isbn_digits array<string>, reviews map<string,array<string>>, posted boolean, in_collection boolean")
    empty = F.array().cast("array<string>")
    cards = cards.withColumns({**{c: empty for c in ("batches", "posted_batches", "holdings_batches", "levels", "audiences", "editions")}, "formats": F.struct(*(F.lit(False).alias(f) for f in ("book", "ebook", "audio"))), "possible_duplicate": F.lit(False), "row_count": F.lit(1), "title_unknown": F.lit(False)})
    (one,) = collapse.collapse_cards(cards).collect()
    assert one.id == "a" and one.reviews == {"kirkus": ["STARRED", "no", "yes"], "pw": ["ok"]} and one.authors == ["bo lee"] and one.row_count == 2


def test_untitled_hits_are_works_of_their_own(spark):
    cards = spark.createDataFrame([("a", "", ["9780000000019"]), ("b", "", ["9780000000026"]), ("c", "Moon", [])], "id string, title string, isbn_digits array<string>")
    ranked = spark.createDataFrame([(1, "a", "", 0.95, "author", 1), (1, "b", "", 0.9, "author", 2), (1, "c", "Moon", 0.6, "fuzzy", 3)], "query_id long, id string, title string, score double, reason string, rank int")
    (r,) = search.classify(ranked, cards).collect()
    assert (r.match, r.close) == ("a", ["b", "c"])


def test_stored_cards_are_found_by_shard(spark, tmp_path):
    cards = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    counts = cards.agg(F.count("*").alias("n"))
    S.write_collection(cards, counts, counts, str(tmp_path), shards=4)
    assert S.read_cards(spark, str(tmp_path)).count() == 50
    wanted = spark.createDataFrame([("k7",), ("k7",), ("none",)], "key string")
    assert [tuple(r) for r in S.read_cards(spark, str(tmp_path), wanted).collect()] == [("k7", 7)]


def test_holdings_rows_are_stored_by_number(spark):
    rows = [("9780000000026", "B", "t2", "", 1, []), ("9780000000019", "A", "", "s", 4, []), ("9790000000001", "A", "t1", "", 2, [])]
    _, _, coded = S.encode_holdings(spark.createDataFrame(rows, "isbn13 string, author string, title string, series string, format int, extras array<string>"))
    assert [r.isbn_number for r in coded.collect()] == [9780000000019, 9780000000026, 9790000000001]


def test_small_functions(spark):
    d = spark.createDataFrame([("follett", "", 5, "01234567890"), ("master", "Moon", 2, "0028653785"), ("sora", None, 0, "x")], "kind string, title string, bits int, isbn string")
    assert [r[0] for r in d.select(T.display_title("title")).collect()] == ["Title not listed", "Moon", "Title not listed"]
    assert [tuple(r[0]) for r in d.select(T.material_formats("bits")).collect()] == [(True, False, True), (False, True, False), (False, False, False)]
    assert [len(r[0]) for r in d.select(I.parse_isbns("isbn")).collect()] == [0, 1, 0]  # eleven characters are no number
    cards, held = split_sources(d)
    assert {r.kind for r in cards.collect()} == {"master", "sora"} and {r.kind for r in held.collect()} == {"follett"}


@pytest.mark.parametrize("limit", [1, 12])
def test_token_search_by_rarest_word(spark, limit):
    tokens = spark.createDataFrame([(1, "moonlight"), (1, "tale"), (2, "moon"), (2, "tale"), (3, "tale"), (4, "moons")], "row_id long, token string")
    queries = spark.createDataFrame([(1, "moon"), (2, "tale moon"), (3, "tal"), (4, "!"), (5, "tale")], "query_id long, query string")
    want = {(1, 2, 1), (1, 1, 2), (1, 4, 3), (2, 1, 1), (2, 2, 2), (5, 1, 1), (5, 2, 2), (5, 3, 3)}
    assert {tuple(r) for r in search.token_search(queries, tokens, limit).collect()} == {w for w in want if w[2] <= limit}


def test_lookup_finds_holdings_that_linked_nowhere(spark):
    from shelfmatch.plans.workloads import attach_holdings, build_catalogue, lookup

    listed = spark.createDataFrame([(0, 1, "master", "Quiet rivers", "Ann Poe", "Sep 2025", "High", "9780028653785")], "source_seq int, row_seq long, kind string, title string, author string, source_batch string, level string, isbn string")
    rows = [(1, "r", "Moonlit gardens", "", "Bo Lee", "9781516080236", "Book"), (2, "r", "Quiet rivers", "", "Ann Poe", "9780028653785", "Book")]
    held = attach_holdings(build_catalogue(listed).cards, spark.createDataFrame(rows, "row_seq long, source_label string, title string, series_title string, author string, isbn string, material_type string"))
    queries = spark.createDataFrame([(1, "moonlit gardens"), (2, "quiet rivers"), (3, "nothing such"), (4, "978-1-5160-8023-6")], "query_id long, query string")
    hits, verdicts = lookup(queries, held.cards, leftovers=held.leftovers)
    assert {(r.query_id, r.id) for r in hits.collect() if r.score > 0.9} >= {(1, "9781516080236")}
    assert {r.query_id: r.verdict for r in verdicts.collect()} == {1: "have_collection", 2: "have_both", 3: "dont_have", 4: "have_collection"}
    assert [(r.id, r.score, r.reason) for r in hits.where("query_id = 4").collect()] == [("9781516080236", 1.0, "isbn")]
    far = lookup(queries, held.cards, level="Middle", leftovers=held.leftovers)[1]
    assert {r.query_id: r.verdict for r in far.collect()} == {1: "dont_have", 2: "dont_have", 3: "dont_have", 4: "have_collection"}
    hits, verdicts = lookup(queries, held.cards)
    assert {r.query_id: r.verdict for r in verdicts.collect()} == {1: "dont_have", 2: "have_both", 3: "dont_have", 4: "dont_have"}


def test_components_of_hubs_chains_and_nothing(spark):
    rng = random.Random(3)
    pairs = [(f"n{i:04}", "hub") for i in range(700)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(70)]
    label = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = {r.key: r.label for r in components(frame).collect()}
    assert got == {n: label[n] for a, b in pairs if a != b for n in (a, b)}
    assert components(frame.limit(0)).count() == 0 and components(frame.where("a = b")).count() == 0


def test_row_facets_are_those_of_the_cards(spark):
    rng = random.Random(7)
    rows = [(k % 3, k, "master", rng.choice(["Dog Man", "Dogman", "Heidi", "", "Moon tale"]), rng.choice(["A", "B"]), rng.choice(["Sep 2025", "Jan 2026", ""]), rng.choice(["high", "Middle", None]), rng.choice(["9780028653785", "9781516080236", ""])) for k in range(60)]
    accepted = ingest.accepted(spark.createDataFrame(rows, "source_seq int, row_seq long, kind string, title string, author string, source_batch string, level string, isbn string"))
    assert {tuple(r) for r in C.row_facets(accepted).collect()} == {tuple(r) for r in C.facets(C.build_cards(accepted)).collect()}


def test_only_touched_shards_are_written_and_read(spark, tmp_path):
    cards = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    counts = cards.agg(F.count("*").alias("n"))
    path = str(tmp_path)
    S.write_collection(cards, counts, counts, path, shards=32)
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("cards/shard=*/*.parquet")}
    before = files()
    changed = spark.createDataFrame([("k7", -7), ("new", -1)], "key string, id long")
    S.update_collection(changed, spark.createDataFrame([("k9",)], "key string"), counts, counts, path)
    got = {r.key: r.id for r in S.read_cards(spark, path).collect()}
    assert got == {f"k{i}": i for i in range(300) if i != 9} | {"k7": -7, "new": -1}
    after = files()
    assert len({p.parent for p in before.items() ^ after.items() for p in [p[0]]}) <= 3
    one = S.read_cards(spark, path, spark.createDataFrame([("k7",)], "key string"))
    assert [r.id for r in one.collect()] == [-7]
    assert re.search(r"PartitionFilters: \[[^\]]*shard#\d+ (=|IN)", one._jdf.queryExecution().executedPlan().toString())
    gone = S.read_cards(spark, path).select("key")
    S.update_collection(changed.limit(0), stored(gone), counts, counts, path)
    assert S.read_cards(spark, path).count() == 0


def test_stored_index_finds_what_plain_search_finds(spark, tmp_path):
    rng = random.Random(9)
    words = ["ocean", "oceans", "oceanic", "sea", "deep", "deeper", "dee", "blue", "bl", "sun", "sunny", "river"]
    tokens = spark.createDataFrame(sorted({(i, w) for i in range(150) for w in rng.choices(words, k=4)}) + [(1000 + i, "common") for i in range(3000)], "row_id long, token string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices([*words, "ocea", "de", "sunn", "none", "comm"], k=rng.randint(1, 3)))) for i in range(60)] + [(99, ""), (98, None)], "query_id long, query string")
    index = tokenindex.build(tokens)
    tokenindex.save(index, str(tmp_path / "ix"))
    found = lambda d: sorted(map(tuple, d.select("query_id", "row_id", "rank").collect()))
    assert found(tokenindex.search(queries, tokenindex.load(spark, str(tmp_path / "ix")))) == found(search.token_search(queries, tokens))
    assert index.postings.agg(F.max(F.size("row_ids"))).first()[0] < 2 * tokenindex.BLOCK
    assert tokenindex.search(queries, tokenindex.build(tokens.limit(0))).count() == 0


def test_compact_holdings_files(spark, tmp_path):
    rows = [(f"978{i * 37 % 100000:010d}", f"A{i % 5}" if i % 3 else "", f"t{i % 7}", "", i % 8, [f"x{i}"] if i % 2 else []) for i in range(400)] + [("97800000000X1", "B", "", "s", 1, []), ("0009780000000", "B", "", "s", 2, [])]
    held = spark.createDataFrame(rows, "isbn13 string, author string, title string, series string, format int, extras array<string>")
    path = str(tmp_path / "held")
    S.write_compact_holdings(held, path)
    want = {r[0]: (r[1], r[2] or r[3], r[4], r[5]) for r in rows}
    got = S.read_compact_holdings(spark, path, ordered=True).collect()
    assert {r.isbn13: (r.author, r.label, r.format, r.extras) for r in got} == want and len(got) == len(rows)
    numbers = [int(r.isbn13) for r in got if r.isbn13.isdigit()]
    assert numbers == sorted(numbers)
    one = S.read_compact_holdings(spark, path, spark.createDataFrame([(rows[7][0],), ("9789999999999",)], "isbn13 string"))
    assert [r.isbn13 for r in one.collect()] == [rows[7][0]]
    assert re.search(r"PushedFilters: \[[^\]]*isbn_number", one._jdf.queryExecution().executedPlan().toString())
    odd = S.read_compact_holdings(spark, path, spark.createDataFrame([("97800000000X1",), ("0009780000000",)], "isbn13 string"))
    assert {r.isbn13 for r in odd.collect()} == {"97800000000X1", "0009780000000"}
    S.write_compact_holdings(held.limit(0), str(tmp_path / "none"))
    assert S.read_compact_holdings(spark, str(tmp_path / "none")).count() == 0
