"""Column expressions against literal tables."""

import pytest
from pyspark.sql import functions as F

from shelfmatch.functions import isbn, similarity, text


def values(spark, expression, cells):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in d.orderBy("i").select(expression(F.col("c")).alias("v")).collect()]


def test_title_key(spark):
    cases = {
        "The 101 Dalmatians!": "101 dalmatians", "DON'T TRUST FISH!": "don t trust fish", "Barbie : a fashion fairytale": "barbie a fashion fairytale",
        "Heidi (unabridged)": "heidi", "Heidi [Abridged] ": "heidi", "Heidi unabridged": "heidi", "Salt & Pepper": "salt and pepper", "The": "the",
        "A the": "the", "  Años ": "os", None: "", "!!!": "", " The Cat ": "cat",
    }
    assert values(spark, text.title_key, list(cases)) == list(cases.values())


def test_folded_and_loose_keys(spark):
    assert values(spark, text.folded_key, ["El Niño", "ﬀ", "Café & Co"]) == ["el nino", "", "cafe and co"]
    assert values(spark, text.loose_key, ["The Cat (abridged)"]) == ["the cat abridged"]


def test_isbn_parse(spark):
    def shown(c):
        return F.array_join(F.transform(isbn.parse_isbns(c), lambda p: F.concat(p["isbn13"], F.lit("/"), p["isbn10"])), "|")

    cases = {
        "9.781516080236E12": "9781516080236/1516080238", "9781516080236": "9781516080236/1516080238", "0-02-865378-5 (hc. : x)": "9780028653785/0028653785",
        "9780028653785 9798893045581": "", "9780028653785; 9798893045581": "9780028653785/0028653785|9798893045581/", "12345678901": "", None: "", "x": "",
    }
    assert values(spark, shown, list(cases)) == list(cases.values())
    assert values(spark, lambda c: isbn.parse_isbns(c)[0]["isbn10"], ["123456789"]) == ["0123456789"]


def test_isbn_forms(spark):
    assert values(spark, isbn.isbn13_to_10, ["9780028653785", "9798893045581", ""]) == ["0028653785", "", ""]
    assert values(spark, isbn.isbn10_to_13, ["002865378X", "12"]) == ["9780028653785", ""]
    assert values(spark, isbn.looks_like_isbn, ["978-0-02-865378-5", "1e3", "cats"]) == [True, True, False]
    got = values(spark, lambda c: F.array_join(isbn.sort_isbns(F.split(c, ",")), ","), ["0028653785,9798893045581,9780028653785"])
    assert got == ["9780028653785,9798893045581,0028653785"]


def test_flags_and_levels(spark):
    assert values(spark, text.is_junk_title, ["Total", "Grand  Total", "Notes", "Selection evidence", "Totally", ""]) == [True, True, True, True, False, False]
    assert values(spark, text.is_staff_only, ["Staff Only", "Teen, staff-only", "Staff – only", "Teen", "understaffonly"]) == [True, True, True, False, False]
    assert values(spark, text.normalize_level, ["elementary", "Middle  School", "HIGH", "Adult "]) == ["Elementary", "Middle", "High", "Adult"]
    assert values(spark, text.clean_digital_title, ["Heidi (Unabridged) ", "Heidi abridged"]) == ["Heidi", "Heidi"]
    assert values(spark, text.format_bit, ["Book", "eBook", "Sound", "book"]) == [1, 2, 4, 0]
    assert values(spark, text.audience_value, ["2024-01-02", "7.5", "Teen"]) == [None, None, "Teen"]


def test_sorted_lists(spark):
    batches = "Zeta|2026-2027|Jan 2026|Sep 2025|Oct 2025"
    assert values(spark, lambda c: F.array_join(text.sort_batches(F.split(c, r"\|")), "|"), [batches]) == ["Sep 2025|Oct 2025|Jan 2026|2026-2027|Zeta"]
    assert values(spark, lambda c: F.array_join(text.sort_levels(F.split(c, ",")), ","), ["Adult,High,Elementary,Middle"]) == ["Elementary,Middle,High,Adult"]
    names = "Ann Lee|Lee, Ann|ann  lee|Bo|"
    assert values(spark, lambda c: F.array_join(text.canonical_authors(F.split(c, r"\|")), "|"), [names]) == ["Lee, Ann|Bo"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("dogman", "dog man", True), ("harry potter stone", "harry poter stone", True), ("charlotte s web", "charlotte s web a story", True),
        ("big cats", "small dogs", False), ("", "x", False), ("river song tale", "river sing tale", False), ("wonder world tales", "wonders world tales", True),
    ],
)
def test_titles_related(spark, a, b, want):
    d = spark.createDataFrame([(a, b)], "a string, b string")
    assert d.select(similarity.titles_related(F.col("a"), F.col("b"))).first()[0] is want
    assert d.select(similarity.titles_related(F.col("b"), F.col("a"))).first()[0] is want


def test_dice_and_distance(spark):
    d = spark.createDataFrame([("night", "nacht"), ("", "x"), ("same", "same"), ("a", "abcdefghijk")], "a string, b string")
    rows = d.select(F.round(similarity.dice(F.col("a"), F.col("b"), similarity.bigrams("a"), similarity.bigrams("b")), 4), similarity.lev_capped(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(0.5, 2), (0.0, 1), (1.0, 0), (rows[3][0], 99)]
