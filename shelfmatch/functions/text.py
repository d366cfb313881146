"""Text cleaning and keys of titles, authors, levels, batches and flags."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' trim() sees it, and words with a meaning in listings.
WS = r"[\t-\r    -     　﻿]"
ARTICLES = ("a", "an", "the")
STOP_WORDS = ("a", "an", "the", "of", "and", "or", "vol", "volume", "book", "part", "novel", "graphic", "edition", "standard")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LEVELS = ("Elementary", "Middle", "High")
MATERIALS = ("Book", "eBook", "Sound", "Recording")
BOOK, EBOOK, AUDIO = 1, 2, 4

C = Column | str
#: Fixed value: what stands for a missing title.
UNTITLED = "Title not listed"


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell(c: C) -> Column:
    """The text of a cell without white space around it; null: empty."""
    return F.coalesce(F.regexp_replace(_c(c).cast("string"), f"^{WS}+|{WS}+$", ""), F.lit(""))


def collapse(c: C) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(_c(c), f"{WS}+", " ")


def title_key(c: C) -> Column:
    """Letters and digits of a title in lower case, without edition marks and leading articles."""
    s = F.lower(cell(c))
    s = F.regexp_replace(s, rf"{WS}*[(\[]{WS}*(un)?abridged{WS}*[)\]]", " ")
    s = F.regexp_replace(s, rf"{WS}+(un)?abridged{WS}*$", "")
    s = F.regexp_replace(s, "[&+]", " and ")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.regexp_replace(s, f"^(({'|'.join(ARTICLES)}) )+", "")


def loose_key(c: C) -> Column:
    """As title_key, but articles and edition marks stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(cell(c)), "[&+]", " and "), "[^a-z0-9]+", " "))


def _folding() -> tuple[str, str]:
    """Characters whose decomposition is one ASCII character and marks, and those ASCII characters."""
    pairs = [(chr(i), d[0]) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and (d := unicodedata.normalize("NFD", chr(i))) != chr(i) and d[0].isascii() and all(unicodedata.category(x)[0] == "M" for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def fold(c: C) -> Column:
    """Base letters of Latin text: accents and other marks go."""
    return F.regexp_replace(F.translate(cell(c), FOLD_FROM, FOLD_TO), r"\p{M}", "")


def folded_key(c: C) -> Column:
    return title_key(fold(c))


def compact_key(c: C) -> Column:
    return F.regexp_replace(folded_key(c), " ", "")


def key_tokens(key: C) -> Column:
    """Words of a key; a blank key has none."""
    return F.filter(F.split(_c(key), " "), lambda t: t != "")


def significant_tokens(key: C) -> Column:
    """Words of a key that say something about the work."""
    return F.filter(key_tokens(key), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def author_tokens(c: C, ampersand: str = " ") -> Column:
    """Distinct words of an author; the lookup form reads & and + as ``and``."""
    s = F.regexp_replace(F.lower(cell(c)), "[&+]", f" {ampersand} ") if ampersand.strip() else F.lower(cell(c))
    return F.array_distinct(key_tokens(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))))


def authors_match(row: Column, rule: Column) -> Column:
    """Whether every word of the rule's author (token arrays) is among the row's; a blank rule matches none."""
    return (F.size(rule) > 0) & (F.size(F.array_except(rule, row)) == 0)


def authors_compatible(a: Column, b: Column) -> Column:
    """Whether one author's words are all among the other's (token arrays, both non-empty)."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def normalize_level(c: C) -> Column:
    v = collapse(cell(c))
    k = F.lower(v)
    return F.when(k == "elementary", "Elementary").when(k.isin("middle", "middle school"), "Middle").when(k.isin("high", "high school"), "High").otherwise(v)


def is_staff_only(c: C) -> Column:
    """Whether an access level names staff only, alone or in a list."""
    return F.regexp_replace(F.lower(cell(c)), "[–—]", "-").rlike(rf"\bstaff({WS}|-)+only\b")


def access_level(c: C) -> Column:
    return F.when(is_staff_only(c), "").otherwise(normalize_level(c))


def clean_digital_title(c: C) -> Column:
    """Without a mark of the edition at the end."""
    s = F.regexp_replace(cell(c), rf"(?i){WS}*[(\[]{WS}*(un)?abridged{WS}*[)\]]{WS}*$", "")
    return cell(F.regexp_replace(s, rf"(?i){WS}+(un)?abridged{WS}*$", ""))


def truthy(c: C) -> Column:
    return F.lower(cell(c)).isin("true", "yes", "1", "x")


def format_bit(material: C) -> Column:
    m = cell(material)
    return F.when(m == "Book", BOOK).when(m == "eBook", EBOOK).when(m.isin("Sound", "Recording"), AUDIO).otherwise(0)


def material_formats(bits: C) -> Column:
    """Flags of a bit mask: struct of book, ebook, audio."""
    b = _c(bits)
    return F.struct(*(((b.bitwiseAND(n)) > 0).alias(k) for k, n in (("book", BOOK), ("ebook", EBOOK), ("audio", AUDIO))))


def display_title(title: C) -> Column:
    """A card's title, or what stands for one."""
    v = F.coalesce(_c(title), F.lit(""))
    return F.when(v != "", v).otherwise(UNTITLED)


def is_holdings_batch(c: C) -> Column:
    return cell(c).rlike(r"(?i)^(follett|sora)\b")


def is_junk_title(c: C) -> Column:
    """Totals and note labels are no titles."""
    return collapse(cell(c)).rlike(r"(?i)^((grand )?totals?|notes?|(review and )?selection evidence)$")


def batch_sort_key(c: C) -> Column:
    """Struct in the order of batches: months by date, then school years, then the rest by label."""
    v = cell(c)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(v, r"^([A-Za-z]+)\s+\d{4}$", 1), 1, 3)))
    year = F.regexp_extract(v, r"^[A-Za-z]+\s+(\d{4})$", 1)
    school = F.regexp_extract(v, "^(\\d{4})\\s*[-–]\\s*\\d{4}$", 1)
    is_month, is_school = month > 0, school != ""
    return F.struct(
        F.when(is_school, 1).when(is_month, 0).otherwise(2).alias("rank"),
        F.when(is_school, school.try_cast("int")).when(is_month, year.try_cast("int")).otherwise(0).alias("year"),
        F.when(is_school, 0).when(is_month, (month - 1).cast("int")).otherwise(0).alias("month"),
        v.alias("label"),
    )


def level_sort_key(c: C, levels: Sequence[str] = LEVELS) -> Column:
    """Struct in the order of levels: the named ones in their order (a site adds its own), then the rest by label."""
    at = F.array_position(F.array(*map(F.lit, levels)), _c(c))
    return F.struct(F.when(at > 0, at - 1).otherwise(999).cast("int").alias("rank"), _c(c).alias("label"))


def sort_by(array: C, key) -> Column:
    """The distinct values of an array in the order of a key struct whose last field is the value."""
    keyed = F.array_sort(F.transform(F.array_distinct(_c(array)), key))
    return F.transform(keyed, lambda s: s["label"])


def sort_batches(array: C) -> Column:
    return sort_by(array, batch_sort_key)


def sort_levels(array: C, levels: Sequence[str] = LEVELS) -> Column:
    return sort_by(array, lambda c: level_sort_key(c, levels))


def audience_value(c: C) -> Column:
    """The audience, or null for blanks, dates and plain numbers."""
    v = cell(c)
    return F.when((v != "") & ~v.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~v.rlike(r"^\d+(\.\d+)?$"), v)


def review_value(c: C) -> Column:
    v = cell(c)
    return F.when((v != "") & (F.lower(v) != "reviews:"), v)


def canonical_authors(names: C) -> Column:
    """Distinct names in their order; ``First Last`` goes where ``Last, First`` is there too."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  (not again for each name)

    def first(clean: Column) -> Column:
        keys = F.transform(clean, lambda n: collapse(F.lower(n)))
        return once(keys, lambda keys: F.filter(F.transform(clean, lambda n, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, n)), lambda n: n.isNotNull()))

    def turned(n: Column) -> Column:
        parts = F.split(collapse(n), " ")
        return F.lower(F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")))

    def plain(firsts: Column) -> Column:
        return once(F.transform(firsts, F.lower), lambda lowered: F.filter(firsts, lambda n: n.contains(",") | ~collapse(n).contains(" ") | ~F.array_contains(lowered, turned(n))))

    return once(once(F.filter(F.transform(_c(names), cell), lambda n: n != ""), first), plain)


def tokenize(c: C) -> Column:
    """Distinct words of at least two characters."""
    return F.array_distinct(F.filter(key_tokens(loose_key(c)), lambda t: F.length(t) >= 2))


def first_nonblank(columns: Sequence[C]) -> Column:
    """The first cell in the order of columns that isn't blank."""
    return F.coalesce(*(F.when(cell(c) != "", _c(c).cast("string")) for c in columns), F.lit(""))
