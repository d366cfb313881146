"""ISBN cells: numbers, hyphenated and annotated texts, and both lengths of a book number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, _c, cell

#: The spelling of numbers and of book numbers, and the columns that may hold them.
SCIENTIFIC = r"(?i)^\s*[0-9]+(\.[0-9]+)?e[+-]?[0-9]+\s*$"
TOKEN = r"[0-9][0-9Xx .()\-]{8,}[0-9Xx]"
ISBN_COLUMNS = ("isbn_13", "normalized_isbn", "isbn", "isbn_hb", "isbn_pb", "isbn_10", "isbn_other")


def strip(c: C) -> Column:
    return F.upper(F.regexp_replace(_c(c), "[^0-9Xx]", ""))


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i, 1).try_cast("int")


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _to13(d: Column) -> Column:
    total = sum((_digit(d, i) * (3 if i % 2 else 1) for i in range(1, 10)), F.lit(9 + 7 * 3 + 8))
    return F.when(d.rlike(r"^\d{9}[\dX]$"), F.concat(F.lit("978"), F.substring(d, 1, 9), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))).otherwise("")


def _to10(d: Column) -> Column:
    total = sum((_digit(d, 3 + i) * (11 - i) for i in range(1, 10)), F.lit(0))
    last = _let(F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11)), lambda check: F.when(check == 10, "X").otherwise(check.cast("string")))
    return F.when(d.rlike(r"^978\d{10}$"), F.concat(F.substring(d, 4, 9), last)).otherwise("")


def isbn10_to_13(c: C) -> Column:
    """978 form of ten characters; the tenth isn't checked. Empty for anything else."""
    return _let(strip(c), _to13)


def isbn13_to_10(c: C) -> Column:
    """Ten-character form of a 978 number; empty for anything else."""
    return _let(F.regexp_replace(_c(c), "[^0-9]", ""), _to10)


def isbn_from_number(c: C) -> Column:
    """Digits of a number written in scientific notation; empty for anything else."""
    v = cell(c)
    return F.when(v.rlike(SCIENTIFIC), F.coalesce(F.round(v.try_cast("double")).try_cast("decimal(38,0)").cast("string"), F.lit(""))).otherwise("")


def _parsed(token: Column) -> Column:
    """Struct of isbn13 and isbn10, or null."""

    def both(d: Column) -> Column:
        whole = F.length(d) == 13
        isbn13 = F.when(whole, d).when(F.length(d) == 10, F.nullif(isbn10_to_13(d), F.lit("")))
        return _let(isbn13, lambda n: F.when(n.isNotNull(), F.struct(n.alias("isbn13"), F.when(whole, isbn13_to_10(d)).otherwise(d).alias("isbn10"))))

    return _let(_let(strip(token), lambda d: F.when(d.rlike(r"^\d{9}$"), F.concat(F.lit("0"), d)).otherwise(d)), both)


def parse_isbns(c: C) -> Column:
    """The numbers of a cell as structs isbn13, isbn10 (empty where there is none), distinct by isbn13."""

    def tokens(v: Column) -> Column:
        found = lambda f: F.when(F.size(f) > 0, f).when(v != "", F.array(v)).otherwise(F.array().cast("array<string>"))
        return _let(isbn_from_number(v), lambda n: F.when(n != "", F.array(n)).otherwise(_let(F.regexp_extract_all(v, F.lit(TOKEN), 0), found)))

    parsed = F.filter(F.transform(_let(cell(c), tokens), _parsed), lambda p: p.isNotNull())
    return F.aggregate(parsed, F.array().cast("array<struct<isbn13:string,isbn10:string>>"), lambda seen, p: F.when(F.exists(seen, lambda s: s["isbn13"] == p["isbn13"]), seen).otherwise(F.concat(seen, F.array(p))))


def collect_isbns(columns: list[C]) -> Column:
    """Distinct digits of the cells in order, each 13-digit form followed by its ten-character one."""
    parts = [F.flatten(F.transform(parse_isbns(c), lambda p: F.array(p["isbn13"], p["isbn10"]))) for c in columns]
    return F.array_distinct(F.filter(F.concat(*parts), lambda d: d != ""))


def primary_isbn(digits: C) -> Column:
    """The first number of 13 characters, else the first, else empty."""
    a = _c(digits)
    return F.coalesce(F.get(F.filter(a, lambda d: F.length(d) == 13), F.lit(0)), F.get(a, F.lit(0)), F.lit(""))


def isbn_search_digits(c: C) -> Column:
    return F.coalesce(F.get(parse_isbns(c), F.lit(0))["isbn13"], strip(cell(c)))


def looks_like_isbn(c: C) -> Column:
    v = cell(c)
    return v.rlike(SCIENTIFIC) | F.length(F.regexp_replace(v, "[^0-9Xx]", "")).between(10, 13)


def isbn_sort_key(d: C) -> Column:
    v = _c(d)
    n = F.length(v)
    return F.struct(F.when((n == 13) & v.startswith("978"), 0).when(n == 13, 1).when(n == 10, 2).otherwise(3).alias("rank"), v.alias("label"))


def sort_isbns(array: C) -> Column:
    return F.transform(F.array_sort(F.transform(F.array_distinct(_c(array)), isbn_sort_key)), lambda s: s["label"])
