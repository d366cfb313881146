"""Similarity of titles: edit distance, bigrams, token overlap, relatedness and the lookup score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, _c, key_tokens, significant_tokens

#: Scores of the tiers of a match.
EXACT, PREFIX, CONTAINS, AUTHOR_EXACT, AUTHOR_PART = 1.0, 0.96, 0.88, 0.84, 0.72


def lev_capped(a: Column, b: Column, gap: int = 8) -> Column:
    """Edit distance; 99 where two non-empty texts differ by more than ``gap`` in length."""
    la, lb = F.length(a), F.length(b)
    return F.when((la > 0) & (lb > 0) & (F.abs(la - lb) > gap), 99).otherwise(F.levenshtein(a, b))


def bigrams(c: C) -> Column:
    """Distinct pairs of neighbouring characters of a text with a blank at either end."""
    padded = F.concat(F.lit(" "), _c(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(_c(c)) + 1), lambda i: F.substring(padded, i, F.lit(2))))


def dice(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(2.0 * F.size(F.array_intersect(grams_a, grams_b)) / (F.size(grams_a) + F.size(grams_b)))


def overlap_tokens(key: C) -> Column:
    """Words of more than one character, and single digits."""
    return F.filter(key_tokens(key), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]+$"))


def tokens_similar(q: Column, t: Column) -> Column:
    number = lambda x: x.rlike("^[0-9]+$")
    return (q == t) | ((t.startswith(q) | q.startswith(t)) & (F.length(q) >= 3) & (F.length(t) >= 3) & ~number(q) & ~number(t))  # patterns last, for the few that begin alike


def token_overlap(q: Column, t: Column) -> Column:
    """Share of the query's tokens (arrays) that have a similar one in the title."""
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.size(F.filter(q, lambda x: F.exists(t, lambda y: tokens_similar(x, y)))) / F.size(q).cast("double"))


def titles_related(a: Column, b: Column, misspelt: bool = True) -> Column:
    """Whether two folded keys name one work: spacing, a shorter title inside a longer one, or (misspelt) small typos."""
    swap = F.length(a) > F.length(b)
    ca, cb = F.regexp_replace(a, " ", ""), F.regexp_replace(b, " ", "")
    parts = F.struct(F.when(swap, b).otherwise(a).alias("short"), F.when(swap, a).otherwise(b).alias("long"), ca.alias("ca"), cb.alias("cb"), significant_tokens(F.when(swap, b).otherwise(a)).alias("s"), significant_tokens(F.when(swap, a).otherwise(b)).alias("t"))

    def related(x: Column) -> Column:
        short, long_, ca, cb, s, t = (x[f] for f in ("short", "long", "ca", "cb", "s", "t"))
        cs, cl = F.when(F.length(ca) <= F.length(cb), ca).otherwise(cb), F.when(F.length(ca) <= F.length(cb), cb).otherwise(ca)

        # each of the shorter title's tokens takes the first free similar token of the longer one
        def take(used: Column, x: Column) -> Column:
            fits = F.transform(t, lambda y, i: (y == x) | ((F.length(x) >= 5) & (F.length(y) >= 5) & (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(x, y) <= 1)))
            free = F.transform(fits, lambda f, i: f & ~F.array_contains(used, i + 1))
            at = F.array_position(free, F.lit(True)).cast("int")
            return F.when(at > 0, F.concat(used, F.array(at))).otherwise(used)

        cheap = (short == long_) | (ca == cb) | ((F.length(short) >= 8) & long_.contains(short)) | ((F.length(cs) >= 8) & cl.contains(cs)) | ((F.length(cs) >= 6) & cl.startswith(cs))
        subset = (F.size(s) >= 2) & (F.size(F.array_except(s, t)) == 0)
        if not misspelt:
            return cheap | subset
        greedy = F.aggregate(s, F.array().cast("array<int>"), take, lambda used: (F.size(used) >= 3) & (F.size(used) >= 0.75 * F.size(s)))
        return F.when(cheap, True).when(subset, True).otherwise(F.when((F.size(s) >= 3) & (F.size(t) >= 3), greedy).otherwise(F.lit(False)))

    # an array of one struct, so that the words of a pair are worked out once
    return F.when((a == "") | (b == ""), False).otherwise(F.get(F.transform(F.array(parts), related), F.lit(0)))


def score_parts(q: str, t: str) -> dict[str, Column]:
    """What ``title_score`` uses several times; as columns of their own they are worked out once and keep its code short."""
    f = lambda s, n: F.col(f"{s}.{n}")
    return {
        "_overlap": token_overlap(f(q, "tokens"), f(t, "tokens")),
        "_distance": lev_capped(f(q, "text"), f(t, "key")),
        "_dice": dice(f(q, "text"), f(t, "key"), f(q, "grams"), f(t, "grams")),
        "_isbn": (f(q, "isbn") != "") & F.exists(f(t, "isbns"), lambda x: (x == f(q, "isbn")) | ((F.length(f(q, "isbn")) >= 10) & (x.contains(f(q, "isbn")) | f(q, "isbn").contains(x)))),
    }


def title_score(q: str, t: str, staged: bool = False) -> Column:
    """Score and reason of a card for a query, from prepared structs (see ``operators.search``).

    Fields of the query: raw, key, loose, text (key, or loose where the key is blank), tokens, grams,
    isbn (digits, empty for other queries).  Fields of the card: key, loose, tokens, grams, authors
    (loose blob), isbns.  staged: the columns of ``score_parts`` are there.
    """
    f = lambda s, n: F.col(f"{s}.{n}")
    key, loose, title, blob = f(q, "key"), f(q, "loose"), f(t, "key"), f(t, "authors")
    parts = score_parts(q, t)
    overlap, dist, same, isbn = (F.col(n) if staged else c for n, c in parts.items())
    both = (key != "") & (title != "")
    longest = F.greatest(F.length(key), F.length(title), F.lit(1))
    near = F.when(both, 1 - dist / longest).otherwise(0.0)
    fuzzy = F.greatest(overlap * 0.78, same * 0.86, F.when(near > 0.72, near * 0.9).otherwise(0.0), F.when(f(t, "loose").contains(loose) & (F.length(loose) >= 3), 0.8).otherwise(0.0), F.when((F.length(key) >= 5) & (F.length(title) >= 5) & (dist <= 2), 0.9).otherwise(0.0))
    author = (blob != "") & (loose != "") & blob.contains(loose)
    by_author = F.greatest(F.when(blob == loose, AUTHOR_EXACT).otherwise(AUTHOR_PART), F.when(title != "", overlap * 0.7).otherwise(0.0))
    row = lambda s, r: F.struct(s.cast("double").alias("score"), r.alias("reason"))
    title_ = F.lit("title")
    return (
        F.when(f(q, "raw") == "", row(F.lit(0.0), title_))
        .when(isbn, row(F.lit(EXACT), F.lit("isbn")))
        .when(both & (key == title), row(F.lit(EXACT), title_))
        .when(both & title.startswith(key), row(F.lit(PREFIX), title_))
        .when(both & title.contains(key), row(CONTAINS + F.least(F.lit(0.07), F.length(key) / F.length(title) * 0.07), title_))
        .when(author, row(by_author, F.when((title != "") & (overlap > 0.5), "title").otherwise("author")))
        .when(title == "", row(F.lit(0.0), F.lit("fuzzy")))
        .otherwise(row(fuzzy, F.when(fuzzy >= 0.9, "title").otherwise("fuzzy")))
    )
