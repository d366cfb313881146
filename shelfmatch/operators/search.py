"""Lookup tables: ISBN and token indexes, scored matches, verdicts and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.isbn import isbn13_to_10, isbn_search_digits, looks_like_isbn
from ..functions.similarity import EXACT, bigrams, overlap_tokens, score_parts, title_score
from ..functions.text import author_tokens, authors_compatible, cell, loose_key, title_key, tokenize
from ..session import give_package
from .components import stored
from .titleblocks import bounded

MIN_SCORE, LIMIT, CONFIDENT, LEAD, CLOSE, SUGGEST = 0.42, 50, 0.92, 0.04, 0.58, 0.62


def rounded(score: Column) -> Column:
    """To six places by plain arithmetic, so that ties fall alike everywhere."""
    return F.floor(score * 1e6 + 0.5) / 1e6


def prepare_queries(queries: DataFrame) -> DataFrame:
    """query_id and struct q of a table (query_id, query)."""
    d = queries.select("query_id", cell("query").alias("raw")).withColumns({"key": title_key("raw"), "loose": loose_key("raw"), "isbn": F.when(looks_like_isbn("raw"), isbn_search_digits("raw")).otherwise("")})
    d = d.withColumn("text", F.when(F.col("key") != "", F.col("key")).otherwise(F.col("loose")))
    return d.select("query_id", F.struct("raw", "key", "loose", "text", "isbn", overlap_tokens("text").alias("tokens"), bigrams("text").alias("grams")).alias("q"))


def prepare_cards(cards: DataFrame) -> DataFrame:
    """id, title and struct t of cards."""
    d = cards.select("id", "title", "isbn_digits", title_key("title").alias("key"), loose_key("title").alias("loose"), loose_key(F.array_join("authors", " ")).alias("authors"))
    return d.select("id", "title", F.struct("key", "loose", "authors", F.col("isbn_digits").alias("isbns"), overlap_tokens("key").alias("tokens"), bigrams("key").alias("grams")).alias("t"))


def _rarest(each: DataFrame, known: DataFrame, most: Column) -> DataFrame:
    """Rows (query_id, g, ...) of each query's ``most`` rarest g, by the rows of known (id, g) that have it; unknown ones come first."""
    df = known.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "g"))
    return each.join(df, "g", "left").withColumn("place", rank).where(F.col("place") <= most).drop("df", "place")


#: Queries that a task compares, titles that it compares them with at most and at least, and tasks that small tables are dealt to.
ASKED, HELD, FEW, TASKS = 1_024, 65_536, 256, 32


def bounded_pairs(q: DataFrame, t: DataFrame, min_score: float = MIN_SCORE, limit: int | None = None) -> DataFrame:
    """Pairs (query_id, id), among them all with a score from min_score on for other reasons than ISBNs.

    Blocks of queries meet blocks of titles (``titleblocks``), so what is shuffled are the titles once for each block of
    queries; all pairs are looked at, few are kept.  With a limit only pairs are kept that may be among a query's best.
    """
    give_package(q.sparkSession)
    asked = stored(q.where("q.text <> ''").select("query_id", "q.key", "q.loose", "q.text"))
    held = stored(t.select("id", "title", "t.key", "t.loose", "t.authors"))
    blocks = -(-asked.count() // ASKED)
    if not blocks:
        return q.limit(0).select("query_id").crossJoin(t.limit(0).select("id"))
    titles = held.count()
    parts = max(1, -(-titles // HELD), min(-(-TASKS // blocks), titles // FEW))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.withColumn("block", dealt("query_id", blocks)).withColumn("part", every(parts))
    right = held.withColumn("part", dealt("id", parts)).withColumn("block", every(blocks))
    both = [d.repartition(2 * blocks * parts, "block", "part").groupBy("block", "part") for d in (left, right)]
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    met = both[0].cogroup(both[1]).applyInPandas(bounded(min_score, limit), f"query_id {kind(q, 'query_id')}, id {kind(t, 'id')}, title string, least long, most long")
    if limit is None:
        return met.select("query_id", "id")
    met = stored(met)
    by = lambda c: F.struct((-F.col(c)).alias("s"), "title", "id")
    sure = met.where(F.col("least") >= F.lit(min_score) * 1e6).select("query_id", by("least").alias("bound"))
    bound = sure.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("bound"))).where(F.col("place") == limit).select("query_id", "bound")
    return met.join(bound, "query_id", "left").where(F.col("bound").isNull() | (by("most") <= F.col("bound"))).select("query_id", "id")


def candidates(q: DataFrame, t: DataFrame, min_score: float = MIN_SCORE, limit: int | None = None) -> DataFrame:
    """Pairs (query_id, id), among them all with a score from min_score on; with a limit those of each query's best."""
    return bounded_pairs(q, t, min_score, limit).union(lookup_pairs(q, t)).distinct()


def _parts(d: Column) -> Column:
    """A number and its parts of 10 to 13 characters."""
    n = F.length(d)
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(d, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(d), *(cut(k) for k in range(10, 14))))


def lookup_pairs(q: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs (query_id, id) where digits are equal or, from ten on, one contains the other: an equi-join of their parts."""
    left = q.where("q.isbn <> ''").select("query_id", F.col("q.isbn").alias("d"), F.explode(_parts(F.col("q.isbn"))).alias("part"))
    right = t.select("id", F.explode("t.isbns").alias("x")).select("id", "x", F.explode(_parts(F.col("x"))).alias("part"))
    long_ = F.length("d") >= 10
    return left.join(right, "part").where((F.col("d") == F.col("x")) | (long_ & (F.col("x").contains(F.col("d")) | F.col("d").contains(F.col("x"))))).select("query_id", "id").distinct()


def _first(q: DataFrame, t: DataFrame) -> DataFrame:
    return lookup_pairs(q, t).join(t.select("id", "title"), "id").groupBy("query_id").agg(F.min(F.struct("title", "id")).alias("m")).select("query_id", "m.id")


def isbn_lookup(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, id: the first card (by title, then id) of each ISBN query."""
    return _first(prepare_queries(queries), prepare_cards(cards))


def isbn_fallback(queries: DataFrame, cards: DataFrame, holdings: DataFrame) -> DataFrame:
    """query_id, id, card: for ISBN queries without a card, the holdings record of the number and the card that it belongs to, if any.

    holdings: row_id, isbn13, extras, author, title; id is the record's (``h:`` and its ISBN).  A record belongs
    to the first card (by title, then id) that shares a number with it, else to the first of its title by a compatible author.
    """
    q = prepare_queries(queries).where("length(q.isbn) >= 10")
    open_ = q.join(isbn_lookup(queries, cards).select("query_id"), "query_id", "left_anti").select("query_id", F.col("q.isbn").alias("isbn"))
    index, _ = search_index(holdings.withColumn("label", F.col("title")))
    found = open_.join(index, "isbn").select("query_id", "row_id").join(holdings, "row_id")
    found = found.withColumns({"id": F.concat(F.lit("h:"), "isbn13"), "numbers": F.filter(F.concat(F.array("isbn13", isbn13_to_10("isbn13")), "extras", F.transform("extras", isbn13_to_10)), lambda d: d != ""), "key": title_key("title"), "names": F.split("author", r"\s*;\s*")})
    first = F.min(F.struct(F.col("card_title").alias("title"), F.col("card_id").alias("id")))
    pool = cards.select(F.col("id").alias("card_id"), F.col("title").alias("card_title"), "isbn_digits", "authors")
    by_isbn = found.select("query_id", F.explode("numbers").alias("d")).join(pool.select("card_id", "card_title", F.explode("isbn_digits").alias("d")), "d").groupBy("query_id").agg(first.alias("a"))
    same = F.exists("authors", lambda x: F.exists("names", lambda y: authors_compatible(author_tokens(x, "and"), author_tokens(y, "and"))))
    by_title = found.where("key <> ''").join(pool.withColumn("key", title_key("card_title")), "key").where(same).groupBy("query_id").agg(first.alias("b"))
    out = found.select("query_id", "id").join(by_isbn, "query_id", "left").join(by_title, "query_id", "left")
    return out.select("query_id", "id", F.coalesce("a.id", "b.id").alias("card"))


def with_fallback(hits: DataFrame, queries: DataFrame, cards: DataFrame, left: DataFrame) -> DataFrame:
    """Hits in which an ISBN query that no card answers has one: the card that the holdings record of its number belongs to, or the record.

    left: of ``leftover_cards``; hits: query_id, id, title, score, reason.
    """
    found = stored(isbn_fallback(queries, cards, left.select("row_id", "isbn13", "extras", "author", "title")).select("query_id", F.coalesce("card", F.substring("id", 3, 20)).alias("id")))
    named = cards.select("id", "title").union(left.select("id", "title"))
    new = found.join(named, "id").select("query_id", "id", "title", F.lit(EXACT).alias("score"), F.lit("isbn").alias("reason"))
    return hits.select("query_id", "id", "title", "score", "reason").join(found.select("query_id"), "query_id", "left_anti").union(new)


#: Pairs that a task scores.
SCORED = 25_000


def score(queries: DataFrame, cards: DataFrame, min_score: float = MIN_SCORE, limit: int | None = None) -> DataFrame:
    """query_id, id, title, score, reason of all pairs from min_score on; ISBN queries with a card of theirs get that alone.

    With a limit, which ``top_k`` then applies, pairs that can't be among a query's best are left out.
    """
    q, t = stored(prepare_queries(queries)), stored(prepare_cards(cards))  # each is read for every way and scored as stored
    only = stored(_first(q, t))  # a card of the number: nothing else is looked for
    rest = q.join(only.select("query_id"), "query_id", "left_anti")
    return score_pairs(candidates(rest, t, min_score, limit).union(only), q, t, min_score)


def score_pairs(pairs: DataFrame, q: DataFrame, t: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """query_id, id, title, score, reason of the pairs (query_id, id) that score min_score or more; q, t: prepared."""
    pairs = stored(pairs)
    pairs = pairs.repartition(pairs.count() // SCORED + 1).join(q, "query_id").join(t, "id").withColumns(score_parts("q", "t")).withColumn("s", title_score("q", "t", staged=True))
    # stored, as a filter on the score would work its parts out again wherever they stand in it
    return stored(pairs.select("query_id", "id", "title", rounded(F.col("s.score")).alias("score"), F.col("s.reason").alias("reason"))).where(F.col("score") >= min_score)


def asked_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, query) with each text once, by its least id, and (of, query_id): which queries it stands for."""
    same = queries.select("query_id", "query", cell("query").alias("raw"))
    first = same.groupBy("raw").agg(F.min(F.struct("query_id", "query")).alias("m")).select("raw", "m.*")
    return stored(first.select("query_id", "query")), stored(same.select("query_id", "raw").join(first.select(F.col("query_id").alias("of"), "raw"), "raw").select("of", "query_id"))


def for_all(ranked: DataFrame, stands_for: DataFrame) -> DataFrame:
    """What was found for each text, for all queries that ask it; cut it (``top_k``) before."""
    return ranked.withColumnRenamed("query_id", "of").join(stands_for, "of").drop("of")


def search_top(queries: DataFrame, cards: DataFrame, min_score: float = MIN_SCORE, limit: int = LIMIT) -> DataFrame:
    """``top_k`` of ``score``; equal queries are scored and ranked once."""
    once, stands_for = asked_once(queries)
    return for_all(top_k(score(once, cards, min_score, limit), limit), stands_for)


def top_k(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds rank: by score, title and id; at most ``limit`` for a query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


def classify(ranked: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """query_id, match (id or null), top_score, n and close (ids of the next works in order, at most five).

    Works are told apart by the title group key of cards (id, title, isbn_digits), so untitled cards are works of their own.
    """
    from .collapse import title_group_key

    group_key = "work"
    works = None if cards is None else cards.select("id", title_group_key().alias(group_key))
    ranked = ranked.withColumn(group_key, F.coalesce(F.nullif("title", F.lit("")), "id")) if works is None else ranked.join(works, "id")
    w = Window.partitionBy("query_id").orderBy("rank")
    r = ranked.withColumns({"second": F.lead("score").over(w), "best": F.first("score").over(w), "best_group": F.first(group_key).over(w)})
    sure = (F.col("rank") == 1) & (F.col("score") >= CONFIDENT) & (F.col("second").isNull() | (F.round(F.col("score") - F.col("second"), 6) >= LEAD) | (F.col("reason") == "isbn"))
    near = (F.col("score") >= CLOSE) & (F.col(group_key) != F.col("best_group"))
    g = r.groupBy("query_id").agg(F.max(F.when(sure, F.col("id"))).alias("match"), F.max("best").alias("top_score"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(near, F.struct("rank", "id")))).alias("near"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "id")))).alias("first"))  # limit bounds the lists
    close = F.transform(F.when(F.col("match").isNotNull(), F.slice("near", 1, 5)).otherwise(F.col("first")), lambda s: s["id"])
    return g.select("query_id", "match", "top_score", "n", close.alias("close"))


def verdicts(queries: DataFrame, classified: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, verdict: have_both, have_collection, have_posted, suggestions, matches or dont_have."""
    from .cards import presence

    where = cards.select(F.col("id").alias("match"), presence().alias("presence"))
    d = queries.select("query_id").join(classified, "query_id", "left").join(where, "match", "left")
    verdict = F.when(F.col("presence") == "both", "have_both").when(F.col("presence") == "holdings", "have_collection").when(F.col("presence") == "posted", "have_posted").when(F.col("n").isNull(), "dont_have").when(F.col("top_score") < SUGGEST, "suggestions").otherwise("matches")
    return d.select("query_id", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def did_you_mean(queries: DataFrame, cards: DataFrame, ranked: DataFrame, min_score: float = 0.18, limit: int = 5) -> DataFrame:
    """For queries without a hit: the best of a lower threshold."""
    none = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    return search_top(none.select("query_id", "query"), cards, min_score, limit)


def search_index(holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(isbn, row_id) with the ten-character forms, later rows overriding; (token, row_id) of authors and labels."""
    ten = isbn13_to_10("isbn13")
    isbns = holdings.select("row_id", F.explode(F.filter(F.concat(F.array("isbn13", ten), "extras", F.transform("extras", isbn13_to_10)), lambda d: d != "")).alias("isbn"))
    tokens = holdings.select("row_id", F.explode(F.array_union(tokenize("author"), tokenize("label"))).alias("token"))
    return isbns.groupBy("isbn").agg(F.max("row_id").alias("row_id")), tokens.distinct()


def token_search(queries: DataFrame, tokens: DataFrame, limit: int = 12) -> DataFrame:
    """query_id, row_id, rank: rows that have all the query's words; words of four characters or more also begin longer ones.

    Rows with the exact word come first for one-word queries; then by row.  Rows are found by the query's
    rarest word; the other words are looked for among the found rows' tokens.
    """
    words = stored(queries.select("query_id", tokenize("query").alias("words")).where(F.size("words") > 0))
    begun = F.when(F.length("token") >= 4, F.transform(F.sequence(F.lit(4), F.length("token")), lambda n: F.substring(F.col("token"), F.lit(1), n))).otherwise(F.array("token"))
    asked = words.select(F.explode("words").alias("g")).distinct()
    index = stored(tokens.select("row_id", F.explode(begun).alias("g")).join(asked, "g").distinct().select(F.col("row_id").alias("id"), "g"))
    one = _rarest(words.select("query_id", F.explode("words").alias("g")), index, F.lit(1))
    met = one.join(index, "g").select("query_id", F.col("id").alias("row_id")).join(words, "query_id")
    held = tokens.join(met.select("row_id").distinct(), "row_id").groupBy("row_id").agg(F.collect_set("token").alias("tokens"))
    begins = lambda w, t: (w == t) | ((F.length(w) >= 4) & t.startswith(w))
    hits = met.join(held, "row_id").where(F.forall("words", lambda w: F.exists("tokens", lambda t: begins(w, t))))
    later = (F.size("words") == 1) & ~F.array_contains("tokens", F.get("words", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(later, "row_id")
    return hits.select("query_id", "row_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= limit)


def _fold_marks() -> Column:
    """Each ISBN and the title key of a hit, if any: a holdings hit folds into one that has a mark of its own."""
    return F.explode(F.concat(F.transform("isbn_digits", lambda d: F.concat(F.lit("i:"), d)), F.filter(F.array(F.concat(F.lit("t:"), title_key("title"))), lambda k: k != "t:")))


def enrich(hits: DataFrame, found: DataFrame, queries: DataFrame, cards: DataFrame, leftovers: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Adds holdings hits (query_id, row_id) that fold into no scored card: query_id, id, title, score, reason.

    leftovers: row_id and the columns of cards.  A holdings hit folds into a hit of its query that shares an
    ISBN or its title; else it counts at least .55 (titled) or .7, and at most .9 unless it is a title match.
    """
    mine = found.join(leftovers, "row_id")
    known = hits.join(cards.select("id", "isbn_digits"), "id").select("query_id", _fold_marks().alias("mark")).distinct()
    marks = mine.select("query_id", "row_id", _fold_marks().alias("mark"))
    folded = marks.join(known, ["query_id", "mark"], "left_semi").select("query_id", "row_id").distinct()
    new = mine.join(folded, ["query_id", "row_id"], "left_anti")
    q, t = prepare_queries(queries), prepare_cards(new.select("id", "title", "isbn_digits", "authors").dropDuplicates(["id"]))
    s = new.select("query_id", "id").distinct().join(q, "query_id").join(t, "id").where("q.isbn = '' and length(q.raw) >= 3").withColumns(score_parts("q", "t")).withColumn("s", title_score("q", "t", staged=True))
    floor = F.greatest("s.score", F.when(F.col("title") != "", 0.55).otherwise(0.7))
    exact = (F.col("title") != "") & (F.col("s.reason") == "title") & (F.col("s.score") >= CONFIDENT)
    more = s.where(floor >= min_score).select("query_id", "id", "title", rounded(F.when(exact, F.col("s.score")).otherwise(F.least(floor, F.lit(0.9)))).alias("score"), F.when(F.col("s.reason") == "title", "title").otherwise("author").alias("reason"))
    return hits.select("query_id", "id", "title", "score", "reason").union(more)


def leftover_cards(leftovers: DataFrame) -> DataFrame:
    """What holdings left over (``holdings.leftovers``) with the columns that search asks of cards and of an index; ids are ISBNs."""
    named = F.col("title") != ""
    return leftovers.select(F.xxhash64("isbn13").alias("row_id"), F.col("isbn13").alias("id"), "isbn13", "extras", F.when(named, F.col("title")).otherwise("").alias("title"), F.array("author").alias("authors"), F.concat(F.array("isbn13"), "extras").alias("isbn_digits"), "author", F.when(named, F.col("title")).otherwise(F.col("series")).alias("label"), F.lit(False).alias("posted"), F.lit(True).alias("in_collection"))


def enriched(queries: DataFrame, cards: DataFrame, left: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, id, title, score, reason: scored works of each query together with holdings that linked nowhere, one hit for each work.

    All hits are enriched and then collapsed, so cut them last (``top_k``).  left: of ``leftover_cards``, stored.

    With a limit, which ``top_k`` then applies, hits are left out that can't be among a query's best works: a card that
    belongs to no work with another one is a work of its own, so the best of these are enough.  All hits of the others,
    and all that a holdings hit of the query may fold into, are scored.
    """
    from .collapse import collapse_labels, collapse_scored

    found = stored(token_search(queries, search_index(left)[1]).select("query_id", "row_id"))
    if limit is None:
        several, hits = cards.select("id"), stored(score(queries, cards))
    else:
        labels = stored(collapse_labels(cards))
        several = stored(labels.join(labels.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "group").select("id"))
        q, t = stored(prepare_queries(queries)), stored(prepare_cards(cards))
        only = stored(_first(q, t))
        rest = q.join(only.select("query_id"), "query_id", "left_anti")
        marked = found.join(left, "row_id").select("query_id", _fold_marks().alias("mark")).join(cards.select("id", _fold_marks().alias("mark")), "mark").select("query_id", "id")
        pairs = bounded_pairs(rest, t.join(several, "id", "left_anti"), limit=limit).union(bounded_pairs(rest, t.join(several, "id", "left_semi"))).union(marked.join(rest, "query_id", "left_semi"))
        hits = score_pairs(pairs.distinct().union(only), q, t)
    hits = stored(enrich(hits, found, queries, cards, left))
    columns = ("id", "isbn_digits", "posted", "in_collection")
    may_share = several.union(left.select("id")).distinct()
    works = collapse_scored(hits.join(may_share, "id", "left_semi").join(cards.select(*columns).union(left.select(*columns)), "id"))
    return works.union(hits.join(may_share, "id", "left_anti").select(*works.columns))


def empty_query(cards: DataFrame, limit: int = LIMIT) -> DataFrame:
    """What a blank query shows: the first cards by title."""
    from .cards import sorted_cards

    return sorted_cards(cards).limit(limit).select("id", "title", F.lit(0.0).alias("score"), F.lit("title").alias("reason"))


