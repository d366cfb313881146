"""Build the catalogue, attach holdings to it, and answer a table of lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import cards as C
from ..operators import collapse, holdings, ingest, search
from ..operators.components import stored


@dataclass
class Catalogue:
    """cards; status (status, n); accepted rows."""

    cards: DataFrame
    status: DataFrame
    rows: DataFrame


def build_catalogue(listings: DataFrame, rules: DataFrame | None = None) -> Catalogue:
    """Listings (canonical columns, source_seq, row_seq, kind) to cards."""
    marked = stored(ingest.with_status(ingest.prepare(listings), rules))
    rows = marked.where("status = 'accepted'").drop("status")
    return Catalogue(C.build_cards(rows), marked.groupBy("status").count().withColumnRenamed("count", "n"), rows)


@dataclass
class Holdings:
    """cards with their holdings, linked records, what is left over, and row counts by status."""

    cards: DataFrame
    linked: DataFrame
    leftovers: DataFrame
    status: DataFrame


def attach_holdings(cards: DataFrame, rows: DataFrame, rules: DataFrame | None = None) -> Holdings:
    marked = stored(holdings.with_status(rows, rules))
    linked = stored(holdings.link(holdings.by_isbn(marked), cards))
    return Holdings(holdings.apply(cards, linked), linked, holdings.leftovers(linked), marked.groupBy("status").count().withColumnRenamed("count", "n"))


def lookup(queries: DataFrame, cards: DataFrame, batch: str = "all", level: str = "all", limit: int = search.LIMIT, leftovers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked hits and the verdict of every query, over the collapsed cards of a batch and level.

    With leftovers (of ``Holdings``) holdings that linked nowhere are found, too: by their words where neither batch nor level is asked
    for, and always by an ISBN that no work has.
    """
    pool = stored(collapse.browse_works(cards, batch, level))
    works = pool.select("id", "title", "isbn_digits", "posted", "in_collection")
    left = None if leftovers is None else stored(search.leftover_cards(leftovers))
    if left is None or batch != "all" or level != "all":
        hits = search.score(queries, pool)
    else:
        hits = search.enriched(queries, pool, left)
    if left is not None:
        works = works.union(left.select(*works.columns))
        hits = search.with_fallback(stored(hits), queries, pool, left)
    ranked = stored(search.top_k(hits, limit))
    return ranked, search.verdicts(queries, search.classify(ranked, works), works)
