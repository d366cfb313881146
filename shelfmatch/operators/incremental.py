"""Adding listings to stored ones: rows already there change nothing, and only touched works are built again.

What is kept between imports is a ``State``: accepted rows and the ISBN index, both appended to; the
component of each group; and the cards with their component.  An import reads the stored fingerprints,
the index of the ISBNs that it brings or touches, and the rows of works that it changes.  Components are
contracted, not worked out anew: the old components are the nodes, and only pairs that a new row
may have made are edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cards as C
from .components import components, shared_isbn_pairs, stored
from .ingest import accepted


@dataclass
class State:
    """rows (accepted); groups: group_key, gid; index: isbn, group_key; cards with gid."""

    rows: DataFrame
    groups: DataFrame
    index: DataFrame
    cards: DataFrame


def _index(rows: DataFrame) -> DataFrame:
    return rows.where("group_key <> ''").select(F.explode("isbns").alias("isbn"), "group_key").distinct()


def begin(rows: DataFrame) -> State:
    """The state after a first import of accepted rows."""
    labels = stored(C.card_labels(rows))
    groups = rows.where("group_key <> ''").select("group_key").distinct().join(labels, "group_key", "left").select("group_key", F.coalesce("label", "group_key").alias("gid"))
    return State(rows, stored(groups), stored(_index(rows)), stored(C.build_cards(rows, labels=labels, with_group=True)))


def new_rows(stored_rows: DataFrame, arrived: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Accepted rows among the arrived listings whose fingerprint isn't stored yet."""
    return accepted(arrived, rules).join(stored_rows.select("fingerprint").distinct(), "fingerprint", "left_anti")


def incremental_import(stored_rows: DataFrame, arrived: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """All accepted rows after the import."""
    added = new_rows(stored_rows, arrived, rules)
    return stored_rows.unionByName(added, allowMissingColumns=True)


def _edges(state: State, added: DataFrame) -> DataFrame:
    """Pairs a < b of groups with a common ISBN, one of which has an added row, that look like one work; others of the same ISBNs may be among them."""
    keys = added.select("group_key").where("group_key <> ''").distinct()
    isbns = _index(added).select("isbn").union(state.index.join(keys, "group_key", "left_semi").select("isbn")).distinct()
    owners = stored(state.index.join(isbns, "isbn", "left_semi").union(_index(added).select("isbn", "group_key")).distinct())
    named = owners.select("group_key").distinct()
    titles = state.rows.select("group_key", "title").join(named, "group_key", "left_semi").union(added.select("group_key", "title").join(named, "group_key", "left_semi"))
    return shared_isbn_pairs(owners.select(F.col("group_key").alias("key"), "isbn"), titles.where("title <> ''").select(F.col("group_key").alias("key"), "title").distinct())


def add_listings(state: State, arrived: DataFrame, rules: DataFrame | None = None) -> State:
    """The state after another import."""
    added = stored(new_rows(state.rows, arrived, rules))
    keys = added.select("group_key").where("group_key <> ''").distinct()
    own = stored(keys.join(state.groups, "group_key", "left").select("group_key", F.coalesce("gid", "group_key").alias("gid")))
    fresh = own.join(state.groups, "group_key", "left_anti")
    of = state.groups.union(fresh)
    side = lambda x: of.select(F.col("group_key").alias(x), F.col("gid").alias(f"g{x}"))
    met = stored(_edges(state, added)).join(side("a"), "a").join(side("b"), "b").where("ga <> gb").select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
    moved = stored(components(met).select(F.col("key").alias("gid"), F.col("label").alias("to")))
    touched = stored(own.select("gid").union(moved.select("gid")).distinct())
    groups = stored(of.join(moved, "gid", "left").select("group_key", F.coalesce("to", "gid").alias("gid")))
    now = touched.join(moved, "gid", "left").select(F.coalesce("to", "gid").alias("gid")).distinct()
    of_touched = stored(groups.join(now, "gid", "left_semi"))
    rows = state.rows.join(of_touched.select("group_key"), "group_key", "left_semi").unionByName(added, allowMissingColumns=True)
    built = C.build_cards(rows, labels=of_touched.withColumnRenamed("gid", "label"), with_group=True)
    cards = state.cards.join(touched, "gid", "left_anti").unionByName(built)
    return State(state.rows.unionByName(added, allowMissingColumns=True), groups, state.index.union(_index(added).select("isbn", "group_key")).distinct(), stored(cards))


def save(state: State, path: str) -> None:
    """Writes a state; the tables are read from elsewhere (another path or working tables), never from the path itself."""
    for name in ("rows", "groups", "index", "cards"):
        getattr(state, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> State:
    return State(*(spark.read.parquet(f"{path}/{name}") for name in ("rows", "groups", "index", "cards")))
