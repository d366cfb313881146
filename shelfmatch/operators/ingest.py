"""From listing rows to accepted rows: exclusion rules, row status and removal of exact repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import ISBN_COLUMNS, collect_isbns, primary_isbn
from ..functions.text import MATERIALS, author_tokens, authors_match, cell, collapse, is_junk_title, is_staff_only, title_key
from ..sources.listings import apply_source_hints
from .components import stored

ROW = ["source_seq", "row_seq"]
#: Rules are a curated list; beyond this many keys they are joined by a shuffle.
RULES_BROADCAST = 200_000


def rule_keys(rules: DataFrame) -> DataFrame:
    """One row for each title or alias of a rule: rule_key, rule_tokens, hide, match_author."""
    names = F.array("title") if "aliases" not in rules.columns else F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = rules.select("author", "hide", "match_author", F.explode(names).alias("name"))
    return each.select(title_key("name").alias("rule_key"), author_tokens("author").alias("rule_tokens"), "hide", "match_author").where("rule_key <> ''").distinct()


def matching_rows(rows: DataFrame, rules: DataFrame, posted: Column | None = None) -> DataFrame:
    """Keys (columns id) of rows (id, key, author) that a rule hides, or excludes where ``posted`` holds; with the kind of hit.

    A hide rule hits its key and every key that goes on after it at a word's end; so rows are joined by
    the beginnings of their keys, as many words long as the longest rule.
    """
    keys = stored(rule_keys(rules))
    n, longest = keys.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("rule_key", " "))), F.lit(0))).first()
    fits = n <= RULES_BROADCAST
    words = F.split("key", " ")
    begun = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(max(longest, 1)))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    each = rows.where("key <> ''").select("id", "key", author_tokens("author").alias("tokens"), (posted if posted is not None else F.lit(False)).alias("posted"), F.explode_outer(begun).alias("rule_key"))
    met = each.join(F.broadcast(keys) if fits else keys, "rule_key")
    same = authors_match(F.col("tokens"), F.col("rule_tokens"))
    hidden = F.col("hide") & (~F.col("match_author") | same)
    excluded = F.col("posted") & (F.col("rule_key") == F.col("key")) & same
    return met.groupBy("id").agg(F.max(hidden).alias("hidden"), F.max(excluded).alias("excluded")).where("hidden or excluded")


def prepare(rows: DataFrame) -> DataFrame:
    """Rows with source hints, key, isbns, group_key and fingerprint."""
    there = [c for c in ISBN_COLUMNS if c in rows.columns]
    r = apply_source_hints(rows)
    isbns = collect_isbns([F.col(c) for c in there]) if there else F.array().cast("array<string>")
    r = r.withColumns({"title": cell("title"), "author": cell("author"), "isbns": isbns})
    r = r.withColumn("key", title_key("title"))
    primary = primary_isbn("isbns")
    return r.withColumns({
        "group_key": F.when(F.col("key") != "", F.col("key")).when(primary != "", F.concat(F.lit("isbn:"), primary)).otherwise(""),
        "fingerprint": F.concat_ws("\t", "key", collapse(F.lower("author")), "source_batch", F.array_join(F.sort_array("isbns"), ",")),
    })


def with_status(prepared: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds status: staff_only, format, material, empty, excluded, duplicate or accepted (the first that fits)."""
    digital, fmt, material = F.col("kind") == "sora", F.lower(cell("format")), cell("material_type")
    early = (
        F.when(digital & is_staff_only("staff_level"), "staff_only")
        .when(digital & ~fmt.isin("ebook", "audiobook"), "format")
        .when((material != "") & ~material.isin(*MATERIALS), "material")
        .when(is_junk_title("title") | ((F.col("title") == "") & (F.size("isbns") == 0)), "empty")
    )
    # stored, as keys and numbers of every row are read up to three times
    r = stored(prepared.withColumn("status", early))
    if rules is not None:
        hits = matching_rows(r.where("status is null").select(F.struct(*ROW).alias("id"), "key", "author", "presence"), rules, F.col("presence") != "holdings")
        hits = hits.select(*(F.col(f"id.{c}").alias(c) for c in ROW), F.lit(True).alias("_hit"))
        r = r.join(hits, ROW, "left").withColumn("status", F.when(F.col("status").isNull() & F.col("_hit"), "excluded").otherwise(F.col("status"))).drop("_hit")
    # the first of equal rows stays: found by an aggregate of the order keys; only fingerprints of several rows are looked up, so whole rows are shuffled for many of them alone
    place = F.struct(*ROW)
    first = stored(r.where("status is null").groupBy("fingerprint").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    r = r.join(first, "fingerprint", "left")
    return r.withColumn("status", F.coalesce("status", F.when(F.col("_first").isNull() | (place == F.col("_first")), "accepted").otherwise("duplicate"))).drop("_first")


def accepted(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    return with_status(prepare(rows), rules).where("status = 'accepted'").drop("status")


def status_counts(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    return with_status(prepare(rows), rules).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
