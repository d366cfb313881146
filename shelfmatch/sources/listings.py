"""Listing files with differing headers: discovery, sheets, kinds, canonical columns and source hints."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import access_level, cell, clean_digital_title, first_nonblank, normalize_level
from ..session import give_package

#: The column of each header spelling (letters and digits in lower case).
ALIASES = {
    "title": "title",
    "booktitle": "title",
    "titlesubtitle": "title",
    "author": "author",
    "authors": "author",
    "authorname": "author",
    "authorartist": "author",
    "creator": "author",
    "sourcebatch": "source_batch",
    "batch": "source_batch",
    "posted": "source_batch",
    "posteddate": "source_batch",
    "dateposted": "source_batch",
    "period": "source_batch",
    "postingperiod": "source_batch",
    "postedperiod": "source_batch",
    "level": "level",
    "campuslevel": "level",
    "gradelevel": "level",
    "elementarymiddleorhigh": "level",
    "contentaccesslevels": "level",
    "book": "book",
    "ebook": "ebook",
    "audio": "audio",
    "isbn": "isbn",
    "isbn10": "isbn_10",
    "isbn13": "isbn_13",
    "normalizedisbn": "normalized_isbn",
    "isbnhb": "isbn_hb",
    "isbnpb": "isbn_pb",
    "isbnother": "isbn_other",
    "possibleduplicate": "possible_duplicate",
    "duplicate": "possible_duplicate",
    "audience": "audience",
    "audiencerating": "audience",
    "booklist": "booklist",
    "kirkus": "kirkus",
    "pw": "pw",
    "slj": "slj",
    "hornbook": "horn_book",
    "commonsensemedia": "common_sense_media",
    "otherreviews": "other_reviews",
    "edition": "edition",
    "qty": "qty",
    "materialtype": "material_type",
    "seriestitle": "series_title",
    "follettebook": "follett_ebook",
    "titleid": "title_id",
    "owned": "owned",
    "subscription": "subscription",
    "format": "format",
}
COLUMNS = tuple(dict.fromkeys(ALIASES.values()))
REVIEWS = ("booklist", "kirkus", "pw", "slj", "horn_book", "common_sense_media", "other_reviews")
#: Batch labels that a source without one gets. The curated list's name and label are a site's own.
BATCHES = {"all-campuses": "All Campuses", "ebook-order": "eBook order", "follett": "Follett 9.16.26", "sora": "Sora 2026-09-16", "curated": "Curated list"}
CURATED = r"curated[- ]?list"
HOLDINGS, IGNORED = "follett", "(?i)summary|evidence|notes|instruction"
EXTENSIONS = ("csv", "json", "parquet", "tsv", "xlsx")
#: Order in which inputs of each role are read.
ROLES = ("master", "incoming", "extra")
#: Files up to which the sheets that count are broadcast.
FILES_BROADCAST = 200_000


def header_key(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def canonicalize_columns(df: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Canonical names for headers; of several headers for one column, the first cell of a row that isn't blank counts."""
    plan: dict[str, list[str]] = {}
    for c in df.columns:
        name = ALIASES.get(header_key(c))
        if name or keep_unknown:
            plan.setdefault(name or c, []).append(c)
    return df.select(*(F.col(f"`{cols[0]}`").alias(name) if len(cols) == 1 else first_nonblank([F.col(f"`{c}`") for c in cols]).alias(name) for name, cols in plan.items()))


def with_all_columns(df: DataFrame) -> DataFrame:
    """Adds the canonical columns that are missing, as nulls."""
    return df.withColumns({c: F.lit(None).cast("string") for c in COLUMNS if c not in df.columns})


def detect_source_kind(path: Column, sheet: Column, headers: Column, curated: str = CURATED) -> Column:
    """Kind of a source from its file name, sheet and header keys (array); the first rule that fits counts."""
    name, tab = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)), F.lower(F.coalesce(sheet, F.lit("")))
    has = lambda *keys: F.size(F.array_intersect(headers, F.array(*map(F.lit, keys)))) == len(keys)
    return (
        F.when(name.contains("district-report") | tab.contains("district report"), "follett")
        .when(has("materialtype", "isbn") & (has("seriestitle") | has("titlesubtitle") | has("title")), "follett")
        .when(name.contains("sora") | tab.contains("title status") | has("titleid", "format", "owned", "title"), "sora")
        .when(name.startswith("ebook-list") | has("qty", "edition", "title", "isbn"), "ebook-order")
        .when(name.contains("all-campuses") | tab.isin("all campuses", "ms books") | has("elementarymiddleorhigh"), "all-campuses")
        .when(name.rlike(curated) | tab.rlike(curated), "curated")
        .otherwise("master")
    )


def select_sheets(sheets: DataFrame, curated: str = CURATED) -> DataFrame:
    """The sheets (path, sheet, sheet_no) of each workbook that count: all data sheets of a campus workbook, else the preferred one."""
    file = Window.partitionBy("path")
    tab = F.lower("sheet")
    ignored = F.col("sheet").rlike(IGNORED)
    first = F.min_by("sheet", "sheet_no").over(file)
    d = sheets.withColumn("_campus", F.max(F.lower("path").rlike(r"all-campuses[^/]*$") | tab.isin("all campuses", "ms books")).over(file))
    d = d.withColumn("_kind", detect_source_kind(F.col("path"), first, F.array().cast("array<string>"), curated)).withColumn("_data", F.max(~ignored).over(file))
    named = F.when(F.col("_kind") == "follett", tab.contains("district report")).when(F.col("_kind") == "sora", tab.contains("title status")).when(F.col("_kind") == "ebook-order", tab.contains("page 1")).when(F.col("_kind") == "curated", tab.rlike(curated) & ~ignored).otherwise(F.col("sheet") == "Master List")
    second = F.when(F.col("_kind") == "follett", tab.contains("summary")).when(F.col("_kind") == "sora", F.lit(False)).otherwise(ignored)
    rank = F.row_number().over(file.orderBy(F.when(named, 0).otherwise(1), F.when(named & (F.col("_kind") != "follett"), 0).when(F.col("_kind").isin("sora"), 0).when((F.col("_kind") == "follett") & ~named, 0).otherwise(second.cast("int")), "sheet_no"))
    d = d.withColumn("_rank", rank).withColumn("_no", F.row_number().over(file.orderBy("sheet_no")))
    chosen = F.when(F.col("_campus"), F.when(F.col("_data"), ~ignored).otherwise(F.col("_no") == 1)).otherwise(F.col("_rank") == 1)
    return d.where(chosen).drop("_campus", "_kind", "_data", "_rank", "_no")


def list_inputs(files: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """path and source_seq of listings: known extensions, no lock files, each path once.

    files: path, and role where there is one (master, incoming or extra; incoming without), place for the order given.
    The master list comes first, then what came in by file name, then extra files as they are given.
    """
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    f = files.select("path", F.col("role") if "role" in files.columns else F.lit("incoming").alias("role"), F.col("place").cast("long") if "place" in files.columns else F.lit(0).cast("long").alias("place"))
    f = f.where(F.lower(name).rlike(rf"\.({'|'.join(extensions)})$") & ~name.startswith("~$"))
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    order = F.struct(F.when(rank > 0, rank).otherwise(len(ROLES) + 1).alias("rank"), F.when(F.col("role") == "incoming", F.collate(name, "en_CI")).alias("name"), "place", "path")
    once = f.groupBy("path").agg(F.min(order).alias("order"))
    # one row a file: the numbering is as long as the list of files
    return once.select("path", (F.row_number().over(Window.orderBy("order")) - 1).cast("int").alias("source_seq"))


def _bare(path: Column | str) -> Column:
    """A path without the scheme of local files, as it is given and as Spark names it."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def _named_sheets(files: DataFrame) -> DataFrame:
    """path, sheet and sheet_no of all sheets."""
    import pyarrow as pa

    from .workbooks import sheet_names

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names = sheet_names(path, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(range(len(names)), pa.int32())], ["path", "sheet", "sheet_no"])

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, sheet_no int")


def _read_sheets(files: DataFrame) -> DataFrame:
    """files: source_seq, source_label, path, content, sheets (array, in order); one row for each row of a sheet."""
    import pyarrow as pa

    from .workbooks import records

    head = ["source_seq", "source_label", "path", "sheet", "headers", "row_seq"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), *[pa.string()] * len(COLUMNS)]

    def rows_of(path: str, content: bytes, sheets: list[str]):
        first, n = None, 0
        for sheet in sheets:
            names, rows = records(path, content, sheet)
            keys = [header_key(h) for h in names]
            first = keys if first is None else first
            plan = {c: [i for i, k in enumerate(keys) if ALIASES.get(k) == c] for c in COLUMNS}
            for row in rows:
                cells = [next((row[i] for i in at if (row[i] or "").strip()), row[at[0]]) if at else None for at in plan.values()]
                yield first, n, cells
                n += 1

    def batch_of(seq, label, path, sheet, got):
        columns = [[seq] * len(got), [label] * len(got), [path] * len(got), [sheet] * len(got), [g[0] for g in got], [g[1] for g in got], *zip(*(g[2] for g in got))]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [*head, *COLUMNS])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                seq, label, path, content, sheets = (c[at].as_py() for c in batch.columns)
                got = []
                for row in rows_of(path, content, sheets):
                    got.append(row)
                    if len(got) == 4096:
                        yield batch_of(seq, label, path, ", ".join(sheets), got)
                        got = []
                if got:
                    yield batch_of(seq, label, path, ", ".join(sheets), got)

    schema = f"source_seq int, source_label string, path string, sheet string, headers array<string>, row_seq long, {', '.join(f'{c} string' for c in COLUMNS)}"
    return files.select("source_seq", "source_label", "path", "content", "sheets").mapInArrow(run, schema)


def read_listings(spark: SparkSession, paths: Sequence[str], labels: Sequence[str] | None = None, curated: str = CURATED) -> DataFrame:
    """All rows of listing files in the order given: canonical columns, source_seq, source_label, kind, sheet and row_seq.

    Spark reads the files' bytes, many small ones to a task and any number of them in one scan; headers, sheets and
    formats are resolved where a file is read.  Of a workbook the sheets count that ``select_sheets`` chooses;
    its kind follows from its name and the first of them.  A file is parsed whole by one task, so one over 2 GB is an error.
    """
    if not paths:
        raise ValueError("no listings given")
    give_package(spark)
    order = spark.createDataFrame([(k, labels[k] if labels else p, p) for k, p in enumerate(paths)], "source_seq int, source_label string, given string")
    once = order.withColumn("bare", _bare("given")).groupBy("bare").agg(F.min(F.struct("source_seq", "source_label")).alias("o")).select("bare", "o.*")
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).select("path", "content", _bare("path").alias("bare"))
    chosen = select_sheets(_named_sheets(files), curated).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", "sheet"))), lambda s: s["sheet"]).alias("sheets"))
    few = len(paths) <= FILES_BROADCAST
    small = lambda d: F.broadcast(d) if few else d
    ready = files.join(small(once), "bare").join(small(chosen), "path")
    kind = detect_source_kind(F.col("path"), F.substring_index("sheet", ", ", 1), F.col("headers"), curated)
    return _read_sheets(ready).select("source_seq", "source_label", kind.alias("kind"), "sheet", "row_seq", *COLUMNS)


def apply_source_hints(df: DataFrame, batches: dict[str, str] | None = None) -> DataFrame:
    """What a kind of source says of its rows: batch label, formats, level, title and presence (posted or holdings)."""
    batches = {**BATCHES, **(batches or {})}
    df, kind = with_all_columns(df), F.col("kind")
    default = F.lit("")
    for k, label in batches.items():
        default = F.when(kind == k, label).otherwise(default)
    material, fmt, yes = cell("material_type"), F.lower(cell("format")), F.lit("true")
    holdings, digital = kind == "follett", kind == "sora"
    title = cell("title")
    return df.withColumns({
        "source_batch": F.when(cell("source_batch") == "", default).otherwise(cell("source_batch")),
        "book": F.when(holdings & (material == "Book"), yes).otherwise(cell("book")),
        "ebook": F.when((kind == "ebook-order") | (holdings & (material == "eBook")) | (digital & (fmt == "ebook")), yes).otherwise(cell("ebook")),
        "audio": F.when((holdings & material.isin("Sound", "Recording")) | (digital & (fmt == "audiobook")), yes).otherwise(cell("audio")),
        "level": F.when(digital, access_level("level")).otherwise(normalize_level("level")),
        "title": F.when(digital, clean_digital_title("title")).when(holdings & (title == ""), cell("series_title")).otherwise(title),
        "presence": F.when(holdings | digital, "holdings").otherwise("posted"),
        "staff_level": cell("level"),
    })


def pick_holdings_sources(df: DataFrame) -> DataFrame:
    """If any holdings source has titles, only the rows of those that have; else all rows."""
    per = df.groupBy("source_label").agg(F.max(cell("title") != "").alias("titled"))
    wanted = per.where("titled")
    some = wanted.select(F.lit(1).alias("one")).limit(1)
    kept = df.join(wanted.select("source_label"), "source_label", "left_semi")
    rest = df.withColumn("_one", F.lit(1)).join(some, F.col("_one") == F.col("one"), "left_anti").drop("_one")
    return kept.unionByName(rest)


def split_sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for cards, and rows for the holdings job."""
    return df.where(F.col("kind") != HOLDINGS), df.where(F.col("kind") == HOLDINGS)
