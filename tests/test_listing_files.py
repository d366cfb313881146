"""Listing files of all formats: sheets, headers, order, and one scan for any number of files."""

import io
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq

from shelfmatch.operators import ingest
from shelfmatch.sources import listings, workbooks


def workbook(sheets: dict) -> bytes:
    """A workbook with shared and inline strings, numbers and booleans."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared: list[str] = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        if len(v) % 2:
            return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">' + "".join(cell("ABCDEFGH"[j] + str(i + 1), v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>no</t></rPh></si>" for s in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k else ""}worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
    return out.getvalue()


def test_formats_and_sheets(spark, tmp_path):
    (tmp_path / "all-campuses.xlsx").write_bytes(workbook({"Notes": [["Title"], ["no"]], "North": [["Book Title", None, "ISBN-13", "eBook"], ["Cats", None, 9780028653785, True], [None, None, None], ["Dogs", "x", 2.5]], "South": [["ISBN", "Title", "Title"], ["123X", "Birds", "other"]]}))
    (tmp_path / "district-report.xlsx").write_bytes(workbook({"Summary": [["Title"], ["no"]], "District Report 7": [["Title/Subtitle", "Material Type", "ISBN"], ["Fish", "Book", "9780028653785"]]}))
    (tmp_path / "a.tsv").write_text("﻿Title\tAuthor\n\"Two\nlines\"\tAnn\n\n \t \nOne\n")
    (tmp_path / "b.json").write_text(json.dumps([{"Title": "J", "ISBN": 9780028653785}, {"Creator": "Bo", "Title": None}]))
    pq.write_table(pa.table({"Title": ["P"], "Qty": [3.0], "Edition": [None], "ISBN": ["1"]}), tmp_path / "c.parquet")
    paths = [str(tmp_path / n) for n in ("district-report.xlsx", "a.tsv", "all-campuses.xlsx", "b.json", "c.parquet", "a.tsv")]
    rows = listings.read_listings(spark, paths, labels=[f"l{k}" for k in range(6)]).orderBy("source_seq", "row_seq").collect()
    got = [(r.source_seq, r.source_label, r.kind, r.sheet, r.row_seq, r.title, r.author, r.isbn, r.isbn_13, r.ebook) for r in rows]
    assert got == [
        (0, "l0", "follett", "District Report 7", 0, "Fish", None, "9780028653785", None, None),
        (1, "l1", "master", "", 0, "Two\nlines", "Ann", None, None, None),
        (1, "l1", "master", "", 1, "One", None, None, None, None),
        (2, "l2", "all-campuses", "North, South", 0, "Cats", None, None, "9780028653785", "true"),
        (2, "l2", "all-campuses", "North, South", 1, "Dogs", None, None, "2.5", None),
        (2, "l2", "all-campuses", "North, South", 2, "Birds", None, "123X", None, None),
        (3, "l3", "master", "", 0, "J", None, "9780028653785", None, None),
        (3, "l3", "master", "", 1, None, "Bo", None, None, None),
        (4, "l4", "ebook-order", "", 0, "P", None, "1", None, None),
    ]
    assert rows[-1].qty == "3" and ingest.accepted(listings.read_listings(spark, paths)).count() >= 5


def test_many_files_are_one_scan(spark, tmp_path):
    n = 400
    for k in range(n):
        (tmp_path / f"f{k:04}.csv").write_text(f"{'Title' if k % 2 else 'Book Title'},Author\nT{k},A\n")
    paths = [str(tmp_path / f"f{k:04}.csv") for k in reversed(range(n))]
    d = listings.read_listings(spark, paths)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("FileScan") <= 2
    assert [r.title for r in d.orderBy("source_seq").collect()] == [f"T{k}" for k in reversed(range(n))]


def test_order_of_inputs(spark):
    files = [("in/b.csv", "incoming", 0), ("in/A.csv", "incoming", 1), ("x/z.csv", "extra", 1), ("x/y.csv", "extra", 0), ("m.xlsx", "master", 0), ("m.xlsx", "extra", 3), ("in/~$b.csv", "incoming", 2), ("in/b.doc", "incoming", 3)]
    d = listings.list_inputs(spark.createDataFrame(files, "path string, role string, place int"))
    assert [r.path for r in d.orderBy("source_seq").collect()] == ["m.xlsx", "in/A.csv", "in/b.csv", "x/y.csv", "x/z.csv"]


def test_values_as_text():
    assert [workbooks.text(v) for v in (1.0, 9.781234567890e12, True, None, "x", 7, 0.5)] == ["1", "9781234567890", "true", None, "x", "7", "0.5"]
    assert workbooks.sheet_names("a.csv", b"") == [""] and workbooks.records("a.csv", b"", "")[0] == []
