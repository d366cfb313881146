"""Rows of one listing file, whatever its format: a helper that runs where Spark has read the file's bytes."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: The name spaces of a workbook's parts.
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_COLUMN = re.compile("[A-Z]+")


def extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def sheet_names(path: str, content: bytes) -> list[str]:
    """The sheets of a workbook in their order; any other file is one sheet without a name."""
    if extension(path) != "xlsx":
        return [""]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [name for name, _ in _members(z)]


def records(path: str, content: bytes, sheet: str) -> tuple[list[str], Iterator[list]]:
    """Headers, and the rows (lists of strings and nulls as long as the headers) that aren't blank."""
    kind = extension(path)
    if kind == "xlsx":
        rows = _workbook_rows(content, sheet)
    elif kind in ("csv", "tsv"):
        rows = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter="\t" if kind == "tsv" else ",")
    elif kind == "json":
        rows = _object_rows(_objects(content.decode("utf-8-sig")))
    elif kind == "parquet":
        rows = _parquet_rows(content)
    else:
        raise ValueError(f"no listing format: {path}")
    rows = iter(rows)
    headers = next((r for r in rows if any(_filled(c) for c in r)), [])
    seen: set[str] = set()
    names = []
    for at, h in enumerate(headers):
        name = h if _filled(h) else f"__EMPTY{at}"
        while name in seen:  # a repeated header is a column of its own
            name += "_1"
        seen.add(name)
        names.append(name)
    width = len(names)
    return names, ((r + [None] * (width - len(r)))[:width] for r in map(list, rows) if any(_filled(c) for c in r[:width]))


def _filled(c: str | None) -> bool:
    return c is not None and c.strip() != ""


def text(v) -> str | None:
    """A cell's value as text: whole numbers without a fraction, booleans in lower case."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return str(v) if isinstance(v, int | float) else json.dumps(v, ensure_ascii=False, default=str)


def _objects(source: str) -> list[dict]:
    start = source.lstrip()[:1]
    return json.loads(source) if start == "[" else [json.loads(line) for line in source.splitlines() if line.strip()]


def _object_rows(objects: list[dict]) -> Iterator[list]:
    names = list(dict.fromkeys(k for o in objects for k in o))
    yield names
    for o in objects:
        yield [text(o.get(n)) for n in names]


def _parquet_rows(content: bytes) -> Iterator[list]:
    import pyarrow.parquet as pq

    file = pq.ParquetFile(io.BytesIO(content))
    yield list(file.schema_arrow.names)
    for batch in file.iter_batches(4096):
        yield from ([text(v) for v in row] for row in zip(*(c.to_pylist() for c in batch.columns)))


def _members(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
    return [(e.get("name"), targets[e.get(_REL)]) for e in sheets]


def _workbook_rows(content: bytes, sheet: str) -> Iterator[list]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        target = dict(_members(z))[sheet]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                for _, e in ElementTree.iterparse(part):
                    if e.tag.endswith("}si"):
                        shared.append(_said(e))
                        e.clear()
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, e in ElementTree.iterparse(part):
                if e.tag.endswith("}row"):
                    yield _row(e, shared)
                    e.clear()


def _said(e: ElementTree.Element) -> str:
    """The text of a string item without its phonetic runs."""
    if e.tag.endswith("}rPh"):
        return ""
    return (e.text or "" if e.tag.endswith("}t") else "") + "".join(map(_said, e))


def _row(row: ElementTree.Element, shared: list[str]) -> list:
    out: list = []
    for c in row:
        at = len(out)
        m = _COLUMN.match(c.get("r") or "")
        if m:
            at = 0
            for letter in m[0]:
                at = at * 26 + ord(letter) - 64
            at -= 1
        out += [None] * (at - len(out))
        kind, v = c.get("t", "n"), next((x.text for x in c if x.tag.endswith("}v")), None)
        if kind == "inlineStr":
            out.append("".join(map(_said, c)))
        elif v is None or kind == "e":
            out.append(None)
        elif kind == "s":
            out.append(shared[int(v)])
        elif kind == "b":
            out.append("true" if v == "1" else "false")
        else:
            out.append(v if kind in ("str", "d") else text(float(v)))
    return out
