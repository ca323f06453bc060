"""Glossary workbooks, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def rows_of(content: bytes) -> list[tuple[int, str | None, str | None, str | None]]:
    """(row, term, target, notes) of the sheet named glossary, else the first; the header must fill A and B."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name") or "", links[s.get(_R)]) for s in book.iter(f"{_M}sheet")]
    target = next((t for n, t in sheets if n.lower() == "glossary"), sheets[0][1])
    shared = [_text(s) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in archive.namelist() else []
    out = []
    for row in ElementTree.fromstring(archive.read("xl/" + target.removeprefix("/xl/"))).iter(f"{_M}row"):
        cells: dict[str, str | None] = {}
        for c in row.iter(f"{_M}c"):
            value = c.find(f"{_M}v")
            text = _text(c) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
            cells[re.match("[A-Z]+", c.get("r"))[0]] = (text or "").strip() or None
        out.append((int(row.get("r")), cells.get("A"), cells.get("B"), cells.get("C")))
    if not out or not (out[0][1] and out[0][2]):
        raise ValueError("the header needs the columns A and B")
    return [r for r in out[1:] if r[1]]


ENTRIES = "path string, row int, term_en string, term_vi string, notes string, error string"


def entry_rows(path: str, content: bytes) -> list[tuple]:
    """Rows of ENTRIES; a file that can't be read is one row with its error."""
    try:
        return [(path, *r, None) for r in rows_of(content)]
    except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [(path, None, None, None, None, str(e))]


def read_glossary(files: DataFrame) -> DataFrame:
    """(path, content) to (path, row, term_en, term_vi, notes, error)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                yield pd.DataFrame(entry_rows(path, content), columns=[c.split()[0] for c in ENTRIES.split(", ")]).astype({"row": "Int32"})

    return files.select("path", "content").mapInPandas(run, ENTRIES)


def write_glossary(rows: list[tuple[str, str | None, str | None]]) -> bytes:
    """A workbook of (term, target, notes), for one file of bounded size."""
    from html import escape

    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{escape(v or "")}</t></is></c>'
    lines = [("term_en", "term_vi", "notes"), *rows]
    body = "".join(f'<row r="{i}">' + "".join(cell(f"{c}{i}", v) for c, v in zip("ABC", r)) + "</row>" for i, r in enumerate(lines, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_M[1:-1]}" xmlns:r="{_R[1:-3]}"><sheets><sheet name="Glossary" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_M[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
