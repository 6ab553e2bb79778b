"""Cells of the first sheet of an xlsx file, row by row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t"))


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(LINK))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_rows(content: bytes) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, {column number: text}) of non-empty rows, both from 1.
    The sheet is parsed as a stream; only its shared texts are held."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        table = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = [_text(item) for item in table.iter(f"{MAIN}si")]
    row_number = 0
    with book.open(_first_sheet(book)) as sheet:
        rows = None
        for event, row in ElementTree.iterparse(sheet, ("start", "end")):
            if event == "start":
                rows = row if row.tag == f"{MAIN}sheetData" else rows
                continue
            if row.tag != f"{MAIN}row":
                continue
            row_number = int(row.get("r") or row_number + 1)
            cells: dict[int, str] = {}
            column = 0
            for cell in row.iter(f"{MAIN}c"):
                column = _column(cell.get("r") or "") or column + 1
                kind = cell.get("t")
                value = _text(cell) if kind == "inlineStr" else cell.findtext(f"{MAIN}v")
                if value is None or kind == "e":
                    continue
                cells[column] = shared[int(value)] if kind == "s" else value
            rows.clear()  # the rows read so far, which would stay under their parent
            if cells:
                yield row_number, cells
