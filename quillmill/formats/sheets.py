"""Workbooks: sheets as tables. Cells are also given in long form, for work with rows and columns."""

from __future__ import annotations

import re
from functools import lru_cache

from .errors import reject
from .grid import table
from .package import Package, text_of

BOOK = "xl/workbook.xml"


def column_index(reference: str) -> int:
    """The column of a cell reference, from 0; -1 without letters."""
    return _letters_index(reference.rstrip("0123456789"))


@lru_cache(1 << 14)
def _letters_index(start: str) -> int:
    out = 0
    for letter in re.match("[A-Za-z]*", start).group().upper():
        out = out * 26 + ord(letter) - 64
    return out - 1


def column_letters(index: int) -> str:
    out = ""
    while index >= 0:
        out = chr(65 + index % 26) + out
        index = index // 26 - 1
    return out


def _shared(package: Package) -> list[str]:
    root = package.xml("xl/sharedStrings.xml")
    if root is None:
        return []
    return ["".join(t.text or "" for t in item.iter("t")) for item in root.findall("si")]


def _value(cell, shared: list[str]) -> str:
    kind, raw = cell.get("t", "n"), text_of(cell.find("v"))
    if kind == "s":
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else raw
    if kind == "inlineStr":
        found = cell.find("is")
        return "" if found is None else "".join(t.text or "" for t in found.iter("t"))
    if kind == "b":
        return "TRUE" if raw.strip() == "1" else "FALSE"
    return raw


def sheet_rows(root, shared: list[str]) -> list[list[str]]:
    """Rows of text, columns filled up from the cells' references, empty rows at the end left out."""
    rows = []
    for row in root.iter("row"):
        cells: dict[int, str] = {}
        last = -1
        for cell in row:
            if cell.tag != "c":
                continue
            at = column_index(cell.get("r", ""))
            at = at if at >= 0 else last + 1
            cells[at], last = _value(cell, shared), max(at, last)
        rows.append([cells.get(k, "") for k in range(last + 1)])
    while rows and not any(v.strip() for v in rows[-1]):
        rows.pop()
    return rows


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet in the workbook's order; sheets without a part are left out."""
    package = Package(data)
    book = package.xml(BOOK)
    if book is None:
        reject("no_sheets")
    relations, shared = package.relations(BOOK), _shared(package)
    out = []
    for sheet in book.iter("sheet"):
        target = relations.get(sheet.get("id", ""), {}).get("target", "")
        root = package.xml(target) if target else None
        if root is not None:
            out.append((sheet.get("name", ""), sheet_rows(root, shared)))
    if not out:
        reject("no_sheets")
    return out


def sheet_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of each filled cell."""
    return [(s, r, c, v) for s, rows in sheets(data) for r, row in enumerate(rows) for c, v in enumerate(row) if v]


def sheets_to_markdown(data: bytes) -> str:
    out = ""
    for k, (name, rows) in enumerate(sheets(data)):
        out += ("\n---\n\n" if k else "") + f"## {name}\n\n" + table(rows, newline=" ", ending="\n\n")
    return out.strip() + "\n"
