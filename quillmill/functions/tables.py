"""Markdown tables from arrays of rows, in the manners of the different formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableStyle:
    """How a format writes its tables.

    ``newline`` is what a line break in a cell becomes (None: stays); ``after_header`` is put between header and body;
    ``escape`` puts a backslash before pipes; ``trim`` trims cells.
    """

    newline: str | None = None
    escape: bool = True
    trim: bool = False
    ending: str = "\n"


CSV = TableStyle(newline="<br>")
SHEET = TableStyle(newline=" ", ending="\n\n")
OFFICE = TableStyle(ending="\n\n")
OPEN_DOCUMENT = TableStyle()
WEB = TableStyle()
SCAN = TableStyle(newline=" ", trim=True)


def cell(value: Column, style: TableStyle) -> Column:
    out = F.coalesce(value, F.lit(""))
    if style.trim:
        out = F.trim(out)
    if style.escape:
        out = F.replace(out, F.lit("|"), F.lit("\\|"))
    if style.newline is not None:
        out = F.replace(out, F.lit("\n"), F.lit(style.newline))
    return out


def width(rows: Column) -> Column:
    """The cells of the longest row."""
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not anew for each element that ``body`` looks at."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def padded(rows: Column) -> Column:
    """Every row with as many cells as the longest."""
    both = F.struct(rows.alias("rows"), width(rows).alias("n"))
    return _with(both, lambda x: F.transform(x["rows"], lambda r: F.concat(r, F.array_repeat(F.lit(""), x["n"] - F.size(r)))))


def _line(row: Column, style: TableStyle) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda v: cell(v, style)), " | "), F.lit(" |"))


def markdown_table(rows: Column, style: TableStyle = CSV, header: Column | None = None) -> Column:
    """``rows`` (array<array<string>>) as a table, its first row as header; '' without cells.

    ``header`` false puts an empty header above all rows.
    """
    full = padded(rows)
    n = width(rows)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n))
    if header is not None:
        blank = F.array(F.array_repeat(F.lit(""), n))
        full = F.when(header, full).otherwise(F.concat(blank, full))
    lines = F.transform(full, lambda r: _line(r, style))
    whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(whole, F.lit(style.ending))).otherwise(F.lit(""))


def dense_row(cells: Column, columns: Column) -> Column:
    """An array of (col, value) structs as ``columns`` values, gaps filled with ''."""

    def at(k: Column) -> Column:
        return F.coalesce(F.get(F.filter(cells, lambda c: c["col"] == k), F.lit(0))["value"], F.lit(""))

    none = F.array().cast("array<string>")
    return F.when(columns > 0, F.transform(F.sequence(F.lit(0), columns - 1), at)).otherwise(none)


def property_table(pairs: Column) -> Column:
    """(property, value) structs as a two-column table; pipes are escaped in values."""
    lines = F.transform(pairs, lambda p: F.concat(F.lit("| "), p["property"], F.lit(" | "), F.replace(p["value"], F.lit("|"), F.lit("\\|")), F.lit(" |")))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("| Property | Value |\n| --- | --- |\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
