"""Text, CSV, JSON, XML and notebooks."""

from __future__ import annotations

import csv
import io
import json
import re
from xml.dom import minidom
from xml.parsers.expat import ExpatError

from . import encodings
from .errors import reject
from .grid import table

_BLANKS = re.compile("[\\t\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+(?=\\n|\\Z)")


def unix(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def clean_whitespace(text: str) -> str:
    """Lines right-trimmed, at most two blank lines in a row."""
    out, blank = [], 0
    for line in _BLANKS.sub("", text).split("\n"):
        blank = 0 if line else blank + 1
        if blank <= 2:
            out.append(line)
    return "\n".join(out)


def text_to_markdown(data: bytes, kind: str = "txt") -> str:
    if not data:
        reject("empty_input")
    text = unix(encodings.text_file(data))
    if kind not in ("md", "markdown"):
        text = clean_whitespace(text)
    return text if text.endswith("\n") else text + "\n"


def delimiter(text: str) -> str:
    """A semicolon if more of them than commas stand outside quotes, else a comma."""
    bare = re.sub(r'"[^"]*(?:"|\Z)', "", text)
    return ";" if bare.count(";") > bare.count(",") else ","


def csv_rows(text: str, by: str) -> list[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return [row for row in csv.reader(io.StringIO(unix(text), newline=""), delimiter=by) if row]


def csv_to_markdown(data: bytes, name: str = "", kind: str = "csv") -> str:
    text = encodings.plain(data)
    if not text.strip():
        reject("empty_input")
    rows = csv_rows(text, "\t" if kind == "tsv" else delimiter(text))
    if not rows:
        reject("empty_input")
    return f"# {name}\n\n" + table(rows, newline="<br>")


def _fenced(name: str, kind: str, text: str) -> str:
    return f"# {name}\n\n```{kind}\n{text}{'' if text.endswith(chr(10)) else chr(10)}```\n"


def json_to_markdown(data: bytes, name: str = "") -> str:
    """Keys sorted by code point, two blanks of indent; what can't be read stays as it is."""
    if not data:
        reject("empty_input")
    raw = encodings.plain(data)
    try:
        return _fenced(name, "json", json.dumps(json.loads(raw), indent=2, sort_keys=True, ensure_ascii=False))
    except (ValueError, RecursionError):
        return _fenced(name, "json", raw)


def xml_to_markdown(data: bytes, name: str = "") -> str:
    """Indented by two blanks; what can't be read stays as it is."""
    if not data:
        reject("empty_input")
    try:
        if re.search(rb"<!ENTITY", data):
            raise ValueError("entities aren't expanded")
        shown = minidom.parseString(data).toprettyxml(indent="  ")
        return _fenced(name, "xml", "\n".join(line for line in shown.split("\n") if line.strip()))
    except (ExpatError, ValueError, RecursionError, LookupError):
        return _fenced(name, "xml", encodings.plain(data))


def notebook_to_markdown(data: bytes, name: str = "") -> str:
    """Markdown cells as they are, code cells fenced in the notebook's language, raw cells as text; outputs are left out."""
    try:
        book = json.loads(encodings.plain(data))
    except (ValueError, RecursionError):
        book = None
    cells = book.get("cells") if isinstance(book, dict) else None
    if not isinstance(cells, list) or not all(isinstance(c, dict) for c in cells):
        reject("notebook_without_cells")
    kernel = (book.get("metadata") or {}).get("kernelspec") if isinstance(book.get("metadata"), dict) else None
    language = kernel.get("language") if isinstance(kernel, dict) else None
    language = language if isinstance(language, str) else "python"
    out = f"# {name}\n\n"
    for c in cells:
        source = c.get("source")
        if isinstance(source, list):
            source = "".join(source) if all(isinstance(s, str) for s in source) else ""
        if not isinstance(source, str) or not source.strip():
            continue
        kind = c.get("cell_type", "raw")
        if kind == "markdown":
            out += source
            out += "" if out.endswith("\n\n") else "\n" if out.endswith("\n") else "\n\n"
        elif kind == "code":
            out += f"```{language}\n{source}\n```\n\n"
        elif kind == "raw":
            out += source + "\n\n"
    return out
