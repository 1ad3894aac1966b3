"""HTML to Markdown: a scanner that makes tokens, and a writer that takes what it finds.

The writer keeps a stack of open inline buffers (the block, links, a table cell), so that markers, text and images
always go to the innermost one. Nested lists come out flat and boilerplate stays, as the rules ask.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .encodings import page

#: Elements without content, and the named references that are known.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REFERENCES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•",
    "middot": "·",
}

_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,8})|#([0-9]{1,9})|([A-Za-z][A-Za-z0-9]{0,9}));")
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*+)([^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+)>""")
_RAW_ENDS = {tag: re.compile(rf"</{tag}[^>]*>", re.IGNORECASE) for tag in ("script", "style")}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile("[ \n\t\r]+")
_BLANK_LINES = re.compile(r"\n{3,}")


@dataclass(frozen=True)
class Token:
    """kind: text, start, end, comment or declaration."""

    kind: str
    name: str = ""
    text: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    closed: bool = False


def decode_references(text: str) -> str:
    """Numeric and known named character references; others stay."""

    def one(match: re.Match) -> str:
        hexadecimal, decimal, name = match.groups()
        if name:
            return REFERENCES.get(name, match.group())
        code = int(hexadecimal, 16) if hexadecimal else int(decimal)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else match.group()

    return _REFERENCE.sub(one, text) if "&" in text else text


def _attributes(inside: str) -> dict[str, str]:
    return {name.lower(): decode_references(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(inside)}


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) of the page's tokens; the text of a start tag is what stands in it, undecoded. An unterminated
    comment, declaration or instruction ends them."""
    at, size = 0, len(html)
    while at < size:
        low = html.find("<", at)
        if low < 0:
            low = size
        if low > at:
            yield "text", "", decode_references(html[at:low])
        if low == size:
            return
        found = _TAG.match(html, low)
        if found:
            slash, name, inside = found.groups()
            tag, at = name.lower(), found.end()
            if slash:
                yield "end", tag, ""
                continue
            yield "start", tag, inside
            if tag in _RAW_ENDS:
                end = _RAW_ENDS[tag].search(html, at)
                if not end:
                    return
                at = end.end()
                yield "end", tag, ""
            continue
        special = next((pair for pair in (("<!--", "-->"), ("<!", ">"), ("<?", ">")) if html.startswith(pair[0], low)), None)
        if special:
            end = html.find(special[1], low + len(special[0]))
            if end < 0:
                return
            yield "comment" if special[0] == "<!--" else "declaration", "", html[low + len(special[0]) : end]
            at = end + len(special[1])
            continue
        yield "text", "", "<"
        at = low + 1


def tokens(html: str) -> Iterator[Token]:
    """The page's tokens, with their attributes."""
    for kind, name, text in scan(html):
        if kind == "start":
            yield Token(kind, name, attributes=_attributes(text), closed=text.endswith("/") or name in VOID)
        else:
            yield Token(kind, name, text)


def starts(html: str, *names: str) -> Iterator[tuple[int, str, dict[str, str]]]:
    """(position among the tokens, name, attributes) of start tags, of all names or of some."""
    for k, (kind, name, text) in enumerate(scan(html)):
        if kind == "start" and (not names or name in names):
            yield k, name, _attributes(text)


INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
BREAKS = frozenset(["p", "div", "section", "article", "header", "footer", "main", "nav", "aside"])


@dataclass
class _Table:
    rows: list[list[str]] = field(default_factory=list)
    row: list[str] = field(default_factory=list)
    headed: bool = False


class MarkdownWriter:
    """Takes a page, gives Markdown. ``escape_pipes`` protects pipes in table cells."""

    def __init__(self, escape_pipes: bool = True, keep_indent: bool = False):
        self.escape_pipes, self.keep_indent = escape_pipes, keep_indent
        self.out: list[str] = []
        self.buffers: list[list[str]] = [[]]  # the block, then open links
        self.links: list[str] = []
        self.cell: list[str] | None = None
        self.link_base = 1
        self.table: _Table | None = None
        self.lists: list[list] = []
        self.heading, self.quotes, self.items = 0, 0, 0
        self.open_marks = {"**": 0, "*": 0, "`": 0}
        self.preformatted: list[str] | None = None

    # where inline content goes
    def _put(self, text: str) -> None:
        self.buffers[-1].append(text)

    def _flush(self) -> None:
        if len(self.buffers) > 1 or self.table is not None or not self.buffers[0]:
            return
        raw = "".join(self.buffers[0])
        self.buffers[0] = []
        line = raw.strip(" \t\u00a0\u3000")
        if not line:
            return
        if self.keep_indent and self.items and not self.heading:
            line = raw[: len(raw) - len(raw.lstrip(" "))] + line
        ending = "\n" if self.items and not self.heading else "\n\n"
        self.out.append("> " * self.quotes + line + ending)

    def feed(self, html: str) -> None:
        for kind, name, text in scan(html):
            if kind == "text":
                self._text(text)
            elif kind == "start":
                if opened := _STARTS.get(name):
                    opened(self, name, text)
                if (text.endswith("/") or name in VOID) and name not in ("br", "img", "hr") and (closer := _ENDS.get(name)):
                    closer(self, name)
            elif kind == "end" and (closer := _ENDS.get(name)):
                closer(self, name)

    def _text(self, text: str) -> None:
        if self.preformatted is not None:
            self.preformatted.append(text)
            return
        if self.table is not None and self.cell is None:
            return
        if "  " in text or "\n" in text or "\t" in text or "\r" in text:
            text = _SPACES.sub(" ", text)
        self.buffers[-1].append(text.replace("\\", "\\\\").replace("`", "\\`"))

    def _start_mark(self, name: str, inside: str) -> None:
        if self.preformatted is None:
            self._put(INLINE[name])
            self.open_marks[INLINE[name]] += 1

    def _end_mark(self, name: str) -> None:
        if self.open_marks[INLINE[name]]:
            self._put(INLINE[name])
            self.open_marks[INLINE[name]] -= 1

    def _start_heading(self, name: str, inside: str) -> None:
        self._flush()
        self.heading = HEADINGS[name]
        self._put("#" * self.heading + " ")

    def _end_heading(self, name: str) -> None:
        self._flush()
        self.heading = 0

    def _start_break(self, name: str, inside: str) -> None:
        self._flush()

    def _end_break(self, name: str) -> None:
        self._flush()

    def _start_br(self, name: str, inside: str) -> None:
        self._put(" " if self.table is not None else "\n" if len(self.buffers) > 1 else "  \n")

    def _start_hr(self, name: str, inside: str) -> None:
        self._flush()
        self.out.append("---\n\n")

    def _start_img(self, name: str, inside: str) -> None:
        held = _attributes(inside)
        self._put(f"![{held.get('alt', '')}]({held.get('src', '')})")

    def _start_a(self, name: str, inside: str) -> None:
        self.links.append(_attributes(inside).get("href", ""))
        self.buffers.append([])

    def _end_a(self, name: str = "") -> None:
        if len(self.buffers) > self.link_base:
            text = "".join(self.buffers.pop())
            target = self.links.pop()
            self._put(f"[{text}]({target})" if target else text)

    def _start_pre(self, name: str, inside: str) -> None:
        self._flush()
        self.preformatted = []

    def _end_pre(self, name: str = "") -> None:
        if self.preformatted is not None:
            code = "".join(self.preformatted)
            self.preformatted = None
            self.out.append(f"```\n{code if code.endswith(chr(10)) else code + chr(10)}```\n\n")

    def _start_blockquote(self, name: str, inside: str) -> None:
        self._flush()
        self.quotes += 1

    def _end_blockquote(self, name: str = "") -> None:
        self._flush()
        self.quotes = max(0, self.quotes - 1)

    def _start_ul(self, name: str, inside: str) -> None:
        self._flush()
        self.lists.append(["-", 0])

    def _start_ol(self, name: str, inside: str) -> None:
        self._flush()
        start = _attributes(inside).get("start", "")
        self.lists.append(["1", (int(start) if re.fullmatch(r"[+-]?\d+", start) else 1) - 1])

    def _end_ul(self, name: str = "") -> None:
        self._flush()
        if self.lists:
            self.lists.pop()
        tail = "".join(self.out[-2:])
        if not self.lists and not tail.endswith("\n\n"):
            self.out.append("\n" if tail.endswith("\n") else "\n\n")

    _end_ol = _end_ul

    def _start_li(self, name: str, inside: str) -> None:
        self._flush()
        marker = "- "
        if self.lists:
            self.lists[-1][1] += 1
            if self.lists[-1][0] == "1":
                marker = f"{self.lists[-1][1]}. "
            marker = "  " * (len(self.lists) - 1) + marker
        if len(self.buffers) == 1 and self.table is None:
            self.buffers[0] = [marker]
        self.items += 1

    def _end_li(self, name: str = "") -> None:
        self._flush()
        self.items = max(0, self.items - 1)

    def _start_table(self, name: str, inside: str) -> None:
        self._flush()
        self.table = _Table()

    def _start_thead(self, name: str, inside: str) -> None:
        if self.table is not None:
            self.table.headed = True

    def _start_tr(self, name: str, inside: str) -> None:
        if self.table is not None:
            self.table.row = []

    def _start_td(self, name: str, inside: str) -> None:
        if self.table is not None:
            self._leave_cell()
            self.cell = []
            self.buffers.append(self.cell)
            self.link_base = len(self.buffers)
            if name == "th":
                self.table.headed = True

    _start_th = _start_td

    def _leave_cell(self) -> str:
        """Close the cell's buffer, and links left open in it."""
        if self.cell is None:
            return ""
        while len(self.buffers) > self.link_base:
            self._end_a()
        text = "".join(self.buffers.pop())
        self.cell, self.link_base = None, 1
        return text

    def _end_td(self, name: str = "") -> None:
        if self.table is not None and self.cell is not None:
            text = self._leave_cell().strip(" \t\u00a0\u3000")
            self.table.row.append(text.replace("|", "\\|") if self.escape_pipes else text)

    _end_th = _end_td

    def _end_tr(self, name: str = "") -> None:
        if self.table is not None:
            self._end_td()
            if self.table.row:
                self.table.rows.append(self.table.row)
            self.table.row = []

    def _end_table(self, name: str = "") -> None:
        if self.table is None:
            return
        self._end_tr()
        table, self.table = self.table, None
        wide = max(map(len, table.rows), default=0)
        if not wide:
            return
        rows = [r + [""] * (wide - len(r)) for r in table.rows]
        if not (table.headed and len(rows) > 1):
            rows.insert(0, [""] * wide)
        lines = [f"| {' | '.join(r)} |" for r in rows]
        self.out.append("\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]) + "\n\n")

    def finished(self) -> str:
        self._end_table()
        while len(self.buffers) > 1:
            self._end_a()
        self._flush()
        return _BLANK_LINES.sub("\n\n", "".join(self.out)).strip() + "\n"


def _handlers(kind: str) -> dict[str, Callable]:
    """The writer's methods by element."""
    shared = ((INLINE, "mark"), (HEADINGS, "heading"), (BREAKS, "break"))
    own = ("br", "hr", "img", "a", "pre", "blockquote", "ul", "ol", "li", "table", "thead", "tr", "td", "th")
    out = {name: getattr(MarkdownWriter, f"_{kind}_{name}") for name in own if hasattr(MarkdownWriter, f"_{kind}_{name}")}
    return out | {name: getattr(MarkdownWriter, f"_{kind}_{held}") for names, held in shared for name in names}


_STARTS, _ENDS = _handlers("start"), _handlers("end")


def html_to_markdown(html: str, **options: bool) -> str:
    writer = MarkdownWriter(**options)
    writer.feed(html)
    return writer.finished()


def bytes_to_markdown(data: bytes, **options: bool) -> str:
    return html_to_markdown(page(data), **options)
