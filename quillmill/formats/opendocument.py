"""OpenDocument texts: headings, paragraphs, spans by style, lists and tables."""

from __future__ import annotations

from .errors import reject
from .grid import table
from .package import Package
from .word import finished, marked


def _styles(*roots) -> dict[str, tuple[bool, bool]]:
    """Style name to (bold, italic); later roots win."""
    out = {}
    for root in roots:
        for style in root.iter("style") if root is not None else ():
            properties = style.find("text-properties")
            if properties is not None:
                out[style.get("name", "")] = (properties.get("font-weight") == "bold", properties.get("font-style") in ("italic", "oblique"))
    return out


class OpenReader:
    def __init__(self, styles: dict[str, tuple[bool, bool]]):
        self.styles = styles

    def inline(self, element, bold: bool = False, italic: bool = False) -> list[tuple[str, tuple[bool, bool, bool]]]:
        marks = (bold, italic, False)
        out = [(element.text or "", marks)]
        for child in element:
            if child.tag == "span":
                b, i = self.styles.get(child.get("style-name", ""), (False, False))
                out += self.inline(child, bold or b, italic or i)
            elif child.tag == "a":
                text, target = marked(self.inline(child)), child.get("href", "")
                out.append((f"[{text}]({target})" if target else text, (False, False, False)))
            elif child.tag == "line-break":
                out.append(("  \n", (False, False, False)))
            elif child.tag == "tab":
                out.append(("\t", marks))
            elif child.tag == "s":
                count = child.get("c", "1")
                out.append((" " * (int(count) if count.isdigit() else 1), marks))
            elif child.tag not in ("annotation", "note", "frame"):
                out += self.inline(child, bold, italic)
            out.append((child.tail or "", marks))
        return out

    def text(self, element) -> str:
        return marked(self.inline(element)).strip(" ")

    def blocks(self, parent, depth: int = 0) -> list[str]:
        out = []
        for child in parent:
            if child.tag == "h":
                level = child.get("outline-level", "1")
                level = min(6, max(1, int(level) if level.isdigit() else 1))
                if text := self.text(child):
                    out.append("#" * level + f" {text}\n\n")
            elif child.tag == "p":
                if text := self.text(child):
                    out.append(text + "\n\n")
            elif child.tag == "list":
                out.append(self.items(child) + ("\n" if depth == 0 else ""))
            elif child.tag == "table":
                rows = [[self.cell(c) for c in r if c.tag in ("table-cell", "covered-table-cell")] for r in child.iter("table-row")]
                out.append(table(rows, newline=" ") + "\n")
            elif child.tag in ("section", "text", "index-body", "table-of-content", "soft-page-break"):
                out += self.blocks(child, depth)
        return out

    def items(self, parent) -> str:
        """Items one a line; nested lists come out flat, numbered where the style's name says so."""
        numbered = "number" in parent.get("style-name", "").lower()
        out, k = [], 0
        for item in parent:
            if item.tag not in ("list-item", "list-header"):
                continue
            k += 1
            texts = [self.text(p) for p in item if p.tag in ("p", "h")]
            text = " ".join(t for t in texts if t)
            if text:
                out.append((f"{k}. " if numbered else "- ") + text + "\n")
            out += [self.items(nested) for nested in item if nested.tag == "list"]
        return "".join(out)

    def cell(self, cell) -> str:
        return " ".join(t for t in (self.text(p) for p in cell.iter("p")) if t)


def open_to_markdown(data: bytes) -> str:
    package = Package(data)
    content = package.xml("content.xml")
    body = None if content is None else content.find("body")
    if body is None:
        reject("open_without_content")
    return finished("".join(OpenReader(_styles(content, package.xml("styles.xml"))).blocks(_text_body(body))))


def _text_body(body):
    found = body.find("text")
    return body if found is None else found
