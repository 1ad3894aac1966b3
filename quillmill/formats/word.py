"""Word documents: paragraphs as records, then Markdown lines from them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from .errors import reject
from .grid import table
from .package import Package

PART = "word/document.xml"


@dataclass(frozen=True)
class Links:
    """What a document refers to: external targets by relationship, images by relationship, list formats."""

    external: dict[str, str]
    images: dict[str, str]
    formats: dict[tuple[str, int], str]


def links_of(package: Package) -> Links:
    relations = package.relations(PART)
    external = {k: r["target"] for k, r in relations.items() if r["mode"] == "External"}
    images = {k: r["target"] for k, r in relations.items() if "/image" in r["type"] and r["mode"] != "External"}
    return Links(external, images, list_formats(package))


def list_formats(package: Package) -> dict[tuple[str, int], str]:
    """(numId, level) to the level's number format, through the abstract definition that the number names."""
    root = package.xml("word/numbering.xml")
    if root is None:
        return {}
    levels: dict[str, dict[int, str]] = {}
    for abstract in root.iter("abstractNum"):
        own = levels.setdefault(abstract.get("abstractNumId", ""), {})
        for level in abstract.iter("lvl"):
            form = level.find("numFmt")
            if form is not None:
                own[_number(level.get("ilvl"))] = form.get("val", "")
    out = {}
    for number in root.iter("num"):
        target = number.find("abstractNumId")
        for level, form in levels.get(target.get("val", "") if target is not None else "", {}).items():
            out[(number.get("numId", ""), level)] = form
    return out


def _number(text: str | None) -> int:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else 0


def style_heading(style: str) -> int:
    """The heading level that a style's name means, 0 for none."""
    name = style.lower().replace(" ", "")
    if name in ("title", "subtitle"):
        return 1 if name == "title" else 2
    found = re.fullmatch(r"(?:heading|titre)([1-6])", name)
    return int(found.group(1)) if found else 0


def style_list(style: str) -> str:
    """bullet, number or ''."""
    name = style.lower().replace(" ", "")
    if name.startswith(("listnumber", "numberlist")):
        return "number"
    return "bullet" if name in ("listparagraph", "ipl") or name.startswith(("listbullet", "bulletlist")) else ""


def _on(properties, name: str) -> bool:
    found = None if properties is None else properties.find(name)
    return found is not None and found.get("val", "true").lower() not in ("false", "0", "none", "off")


def marked(pieces: list[tuple[str, tuple[bool, bool, bool]]]) -> str:
    """(text, (bold, italic, strike)) runs as Markdown; neighbours alike share their marks, blanks stay outside them."""
    joined: list[list] = []
    for text, marks in pieces:
        if joined and joined[-1][1] == marks:
            joined[-1][0] += text
        else:
            joined.append([text, marks])
    out = []
    for text, (bold, italic, strike) in joined:
        mark = "***" if bold and italic else "**" if bold else "*" if italic else ""
        core = text.strip(" ")
        if not core or not (mark or strike):
            out.append(text)
            continue
        left, right = text[: len(text) - len(text.lstrip(" "))], text[len(text.rstrip(" ")) :]
        core = f"~~{core}~~" if strike else core
        out.append(f"{left}{mark}{core}{mark}{right}")
    return "".join(out)


class WordReader:
    def __init__(self, links: Links, assets: dict[str, str] | None = None):
        self.links, self.assets = links, assets or {}
        self.counters: Counter = Counter()

    def blocks(self, parent) -> list[str]:
        out = []
        for child in parent:
            if child.tag == "p":
                out.append(self.paragraph(child))
            elif child.tag == "tbl":
                out.append(table([[self.cell(c) for c in row.findall("tc")] for row in child.findall("tr")], newline=" ") + "\n")
            elif child.tag in ("sdt", "sdtContent", "ins", "smartTag", "customXml"):
                out += self.blocks(child)
        return out

    def cell(self, cell) -> str:
        texts = []
        for child in cell.iter("p"):
            texts.append(self.inline(child).strip())
        return " ".join(t for t in texts if t)

    def inline(self, parent) -> str:
        out: list[str] = []
        pieces: list[tuple[str, tuple[bool, bool, bool]]] = []

        def flush() -> None:
            out.append(marked(pieces))
            pieces.clear()

        for child in parent:
            if child.tag == "r":
                properties = child.find("rPr")
                marks = (_on(properties, "b"), _on(properties, "i"), _on(properties, "strike"))
                for part in child:
                    if part.tag == "t":
                        pieces.append((part.text or "", marks))
                    elif part.tag == "tab":
                        pieces.append(("\t", marks))
                    elif part.tag in ("br", "cr"):
                        flush()
                        out.append("\n\n---\n\n" if part.get("type") == "page" else "  \n")
                    elif part.tag in ("drawing", "pict", "object"):
                        flush()
                        out += self.images(part)
            elif child.tag == "hyperlink":
                flush()
                text, target = self.inline(child), self.links.external.get(child.get("id", ""), "")
                out.append(f"[{text}]({target})" if target and text else text)
            elif child.tag in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "customXml"):
                flush()
                out.append(self.inline(child))
        flush()
        return "".join(out)

    def images(self, part) -> list[str]:
        found = [e.get("embed") or e.get("id") or "" for e in part.iter() if e.tag in ("blip", "imagedata")]
        paths = [self.assets.get(k, self.links.images.get(k, "")) for k in found]
        return [f"![]({p})" for p in paths if p]

    def paragraph(self, paragraph) -> str:
        properties = paragraph.find("pPr")

        def value(path: str) -> str:
            found = None if properties is None else properties.find(path)
            return "" if found is None else found.get("val", "")

        style = value("pStyle")
        level = style_heading(style)
        outline = value("outlineLvl")
        if not level and outline.isdigit() and int(outline) <= 5:
            level = int(outline) + 1
        text = self.inline(paragraph)
        if not text.strip():
            return ""
        if level:
            return "#" * level + " " + text.strip() + "\n\n"
        return self.marker(value("numPr/numId"), _number(value("numPr/ilvl")), style) + text + "\n\n"

    def marker(self, number: str, level: int, style: str) -> str:
        """A list item's indent and bullet or running number; counters never start again."""
        if number and number != "0":
            kind = "bullet" if self.links.formats.get((number, level), "decimal") in ("bullet", "none") else "number"
        else:
            kind, number = style_list(style) if number != "0" else "", "style"
        if not kind:
            return ""
        if kind == "bullet":
            return "  " * level + "- "
        self.counters[number, level] += 1
        return "  " * level + f"{self.counters[number, level]}. "


def finished(markdown: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", markdown).strip() + "\n"


def word_to_markdown(data: bytes, name: str = "", with_assets: bool = False) -> str:
    """``with_assets`` refers to images as they lie in the asset folder <name>_assets."""
    package = Package(data)
    root = package.xml(PART)
    body = None if root is None else root.find("body")
    if body is None:
        reject("word_without_document")
    links = links_of(package)
    places = {k: f"{name}_assets/{p.rpartition('/')[2]}" for k, p in links.images.items()} if with_assets else {}
    return finished("".join(WordReader(links, places).blocks(body)))


def word_assets(data: bytes, name: str = "") -> list[tuple[str, bytes]]:
    """The images that a document refers to: (path, bytes)."""
    package = Package(data)
    found = ((f"{name}_assets/{p.rpartition('/')[2]}", package.read(p)) for p in links_of(package).images.values())
    return [(path, content) for path, content in found if content is not None]
