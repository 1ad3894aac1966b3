"""Presentations: a section for each slide, in the order of the slides' numbers."""

from __future__ import annotations

import re

from .errors import reject
from .grid import table
from .package import Package
from .word import finished


def _run(run) -> str:
    text = "".join(t.text or "" for t in run.findall("t"))
    properties = run.find("rPr")
    bold, italic = ((properties is not None and properties.get(k) in ("1", "true")) for k in ("b", "i"))
    mark = "***" if bold and italic else "**" if bold else "*" if italic else ""
    return f"{mark}{text}{mark}" if text.strip() else text


def _paragraph(paragraph) -> str:
    out = []
    for child in paragraph:
        if child.tag in ("r", "fld"):
            out.append(_run(child))
        elif child.tag == "br":
            out.append("  \n")
    return "".join(out)


def slide_blocks(root) -> list[str]:
    """The slide's paragraphs and tables in order."""
    out = []
    todo = [root]
    while todo:
        element = todo.pop()
        if element.tag == "tbl":
            rows = [["".join(_paragraph(p) for p in c.iter("p")).strip() for c in r.findall("tc")] for r in element.findall("tr")]
            out.append(table(rows, newline=" ").rstrip("\n"))
        elif element.tag == "p" and any(c.tag in ("r", "fld", "br") for c in element):
            out.append(_paragraph(element).strip())
        else:
            todo.extend(reversed(element))
    return [b for b in out if b]


def slides_to_markdown(data: bytes) -> str:
    """``## Slide n`` counts the files in order; empty slides are left out."""
    package = Package(data)
    numbered = [(int(m.group(1)), n) for n in package.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
    if not numbered:
        reject("no_slides")
    sections = []
    for k, (_, name) in enumerate(sorted(numbered), 1):
        blocks = slide_blocks(package.xml(name))
        if blocks:
            sections.append(f"## Slide {k}\n\n" + "\n\n".join(blocks))
    return finished("\n\n---\n\n".join(sections))
