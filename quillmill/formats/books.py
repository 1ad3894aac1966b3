"""Electronic books: EPUB packages, and MOBI files with their records."""

from __future__ import annotations

import posixpath
import re
import struct
from dataclasses import dataclass
from urllib.parse import unquote

from . import encodings
from .errors import reject
from .html import bytes_to_markdown, html_to_markdown
from .package import Package, text_of

PAGES = ("application/xhtml+xml", "text/html", "application/html")


@dataclass(frozen=True)
class Chapter:
    id: str
    href: str
    title: str | None
    markdown: str


@dataclass(frozen=True)
class Book:
    title: str
    authors: tuple[str, ...]
    language: str | None
    chapters: tuple[Chapter, ...]


def title_in(html: str) -> str | None:
    for tag in ("h1", "h2", "h3", "title"):
        found = re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", html, re.IGNORECASE | re.DOTALL)
        text = re.sub("<[^>]+>", "", found.group(1)).strip() if found else ""
        if text:
            return text
    return None


def read_book(data: bytes, name: str = "") -> Book:
    """Chapters in spine order; parts that aren't linear, aren't pages or don't exist are left out."""
    package = Package(data)
    container = package.xml("META-INF/container.xml")
    root = None if container is None else next(container.iter("rootfile"), None)
    path = "" if root is None else root.get("full-path", "")
    book = package.xml(path) if path else None
    if book is None:
        reject("book_without_package")
    folder = posixpath.dirname(path)
    title = next((t for t in (text_of(e).strip() for e in book.iter("title")) if t), name)
    authors = tuple(t for t in (text_of(e).strip() for e in book.iter("creator")) if t)
    language = next((t for t in (text_of(e).strip() for e in book.iter("language")) if t), None)
    parts = {item.get("id", ""): item for item in book.iter("item")}
    chapters = []
    for reference in book.iter("itemref"):
        item = parts.get(reference.get("idref", ""))
        if item is None or reference.get("linear") == "no" or item.get("media-type") not in PAGES:
            continue
        href = unquote(item.get("href", ""))
        content = package.read(posixpath.normpath(posixpath.join(folder, href)))
        if content is not None:
            text = encodings.page(content)
            chapters.append(Chapter(item.get("id", ""), href, title_in(text), html_to_markdown(text)))
    if not chapters:
        reject("book_without_chapters")
    return Book(title, authors, language, tuple(chapters))


#: Labels of the front matter and the index.
AUTHOR_LABEL, LANGUAGE_LABEL, INDEX_LABEL = "**作者：** ", "**语言：** ", "## 目录"


def front_matter(book: Book) -> str:
    out = f"# {book.title}\n\n"
    if book.authors:
        out += AUTHOR_LABEL + ", ".join(book.authors) + "\n\n"
    if book.language:
        out += LANGUAGE_LABEL + book.language + "\n\n"
    return out


def _ended(text: str) -> str:
    return text if text.endswith("\n") else text + "\n"


def combined(book: Book) -> str:
    """The whole book as one text."""
    parts = [_ended((f"## {c.title}\n\n" if c.title else "") + c.markdown) for c in book.chapters]
    return front_matter(book) + "---\n\n" + "\n---\n\n".join(parts)


def chapter_files(book: Book) -> list[tuple[str, str]]:
    """(path, text) of a folder with an index and a file for each chapter."""
    folder = book.title.replace("/", "_")
    index = front_matter(book) + INDEX_LABEL + "\n\n"
    files = []
    for k, c in enumerate(book.chapters, 1):
        safe = (c.title or f"chapter_{k:02d}").replace("/", "_").replace(":", "_")[:60]
        file = f"{k:02d}_{safe}.md"
        files.append((f"{folder}/{file}", _ended((f"# {c.title}\n\n" if c.title else "") + c.markdown)))
        index += f"- [{c.title or f'Chapter {k}'}]({file})\n"
    return [(f"{folder}/index.md", index), *files]


def epub_to_markdown(data: bytes, name: str = "") -> str:
    return combined(read_book(data, name))


# MOBI

def palm_unpacked(data: bytes) -> bytes:
    """PalmDoc compression: literals, runs of literals, references back, and a blank with a letter."""
    out = bytearray()
    at = 0
    while at < len(data):
        byte = data[at]
        at += 1
        if byte == 0 or 0x09 <= byte < 0x80:
            out.append(byte)
        elif byte < 0x09:
            out += data[at : at + byte]
            at += byte
        elif byte >= 0xC0:
            out += bytes((0x20, byte ^ 0x80))
        else:
            if at >= len(data):
                break
            pair = (byte << 8 | data[at]) & 0x3FFF
            at += 1
            distance, length = pair >> 3, (pair & 7) + 3
            if not 0 < distance <= len(out):
                break
            for _ in range(length):
                out.append(out[-distance])
    return bytes(out)


@dataclass(frozen=True)
class _Section:
    """One text of a MOBI file: where its header record is, and what the header says."""

    first: int
    compression: int
    texts: int
    encryption: int
    charset: int
    trailing: int
    tags: dict[int, bytes]


class MobiFile:
    def __init__(self, data: bytes):
        if len(data) < 78:
            reject("mobi_too_small")
        count = struct.unpack_from(">H", data, 76)[0]
        if count == 0 or len(data) < 78 + 8 * count:
            reject("mobi_too_small")
        starts = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(count)] + [len(data)]
        self.records = [data[a:b] if a <= b else b"" for a, b in zip(starts, starts[1:], strict=False)]
        self.main = self._section(0)

    def _section(self, first: int) -> _Section | None:
        head = self.records[first] if 0 <= first < len(self.records) else b""
        if len(head) < 16:
            return None
        compression, _, _, texts, _, encryption, _ = struct.unpack_from(">HHIHHHH", head)
        charset, trailing, tags = 1252, 0, {}
        if head[16:20] == b"MOBI" and len(head) >= 132:
            length, _, charset = struct.unpack_from(">III", head, 20)
            if length >= 228 and len(head) >= 244:
                trailing = struct.unpack_from(">H", head, 242)[0]
            if struct.unpack_from(">I", head, 128)[0] & 0x40:
                tags = self._tags(head[16 + length :])
        return _Section(first, compression, texts, encryption, charset, trailing, tags)

    @staticmethod
    def _tags(block: bytes) -> dict[int, bytes]:
        out: dict[int, bytes] = {}
        if block[:4] != b"EXTH" or len(block) < 12:
            return out
        at = 12
        for _ in range(struct.unpack_from(">I", block, 8)[0]):
            if at + 8 > len(block):
                break
            tag, size = struct.unpack_from(">II", block, at)
            if size < 8:
                break
            out[tag] = block[at + 8 : at + size]
            at += size
        return out

    def later(self) -> _Section | None:
        """The section behind the boundary that tag 121 names, if there is one."""
        tag = self.main.tags.get(121, b"") if self.main else b""
        first = int.from_bytes(tag, "big") if len(tag) == 4 else 0xFFFFFFFF
        return self._section(first) if first < len(self.records) else None

    def _content(self, record: bytes, trailing: int) -> bytes:
        for bit in range(15, 0, -1):
            if trailing >> bit & 1 and record:
                size, shift = 0, 0
                for byte in reversed(record[-4:]):
                    size |= (byte & 0x7F) << shift
                    shift += 7
                    if byte & 0x80:
                        break
                record = record[: max(0, len(record) - size)]
        if trailing & 1 and record:
            record = record[: max(0, len(record) - (record[-1] & 3) - 1)]
        return record

    def text(self, section: _Section) -> bytes:
        parts = []
        for record in self.records[section.first + 1 : section.first + 1 + section.texts]:
            body = self._content(record, section.trailing)
            parts.append(palm_unpacked(body) if section.compression == 2 else body)
        return b"".join(parts)


def mobi_to_markdown(data: bytes) -> str:
    """The later section if it can be read, else the main one."""
    file = MobiFile(data)
    if file.main is None:
        reject("mobi_too_small")
    if file.main.encryption or any(tag in file.main.tags for tag in (401, 402, 403, 404)):
        reject("mobi_protected")
    for section in (file.later(), file.main):
        if section is None or section.encryption or section.compression not in (1, 2):
            continue
        raw = file.text(section)
        if section.charset == 65001:
            text = html_to_markdown(encodings.plain(raw))
        elif section.charset == 1252:
            text = html_to_markdown(raw.decode("cp1252", "replace"))
        else:
            text = bytes_to_markdown(raw)
        if text.strip():
            return text
    reject("mobi_compression" if file.main.compression not in (1, 2) else "mobi_empty")
