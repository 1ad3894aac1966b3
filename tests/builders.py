"""Small documents of every kind, built from nothing but the standard library."""

from __future__ import annotations

import io
import struct
import zipfile

W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a"'


def zipped(**entries: str | bytes) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return held.getvalue()


def pack(entries: dict[str, str | bytes]) -> bytes:
    return zipped(**entries)


def docx(body: str, numbering: str = "", relations: str = "", **more: bytes) -> bytes:
    entries: dict = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}
    if numbering:
        entries["word/numbering.xml"] = f"<w:numbering {W}>{numbering}</w:numbering>"
    if relations:
        entries["word/_rels/document.xml.rels"] = f"<Relationships>{relations}</Relationships>"
    return pack(entries | more)


def para(text: str, style: str = "", extra: str = "", run: str = "") -> str:
    style = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f'<w:p><w:pPr>{style}{extra}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def pptx(slides: dict[int, str]) -> bytes:
    return pack({f"ppt/slides/slide{k}.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{v}</p:sld>' for k, v in slides.items()})


def xlsx(sheets: dict[str, str], strings: list[str]) -> bytes:
    names = "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(sheets))
    rels = "".join(f'<Relationship Id="r{k}" Type="t" Target="worksheets/sheet{k}.xml"/>' for k in range(len(sheets)))
    return pack(
        {
            "xl/workbook.xml": f'<workbook xmlns:r="http://r"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>",
            "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>",
            **{f"xl/worksheets/sheet{k}.xml": f"<worksheet><sheetData>{v}</sheetData></worksheet>" for k, v in enumerate(sheets.values())},
        }
    )


def odt(body: str, styles: str = "") -> bytes:
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:style="s" xmlns:fo="f" xmlns:table="b" xmlns:xlink="x"'
    return pack({"content.xml": f"<office:document-content {ns}><office:automatic-styles>{styles}</office:automatic-styles>"
                                f"<office:body><office:text>{body}</office:text></office:body></office:document-content>"})  # fmt: skip


def epub(chapters: dict[str, str], spine: str, title: str = "Book", creator: str = "A. Uthor") -> bytes:
    items = "".join(f'<item id="c{k}" href="{h}" media-type="application/xhtml+xml"/>' for k, h in enumerate(chapters))
    opf = (f'<package xmlns:dc="dc"><metadata><dc:title>{title}</dc:title><dc:creator>{creator}</dc:creator><dc:language>en</dc:language></metadata>'
           f"<manifest>{items}</manifest><spine>{spine}</spine></package>")  # fmt: skip
    container = '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
    from urllib.parse import unquote

    return pack({"META-INF/container.xml": container, "OEBPS/content.opf": opf, **{f"OEBPS/{unquote(h)}": t for h, t in chapters.items()}})


def mobi(text: bytes, compression: int = 1, encryption: int = 0, texts: int = 1) -> bytes:
    head = struct.pack(">HHIHHHH", compression, 0, len(text), texts, 4096, encryption, 0)
    head += b"MOBI" + struct.pack(">III", 232, 2, 65001) + bytes(244 - 32)
    records = [head, text]
    out = bytes(76) + struct.pack(">H", len(records))
    at = 78 + 8 * len(records)
    for k, r in enumerate(records):
        out += struct.pack(">II", at, k)
        at += len(r)
    return out + b"".join(records)


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with 512-byte sectors whose streams all lie in the mini stream."""
    mini, starts, table = b"", {}, []
    for name, content in streams.items():
        starts[name] = (len(mini) // 64, len(content))
        blocks = max(1, -(-len(content) // 64))
        first = len(table)
        table += [*range(first + 1, first + blocks), 0xFFFFFFFE]
        mini += content.ljust(blocks * 64, b"\0")
    mini_sectors = -(-len(mini) // 512)
    names = list(streams)
    entries = [_entry("Root Entry", 5, 1 if names else 0xFFFFFFFF, 0xFFFFFFFF, 3, len(mini))]
    for k, name in enumerate(names):
        right = k + 2 if k + 1 < len(names) else 0xFFFFFFFF
        entries.append(_entry(name, 2, 0xFFFFFFFF, right, *starts[name]))
    directory = b"".join(entries)
    directory_sectors = -(-len(directory) // 512)
    # sector 0: table of sectors, 1: table of mini sectors, 2: unused, 3..: mini stream, then the directory
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFF]
    fat += [*range(4, 3 + mini_sectors), 0xFFFFFFFE]
    first_directory = 3 + mini_sectors
    fat += [*range(first_directory + 1, first_directory + directory_sectors), 0xFFFFFFFE]
    sectors = struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat))))
    sectors += struct.pack("<128I", *(table + [0xFFFFFFFF] * (128 - len(table)))) + bytes(512)
    sectors += mini.ljust(mini_sectors * 512, b"\0") + directory.ljust(directory_sectors * 512, b"\0")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, 1, first_directory, 0, 4096, 1, 1, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108) + sectors


def _entry(name: str, kind: int, child_or_left: int, right: int, start: int, size: int) -> bytes:
    raw = name.encode("utf-16-le") + b"\0\0"
    child = child_or_left if kind == 5 else 0xFFFFFFFF
    out = raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", 0xFFFFFFFF, right if kind != 5 else 0xFFFFFFFF, child)
    return out + bytes(36) + struct.pack("<II", start, size) + bytes(4)
