"""Files of many kinds made from an order's number and its lines (number, part, flag), for queries over the byte readers."""

from __future__ import annotations

import base64
import json
import quopri
import struct
import zlib

Lines = list[tuple[int, int, str]]

_WORD = 'xmlns:w="w" xmlns:r="r"'
_OPEN = 'xmlns:office="o" xmlns:text="t" xmlns:style="s" xmlns:fo="f" xmlns:table="b"'


def _zipped(entries: dict[str, str]) -> bytes:
    """An archive of stored entries, byte for byte what zipfile writes under ZipInfo(name)."""
    out, at, listed = [], 0, []
    for name, content in entries.items():
        raw, data = name.encode(), content.encode()
        common = struct.pack("<HHHHLLLHH", 0, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(raw), 0)
        out += (b"PK\3\4\x14\0", common, raw, data)
        listed.append(b"PK\1\2\x14\x03\x14\0" + common + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + raw)
        at += 30 + len(raw) + len(data)
    directory = b"".join(listed)
    return b"".join(out) + directory + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(listed), len(listed), len(directory), at, 0)


def docx(order: int, lines: Lines) -> bytes:
    """A heading by style; list items, bold and plain paragraphs by flag; a table of all lines."""

    def para(text: str, properties: str = "", run: str = "") -> str:
        return f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"

    item = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    body = para(f"Order {order}", '<w:pStyle w:val="Heading1"/>')
    for _, part, flag in lines:
        body += para(f"part {part}", item if flag == "A" else "", "<w:b/>" if flag == "R" else "")
    cells = "".join(f"<w:tr><w:tc>{para(str(n))}</w:tc><w:tc>{para(flag + '|' + str(part))}</w:tc></w:tr>" for n, part, flag in lines)
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    return _zipped({
        "word/document.xml": f"<w:document {_WORD}><w:body>{body}<w:tbl>{cells}</w:tbl></w:body></w:document>",
        "word/numbering.xml": f"<w:numbering {_WORD}>{numbering}</w:numbering>",
    })


def pptx(order: int, lines: Lines) -> bytes:
    """A slide for each line, some bold."""
    out = {}
    for k, (_, part, flag) in enumerate(lines, 1):
        marks = ' b="1"' if flag == "R" else ""
        out[f"ppt/slides/slide{k}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:rPr{marks}/><a:t>order {order} part {part}</a:t></a:r></a:p></p:sld>'
    return _zipped(out)


def xlsx(order: int, lines: Lines) -> bytes:
    """One sheet: shared strings, a hole, numbers, truth values."""
    rows = "".join(f'<row><c r="A{n}" t="s"><v>{n - 1}</v></c><c r="C{n}"><v>{part}</v></c><c r="D{n}" t="b"><v>{int(flag == "R")}</v></c></row>' for n, part, flag in lines)
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns:r="r"><sheets><sheet name="Order {order}" r:id="r0"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r0" Type="t" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>line {n}</t></si>" for n, _, _ in lines) + "</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    })


def odt(order: int, lines: Lines) -> bytes:
    """A heading, a list, and paragraphs with a span whose style is bold."""
    style = '<style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style>'
    items = "".join(f"<text:list-item><text:p>part {part}</text:p></text:list-item>" for _, part, _ in lines)
    paras = "".join(f'<text:p>line {n} <text:span text:style-name="B">{flag}</text:span></text:p>' for n, _, flag in lines)
    return _zipped({
        "content.xml": f"<office:document-content {_OPEN}><office:automatic-styles>{style}</office:automatic-styles><office:body><office:text>"
        f'<text:h text:outline-level="2">Order {order}</text:h><text:list>{items}</text:list>{paras}</office:text></office:body></office:document-content>',
    })


def epub(order: int, lines: Lines) -> bytes:
    """A chapter for each line, in the spine's order, which is the reverse of the manifest's."""
    items = "".join(f'<item id="c{n}" href="c{n}.xhtml" media-type="application/xhtml+xml"/>' for n, _, _ in lines)
    spine = "".join(f'<itemref idref="c{n}"/>' for n, _, _ in reversed(lines))
    return _zipped({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>',
        "b.opf": f'<package xmlns:dc="dc"><metadata><dc:title>Order {order}</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>',
        **{f"c{n}.xhtml": f"<html><body><h1>Line {n}</h1><p>part <i>{part}</i></p></body></html>" for n, part, _ in lines},
    })


def mail(order: int, lines: Lines) -> bytes:
    """Alternatives, of which the HTML one is quoted-printable or base64; the subject is an encoded word."""
    html = "".join(f"<p>café {n} <b>{part}</b></p>" for n, part, _ in lines).encode()
    quoted = order % 2 == 0
    body = quopri.encodestring(html) if quoted else base64.encodebytes(html)
    subject = base64.b64encode(f"État {order}".encode()).decode()
    head = (
        f"From: =?utf-8?Q?Jos=C3=A9?= <a{order}@example.org>\r\nSubject: =?utf-8?B?{subject}?=\r\n"
        'Content-Type: multipart/alternative;\r\n boundary="x=y"\r\n\r\n--x=y\r\nContent-Type: text/plain\r\n\r\nplain\r\n--x=y\r\n'
        f"Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: {'quoted-printable' if quoted else 'base64'}\r\n\r\n"
    )
    return head.encode() + body.replace(b"\n", b"\r\n") + b"\r\n--x=y--\r\n"


def json_file(order: int, lines: Lines) -> bytes:
    return json.dumps({"order": order, "lines": [{"part": part, "flag": flag} for _, part, flag in lines], "a/b": None}).encode()


def xml(order: int, lines: Lines) -> bytes:
    return (f'<order key="{order}">' + "".join(f"<line><part>{part}</part></line>" for _, part, _ in lines) + "</order>").encode()


def csv(order: int, lines: Lines) -> bytes:
    """Quotes, pipes, line ends in cells, and a short row."""
    return ("key;part;note\r\n" + "".join(f'{order};"{part};{flag}";"a|""{n}""\nb"\r\n' for n, part, flag in lines) + "end\r\n").encode()


def rtf(order: int, lines: Lines) -> bytes:
    body = "".join(rf"\b {flag}\b0  part {part} caf\'e9\par " for _, part, flag in lines)
    return (r"{\rtf1\ansi\fs48\b Order " + str(order) + r"\b0\fs24\par " + body + "}").encode()


def mobi(order: int, lines: Lines) -> bytes:
    """PalmDoc text whose bytes are literal, but for blanks before letters."""
    text = "".join(f"<p>order {order} part {part}</p>" for _, part, _ in lines).encode()
    packed = bytearray()
    k = 0
    while k < len(text):
        if text[k] == 32 and k + 1 < len(text) and 0x40 <= text[k + 1] < 0x80:
            packed.append(text[k + 1] ^ 0x80)
            k += 2
        else:
            packed.append(text[k])
            k += 1
    head = struct.pack(">HHIHHHH", 2, 0, len(text), 1, 4096, 0, 0) + b"MOBI" + struct.pack(">III", 232, 2, 65001) + bytes(212)
    starts = 78 + 16
    table = struct.pack(">H", 2) + struct.pack(">II", starts, 0) + struct.pack(">II", starts + len(head), 1)
    return bytes(76) + table + head + bytes(packed)


def msg(order: int, lines: Lines) -> bytes:
    """A compound file: the streams in the mini stream, named by property."""
    body = "\r\n\r\n".join(f"part {part} {flag}" for _, part, flag in lines)
    streams = {"__substg1.0_0037001F": f"Order {order}", "__substg1.0_0C1A001F": "Ann", "__substg1.0_0C1F001F": "a@example.org", "__substg1.0_1000001F": body}
    mini, chains, entries = b"", [], []
    for k, (name, text) in enumerate(streams.items(), 1):
        data = text.encode("utf-16-le")
        blocks = max(1, -(-len(data) // 64))
        entries.append(_entry(name, 2, k + 1 if k < len(streams) else -1, -1, len(mini) // 64, len(data)))
        chains += [*range(len(chains) + 1, len(chains) + blocks), 0xFFFFFFFE]
        mini += data.ljust(blocks * 64, b"\0")
    chain_sectors, mini_sectors = -(-len(chains) // 128), -(-len(mini) // 512)
    first_mini, first_entry = 1 + chain_sectors, 1 + chain_sectors + mini_sectors
    directory = b"".join([_entry("Root Entry", 5, -1, 1, first_mini, len(mini)), *entries])
    entry_sectors = -(-len(directory) // 512)
    table = [0xFFFFFFFD]
    for first, count in ((1, chain_sectors), (first_mini, mini_sectors), (first_entry, entry_sectors)):
        table += [*range(first + 1, first + count), 0xFFFFFFFE]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, 1, first_entry, 0, 4096, 1, chain_sectors, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    sectors = struct.pack("<128I", *(table + [0xFFFFFFFF] * (128 - len(table))))
    sectors += struct.pack(f"<{128 * chain_sectors}I", *(chains + [0xFFFFFFFF] * (128 * chain_sectors - len(chains))))
    return head + sectors + mini.ljust(mini_sectors * 512, b"\0") + directory.ljust(entry_sectors * 512, b"\0")


def _entry(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
    raw = name.encode("utf-16-le") + b"\0\0"
    links = struct.pack("<III", 0xFFFFFFFF, right & 0xFFFFFFFF, child & 0xFFFFFFFF)
    return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + links + bytes(36) + struct.pack("<IQ", start, size)


def html(order: int, lines: Lines) -> bytes:
    """Headings, paragraphs with marks and links, a list, a table, a quotation, code, and what is left out."""
    items = "".join(f"<li>item {n}</li>" for n, _, _ in lines)
    rows = "".join(f"<tr><td>{n}</td><td>{flag}|{part}</td></tr>" for n, part, flag in lines)
    paras = "".join(f'<p>part <b>{part}</b> &amp; <a href="u/{n}">more</a><br>next</p>' for n, part, _ in lines)
    return (
        f"<!DOCTYPE html><html><head><style>p {{}}</style></head><body><script>'</p>'</script><h1>Order {order}</h1>{paras}<ol>{items}</ol><!-- c -->"
        f"<table><tr><th>n</th><th>part</th></tr>{rows}</table><blockquote>said {order}</blockquote><pre>a\n  {order}</pre><hr><p>end</body></html>"
    ).encode()
