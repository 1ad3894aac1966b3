"""Readers of single documents against small files built here."""

import json

import pytest

from quillmill.formats import books, encodings, images, mail, opendocument, outlook, plain, sheets, slides, styled, word
from quillmill.formats.errors import ConversionError
from quillmill.formats.html import decode_references, html_to_markdown, tokens
from quillmill.plans.convert import convert_one

from . import builders as b


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>A <b>b</b></h2><p>x &amp; y", "## A **b**\n\nx & y\n"),
        ("<p>a<br>b</p>", "a  \nb\n"),
        ('<p><a href="u">l <i>k</i></a> <a>n</a></p>', "[l *k*](u) n\n"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>t", "- a\n- b\n- c\n\nt\n"),
        ('<ol start="3"><li>a</li><li>b</li></ol>', "3. a\n4. b\n"),
        ("<li><p>x</p></li>", "-\nx\n"),
        ("<blockquote><blockquote>q</blockquote></blockquote>", "> > q\n"),
        ("<pre>a\n  b</pre>", "```\na\n  b\n```\n"),
        ("a<hr>b", "a\n\n---\n\nb\n"),
        ("<img src=s alt=t>", "![t](s)\n"),
        ("<table><tr><th>h</th></tr><tr><td>1|2</td><td>3</td></tr></table>", "| h |  |\n| --- | --- |\n| 1\\|2 | 3 |\n"),
        ("<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |\n"),
        ('<table><tr><td><a href="u">t</a></td></tr></table>', "|  |\n| --- |\n| [t](u) |\n"),
        ("a<script>if (a < b) '</p>'</script>b", "ab\n"),
        ("a<!-- never ends", "a\n"),
        ("1 < 2 `c` \\", "1 < 2 \\`c\\` \\\\\n"),
        ("<title>T</title><nav>n</nav>", "T\n\nn\n"),
        ("", "\n"),
    ],
)
def test_html(html, markdown):
    assert html_to_markdown(html) == markdown


def test_html_tokens_and_references():
    assert [t.kind for t in tokens('<!DOCTYPE x><a HREF="x>y" b>t</a><!--c-->')] == ["declaration", "start", "text", "end", "comment"]
    assert next(t for t in tokens('<a HREF="x&amp;y">')).attributes == {"href": "x&y"}
    assert decode_references("&#65;&#x42;&nbsp;&bogus;&amp") == "AB &bogus;&amp"


def test_encodings():
    assert encodings.text_file("é".encode("utf-16")) == "é"
    assert encodings.text_file("中文".encode("gb18030")) == "中文"
    assert encodings.text_file(b"\xef\xbb\xbfx") == "x"
    assert encodings.page(b'<meta charset="gbk">' + "中".encode("gbk")).endswith("中")
    assert encodings.plain(b"\xe9") == "é"


def test_text():
    assert plain.text_to_markdown(b"a  \r\n\r\n\r\n\r\nb\rc") == "a\n\n\nb\nc\n"
    assert plain.text_to_markdown(b"a  \n\n\n\nb", "md") == "a  \n\n\n\nb\n"
    with pytest.raises(ConversionError):
        plain.text_to_markdown(b"")


def test_csv():
    assert plain.csv_to_markdown(b'a;b\r\n"x;\n|y";"q""r"\r\nz', "n") == '# n\n\n| a | b |\n| --- | --- |\n| x;<br>\\|y | q"r |\n| z |  |\n'
    assert plain.csv_to_markdown(b"a\tb\n1,2\t3", "n", "tsv").endswith("| 1,2 | 3 |\n")


def test_json_xml_notebook():
    assert plain.json_to_markdown(b'{"b":1,"a":["/"]}', "n") == '# n\n\n```json\n{\n  "a": [\n    "/"\n  ],\n  "b": 1\n}\n```\n'
    assert "{oops" in plain.json_to_markdown(b"{oops", "n")
    assert "<a>\n  <b/>\n</a>" in plain.xml_to_markdown(b"<a><b></b></a>", "n")
    assert "<a>" in plain.xml_to_markdown(b"<a>", "n")
    cells = [{"cell_type": "markdown", "source": ["# x\n", "y"]}, {"cell_type": "code", "source": "1"}, {"cell_type": "code", "source": " "}, {"cell_type": "odd", "source": "z"}]
    book = json.dumps({"cells": cells, "metadata": {"kernelspec": {"language": "r"}}}).encode()
    assert plain.notebook_to_markdown(book, "n") == "# n\n\n# x\ny\n\n```r\n1\n```\n\n"
    with pytest.raises(ConversionError):
        plain.notebook_to_markdown(b"{}", "n")


def test_mail():
    alternative = (
        b"From: a@b\nSubject: =?utf-8?Q?caf=C3=A9?= =?utf-8?B?IMOp?=\nContent-Type: multipart/alternative; boundary=\"x=y\"\n\n"
        b"--x=y\nContent-Type: text/plain\n\nplain\n--x=y\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<p>h=C3=A9=\n llo</p>\n--x=y--\n"
    )
    assert mail.mail_to_markdown(alternative) == "# café é\n\n- **From:** a@b\n\n---\n\nhé llo\n"
    assert mail.reflowed("a\nb\n\n> q\nc\nd") == "a b\n\n> q\nc d"
    nested = b"Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/related; boundary=i\n\n--i\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGk=\n--i--\n--o--\n"
    assert mail.mail_to_markdown(nested).endswith("hi\n")
    with pytest.raises(ConversionError):
        mail.mail_to_markdown(b"Subject: x\n\n \n")


def test_outlook():
    def wide(text):
        return text.encode("utf-16-le")

    data = b.compound({"__substg1.0_0037001F": wide("Hi"), "__substg1.0_0C1A001F": wide("A"), "__substg1.0_0C1F001F": wide("a@b"), "__substg1.0_10130102": b"<p>B <b>c</b></p>"})
    assert outlook.outlook_to_markdown(data) == "# Hi\n\n- **From:** A <a@b>\n\n---\n\nB **c**\n"
    narrow = b.compound({"__substg1.0_0037001E": b"S", "__substg1.0_1000001E": b"x" * 100})
    assert outlook.outlook_to_markdown(narrow).endswith("x" * 100 + "\n")
    for bad in (b"", b"x" * 600, data[:700]):
        assert convert_one("msg", bad, "n")[0] == "failed"


def test_word():
    numbering = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'
    relations = '<Relationship Id="h" Type="x/hyperlink" Target="http://e" TargetMode="External"/><Relationship Id="i" Type="x/image" Target="media/p.png"/>'
    item = '<w:numPr><w:ilvl w:val="{}"/><w:numId w:val="1"/></w:numPr>'
    body = (
        b.para("Head", "Heading2") + b.para("Out", extra='<w:outlineLvl w:val="0"/>') + b.para("a", extra=item.format(0)) + b.para("b", extra=item.format(1))
        + b.para("c", extra=item.format(1)) + b.para("l", "ListParagraph") + b.para("bold", run="<w:b/>") + b.para("no", run='<w:b w:val="0"/>')
        + '<w:p><w:hyperlink r:id="h"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:br w:type="page"/></w:r></w:p><w:p><w:r><w:drawing><a:blip r:embed="i"/></w:drawing></w:r></w:p>'
        + f"<w:tbl><w:tr><w:tc>{b.para('x|y')}</w:tc><w:tc>{b.para('z')}{b.para('q')}</w:tc></w:tr></w:tbl>"
    )
    shown = word.word_to_markdown(b.docx(body, numbering, relations), "n", with_assets=True)
    assert shown.startswith("## Head\n\n# Out\n\n- a\n\n  1. b\n\n  2. c\n\n- l\n\n**bold**\n\nno\n\n[link](http://e)\n\n---\n\n![](n_assets/p.png)")
    assert shown.endswith("| x\\|y | z q |\n| --- | --- |\n")
    data = b.docx(body, numbering, relations, **{"word/media/p.png": b"png"})
    assert word.word_assets(data, "n") == [("n_assets/p.png", b"png")]
    assert convert_one("docx", b.pack({"a": "b"}), "n")[:2] == ("failed", "word_without_document")


def test_slides():
    def slide(text):
        return f"<a:p><a:r><a:rPr b='1'/><a:t>{text}</a:t></a:r></a:p>"

    table = f"<a:tbl><a:tr><a:tc>{slide('h')}</a:tc></a:tr><a:tr><a:tc>{slide('1')}</a:tc></a:tr></a:tbl>"
    shown = slides.slides_to_markdown(b.pptx({10: slide("ten"), 2: "", 1: slide("one") + table}))
    assert shown == "## Slide 1\n\n**one**\n\n| **h** |\n| --- |\n| **1** |\n\n---\n\n## Slide 3\n\n**ten**\n"


def test_sheets():
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>i|</t></is></c></row><row><c r="AA2"><v>5</v></c><c r="A2" t="b"><v>1</v></c></row><row><c r="A3" t="s"><v>1</v></c></row>'
    data = b.xlsx({"One": rows, "Two": ""}, ["shared", " "])
    shown = sheets.sheets_to_markdown(data)
    assert shown.startswith("## One\n\n| shared |  | i\\| |") and "| TRUE |" in shown and "\n---\n\n## Two" in shown
    assert len(sheets.sheets(data)[0][1]) == 2
    assert ("One", 1, 26, "5") in sheets.sheet_cells(data)
    assert [sheets.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [sheets.column_index(x) for x in ("A1", "ZZ3", "7")] == [0, 701, -1]


def test_open_document():
    styles = '<style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style>'
    body = (
        '<text:h text:outline-level="9">H</text:h><text:p>a<text:s text:c="3"/><text:span text:style-name="B">b</text:span> <text:a xlink:href="u">l</text:a></text:p>'
        "<text:list><text:list-item><text:p>x</text:p><text:list><text:list-item><text:p>y</text:p></text:list-item></text:list></text:list-item></text:list>"
        "<table:table><table:table-row><table:table-cell><text:p>1</text:p></table:table-cell></table:table-row></table:table>"
    )
    assert opendocument.open_to_markdown(b.odt(body, styles)) == "###### H\n\na   **b** [l](u)\n\n- x\n- y\n\n| 1 |\n| --- |\n"


def test_books():
    chapters = {"a%20b.xhtml": "<h1>One</h1><p>x</p>", "c.xhtml": "<title>T/w:o</title><p>y</p>", "d.xhtml": "<p>z</p>"}
    spine = '<itemref idref="c1"/><itemref idref="c0"/><itemref idref="c2" linear="no"/><itemref idref="gone"/>'
    book = books.read_book(b.epub(chapters, spine))
    assert [c.title for c in book.chapters] == ["T/w:o", "One"]
    assert books.combined(book).startswith("# Book\n\n**作者：** A. Uthor\n\n**语言：** en\n\n---\n\n## T/w:o\n\n")
    assert [p for p, _ in books.chapter_files(book)] == ["Book/index.md", "Book/01_T_w_o.md", "Book/02_One.md"]


def test_mobi():
    html = b"<p>hello hello</p>"
    assert books.mobi_to_markdown(b.mobi(html)) == "hello hello\n"
    assert convert_one("mobi", b.mobi(html, encryption=1), "n")[1] == "mobi_protected"
    assert convert_one("mobi", b.mobi(html, compression=17480), "n")[1] == "mobi_compression"
    assert convert_one("mobi", b.mobi(html, texts=0), "n")[1] == "mobi_empty"


def test_palm_references():
    assert books.palm_unpacked(bytes([ord("a"), ord("b"), 0x80, 0x10])) == b"ab" + b"aba"
    assert books.palm_unpacked(b"x\xf9") == b"x y"


def test_rich_text():
    data = (
        rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\fs48\b Title\b0\fs24\par body \i it\i0  caf\'e9 \u8211?x\par \'95 item\par "
        rb'{\field{\*\fldinst HYPERLINK "http://e"}{\fldrslt link}}\par}'
    )
    assert styled.rich_text_to_markdown(data) == "# **Title**\n\nbody *it* café –x\n\n- item\n\n[link](http://e)\n"


def test_images():
    import struct

    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, 4, int.from_bytes(b"Cam\0", "little")) + struct.pack("<HHII", 0x8769, 4, 1, 38) + bytes(4)
    tiff += struct.pack("<H", 2) + struct.pack("<HHII", 0x829A, 5, 1, 68) + struct.pack("<HHII", 0x8827, 3, 1, 200) + bytes(4) + struct.pack("<II", 1, 125)
    body = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + bytes(4) + b"\xff\xd9"
    assert images.image_properties(body) == [("ImageSize", "40 × 30"), ("Make", "Cam"), ("ISO", "200"), ("ExposureTime", "1/125s")]
    assert images.property_table([("a", "b|c")]) == "| Property | Value |\n| --- | --- |\n| a | b\\|c |\n"
    assert images.needs_upscale(100, 1499, 2) and not images.needs_upscale(1500, 10, 2)


@pytest.mark.parametrize("kind", ["docx", "pptx", "xlsx", "odt", "epub", "mobi", "msg", "rtf", "png", "ipynb", "csv", "eml"])
@pytest.mark.parametrize("data", [b"", b"PK\x03\x04", b"\0" * 100, b"{\\rtf", bytes(range(256))])
def test_broken_documents_are_rows(kind, data):
    status, error, _, markdown = convert_one(kind, data, "n")
    assert (status == "success") == (markdown is not None)
    assert status == "success" or error


def test_outside_kinds():
    assert convert_one("pdf", b"%PDF", "n")[:2] == ("unsupported", "needs_outside_engine")
    assert convert_one("", b"", "n")[:2] == ("unsupported", "unsupported_format")
