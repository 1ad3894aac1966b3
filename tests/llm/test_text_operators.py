"""License scans, fixity audits and page extraction against brute force and known texts, and odd cases."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from quillmill.llm import fixity, license_scan
from quillmill.llm.html_tree import blocks_of, tree_of
from quillmill.llm.html_wrappers import Rules, aligned, extract, fold, infer_wrappers, main_text, merged, rules_of, wrapper_of
from quillmill.llm.shared import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan_model(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, t.label) for t in license_scan.BASE for k in range(len(words)) if tuple(words[k : k + len(t.words)]) == t.words]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    texts = [
        "Released under the MIT License.", "under the mit-license UNDER THE MIT LICENSE x", "mit license", "Apache License, Version 2.0", "cc by cc by nc nc cc by nc", None, "",
        "This work is licensed under the GNU General Public License, version 3.", "éunder the MIT License", "under the MİT license", "under the mit license", "1cc by nc",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "licence of x", "word " * 40_000 + "licensed under CC BY-NC 4.0", "general public license",
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "rid": F.lit(2), "start": F.lit(3), "label": F.lit("z")})
    got = license_scan.scan(docs).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_words)
    assert sorted((*key(r), r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(((i if i is not None else -1), *scan_model(t)) for i, t in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[7] == "gpl-3" and labels[12] == "mit" and labels[14] == "cc-by-nc" and labels[15] == "" and labels[0] == "mit"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan(docs.limit(0)).count() == 0


def record(k, digest=None):
    digest = digest or hashlib.sha256(str(k).encode()).hexdigest()
    return (k // 100, (k % 100) * 40_000, 40_000, digest)


def test_fixity_audit(spark):
    schema = "file long, offset long, length long, digest string"
    rows = [record(k) for k in range(1200)]
    own = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema + ", page_id long")
    same, report = fixity.audit(own, spark.createDataFrame(rows, schema))
    assert report == [(9, 0)] and {r.state for r in same.collect()} == {"ok"}
    other = [r for k, r in enumerate(rows) if k != 77]
    other[500] = record(501, "spoilt")
    other.append((3, 99_000_000, 5, "more"))
    found, report = fixity.audit(own, spark.createDataFrame(other, schema))
    states = collections.Counter(r.state for r in found.collect())
    assert states == {"ok": 1198, "missing": 1, "corrupt": 1, "extra": 1}
    assert found.filter("state = 'corrupt'").first().page_id == 501 and found.filter("state = 'missing'").first().page_id == 77
    assert all(n <= 4 for _, n in report) and report[-1][0] == 0
    none, _ = fixity.audit(own, spark.createDataFrame([], schema))
    assert {r.state for r in none.collect()} == {"missing"}
    assert fixity.audit(own.limit(0), spark.createDataFrame([], schema))[0].count() == 0


def test_archive_records(spark):
    rows = spark.createDataFrame([(1, None, "é"), (None, "u", None), (1, None, "é"), (5000, "u", "x")], "page_id long, url string, html string")
    record_of = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    shown = rows.select("page_id", record_of.alias("r"), fixity.file_of(F.col("page_id"), record_of).alias("file"), F.octet_length(record_of).cast("long").alias("length"))
    laid = fixity.laid_out(shown, ["page_id", "r"]).collect()
    assert sorted((r.file, r.offset) for r in laid if r.page_id == 1) == [(0, 0), (0, next(r.length for r in laid if r.page_id == 1))]
    assert next(r.file for r in laid if r.page_id is None) < 0 and next(r.file for r in laid if r.page_id == 5000) == 1
    assert "Content-Length: 2\r\n\r\né\r\n\r\n" in next(r.r for r in laid if r.page_id == 1)


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>'</p>'</script></head><body><header>H</header><nav><ul><li>m<li>n</ul></nav>"
    "<div class='ad'>buy</div><div class='cookie-notice'>c</div><article><header><h1>{0} &amp; co</h1></header><p>one  <b>{0}</b>\n two<p>three<br>four"
    "<ul><li>i<li>j</ul><form>f</form><table><tr><td>1<td>2</table><section class='comments'><p>r</p></section></article><aside>s</aside><footer>&copy;</footer>"
)
TEXT = "{0} & co\none {0} two\nthree four\ni\nj\n1\n2"


def test_pages(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(f"T{k}")) for k in range(12)]
    rows += [(100, None, None), (101, "", ""), (102, "nonsense", "<<<p>a<b"), (0, rows[0][1], rows[0][2]), (None, "http://h0.example/x", "<article>" + "<p>w</p>" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit(2), "text": F.lit(3)})
    got = collections.Counter((r.page_id, r.url, r.text) for r in extract(pages).collect())
    want = collections.Counter((k, u, TEXT.format(f"T{k}")) for k, u, _ in rows[:12])
    want.update([(100, None, ""), (101, "", ""), (102, "nonsense", "<<\na"), (0, rows[0][1], TEXT.format("T0")), (None, "http://h0.example/x", "\n".join(["w"] * 5000))])
    assert got == want
    assert extract(pages.limit(0)).count() == 0


def plain_page(k, extra=""):
    return f"<body><div class=top>Site name</div><div class=body><h1>Title {k}</h1><p>{'text ' * (20 + k)}{k}</p>{extra}</div><div class=low>All rights</div></body>"


def test_wrappers_without_article(spark):
    pages = spark.createDataFrame([(k, f"http://e.org/{k}", plain_page(k, "<p>more</p>" * (k % 3))) for k in range(9)], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in extract(pages).collect()}
    assert texts[3] == "Title 3\n" + " ".join(["text"] * 23) + " 3"
    assert texts[4].endswith("4\nmore")
    row = infer_wrappers(pages, Scratch(spark, "t")).collect()
    assert len(row) == 1 and row[0].host == "e.org"


def texts_of(spark, htmls):
    rows = [(k, f"http://e.org/{k}", html) for k, html in enumerate(htmls)]
    return [r.text for r in sorted(extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_copies_of_a_page_are_not_boilerplate(spark):
    assert texts_of(spark, ["<body><h1>T</h1><p>x</p></body>"] * 5) == ["T\nx"] * 5
    assert texts_of(spark, ["<body><h1>T</h1><p>x</p><p>y</p></body>"] * 4 + ["<body><h1>T</h1><p>z</p></body>"]) == ["T\nx\ny"] * 4 + ["T\nz"]


def test_wrappers_decide_over_article_elements(spark):
    inside = [f"<article><h1>T {k}</h1><div class=by>Our newsroom</div><p>{'w ' * 9}{k}</p></article>" for k in range(5)]
    assert texts_of(spark, inside) == [f"T {k}\n{'w ' * 9}{k}" for k in range(5)]
    beside = [f"<body><div class=story><h2>S</h2><p>{'long ' * 40}{k}</p><p>end {k}</p></div><article>see {k}</article></body>" for k in range(5)]
    assert all(f"long {k}\nend {k}" in text for k, text in enumerate(texts_of(spark, beside)))


def test_articles_are_joined(spark):
    split = "<body><main><p>{0} a</p></main><article class=post><p>{1} {0}</p></article><article class=post><p>c {0}</p></article></body>"
    want = [f"{k} a\n{'b ' * 50}{k}\nc {k}" for k in range(4)]
    assert texts_of(spark, [split.format(k, ("b " * 50).strip()) for k in range(4)]) == want
    assert texts_of(spark, [split.format(0, ("b " * 50).strip())]) == want[:1]  # one page tells nothing apart


def test_text_beside_the_largest_group_stays(spark):
    post = "<body><div class=top>Site</div><div class=post><h1>Title {0}</h1><div class=intro><p>in {0}</p></div><div class=text>{1}</div></div></body>"
    pages = [post.format(k, f"<p>{'w ' * 60}{k}</p><p>z {k}</p>") for k in range(4)]
    assert texts_of(spark, pages) == [f"Title {k}\nin {k}\n{'w ' * 60}{k}\nz {k}" for k in range(4)]


def test_marks_of_layout_keep_the_article(spark):
    story = "<h1>T {0}</h1><p>" + "w " * 30 + "{0}</p>"
    want = [f"T {k}\n{'w ' * 30}{k}" for k in range(4)]
    for shape in (
        "<div id=page class='no-sidebar'><article>%s</article></div>", "<div class='sidebar-page'><article>%s</article></div>",
        "<article class='post has-sidebar'>%s</article>", "<form id=aspnet><div class=top>Site</div><main>%s</main></form>",
        "<div class='widget'><div class=body>%s</div></div>",
        "<article>%s</article><article class=comment><p>{0} first</p></article><div class=related><article>see {0}</article></div>",
    ):
        page = "<body>" + shape % story + "</body>"
        assert texts_of(spark, [page.format(k) for k in range(4)]) == want


def test_wrapper_parts():
    one, two = (wrapper_of(tree_of(x)) for x in ("<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>a</li></ul><h2>n</h2><p>x</p>"))
    whole = merged(one, two)
    assert [(n[0], n[1], n[2]) for n in whole[4]] == [("ul", False, False), ("h2", False, True), ("p", False, False)]
    assert whole[4][0][4][0][1] is True  # repeated items
    assert whole[4][2][4][0][5] is not None and whole[4][0][4][0][4][0][5] is None  # the same text, and a slot
    assert aligned([], fold(two[4]))[0][2] is True
    assert rules_of(wrapper_of(tree_of(""))) == Rules(frozenset(), frozenset())


def test_html_tree():
    assert blocks_of(tree_of("<p>a<div>b<p>c</div>d <!-- e --> f<textarea>g</textarea>")) == ["a", "b", "c", "d f"]
    assert blocks_of(tree_of("<p title='a>b'>x</p><p hidden>y</p><div style='display: none'>z</div><p>&lt;&#65;&nbsp;B")) == ["x", "<A B"]
    assert main_text("<main>a</main><article>bb</article>", Rules(frozenset(), frozenset())) == "bb"
    assert blocks_of(tree_of("<div>" * 3000 + "deep")) == ["deep"]
    assert blocks_of(tree_of('<a "<a "' * 2000)) is not None
