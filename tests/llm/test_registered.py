"""The six registered queries without SQL, on the smallest tables, against plain versions of what they return."""

import collections
import math
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from quillmill.llm import registry
from quillmill.llm.packing import encoder
from quillmill.llm.q_packing import tokenizer_path

from .test_dedup_and_joins import groups, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_op1_packing(spark, documents):
    rows = run(spark, "op1_packing")
    encode = encoder(tokenizer_path()).whole
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == documents.keys()
    for doc, text in documents.items():
        ids = np.array([*encode.encode(text, add_special_tokens=False).ids, 1], "<u4")
        held = sorted(pieces[doc], key=lambda r: r.start)
        assert [r.start for r in held] == np.cumsum([0, *(r.length for r in held)])[:-1].tolist() and sum(r.length for r in held) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in held)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= 2048
    used = sum(r.length for r in rows)
    assert len(sequences) * 2048 <= used * 1.03 + 4096


def test_op2_toxicity(spark, documents):
    rows = run(spark, "op2_toxicity")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {r.doc_id for r in rows} == documents.keys() and len(rows) == len(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    learnt = [r.predicted == toxic[r.doc_id] for r in rows if r.doc_id in toxic and not r.held_out]
    assert sum(learnt) >= 0.9 * len(learnt)


def test_op6_lm_scoring(spark, documents):
    rows = run(spark, "op6_lm_scoring")
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)), "\n"] for k, t in documents.items()}
    counts = collections.Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        ws = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    assert len(rows) == len(documents) and sum(r.score for r in rows) > sum(r.base_score for r in rows)


class Article(HTMLParser):
    """The blocks within article elements, without scripts."""

    def __init__(self):
        super().__init__()
        self.inside, self.raw, self.run, self.blocks = 0, False, [], []

    def ended(self):
        if text := " ".join("".join(self.run).split()):
            self.blocks.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "div"):
            self.ended()
        elif tag == "br":
            self.run.append(" ")
        self.inside += tag == "article"
        self.raw = tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "div"):
            self.ended()
        self.inside -= tag == "article"
        self.raw = False

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.run.append(data)


def test_op8_html_extraction(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op8_html_extraction")
    assert {r.page_id for r in rows} == pages.keys() and len(rows) == len(pages)
    for r in rows:
        plain = Article()
        plain.feed(pages[r.page_id].html or "")
        assert r.text == "\n".join(plain.blocks) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op9_ngram_join(spark, documents):
    ids = sorted(documents)
    sets = [shingles(documents[k]) for k in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links = collections.Counter(x for p in pairs for x in p)
    label = groups(len(ids), pairs)
    got = {r.doc_id: (r.n_links, r.component_id) for r in run(spark, "op9_ngram_join")}
    assert got == {k: (links[at], ids[label[at]]) for at, k in enumerate(ids)}


def test_op10_cap_join(spark):
    held = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(held)
    x = np.array([held[k] for k in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = groups(len(ids), np.argwhere(np.triu(linked)).tolist())
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, "op10_cap_join")}
    assert got == {k: (int(linked[at].sum()), ids[label[at]], ids[label[at]] == k) for at, k in enumerate(ids)}
