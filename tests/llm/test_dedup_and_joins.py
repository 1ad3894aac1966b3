"""Exact dedup, n-gram join and cap join against brute force, and the cases that each must bear."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import cap_join, ngram_join
from quillmill.llm.exact_dedup import DigestLog, exact_dedup, keep_one
from quillmill.llm.graph import components
from quillmill.llm.shared import Scratch, rows_that_stay

DOCS = "doc_id long, text string"
ODD = [(3, "a"), (1, "a"), (3, "a"), (None, "a"), (2, None), (5, ""), (None, "b"), (7, "A"), (8, "x" * 200_000), (9, "x" * 200_000 + "y")]


def groups(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def weak(column):
    return F.substring(F.md5(column.cast("binary")), 1, 1).cast("binary")


@pytest.mark.parametrize("digest", [None, weak])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, digest, keep):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"digest": F.lit(1), "rid": F.lit(2), "n": F.lit(3), "best": F.lit("z")})
    got = exact_dedup(docs, keep=keep, **({"digest": digest} if digest else {})).collect()
    texts = [(i, t or "") for i, t in ODD]
    by_text = collections.defaultdict(list)
    for i, t in texts:
        by_text[t].append(i)
    pick = max if keep == "max" else min
    want = collections.Counter()
    for t, ids in by_text.items():
        known = [i for i in ids if i is not None]
        winner = pick(known) if known else None
        for i in ids:
            want[i, winner, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter((r.id, r.keep_id, r.group_size, r.sha.hex()) for r in got) == want
    kept = collections.Counter(r.sha.hex() for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(by_text)
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_exact_dedup_in_batches_and_empty(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], DOCS)
    two = spark.createDataFrame([(3, "a"), (4, "c")], DOCS)
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(one, keep="min", batches=[two]).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}
    assert exact_dedup(one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        DigestLog(Scratch(spark, "t"), keep="first")


def test_log_levels(spark):
    log = DigestLog(Scratch(spark, "t"), keep="min", fanout=2)
    for k in range(5):
        rows = spark.createDataFrame([(b"d%d" % (k % 2), k, k)], "digest binary, id long, rid long")
        log.flush(rows)
    assert len(log.levels) > 1 and all(len(level) < 2 for level in log.levels)
    assert sorted((bytes(r.digest), r.best.id, r.n) for r in log.compact().collect()) == [(b"d0", 0, 3), (b"d1", 1, 2)]


def test_keep_one_has_all_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (2, "a", 4), (3, "b", 1), (None, None, 1)], "doc_id long, text string, kept int")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.kept) for r in got.collect()) == [(0, "", 1), (2, "a", 4), (3, "b", 1)]
    assert keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    edges = spark.createDataFrame([(a, b) for a, b in pairs], "u long, v long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t"), "g").collect()}
    want = groups(341, pairs)
    assert got == {k: want[k] for a, b in pairs if a != b for k in (a, b)}
    assert components(edges.limit(0), Scratch(spark, "t"), "e").count() == 0


def near_texts(seed=0):
    """Base texts with variants near the threshold, copies, short texts and odd ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
            if rng.random() < 0.3:
                out.append(" ".join(text).upper() + "!")
    crowd = [rng.choice(words) for _ in range(100)]
    for k in range(230):  # larger than a block, all distinct
        text = list(crowd)
        text[k % 100] = f"v{k}"
        text[(k * 7) % 100] = f"u{k}"
        out.append(" ".join(text))
    return [*out, "one", "one", "one two", "", None, "...", "a b c d e", "A b-c d e", "long " * 30_000]


def shingles(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    width = min(n, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def test_ngram_join(spark):
    texts = near_texts()
    rows = [(100 + (k * 37) % 1000, t) for k, t in enumerate(texts)] + [(100, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "cid": F.lit(2), "size": F.lit(3), "grams": F.lit(0)})
    got = sorted(((r.doc_id if r.doc_id is not None else 10**6, r.sha.hex(), r.n_links, r.component_id) for r in ngram_join.ngram_join(docs).collect()))
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links = collections.Counter(x for p in pairs for x in p)
    label = groups(len(rows), pairs)
    least = collections.defaultdict(list)
    for k, g in enumerate(label):
        least[g].append(rows[k][0] if rows[k][0] is not None else 10**6)
    want = sorted(((i if i is not None else 10**6), hashlib.sha256((t or "").encode()).hexdigest(), links[k], min(least[label[k]])) for k, (i, t) in enumerate(rows))
    assert got == want
    kept = ngram_join.ngram_join(docs).groupBy("component_id").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    empty = sum(not s for s in sets)
    assert sum(r.n for r in kept) == len({g for k, g in enumerate(label) if sets[k]}) + empty


def test_ngram_join_blocks_agree(spark, monkeypatch):
    texts = near_texts(1)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    want = sorted(map(tuple, ngram_join.ngram_join(docs).drop("sha").collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, ngram_join.ngram_join(docs).drop("sha").collect())) == want


def test_ngram_parameters_and_empty(spark):
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert bands * rows <= 192 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.9999, most_hashes=4)
    assert ngram_join.ngram_join(spark.createDataFrame([], DOCS)).count() == 0
    alone = ngram_join.ngram_join(spark.createDataFrame([(1, "a b"), (2, None)], DOCS)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in sorted(alone)] == [(0, 1, True), (0, 2, True)]


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "b", 0), (None, None, 3)], "doc_id long, text string, stays int")
    decided = ngram_join.ngram_join(docs).select("doc_id", "sha", "kept")
    got = rows_that_stay(docs, decided, Scratch(spark, "t"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.stays) for r in got) == [(0, 3), (1, 1), (2, 0)]


def test_cap_join(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 32))
    near = np.concatenate([b + rng.normal(size=(rng.integers(1, 9), 32)) * rng.uniform(0.05, 0.3) for b in base])
    crowd = base[0] + rng.normal(size=(260, 32)) * 0.05
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([near, crowd]).astype(np.float32))]
    n = len(rows)
    rows += [(n, rows[0][1]), (n + 1, [2 * x for x in rows[0][1]]), (0, rows[0][1])]
    bad = [(n + 2, None), (n + 3, []), (n + 4, [0.0] * 32), (n + 5, [1.0, None] * 16), (n + 6, [float("nan")] * 32), (n + 7, [float("inf")] + [0.0] * 31)]
    short = [(n + 8, [1.0, 0.0]), (n + 9, [1.0, 0.001]), (n + 10, [0.0, 1.0])]
    frame = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<float>").withColumns({"key": F.lit(1), "size": F.lit(2), "filters": F.lit(0)})
    got = sorted(map(tuple, cap_join.cap_join(frame).collect()))
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = groups(len(rows), np.argwhere(np.triu(linked)).tolist())
    ids = [i for i, _ in rows]
    least = collections.defaultdict(lambda: 10**9)
    for k, g in enumerate(label):
        least[g] = min(least[g], ids[k])
    want = [(ids[k], int(linked[k].sum()), least[label[k]]) for k in range(len(rows))] + [(i, 0, i) for i, _ in bad]
    want += [(n + 8, 1, n + 8), (n + 9, 1, n + 8), (n + 10, 0, n + 10)]
    assert got == sorted(want)


def test_cap_join_blocks_and_empty(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.repeat(rng.normal(size=(4, 8)), 30, axis=0) + rng.normal(size=(120, 8)) * 0.02)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, cap_join.cap_join(frame).collect()))
    monkeypatch.setattr(cap_join, "BLOCK_ROWS", 5)
    assert sorted(map(tuple, cap_join.cap_join(frame).collect())) == want and {w[1] for w in want} == {29}
    assert cap_join.cap_join(frame.limit(0)).count() == 0
    assert [tuple(r) for r in cap_join.cap_join(spark.createDataFrame([(1, None)], frame.schema)).collect()] == [(1, 0, 1)]


def test_codes_miss_few_pairs_of_a_large_table():
    x, y = cap_join.pairs_at(64, 0.95, 4000, 7)
    assert np.allclose((x * y).sum(axis=1), 0.95)
    met = np.zeros(len(x), bool)
    for code in cap_join.codes_for(64, 615_000, 0.95, 1e-8, 1e-4, 32, 64):
        met |= cap_join.pairs_met(code, x, y)
    assert met.mean() > 0.999


def test_list_decoding_is_complete():
    code = cap_join.ProductCode.fitted(12, 500, 0.95, 0.999)
    unit = np.random.default_rng(2).normal(size=(50, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    vector, name = code.decode(unit)
    turned = unit @ code.rotation
    a, b = code.words
    whole = ((turned[:, : a.shape[1]] @ a.T)[:, :, None] + (turned[:, a.shape[1] :] @ b.T)[:, None, :]) / np.sqrt(2)
    want = np.argwhere(whole.reshape(50, -1) >= code.alpha)
    assert sorted(zip(vector.tolist(), name.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
