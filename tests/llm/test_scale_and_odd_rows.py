"""What must hold at every size and for odd rows: recall of codes, salted joins, filters, runs, long texts, deep markup."""

import cProfile
import collections
import math
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import cap_join, exact_dedup, fixity, graph, hmm, html_wrappers, lm_scoring, mixing, packing, q_mixing, shared, text_cnn, toxicity
from quillmill.llm.q_packing import tokenizer_path

DOCS = "doc_id long, text string"


@pytest.mark.parametrize(
    ("dim", "rows"), [(2, 1000), (2, 10**9), (3, 10**6), (4, 20_000), (8, 10**7), (16, 10**5), (64, 1000), (64, 10**6), (64, 10**8), (64, 10**9), (768, 20_000)]
)
def test_codes_meet_pairs_at_the_threshold(dim, rows):
    x, y = cap_join.pairs_at(dim, 0.95, 400, 99)
    met = np.zeros(len(x), bool)
    for code in cap_join.codes_for(dim, rows, 0.95, 1e-4, 1e-4, 32, 512):
        met |= cap_join.pairs_met(code, x, y)
    assert met.mean() >= 0.99


def test_few_components(spark):
    x = np.random.default_rng(0).normal(size=(1500, 2))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in cap_join.cap_join(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert got == dict(enumerate(want.tolist()))
    line = spark.createDataFrame([(1, [2.0]), (2, [3.0]), (3, [-1.0])], frame.schema)
    assert sorted(map(tuple, cap_join.cap_join(line).collect())) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(3)
    for dim in (2, 20, 64, 200):
        x = rng.normal(size=(60, dim))
        x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.3])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= 0.95
        np.fill_diagonal(linked, False)
        assert (cap_join.may_link(cap_join.sketches(x), 0.95) | ~linked.any(axis=1)).all()


def test_odd_vectors(spark):
    tiny, huge = [1e-200, 2e-200], [3e200, 6e200]
    rows = [(1, tiny), (2, huge), (3, [1.0, 2.0]), (4, [None, 1.0]), (5, [-0.0, 1.0]), (6, [0.0, 1.0]), (None, [0.0, 2.0]), (7, [1e-40, 0.0]), (8, [1.0, 0.0])]
    got = cap_join.cap_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    links = {r.id: (r.n_links, r.component_id) for r in got}
    assert links == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (2, 5), 6: (2, 5), None: (2, 5), 7: (1, 7), 8: (1, 7)}


def test_salted_join_is_a_join(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(900)], "v long, k string")
    by_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("k <> 'k0'")
    for how in ("inner", "left"):
        want = collections.Counter((r.v, r.k, r.top) for r in rows.join(by_key, "k", how).collect())
        got = shared.salted_join(rows, by_key, ["k"], 900, how)
        assert set(got.columns) == {"k", "v", "top"} and collections.Counter((r.v, r.k, r.top) for r in got.collect()) == want
    parts = shared.salted_join(rows, by_key, ["k"], 900).filter("k = 'hot'").select(F.spark_partition_id().alias("p"))
    assert parts.count() == 600


def test_filter_holds_nothing_back(spark):
    rows = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    marks = shared.DigestFilter(rows.filter("id < 500").select("digest"), 500)
    passed = {r.id for r in rows.filter(marks.may_hold(F.col("digest"))).collect()}
    assert set(range(500)) <= passed and len(passed) < 600
    assert shared.DigestFilter(rows.limit(0).select("digest"), 0).bits.sum() == 0


def test_scratch_tables_go(spark):
    scratch = shared.Scratch(spark, "t")
    kept = scratch.save(spark.range(3), "a")
    scratch.save(spark.range(4), "b")
    scratch.keep("a")
    assert kept.count() == 3 and scratch.names == {"a"}
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    shared.close_scratch(spark)
    assert not files.exists(path)


def test_edges_of_a_task_are_contracted():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 300, (2, 200))
    nodes, roots = graph.contracted(u, v)
    label = {k: k for k in range(300)}
    for _ in range(300):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            label[a] = label[b] = min(label[a], label[b])
    want = {k: label[k] for k in {*u.tolist(), *v.tolist()} if label[k] != k}
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == want


def test_components_of_more_edges_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD_EDGES", 8)
    edges = [(k, k + 1) for k in range(60)] + [(200, k) for k in range(100, 160)] + [(k, 70) for k in range(71, 80)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7, "u")
    got = {r.node: r.component for r in graph.components(frame, shared.Scratch(spark, "t"), "g").collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in [*range(100, 160), 200]}, **{k: 70 for k in range(70, 80)}}


@pytest.mark.parametrize("keep", ["max", "min"])
def test_runs_of_small_memtables(spark, keep):
    rng = random.Random(1)
    rows = [(rng.randrange(40), f"t{rng.randrange(12)}") for _ in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs, keep=keep, memtable=5).select("id", "keep_id", "group_size").collect()))
    by_text = collections.defaultdict(list)
    for i, t in rows:
        by_text[t].append(i)
    pick = max if keep == "max" else min
    assert got == sorted((i, pick(by_text[t]), len(by_text[t])) for i, t in rows)
    log = exact_dedup.DigestLog(shared.Scratch(spark, "t"), keep, memtable=5)
    log.flush(docs.select(F.col("text").cast("binary").alias("digest"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rid")))
    run = log.levels[0][0][1].withColumn("part", F.input_file_name()).collect()
    drops = sum(a.part != b.part or a.digest > b.digest for a, b in zip(run, run[1:], strict=False))
    assert drops >= 20  # sorted runs, one after another
    merged = [bytes(r.digest) for r in log.compact().collect()]
    assert len(merged) == len(set(merged)) == len(by_text)


def brute_counts(model, sequences):
    states = len(model.move)
    start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape), 0.0
    for s in sequences:
        n = len(s)
        ahead, back = np.zeros((n, states)), np.ones((n, states))
        ahead[0] = model.start[0] * model.emit[:, s[0]]
        for t in range(1, n):
            ahead[t] = (ahead[t - 1] @ model.move) * model.emit[:, s[t]]
        for t in range(n - 2, -1, -1):
            back[t] = model.move @ (model.emit[:, s[t + 1]] * back[t + 1])
        whole = ahead[-1].sum()
        total += math.log(whole)
        start += ahead[0] * back[0] / whole
        for t in range(n):
            emit[:, s[t]] += ahead[t] * back[t] / whole
            if t:
                move += ahead[t - 1][:, None] * model.move * (model.emit[:, s[t]] * back[t])[None, :] / whole
    return np.concatenate([start, move.ravel(), emit.ravel()]), total


@pytest.mark.parametrize("steps", [2, 3, 5, 8, 64])
def test_counts_are_those_of_whole_sequences(steps):
    rng = np.random.default_rng(0)
    model = hmm.Hmm.fresh(np.arange(1.0, 9.0), 3, noise=1.0, stay=0.6)
    sequences = [rng.integers(0, 8, n) for n in (1, 4, 5, 17, 33, 10, 3, 8, 9)]
    want, likelihood = brute_counts(model, sequences)
    got, found = hmm.expected_counts(model, *hmm.segments_of(sequences, steps))
    assert np.allclose(got, want, atol=1e-4) and abs(found - likelihood) < 1e-3


def test_scores_against_a_model_by_hand(spark):
    """The whole operator again in plain loops: classes, Baum-Welch, forward recursion and shares of classes."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "stvw" for b in ("ong", "ing", "est", "al")]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for k in range(60)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, DOCS), held, states=2, rounds=3, common=0.05, gain=0.0).collect()}
    tokens = {k: [*t.encode().split(), b""] for k, t in rows}
    training = [tokens[k] for k, _ in rows if zlib.crc32(str(k).encode()) % 10]
    counts = collections.Counter(w for ts in training for w in ts)
    total = sum(counts.values())
    often = sorted((w for w in counts if w and counts[w] >= max(1, math.ceil(total * 0.05))), key=lambda w: (-counts[w], lm_scoring.hash_of(w)))
    own = {w: k for k, w in enumerate(often[: lm_scoring.OWN])}
    class_of = lambda w: own.get(w, lm_scoring.ending_of(w))
    size, kinds = np.zeros(lm_scoring.CLASSES), np.zeros(lm_scoring.CLASSES)
    for w, n in counts.items():
        size[class_of(w)] += n
        kinds[class_of(w)] += 1
    model = hmm.Hmm.fresh(size, 2)
    sequences = [np.array([class_of(w) for w in ts]) for ts in training]
    for _ in range(3):
        model = model.maximised(brute_counts(model, sequences)[0])
    for k, ts in tokens.items():
        path = hmm.log10_likelihoods(model, [np.array([class_of(w) for w in ts])])[0]
        shares = sum(math.log10((counts[w] + 0.1) / (size[class_of(w)] + 0.1 * (kinds[class_of(w)] + 1))) for w in ts)
        assert abs(got[k] - path - shares) < 1e-3


def test_split_of_texts():
    import pyarrow as pa

    texts = ["  A b\tC ", "", "x\x0by\x0cz \n", "É é\x1cq", " "]
    lengths, places, words = lm_scoring.split_of(pa.array(texts))
    want = [re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode()) for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and [words[p] for p in places] == [w for ws in want for w in ws]


def test_long_texts_are_learnt_from_and_scored_in_windows(spark, monkeypatch):
    rng = random.Random(0)
    words = ["".join(rng.choice("abdeghiklmnorst") for _ in range(5)) for _ in range(300)]
    rows = []
    for k in range(240):  # only long texts are toxic, and hold the word once
        text = [rng.choice(words) for _ in range(1500 if k % 2 else 40)]
        if k % 4 == 1:
            text[rng.randrange(len(text))] = "vile"
        rows.append((k, " ".join(text), int(k % 4 == 1)))
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    model = toxicity.ToxicityModel.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    table = toxicity._WordTable(model.cnn)
    texts = [r[1] for r in rows[:60]] + ["", "vile"]
    whole, languages = toxicity.logits_and_languages(texts, table)
    score = 1 / (1 + np.exp(model.thresholds[languages] - whole))
    right = [(s >= 0.5) == bool(r[2]) for s, r in zip(score[:60], rows[:60], strict=True)]
    assert sum(right) >= 57
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    again, guessed = toxicity.logits_and_languages(texts, table)
    assert np.allclose(whole, again, atol=1e-5) and (languages == guessed).all()


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 20_000, raising=False)  # several shards, merged in several steps
    monkeypatch.setattr(toxicity, "MERGED_AT_ONCE", 2, raising=False)
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeghiklmnorst") for _ in range(5)) for _ in range(300)]
    order = [r.id for r in spark.range(7000).orderBy(F.xxhash64("id", F.lit(11)), "id").collect()]
    rows, seen = [], 0
    for k in order:  # the second word is only in toxic rows after the first 3,000 of that order
        text = [rng.choice(words) for _ in range(10)]
        if k % 2:
            text[rng.randrange(10)] = "vile" if seen < 3000 else "grubby"
            seen += 1
        rows.append((k, " ".join(text), k % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    model = toxicity.ToxicityModel.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), steps=100)
    texts = [(k, " ".join([*rng.sample(words, 9), word])) for k, word in enumerate(["grubby", "vile", "", "and"] * 25)]
    scored = model.scores(spark.createDataFrame(texts, DOCS), F.col("text"), [F.col("doc_id")], "doc_id long").collect()
    right = [(r.score >= 0.5) == (r.doc_id % 4 < 2) for r in scored]
    assert sum(right) >= 97


def test_classes_of_many_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * (k % 3)) for k in range(200)], DOCS)
    want = packing.pack(docs, tokenizer_path()).agg(F.countDistinct("sequence_id"), F.sum("length"), F.count("*")).first()
    monkeypatch.setattr(packing, "BUCKET_ROWS", 4)
    got = packing.pack(docs, tokenizer_path())
    assert tuple(got.agg(F.countDistinct("sequence_id"), F.sum("length"), F.count("*")).first()) == tuple(want)
    assert got.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fitted, _, stays = mixing.mix(docs, q_mixing.TARGETS, q_mixing.KEEP)
    text = F.coalesce("text", F.lit(""))
    sums = docs.filter(stays).select("source", "lang", mixing.topic_of(text).alias("topic"), mixing.tokens_of(text).alias("n"))
    sums = sums.groupBy("source", "lang", "topic").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in sums)
    values = {d: [v for v in dict.fromkeys(c[k] for c in fitted.cells)] for k, d in enumerate(mixing.DIMENSIONS)}
    for k, dimension in enumerate(mixing.DIMENSIONS):
        target = q_mixing.TARGETS.of(dimension)
        expected = {v: sum(c[3] * c[5] for c in fitted.cells if c[k] == v) for v in values[dimension]}
        whole = sum(expected.values())
        for value, share in target.items():
            if value in expected:
                assert abs(expected[value] / whole - share) < 0.003
                assert abs(sum(r.n for r in sums if r[k] == value) / total - share) < 0.02


def test_offsets_are_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 3]), f"{rng.randrange(40):02x}z{rng.randrange(3)}", rng.randrange(1, 9)) for _ in range(300)]
    rows = [(i, d, len(d) + int(d[:2], 16) % 7) for i, d, _ in rows]
    frame = spark.createDataFrame(rows, "page_id long, digest string, length long").withColumn("file", F.coalesce("page_id", F.lit(-1)))
    got = fixity.laid_out(frame, ["page_id", "digest"]).collect()
    for file in (-1, 3):
        want, at = [], 0
        for d, n in sorted((d, n) for i, d, n in rows if (-1 if i is None else i) == file):
            want.append((d, n, at))
            at += n
        assert sorted((r.digest, r.length, r.offset) for r in got if r.file == file) == sorted(want)
    monkey = fixity.LOT
    try:
        fixity.LOT = 2
        assert sorted(map(str, fixity.laid_out(frame, ["page_id", "digest"]).collect())) == sorted(map(str, got))
    finally:
        fixity.LOT = monkey


def texts_of(spark, htmls):
    rows = [(k, f"http://e.org/{k}", html) for k, html in enumerate(htmls)]
    return [r.text for r in sorted(html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_deep_markup(spark):
    deep = "<article>" + "<div>" * 5000 + "<p>deep {0}</p>" + "</div>" * 2500 + "after {0}"
    assert texts_of(spark, [deep.format(k) for k in range(4)]) == [f"deep {k}\nafter {k}" for k in range(4)]
    assert texts_of(spark, ["<div class=ad>" * 3000 + "x", "<form>" * 3000 + "y", "<nav>" * 3000 + "z"])[2] == ""


def test_repeated_groups_and_long_pages(spark):
    page = "<article><h1>T {0}</h1>" + "".join(f"<h2>h{k} {{0}}</h2><p>p{k}</p>" for k in range(2000)) + "</article>"
    texts = texts_of(spark, [page.format(k) for k in range(3)])
    assert texts[1].count("\n") == 4000 and texts[1].startswith("T 1\nh0 1\np0\n")
    folded = html_wrappers.wrapper_of(html_wrappers.tree_of(page.format(0)))[html_wrappers.CONTENT][0][html_wrappers.CONTENT]
    assert [n[html_wrappers.KEY] for n in folded] == ["h1", "h2", "p"] and folded[1][html_wrappers.REPEATED] and folded[2][html_wrappers.REPEATED]


def test_partners_rise():
    rng = random.Random(0)
    for n, kinds in ((10, 3), (300, 200), (300, 2), (900, 5000)):
        for _ in range(20):
            a, b = ([str(rng.randrange(kinds)) for _ in range(rng.randrange(n))] for _ in range(2))
            pairs = html_wrappers._partners(a, b)
            assert all(a[x] == b[y] for x, y in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_wrappers_do_not_depend_on_the_order_of_their_parts():
    pages = [f"<body><div class=a>{k}</div>{'<p>x</p>' * (k % 3)}<h2>y</h2></body>" for k in range(5)]
    import pyarrow as pa

    packed = [html_wrappers._packed(html_wrappers.wrapper_of(html_wrappers.tree_of(p))) for p in pages]
    one, two = (html_wrappers.merge_wrappers(pa.table({"host": ["h"] * 5, "wrapper": w})).column("wrapper")[0].as_py() for w in (packed, packed[::-1]))
    assert one == two


ODD = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,string>, key int, cid string"


def test_odd_rows_through_every_stage(spark):
    """Nulls, empty and long texts, repeated rows, a map column and names that the operators use themselves."""
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    tags = {"a": "b"}
    rows = [(None, None, None, None, None, None, 1, "c"), (1, "", "en", "src1", 0, tags, 2, "c"), (1, "", "en", "src1", 0, tags, 2, "c"), (2, long, "en", "src2", 5, tags, 3, "c"), (3, long, None, "src2", 5, {}, None, None)]
    rows += [(k, f"the quick text number {k} of several plain ones", "en", "src1", 9, tags, k, "d") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, ODD)
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before = held.collect()
        after = stage(spark, held, sf)
        if name != "packing":
            assert after.columns == docs.columns, name
            held = shared.Scratch(spark, "odd").save(after, name)
            assert 0 < held.count() <= len(rows)
        else:
            assert after.count() >= held.count()
        if name == "exact_dedup":
            assert held.groupBy(F.coalesce("text", F.lit(""))).count().filter("count > 1").count() == 0
            largest = {}
            for r in before:
                largest[r.text or ""] = max(largest.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
            assert {-1 if r.doc_id is None else r.doc_id for r in held.collect()} == set(largest.values())


def test_keep_one_with_a_map_column(spark):
    docs = spark.createDataFrame([(1, "a", {"x": 1}), (1, "a", {"x": 1}), (2, "a", {}), (3, None, None)], "doc_id long, text string, m map<string,int>")
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == [2, 3]
    assert [r.doc_id for r in exact_dedup.keep_one(docs.filter("doc_id = 1")).collect()] == [1]


def random_texts(n, words, seed=0):
    """Texts of words that are hardly ever repeated."""
    letters = np.random.default_rng(seed).integers(97, 123, (n, words, 7), np.uint8)
    letters[:, :, -1] = 32
    return [t.tobytes().decode() for t in letters]


def calls_of(work):
    """How many functions, Python's and built-in ones, are called in ``work``."""
    profile = cProfile.Profile()
    profile.runcall(work)
    return sum(s.callcount for s in profile.getstats())


def test_words_are_split_as_by_a_pattern(monkeypatch):
    rng = random.Random(0)
    texts = ["", "a", " ", "ΑΣ", "ΑΣ Β", "x_y"] + ["".join(rng.choice("abcdeéßİΣσ中_1٣ \n\t.-́\x00") for _ in range(rng.randrange(60))) for _ in range(2000)]
    want = [re.findall(r"\w+", t.lower()) for t in texts]
    of = None
    for piece in (1 << 16, 40, 8):  # words of several pieces too
        monkeypatch.setattr(text_cnn, "PIECE", piece)
        counts, packed = text_cnn.packed_words(texts, 1 << 15)
        assert counts.tolist() == [len(w) for w in want]
        seen = dict(zip([w for words in want for w in words], packed.tolist(), strict=True))
        assert [seen[w] for words in want for w in words] == packed.tolist()
        assert of in (None, seen)
        of = seen
    assert len(set(of.values())) > 0.98 * len(of)


def test_toxicity_calls_nothing_for_each_word():
    texts = random_texts(200, 300)
    model = text_cnn.TextCnn.fresh()
    table = toxicity._WordTable(model)
    toxicity.logits_and_languages(texts[:2], table)
    assert calls_of(lambda: toxicity.logits_and_languages(texts, table)) < 200 * 300 / 10
    rows = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["id", "text"])
    found = []
    assert calls_of(lambda: found.extend(toxicity._Features(model.buckets)(iter([rows])))) < 200 * 300 / 10
    found = pa.Table.from_batches(found).append_column("shard", pa.array([0] * 200, pa.int32()))
    dealt = toxicity._shard(found, pa.table({"id": range(200), "label": [k % 2 for k in range(200)]})).to_batches()
    assert calls_of(lambda: list(toxicity._Pass(model, 0, 1.0, 4, 0)(iter(dealt)))) < 4 * 200 * 20


def test_toxicity_memory_does_not_grow_with_a_batch():
    rows = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(random_texts(4000, 500))], ["doc_id", "__text"])
    cnn = text_cnn.TextCnn.average([text_cnn.TextCnn.fresh(seed=k) for k in range(3)])
    scores = toxicity._Scores(toxicity.ToxicityModel(cnn, np.zeros(len(toxicity.LANGUAGES))))
    list(scores(iter([rows.slice(0, 2)])))
    tracemalloc.start()
    got = list(scores(iter([rows])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 4000 and most < 60e6


KEPT = """
import re, sys
import numpy as np, pyarrow as pa
from quillmill.llm import text_cnn, toxicity

def held():
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def work(docs):
    rng = np.random.default_rng(0)
    words = [pa.array([w.tobytes()], pa.binary()) for w in rng.integers(0, 300_000, (docs, 1000))]
    ids = pa.array(range(docs))
    rows = pa.table({"shard": pa.array([0] * docs, pa.int32()), "id": ids, "n": [1000] * docs, "words": pa.chunked_array(words)})
    shard = toxicity._shard(rows, pa.table({"id": ids, "label": pa.array([k % 2 for k in range(docs)], pa.int32())}))
    assert shard["n"].to_pylist() == [1000 * docs] and shard["codes"].nbytes >= 1500 * docs
    return shard

work(20)
before = held()
work(3000)
work(20)
print(held() - before)
"""


def test_toxicity_shard_is_read_as_it_was_written():
    words = [[5, 3, 5, 70_000, 3], [], [9, 5], list(range(200_000, 270_000)), []]
    rows = pa.table({"shard": pa.array([7] * 5, pa.int32()), "id": [4, 2, 9, 1, 3], "n": [len(w) for w in words], "words": [np.array(w, np.int64).tobytes() for w in words]})
    for chosen in ([4, 2, 9, 1], [2, 3]):  # the last is all empty texts
        held = pa.table({"id": chosen, "label": pa.array([k % 2 for k in range(len(chosen))], pa.int32())})
        dealt = toxicity._shard(rows, held)
        [(shard, texts, labels)] = toxicity._documents(iter(dealt.to_batches()))
        by_id = dict(zip([4, 2, 9, 1, 3], words, strict=True))
        label = dict(zip(chosen, held["label"].to_pylist(), strict=True))
        got = [texts.vocabulary[texts.codes[end - n : end]].tolist() for n, end in zip(texts.lengths, texts.ends, strict=True)]
        assert shard == 7 and got == [by_id[k] for k in sorted(chosen)] and labels.tolist() == [label[k] for k in sorted(chosen)]
        assert dealt["codes"].nbytes < 4 * len(texts.codes) + 64


@pytest.mark.skipif(sys.platform != "linux", reason="memory is read from /proc")
def test_toxicity_shard_gives_its_memory_back():
    """A Python worker outlives its task: what a large shard took and a small one after it leaves is missing to later stages."""
    root = Path(__file__).parents[2]
    ran = subprocess.run([sys.executable, "-c", KEPT], cwd=root, capture_output=True, text=True, timeout=120, check=False)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 40
