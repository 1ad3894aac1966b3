"""Packing, toxicity, language model and mixing: round trips, held-out accuracy, brute force, odd cases."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import hmm, lm_scoring, mixing
from quillmill.llm.cutting_stock import best_filling, plan
from quillmill.llm.packing import encoder, pack
from quillmill.llm.q_packing import tokenizer_path
from quillmill.llm.toxicity import ToxicityModel, without_toxic

DOCS = "doc_id long, text string, lang string, source string"


def invented(n, seed=0, bad="vile"):
    """Texts of invented words; a tenth hold a form of ``bad`` and are marked."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(3, 80))]
        toxic = rng.random() < 0.2
        for _ in range(toxic * rng.randrange(1, 3)):
            text.insert(rng.randrange(len(text)), bad + rng.choice(["", "ly", "st", "ness", "zo"]))
        rows.append((k, " ".join(text), "en", f"s{k % 3}", int(toxic)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_demand(seed):
    rng = random.Random(seed)
    demand = collections.Counter(rng.randrange(1, 65) for _ in range(rng.choice([1, 40, 3000])))
    patterns = plan(dict(demand), 64)
    held = collections.Counter()
    for p in patterns:
        assert sum(s * c for s, c in zip(p.sizes, p.counts, strict=True)) <= 64 and p.times > 0
        for s, c in zip(p.sizes, p.counts, strict=True):
            held[s] += c * p.times
    assert held == demand
    bins, least = sum(p.times for p in patterns), math.ceil(sum(s * n for s, n in demand.items()) / 64)
    assert bins <= least * 1.03 + 2
    assert plan({}, 64) == []
    with pytest.raises(ValueError):
        plan({65: 1}, 64)


def test_best_filling_against_all():
    sizes, prices = np.array([3, 5, 7]), np.array([0.31, 0.52, 0.74])
    value, counts = best_filling(prices, sizes, 20)
    every = max(sum(p * c for p, c in zip(prices, cs, strict=True)) for cs in itertools.product(range(7), range(5), range(3)) if sum(s * c for s, c in zip(sizes, cs, strict=True)) <= 20)
    assert abs(value - every) < 1e-9 and abs(counts @ prices - every) < 1e-9 and counts @ sizes <= 20


def test_encoder_gives_the_ids_of_tokenizers():
    own = encoder(tokenizer_path())
    texts = ["", " ", "Hello  world\n\n\t x", "éàü ß ñ 中文 🙂‍↔️", "a" * 3000, " " * 500 + "x", "don't <|endoftext|> stop", "\x00\x7f​", "1234567890 ½", *(r[1] for r in invented(200))]
    for text in texts:
        assert own.ids(text).tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["the", "of", "walking", "éclair", "x1"]) for _ in range(rng.choice([1, 20, 300, 3000]))) for _ in range(150)]
    rows = [(k % 140, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (None, "null id"), (0, texts[0]), (502, "word " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "size": F.lit(2), "pid": F.lit(3), "rank": F.lit(4)})
    got = pack(docs, tokenizer_path()).collect()
    own = encoder(tokenizer_path())
    want = collections.Counter()
    for doc_id, text in rows:
        ids = np.append(own.ids(text or ""), np.uint32(1)).astype("<u4")
        for low in range(0, len(ids), 2048):
            want[doc_id, low, len(ids[low : low + 2048]), zlib.crc32(ids[low : low + 2048].tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    used = sum(r.length for r in got)
    assert len(sequences) * 2048 <= used * 1.03 + 4096
    assert pack(docs.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        pack(docs, tokenizer_path(), grain=7)


def test_toxicity_on_held_out_rows(spark):
    rows = invented(1500)
    docs = spark.createDataFrame([r[:4] for r in rows], DOCS).withColumns({"score": F.lit(1.0), "words": F.lit(1), "label": F.lit(1)})
    labels = spark.createDataFrame([(r[0], 0, r[4]) for r in rows] + [(5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = ToxicityModel.fit(docs, labels, usable=F.col("id") % 5 != 0)
    scored = {r.doc_id: r.score for r in model.scores(docs, F.col("text"), [F.col("doc_id")], "doc_id long").collect()}
    unseen = [r for r in rows if r[0] % 5 == 0]
    right = [(scored[r[0]] >= 0.5) == bool(r[4]) for r in unseen]
    assert sum(right) / len(right) >= 0.97
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s < 0.5}


def test_toxicity_odd_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "xx", None), (2, "word " * 50_000, None, None), (None, "a", None, None), (3, "vile " * 9, None, None)], DOCS)
    for labels in ([], [(1, 1), (2, 1)], [(1, None)], [(1, 0), (2, 1), (2, 0), (9, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = ToxicityModel.fit(docs, table)
        got = model.scores(docs, F.col("text"), [F.col("doc_id")], "doc_id long").collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert model.scores(docs.limit(0), F.col("text"), [F.col("doc_id")], "doc_id long").count() == 0
        if len({v for _, v in labels if v is not None}) < 2:
            assert all(r.score < 0.5 for r in got)


def test_a_text_scores_alike_alone_and_in_a_batch(spark):
    rows = invented(300, 2)
    docs = spark.createDataFrame([r[:4] for r in rows], DOCS)
    model = ToxicityModel.fit(docs, spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int"), epochs=1, steps=1)
    from quillmill.llm.toxicity import _WordTable, logits_and_languages

    texts = [r[1] for r in rows[:50]] + ["", "x"]
    together, _ = logits_and_languages(texts, _WordTable(model.cnn))
    alone = [logits_and_languages([t], _WordTable(model.cnn))[0][0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def brute_likelihood(model, sequence):
    total = 0.0
    states = range(model.move.shape[0])
    for path in itertools.product(states, repeat=len(sequence)):
        p = model.start[0][path[0]] * model.emit[path[0], sequence[0]]
        for t in range(1, len(sequence)):
            p *= model.move[path[t - 1], path[t]] * model.emit[path[t], sequence[t]]
        total += p
    return math.log10(total)


def test_forward_is_exact():
    model = hmm.Hmm.fresh(np.arange(1.0, 7.0), 3, noise=1.0, stay=0.6)
    rng = np.random.default_rng(0)
    sequences = [rng.integers(0, 6, n) for n in (1, 4, 6, 2, 6)]
    assert np.allclose(hmm.log10_likelihoods(model, sequences), [brute_likelihood(model, s) for s in sequences])
    assert np.isfinite(hmm.log10_likelihoods(model, [rng.integers(0, 6, 50_000)])).all()


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    sequences = [np.where(rng.random(200) < 0.9, rng.integers(0, 4, 200) + 4 * (k % 2), rng.integers(0, 8, 200)) for k in range(40)]
    model = hmm.Hmm.fresh(np.ones(8), 2)
    seen = []
    for _ in range(8):
        counts, likelihood = hmm.expected_counts(model, *hmm.segments_of(sequences, 64))
        seen.append(likelihood)
        model = model.maximised(counts)
    assert all(b >= a - 1 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 500
    counts, _ = hmm.expected_counts(model, *hmm.segments_of(sequences, 64))
    assert abs(counts[model.start.size + model.move.size :].sum() - 8000) < 1


def test_language_model_against_brute_force(spark):
    rows = [(k, t) for k, t, *_ in invented(120)] + [(500, None), (501, ""), (502, "ÀB c\x0bD e f "), (None, "new words here"), (3, "again again"), (504, "z " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit(1), "n": F.lit(2), "rid": F.lit(3), "classes": F.lit("x")})
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = lm_scoring.score_texts(docs, held, states=3, rounds=2, common=0.01).collect()

    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        import re

        return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]

    training = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(w for t in training for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        ws = words(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(math.isfinite(r.score) and r.score < 0 for r in got) and unseen
    alone = lm_scoring.score_texts(docs, F.lit(True), states=2).collect()
    assert {r.train_tokens for r in alone} == {0} and {r.n_known for r in alone} == {0}
    assert lm_scoring.score_texts(docs.limit(0), held).count() == 0


def test_word_probabilities_sum_to_one():
    """The model's word distribution: classes by state, then smoothed shares of known words and one unknown."""
    vocabulary = lm_scoring.Vocabulary(np.array([], np.int64), np.array([]), {}, np.array([6.0, 0.0, 3.0]), np.array([2.0, 0.0, 1.0]))
    shares = 10 ** -vocabulary.class_logs()
    counts = [[4, 2], [], [3]]
    for k, held in enumerate(counts):
        assert abs(sum((c + 0.1) * shares[k] for c in held) + 0.1 * shares[k] - 1) < 1e-9


def test_raking_meets_marginals():
    rng = np.random.default_rng(0)
    cube = rng.integers(1, 100, (4, 3, 2)).astype(float)
    marginals = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2]), np.array([0.9, 0.1])]
    weights = mixing.rake(cube, marginals)
    for axis, want in enumerate(marginals):
        assert np.allclose(weights.sum(axis=tuple(a for a in range(3) if a != axis)), want)


def test_raking_within_what_cells_have():
    cube = np.random.default_rng(1).integers(1, 100, (4, 3, 2)).astype(float)
    cube[0] *= 9
    marginals = [np.full(4, 0.25), np.array([0.5, 0.3, 0.2]), np.array([0.8, 0.2])]
    kept = cube * mixing.rake_within(cube, mixing.rake(cube, marginals), 0.5)
    assert (kept <= cube).all() and kept.sum() > 0
    for axis, want in enumerate(marginals):
        assert np.allclose(kept.sum(axis=tuple(a for a in range(3) if a != axis)) / kept.sum(), want, atol=0.003)


def test_mix_meets_targets_that_ask_for_more_than_cells_have(spark):
    rows = [(k, "w " * 50, "en" if k % 10 else "de", "big" if k % 3 else "small") for k in range(3000)]
    targets = mixing.Targets(source={"big": 0.5, "small": 0.5}, lang={"en": 0.7, "de": 0.3})
    fitted, _, _ = mixing.mix(spark.createDataFrame(rows, DOCS), targets, keep=0.9)
    kept = {c[:3]: c[3] * c[5] for c in fitted.cells}
    assert abs(sum(n for c, n in kept.items() if c[1] == "de") / sum(kept.values()) - 0.3) < 0.01


def test_mixing(spark):
    rows = [(k, "w " * 50, "en" if k % 4 else "de", "big" if k % 3 else "small") for k in range(6000)]
    rows += [(None, "a b", None, None), (1, None, "en", "big"), (1, "", "xx", "new")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tokens": F.lit(9), "probability": F.lit(1)})
    targets = mixing.Targets(source={"big": 0.4, "small": 0.6}, lang={"en": 0.7, "de": 0.3}, topic={"short": 1.0})
    fitted, probability, stays = mixing.mix(docs, targets, keep=0.3)
    kept = docs.filter(stays).collect()
    assert abs(len(kept) - 1800) < 150
    assert abs(sum(r.source == "small" for r in kept) / len(kept) - 0.6) < 0.04 and abs(sum(r.lang == "de" for r in kept) / len(kept) - 0.3) < 0.04
    assert sorted(map(str, docs.filter(stays).collect())) == sorted(map(str, kept))
    assert len(fitted.cells) <= 3 * 3 * 2
    assert docs.select(probability).filter("probability IS NULL").count() == 0
    empty = docs.limit(0)
    assert empty.filter(mixing.mix(empty, targets)[2]).count() == 0
