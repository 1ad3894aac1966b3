"""Toxicity of documents: a convolutional text classifier whose thresholds are calibrated by language.

The classifier (see text_cnn) learns from every labelled row, whatever their number: the rows are dealt into shards of about
SHARD_WORDS words, each pass trains on all shards side by side, from the same parameters, and the shards' parameters are
averaged before the next pass. The networks' mean logits of all labelled rows calibrate the thresholds. Scores read the
text alone. The language that picks a threshold is guessed from the text's own function words, known by their features.
A threshold that was calibrated to t maps to the score 0.5: score = 1 / (1 + exp(t - logit)).
Scoring is a map over the rows without a shuffle; a filter's largest response in a text is the largest of those in its
windows, so that memory is bounded for texts of any length; a batch is read ROWS_AT_ONCE rows at a time. What a batch or
a shard took is given back to the system after it.

Defined results. A null text counts as empty; an empty text has a score like any other. Texts of any length are learnt
from and read whole. Rows without a usable label (null, or none at all) are not learnt from; if no label of one class remains, every
score is the logit of the untrained part, below 0.5. Repeated labels of one document count as toxic if any is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import DigestFilter, Scratch, crc_of_id, give_back, text_or_empty
from .text_cnn import GAP, PLACES, STRETCH, TextCnn, Texts, batches_of, packed_words, peaks, train

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by at from or an not have",
    "fr": "le la les des et en un une du que qui est pour dans par sur au avec pas ce aux ne se",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
WORDS_AT_ONCE = 50_000
CHARACTERS_AT_ONCE = 400_000
ROWS_AT_ONCE = 256
SHARD_WORDS = 4_000_000
MERGED_AT_ONCE = 64
PART_ROWS = 512

class _WordTable:
    """What scoring looks up: the network, and the function words' features with their votes for languages."""

    def __init__(self, model: TextCnn):
        self.model = model
        votes: dict[str, np.ndarray] = {}
        for k, words in enumerate(FUNCTION_WORDS.values()):
            for word in words.split():
                votes.setdefault(word, np.zeros(len(LANGUAGES), np.float32))[k] = 1
        packed = packed_words(list(votes), model.buckets)[1]
        order = np.argsort(packed)
        self.packed = packed[order]
        self.votes = np.stack(list(votes.values()))[order]

    def voted(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The votes for each language among the words of each text, which are given one after another."""
        at = np.minimum(np.searchsorted(self.packed, words), len(self.packed) - 1)
        some = np.flatnonzero(self.packed[at] == words)
        text = np.searchsorted(np.cumsum(counts), some, side="right")
        own = [np.bincount(text, self.votes[at[some], k], len(counts)) for k in range(len(LANGUAGES))]
        return np.stack(own, axis=1)


def logits_and_languages(texts: list[str], table: _WordTable) -> tuple[np.ndarray, np.ndarray]:
    """For each text its logit and the number of its guessed language in LANGUAGES."""
    model = table.model
    largest = np.zeros((len(texts), len(model.out)), np.float32)  # responses are never below zero
    votes = np.zeros((len(texts), len(LANGUAGES)))
    owners: list[int] = []
    windows: list[np.ndarray] = []
    lengths: list[int] = []  # without the words that filters at a window's end look ahead to
    held = 0

    def look() -> None:
        vocabulary, codes = np.unique(np.concatenate(windows), return_inverse=True)
        laid = Texts(vocabulary, codes, np.array([len(w) for w in windows]))
        features, words, starts, spans = laid.laid_out(np.arange(len(windows)), model.buckets)
        own = np.maximum(lengths, 1)
        ahead = np.concatenate([np.arange(s + n, s + m) for s, n, m in zip(starts, own, spans, strict=True) if m > n] or [np.zeros(0, np.int64)])
        hidden, _ = peaks(model, model.vectors(features), words, starts, spans, min(PLACES, WORDS_AT_ONCE), places=False, void=ahead)
        np.maximum.at(largest, owners, hidden)
        for used in (owners, windows, lengths):
            used.clear()

    low = 0
    while low < len(texts):
        high, size = low + 1, len(texts[low])
        while high < len(texts) and size + len(texts[high]) <= CHARACTERS_AT_ONCE:
            size += len(texts[high])
            high += 1
        counts, found = packed_words(texts[low:high], model.buckets)
        votes[low:high] = table.voted(counts, found)
        for k, (n, end) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True), low):
            for at in range(end - n, max(end, end - n + 1), WORDS_AT_ONCE):
                own = min(WORDS_AT_ONCE, end - at)
                if windows and held + own > WORDS_AT_ONCE:
                    look()
                    held = 0
                owners.append(k)
                lengths.append(own)
                windows.append(found[at : min(at + own + GAP, end)])
                held += own
        low = high
    if windows:
        look()
    votes[:, -1] = 0.5
    return (largest @ model.out + model.out_bias).astype(np.float64), votes.argmax(axis=1)


def thresholds_by_language(logits: np.ndarray, languages: np.ndarray, labels: np.ndarray, least: int = 20) -> np.ndarray:
    """For each language the logit at which most labels are right, in the middle of the widest such gap.

    A language with fewer than ``least`` labels of either class takes the threshold of all.
    """

    def best(x: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order].astype(float)
        wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
        low, high = np.r_[x[0] - 2, x], np.r_[x, x[-1] + 2]
        wide = np.where(wrong <= wrong.min() + 1e-9, high - low, -1)
        k = int(wide.argmax())
        return float((low[k] + high[k]) / 2)

    if not len(labels) or labels.min() == labels.max():
        return np.zeros(len(LANGUAGES))
    out = np.full(len(LANGUAGES), best(logits, labels))
    for k in range(len(LANGUAGES)):
        own = languages == k
        if min((labels[own] > 0).sum(), (labels[own] <= 0).sum()) >= least:
            out[k] = best(logits[own], labels[own])
    return out


@dataclass(frozen=True)
class ToxicityModel:
    cnn: TextCnn
    thresholds: np.ndarray

    @staticmethod
    def fit(
        docs: DataFrame,
        labels: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        label_col: str = "toxic",
        usable: Column | None = None,
        epochs: int = 8,
        steps: int = 400,
        networks: int = 3,
    ) -> ToxicityModel:
        """Learn from all labelled documents that ``docs`` holds.

        ``usable`` is a condition on the id. Training takes ``epochs`` passes, and more until a shard has taken ``steps``
        steps, but not over 60 passes. ``networks`` start from different weights, and their logits are averaged. All
        rows train every network and calibrate the thresholds.
        """
        scratch = Scratch(docs.sparkSession, "toxicity")
        held = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).dropna()
        if usable is not None:
            held = held.filter(usable)
        held = held.groupBy("id").agg(F.max("label").alias("label")).filter(F.col("label").isin(0, 1))
        held = scratch.save(held, "held")
        digest = F.unhex(F.md5(F.col("id").cast("string").cast("binary")))
        labelled = DigestFilter(held.select(digest.alias("digest")), held.count())  # others aren't read on
        rows = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs[text_col]).alias("text"))
        models = [TextCnn.fresh(seed=k) for k in range(networks)]
        found = rows.filter("id IS NOT NULL").filter(labelled.may_hold(digest)).mapInArrow(_Features(models[0].buckets), "id long, n long, words binary")
        found = scratch.save(found, "features", compression="zstd")
        shards = math.ceil((found.agg(F.sum("n")).first()[0] or 0) / SHARD_WORDS) or 1
        shard = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(shards)).cast("int").alias("shard")
        by_shard = [rows.select(shard, "*").groupBy("shard") for rows in (found, held)]
        dealt = by_shard[0].cogroup(by_shard[1]).applyInArrow(_shard, SHARD)
        dealt = scratch.save(dealt, "shards", maxRecordsPerFile="1", compression="uncompressed")  # codes are compressed already
        scratch.drop("features")
        words, *by_label = (v or 0 for v in dealt.agg(*(F.sum(c) for c in ("n", "clean", "toxic"))).first())
        if not all(by_label):
            scratch.close()
            models[0].out[:] = 0
            models[0].out_bias = -4.0
            return ToxicityModel(models[0], np.zeros(len(LANGUAGES)))
        a_pass = max(sum(by_label) / 64, words / STRETCH) / shards
        passes = min(60, max(epochs, math.ceil(steps / max(1, a_pass))))
        weight = min(20.0, max(1.0, by_label[0] / by_label[1]))
        for k in range(passes if shards > 1 else 1):  # one shard takes all its passes in a task
            models = _averaged(dealt, shards, [_Pass(m, n, weight, 1 if shards > 1 else passes, k) for n, m in enumerate(models)])
        model = TextCnn.average(models)
        scored = dealt.mapInArrow(_Logits(model), "logit double, language int, label int").toArrow()  # 16 bytes a labelled row
        scratch.close()
        scored = scored.sort_by([("logit", "ascending"), ("label", "ascending")])
        logits, languages, y = (scored.column(n).to_numpy() for n in ("logit", "language", "label"))
        return ToxicityModel(model, thresholds_by_language(logits, languages, y))

    def scores(self, docs: DataFrame, text: Column, keep: list[Column], schema: str) -> DataFrame:
        """``keep`` (as ``schema`` says) and score double for each row."""
        rows = docs.select(*keep, text_or_empty(text).alias("__text"))
        return rows.mapInArrow(_Scores(self), f"{schema}, score double")

    def scorer(self):
        """A Column function from text to score."""
        score = _Scores(self)

        @F.arrow_udf("double")
        def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = _WordTable(score.model.cnn)
            for batch in texts:
                yield pa.array(score.of(batch, table))
                give_back()

        return scored


@dataclass(frozen=True)
class _Features:
    """Batches of (id, text) to the number of words and the words, each its features in 64 bits."""

    buckets: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                counts, words = packed_words(texts.slice(low, ROWS_AT_ONCE).to_pylist(), self.buckets)
                own = pa.array([w.tobytes() for w in np.split(words, np.cumsum(counts)[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(low, ROWS_AT_ONCE), pa.array(counts), own], ["id", "n", "words"])
            give_back()


SHARD = "shard int, n long, clean long, toxic long, lengths binary, labels binary, vocabulary binary, codes binary"
_SHARD_TYPES = [("shard", pa.int32()), *((n, pa.int64()) for n in ("n", "clean", "toxic")), *((n, pa.binary()) for n in ("lengths", "labels", "vocabulary", "codes"))]
PARAMETERS = "network int, part int, shard int, ids binary, weights binary, values binary"


def _shard(rows: pa.Table, held: pa.Table) -> pa.Table:
    """One row of a shard's labelled documents, in the order of id and words."""
    ids, own = rows.column("id").to_numpy(), held.column("id").to_numpy()
    by_id = np.argsort(own)
    labelled = np.flatnonzero(np.isin(ids, own))
    order = pc.sort_indices(rows, [("id", "ascending"), ("words", "ascending")]).to_numpy()
    order = order[np.isin(order, labelled)]
    if not len(order):
        return pa.Table.from_batches([], pa.schema(_SHARD_TYPES))
    found = [w.as_buffer() for w in rows.column("words")]
    words = [np.frombuffer(found[k], np.int64) for k in order]
    lengths = np.array([len(w) for w in words], np.int64)
    parts = []
    for low in range(0, len(words), 256):  # a part at a time, for the memory
        some, number = np.unique(np.concatenate(words[low : low + 256]), return_inverse=True)
        parts.append((some, number.astype(np.int32)))
    vocabulary = np.unique(np.concatenate([some for some, _ in parts]))
    codes, at = np.empty(lengths.sum(), np.int32), 0
    for k, (some, number) in enumerate(parts):
        codes[at : at + len(number)] = np.searchsorted(vocabulary, some)[number]
        at += len(number)
        parts[k] = None
    labels = held.column("label").to_numpy()[by_id][np.searchsorted(own[by_id], ids[order])].astype(np.int8)
    values = [rows.column("shard")[0].as_py(), len(codes), int((labels == 0).sum()), int((labels == 1).sum())]
    columns = [*(pa.array([v], t) for (_, t), v in zip(_SHARD_TYPES, values, strict=False)), *(_whole(c) for c in (lengths, labels, vocabulary, _squeezed(codes)))]
    give_back()
    return pa.Table.from_arrays(columns, [n for n, _ in _SHARD_TYPES])


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Codes compressed, all their lowest bytes first: every pass takes them through the JVM again."""
    planes = np.ascontiguousarray(codes.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return np.frombuffer(pa.compress(pa.py_buffer(planes), codec="zstd"), np.uint8)


def _codes(squeezed: pa.Buffer, n: int) -> np.ndarray:
    """``n`` codes that _squeezed has compressed."""
    planes = np.frombuffer(pa.decompress(squeezed, 4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _whole(values: np.ndarray) -> pa.Array:
    """An array's bytes as one binary value, without a copy."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, values.nbytes], np.int32)), pa.py_buffer(values)])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts, np.ndarray]]:
    """Shards as (number, texts, labels)."""
    types = {"lengths": np.int64, "labels": np.int8, "vocabulary": np.int64}
    for batch in batches:
        for k in range(batch.num_rows):
            lengths, labels, packed = (np.frombuffer(batch.column(n)[k].as_buffer(), t) for n, t in types.items())
            codes = _codes(batch.column("codes")[k].as_buffer(), int(lengths.sum()))
            yield batch.column("shard")[k].as_py(), Texts(packed, codes, lengths), labels
            give_back()


@dataclass(frozen=True)
class _Pass:
    """Shards to how training on each moves a network's parameters, in 16 bits: parts of the embedding, and part -1."""

    model: TextCnn
    network: int
    toxic_weight: float
    passes: int
    number: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts, labels in _documents(batches):
            seed = [self.network, shard, self.number]
            model, moved = train(self.model, texts, labels.astype(np.float64), self.toxic_weight, self.passes, seed=seed)
            parts = [(-1, np.zeros(1, np.int32), model.dense() - self.model.dense())]
            ids = np.flatnonzero(moved).astype(np.int32)
            for part in np.unique(ids // PART_ROWS).tolist():
                own = ids[ids // PART_ROWS == part]
                parts.append((part, own, model.embedding[own] - self.model.embedding[own]))
            columns = [
                pa.array([self.network] * len(parts), pa.int32()),
                pa.array([p for p, _, _ in parts], pa.int32()),
                pa.array([shard] * len(parts), pa.int32()),
                pa.array([i.tobytes() for _, i, _ in parts], pa.binary()),
                pa.array([np.full(len(i), float(len(labels))).tobytes() for _, i, _ in parts], pa.binary()),
                pa.array([v.astype(np.float16).tobytes() for _, _, v in parts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["network", "part", "shard", "ids", "weights", "values"])


def _merger(kind: type, at_once: int):
    return lambda rows: _merged(rows, kind, at_once)


def _merged(rows: pa.Table, kind: type, at_once: int) -> pa.Table:
    """Of one part of a network the mean over shards, by their rows; of an embedding's row over those that moved it."""
    rows = rows.sort_by("shard")
    ids, weights = (np.concatenate([np.frombuffer(b.as_buffer(), t) for b in rows.column(n)]) for n, t in (("ids", np.int32), ("weights", np.float64)))
    values = np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in rows.column("values")]).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, weights, values = ids[order], weights[order], values[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    total = np.add.reduceat(weights, first)
    mean = np.add.reduceat(values * weights[:, None], first, axis=0) / total[:, None]
    out = {n: rows.column(n).slice(0, 1) for n in ("network", "part")}
    out["shard"] = pa.array([rows.column("shard")[0].as_py() // at_once], pa.int32())
    for name, value in (("ids", ids[first]), ("weights", total), ("values", mean.astype(np.float32))):
        out[name] = pa.array([value.tobytes()], pa.binary())
    return pa.table(out)


def _averaged(dealt: DataFrame, shards: int, passes: list[_Pass]) -> list[TextCnn]:
    """The networks after a pass over all shards, which are merged MERGED_AT_ONCE at a time."""
    trained = None
    for one in passes:
        found = dealt.mapInArrow(one, PARAMETERS)
        trained = found if trained is None else trained.unionByName(found)
    kind = np.float16
    while True:
        trained = trained.groupBy("network", "part", (F.col("shard") / MERGED_AT_ONCE).cast("int").alias("of")).applyInArrow(_merger(kind, MERGED_AT_ONCE), PARAMETERS)
        kind = np.float32
        shards = math.ceil(shards / MERGED_AT_ONCE)
        if shards == 1:
            break
    models = [p.model.copy() for p in passes]
    for r in trained.collect():  # as many as a network has parts
        values = np.frombuffer(r["values"], np.float32)
        if r.part < 0:
            models[r.network].set_dense(models[r.network].dense() + values)
        else:
            ids = np.frombuffer(r.ids, np.int32)
            models[r.network].embedding[ids] += values.reshape(len(ids), -1)
    return models


@dataclass(frozen=True)
class _Logits:
    """Shards to a row for each document: its logit, its guessed language and its label."""

    model: TextCnn

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = self.model, _WordTable(self.model)
        for _, texts, labels in _documents(batches):
            for chosen in batches_of(texts.lengths, np.arange(len(labels))):
                features, words, starts, lengths = texts.laid_out(chosen, model.buckets)
                hidden, _ = peaks(model, model.vectors(features), words, starts, lengths, places=False)
                logits = (hidden @ model.out + model.out_bias).astype(np.float64)
                counts = texts.lengths[chosen]
                own = texts.codes[texts.ends[chosen[0]] - counts[0] : texts.ends[chosen[-1]]]
                votes = table.voted(counts, texts.vocabulary[own])
                votes[:, -1] = 0.5
                columns = [pa.array(logits), pa.array(votes.argmax(axis=1), pa.int32()), pa.array(labels[chosen], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["logit", "language", "label"])


@dataclass(frozen=True)
class _Scores:
    model: ToxicityModel

    def of(self, texts: pa.Array, table: _WordTable) -> np.ndarray:
        parts = [logits_and_languages([t or "" for t in texts.slice(low, ROWS_AT_ONCE).to_pylist()], table) for low in range(0, len(texts), ROWS_AT_ONCE)]
        logits, languages = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, np.int64))
        return 1 / (1 + np.exp(np.clip(self.model.thresholds[languages] - logits, -50, 50)))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordTable(self.model.cnn)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "__text"]
            scores = self.of(batch.column("__text"), table)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores)], [*names, "score"])
            give_back()


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    return docs.filter(model.scorer()(docs[text_col]) < 0.5)


def held_out(id_column: Column, folds: int = 5) -> Column:
    return F.coalesce(crc_of_id(id_column) % folds == 0, F.lit(False))
