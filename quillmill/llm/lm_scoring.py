"""Language-model scores of documents: a hidden Markov model over word classes, and a unigram base score.

1. Counts of all training tokens are summed in each task, then by token over the cluster.
2. The commonest tokens have a class of their own; the others are classed by their last bytes. A token's probability
   is that of its class times its smoothed share of the class, so that the model is a proper distribution over words.
3. The model's states are trained by Baum-Welch: every task sums expected counts over its whole documents, and the sums
   by parameter make the next model. Its size is fixed; the counts cover all training documents each round. Training
   ends when a round raises the likelihood by less than a share of it, or after the most rounds.
4. A document's likelihood is computed exactly by the scaled forward recursion over the whole document.

Counts of tokens that make up a share of at least ``common`` of the corpus (so at most 1 / common of them) go to
every task; the other tokens of documents are joined with the counts table by hash.

Tokens are told apart by 64-bit hashes. Defined results. A null text counts as empty and has the end token alone.
Rows without an identifier are training rows. Repeated rows are scored each. Without training tokens every token is
unknown. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hmm import Hmm, expected_counts, log10_likelihoods, segments_of
from .shared import Scratch, text_or_empty

END = b""
#: Own classes, classes by ending, and the end token's class.
OWN, ENDINGS = 256, 255
CLASSES = OWN + ENDINGS + 1
HELD_WORDS = 300_000
#: Steps of a segment, see hmm, and tokens that are trained at once.
STEPS = 2048
TOKENS_AT_ONCE = 4_000_000
BYTES_AT_ONCE = 1 << 22


def split_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Texts' tokens as A-Z in lower case, parted by white space of ASCII: (tokens of each text, places in the list of
    distinct tokens, that list). End tokens are left to the caller."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, lengths = words.flatten(), pc.list_value_length(words).to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0)  # white space at the ends makes empty parts
    if not pc.all(some, min_count=0).as_py():
        owner = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(lengths))
        flat = flat.filter(some)
    coded = flat.dictionary_encode()
    return lengths.astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part has about BYTES_AT_ONCE of text."""
    sizes = pc.binary_length(batch.column(column)).to_numpy()
    low, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        held += size
        if held >= BYTES_AT_ONCE or k == len(sizes) - 1:
            yield batch.slice(low, k + 1 - low)
            low, held = k + 1, 0


def hash_of(token: bytes) -> int:
    """64 bits, signed."""
    value = xxhash.xxh3_64_intdigest(token)
    return value - (1 << 64) if value >> 63 else value


def ending_of(token: bytes) -> int:
    return OWN + zlib.crc32(token[-3:]) % ENDINGS if token else CLASSES - 1


@dataclass(frozen=True)
class CountTokens:
    """Batches of texts to (hash, ending, n), summed within the task."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in parts_of(batch, 0):
                lengths, places, words = split_of(part.column(0))
                counts.update(dict(zip(words, np.bincount(places, minlength=len(words)).tolist(), strict=True)))
                counts[END] += len(lengths)
                if len(counts) > HELD_WORDS:
                    yield self._flushed(counts)
                    counts = Counter()
        if counts:
            yield self._flushed(counts)

    def _flushed(self, counts: Counter) -> pa.RecordBatch:
        words = counts.keys()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(map(hash_of, words), pa.int64()), pa.array(map(ending_of, words), pa.int32()),
                pa.array(counts.values(), pa.int64()),
            ],
            ["hash", "ending", "n"],
        )


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows: counts of the common tokens, by sorted hash, and the tokens with a class of their own."""

    hashes: np.ndarray
    counts: np.ndarray
    own: dict[int, int]
    class_tokens: np.ndarray
    class_kinds: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def kinds(self) -> int:
        return int(self.class_kinds.sum())

    def class_logs(self) -> np.ndarray:
        """log10 of what a token's smoothed count is divided by, for each class."""
        return np.log10(self.class_tokens + 0.1 * (self.class_kinds + 1))


class _Known:
    """For each token met: class, hash, log10 of its smoothed count (not a number where the counts table must say)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.row: dict[bytes, int] = {}
        self.classes = np.zeros(HELD_WORDS, np.uint16)
        self.hashes = np.zeros(HELD_WORDS, np.int64)
        self.logs = np.zeros(HELD_WORDS)

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        """The rows of distinct ``tokens``."""
        new = [t for t in tokens if t not in self.row]
        if len(self.row) + len(new) > len(self.classes):
            self.row.clear()
            new = tokens
            if len(new) > len(self.classes):
                self.classes, self.hashes, self.logs = (np.zeros(len(new), x.dtype) for x in (self.classes, self.hashes, self.logs))
        if new:
            low, high = len(self.row), len(self.row) + len(new)
            v = self.vocabulary
            hashes = np.fromiter(map(hash_of, new), np.int64, len(new))
            self.hashes[low:high] = hashes
            self.classes[low:high] = [v.own.get(h, e) for h, e in zip(hashes.tolist(), map(ending_of, new), strict=True)]
            logs = np.full(len(new), np.nan)
            if len(v.hashes):
                at = np.minimum(np.searchsorted(v.hashes, hashes), len(v.hashes) - 1)
                common = v.hashes[at] == hashes
                logs[common] = np.log10(v.counts[at[common]] + 0.1)
            self.logs[low:high] = logs
            self.row.update(zip(new, range(low, high), strict=True))
        return np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))


@dataclass(frozen=True)
class Classify:
    """Batches of (doc_id, held_out, text) to rows with the tokens' classes and the hashes that must be looked up."""

    vocabulary: Vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(self.vocabulary)
        for batch in batches:
            for part in parts_of(batch, 2):
                yield self._batch(part, known)

    def _batch(self, batch: pa.RecordBatch, known: _Known) -> pa.RecordBatch:
        words, places, distinct = split_of(batch.column(2))
        held = known.rows([*distinct, END])
        lengths = words + 1
        starts = np.cumsum(lengths) - lengths
        rows = np.full(int(lengths.sum()), held[-1])
        inner = np.ones(len(rows), bool)
        inner[starts + words] = False
        rows[inner] = held[places]
        classes, logs, hashes = known.classes[rows], known.logs[rows], known.hashes[rows]
        rare = np.isnan(logs)
        sums = np.add.reduceat(np.where(rare, 0.0, logs), starts)
        found = np.add.reduceat((~rare).astype(np.int64), starts)
        ends = np.r_[0, np.cumsum(lengths - found)].astype(np.int32)
        parts = [classes[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(lengths), pa.array(sums), pa.array(found),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[rare])), pa.array(parts, pa.binary()),
            ],
            ["doc_id", "held_out", "n_tokens", "common_sum", "common_known", "rare", "classes"],
        )


def _sequences(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches cut so that each holds about TOKENS_AT_ONCE tokens, with their classes."""
    for batch in batches:
        sequences = [np.frombuffer(c, dtype=np.uint16).astype(np.int64) for c in batch.column(name).to_pylist()]
        low, total = 0, 0
        for k, s in enumerate(sequences):
            total += len(s)
            if total >= TOKENS_AT_ONCE or k == len(sequences) - 1:
                yield batch.slice(low, k + 1 - low), sequences[low : k + 1]
                low, total = k + 1, 0


@dataclass(frozen=True)
class Expect:
    """Batches of class sequences to the task's expected counts: (parameter, value); parameter -1 is the likelihood."""

    model: Hmm

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, likelihood = np.zeros(self.model.parameters), 0.0
        for _, sequences in _sequences(batches, "classes"):
            more, part = expected_counts(self.model, *segments_of(sequences, STEPS))
            counts += more
            likelihood += part
        if counts.any():
            places = pa.array(np.r_[-1, np.arange(len(counts))], pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array(np.r_[likelihood, counts])], ["parameter", "value"])


@dataclass(frozen=True)
class Forward:
    """Batches of classified rows to (rid, path, shares): log10 of the class sequence, and of what shares are out of."""

    model: Hmm
    class_logs: np.ndarray

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sequences in _sequences(batches, "classes"):
            lengths = np.array([len(s) for s in sequences])
            shares = np.add.reduceat(self.class_logs[np.concatenate(sequences)], np.cumsum(lengths) - lengths)
            names = [n for n in batch.schema.names if n != "classes"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(log10_likelihoods(self.model, sequences)), pa.array(shares)],
                [*names, "path", "shares"],
            )


def _vocabulary(counts: DataFrame, common: float) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, math.ceil(total * common))
    held = counts.filter(F.col("n") >= least).select("hash", "n").collect()  # at most 1 / common rows
    held.sort(key=lambda r: r.hash)
    end = hash_of(END)
    leading = sorted((r for r in held if r.hash != end), key=lambda r: (-r.n, r.hash))[:OWN]
    own = {r.hash: k for k, r in enumerate(leading)}
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    grouped = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    for ending, n, k in grouped:
        tokens[ending], kinds[ending] = n, k
    if own:
        for hashed, ending, n in counts.filter(F.col("hash").isin(list(own))).select("hash", "ending", "n").collect():
            tokens[ending] -= n
            kinds[ending] -= 1
            tokens[own[hashed]], kinds[own[hashed]] = n, 1
    return Vocabulary(np.array([r.hash for r in held], np.int64), np.array([r.n for r in held], np.float64), own, tokens, kinds)


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 5,
    common: float = 2e-6, gain: float = 1e-3,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text. Rows where ``held_out`` is true aren't learnt from. Training takes
    at most ``rounds`` rounds, and ends when one gains less than a share of ``gain`` of the log-likelihood.
    """
    scratch = Scratch(docs.sparkSession, "lm-scoring")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        text_or_empty(docs[text_col]).alias("text"),
    )
    counted = rows.filter("NOT held_out").select("text").mapInArrow(CountTokens(), "hash long, ending int, n long")
    counts = scratch.save(counted.groupBy("hash", "ending").agg(F.sum("n").alias("n")), "counts")
    vocabulary = _vocabulary(counts, common)
    schema = (
        "doc_id long, held_out boolean, n_tokens long, common_sum double, common_known long, rare array<long>, classes binary"
    )
    classified = rows.mapInArrow(Classify(vocabulary), schema).withColumn("rid", F.monotonically_increasing_id())
    classified = scratch.save(classified, "classified")

    model = Hmm.fresh(vocabulary.class_tokens, states)
    training = classified.filter("NOT held_out").select("classes")
    before = -math.inf
    for _ in range(rounds):
        sums = training.mapInArrow(Expect(model), "parameter int, value double").groupBy("parameter").agg(F.sum("value").alias("value"))
        held = dict(sums.collect())  # a row for each parameter of the model
        if not held:
            break
        likelihood = held.pop(-1)
        model = model.maximised(np.array([held[k] for k in range(model.parameters)]))
        if likelihood - before < gain * abs(likelihood):
            break
        before = likelihood

    forward = Forward(model, vocabulary.class_logs())
    kept = "rid long, doc_id long, held_out boolean, n_tokens long, common_sum double, common_known long"
    scored = classified.select(*[c.split()[0] for c in kept.split(", ")], "classes").mapInArrow(forward, f"{kept}, path double, shares double")
    least = max(1, math.ceil(vocabulary.tokens * common))
    wanted = classified.select("rid", F.explode("rare").alias("hash"))
    looked = wanted.join(counts.filter(F.col("n") < least).select("hash", "n"), "hash", "left")
    rare = looked.groupBy("rid").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_sum"), F.count("n").alias("rare_known")
    )
    whole = F.col("common_sum") + F.coalesce("rare_sum", F.lit(0.0))
    base = math.log10(vocabulary.tokens + 0.1 * (vocabulary.kinds + 1))
    return scored.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (whole - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("path") + whole - F.col("shares")).alias("score"),
    )
