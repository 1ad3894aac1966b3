"""Similarity join of documents on word n-grams: MinHash bands find candidates, full n-gram sets verify them.

1. Every text becomes its set of n-gram hashes (64 bits), a MinHash signature of that set, and the hashes of the
   signature's bands. The numbers of bands and rows follow from the threshold and the recall wanted at it.
2. Texts with equal sets are one class; only its first row goes on, with the class's size.
3. Classes that share a band hash are candidates. Each bucket links its members to its least one; the components of
   these links bound what has to be compared.
4. A small component is verified as a whole in one task, from the sets of its members. In a large one every bucket is
   verified by itself, in pairs of blocks of bounded size, and a pair counts only in its first common bucket. So a
   group of any size is dealt over many tasks, and no pair is ever a row: a block returns, for each member, how many
   rows it is linked with and the least member that it reaches.
5. Components of the verified links name the groups.

Defined results. Words are the runs of letters, digits and underscores of the lower-cased text. A text of fewer words
than n is one n-gram of all its words. A null or empty text, or one without words, is linked with nothing. Repeated
rows are copies of each other. Null identifiers come last when a group's first document is chosen. Tables may be
empty, and other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, heads_of
from .shared import DigestFilter, Scratch, salted_join, sha256, text_or_empty

WORD = re.compile(r"\w+")
CACHED_WORDS = 400_000
WORDS_AT_ONCE = 300_000
BLOCK_ROWS, BLOCK_GRAMS = 512, 500_000


def bands_for(threshold: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands * rows hashes reach ``recall`` at ``threshold``."""
    found = None
    for rows in range(1, most_hashes + 1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-share))
        if bands * rows <= most_hashes:
            found = bands, rows
    if found is None:
        raise ValueError("too few hashes for this threshold and recall")
    return found


class _WordHashes(dict):
    """Word to its 64-bit hash; forgets all when full, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text's word hashes."""
    if not len(words):
        return words
    width = min(n, len(words))
    grams = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    grams = np.sort(_mixed(grams + np.uint64(width)))
    return grams[np.r_[True, grams[1:] != grams[:-1]]]


def text_grams(text: str, n: int, hashes: _WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return gram_set(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), n)


@dataclass(frozen=True)
class Signatures:
    """Batches of (doc_id, sha, text) to (doc_id, sha, key, grams, bands)."""

    n: int
    bands: int
    rows: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        rng = np.random.default_rng(20240229)
        factors = rng.integers(0, 2**32, self.bands * self.rows, dtype=np.uint32) | np.uint32(1)
        masks = rng.integers(0, 2**32, self.bands * self.rows, dtype=np.uint32)
        for batch in batches:
            texts, at = batch.column(2), 0
            while at < len(texts):
                sets, total = [], 0
                while at + len(sets) < len(texts) and total < WORDS_AT_ONCE:
                    sets.append(text_grams(texts[at + len(sets)].as_py(), self.n, hashes))
                    total += len(sets[-1])
                yield self._signed(batch.slice(at, len(sets)), sets, factors, masks)
                at += len(sets)

    def _signed(self, batch, sets, factors, masks) -> pa.RecordBatch:
        filled = [s for s in sets if len(s)]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        bands = np.zeros((0, self.bands), dtype=np.int64)
        if filled:
            flat = np.concatenate(filled)
            flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
            starts = np.cumsum([0] + [len(s) for s in filled[:-1]])
            least = np.empty((len(factors), len(filled)), dtype=np.uint32)
            work = np.empty_like(flat)
            for k, (factor, mask) in enumerate(zip(factors, masks, strict=True)):
                np.multiply(flat, factor, out=work)
                np.bitwise_xor(work, mask, out=work)
                least[k] = np.minimum.reduceat(work, starts)
            bands = np.empty((len(filled), self.bands), dtype=np.int64)
            for b in range(self.bands):
                folded = np.full(len(filled), b + 1, dtype=np.uint64)
                for row in least[b * self.rows : (b + 1) * self.rows]:
                    folded = _mixed(folded * np.uint64(0x9E3779B97F4A7C15) + row)
                bands[:, b] = folded.view(np.int64)
        ends = np.cumsum([0] + [self.bands * bool(len(s)) for s in sets]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists],
            ["doc_id", "sha", "key", "grams", "bands"],
        )


@dataclass(frozen=True)
class GramSets:
    """Batches of (cid, text) to (cid, set); the set is the bytes of its sorted hashes."""

    n: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [text_grams(t.as_py(), self.n, hashes).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["cid", "set"])


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share, from products of 0/1 matrices over ``width`` elements."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    often = np.diff(np.r_[first, len(flat)])
    column = np.repeat(np.cumsum(often > 1) - 1, often)
    held = np.repeat(often > 1, often)
    column, owner = column[held], owner[held]
    common = np.zeros((m, m), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        block = np.zeros((m, width), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        common += block @ block.T
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def least_reached(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member of a block the least id in its component of ``linked`` (symmetric, boolean)."""
    label = ids.copy()
    while True:
        near = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        after = np.minimum(label, near)
        if (after == label).all():
            return label
        label = after


LINKS = "cid long, links long, root long"


@dataclass(frozen=True)
class VerifyBlock:
    """The members of one component or of two blocks of one bucket to (cid, links, root)."""

    numerator: int
    denominator: int

    def __call__(self, table: pa.Table) -> pa.Table:
        ids = table.column("cid").to_numpy()
        side = table.column("side").to_numpy()
        weight = table.column("size").to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("set").to_pylist()]
        count = np.array([len(s) for s in sets])
        common = common_counts(sets).astype(np.int64)
        union = count[:, None] + count[None, :] - common
        linked = common * self.denominator >= self.numerator * union
        np.fill_diagonal(linked, False)
        i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        if i != j:
            linked &= side[:, None] != side[None, :]
        band = int(table.column("band")[0].as_py())
        if band > 0:  # a pair counts in its first common bucket
            bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
            for earlier in range(band):
                linked &= bands[:, None, earlier] != bands[None, :, earlier]
        some = linked.any(axis=1)
        links = linked @ weight
        root = least_reached(linked, ids)
        return pa.table({"cid": ids[some], "links": links[some], "root": root[some]})


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, sha, class_id, class_size, n_links, component_id, kept.

    class_id is the first doc_id among the rows with an equal n-gram set, n_links the number of other rows whose
    similarity is at least ``threshold``, component_id the first doc_id that is reachable over links, and kept marks
    one row of each component. ``recall`` is the share of pairs exactly at the threshold that the bands find.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    bands, rows = bands_for(threshold, recall)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    texts = texts.select("doc_id", sha256(F.col("text")).alias("sha"), "text")
    signed = texts.mapInArrow(Signatures(n, bands, rows), "doc_id long, sha binary, key binary, grams long, bands array<long>")
    signed = scratch.save(signed.withColumn("rid", F.monotonically_increasing_id()), "signed")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "sha"))
    classes = signed.filter("grams > 0").groupBy("key").agg(
        first.alias("rep"), F.count("*").alias("size"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
    )
    classes = scratch.save(classes.select("key", F.col("rep.rid").alias("cid"), "rep", "size", "grams", "bands"), "classes")

    # Buckets of two classes and more, each linked to its least class.
    each = classes.select("cid", "grams", F.posexplode("bands").alias("band", "value"))
    buckets = scratch.save(
        each.groupBy("band", "value").agg(
            F.count("*").alias("members"), F.sum("grams").alias("total"), F.min("cid").alias("least"),
            F.bit_xor(F.xxhash64("cid")).alias("whose"),
        ).filter("members > 1"),
        "buckets",
    )
    held = buckets.withColumn("n", F.col("members"))
    pairs = buckets.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    stars = salted_join(each.select("cid", "band", "value"), held.select("band", "value", "least", "n"), ["band", "value"], pairs)
    stars = stars.select(F.col("cid").alias("u"), F.col("least").alias("v"))
    candidate = components(stars, scratch, "candidate").withColumnsRenamed({"node": "cid", "component": "comp"})
    members = scratch.save(classes.select("cid", "rep", "size", "grams", "bands").join(candidate, "cid"), "members")
    extent = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("grams").alias("total"))
    large = scratch.save(extent.filter((F.col("m") > BLOCK_ROWS) | (F.col("total") > BLOCK_GRAMS)).select("comp"), "large")

    # The sets of the members, from their texts; only texts that a filter of the members' digests lets through are dealt.
    wanted = members.select("cid", F.col("rep.doc_id").alias("doc_id"), F.col("rep.sha").alias("sha"))
    marks = DigestFilter(wanted.select("sha"), wanted.count())
    same = (texts["sha"] == wanted["sha"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    found = texts.filter(marks.may_hold(texts["sha"])).join(wanted, same).select("cid", "text").dropDuplicates(["cid"])
    sets = scratch.save(found.mapInArrow(GramSets(n), "cid long, set binary"), "sets")

    small = members.join(large, "comp", "left_anti").select(
        F.col("comp").alias("group"), F.lit(-1).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"),
        "cid", "size", F.lit(None).cast("array<long>").alias("bands"),
    )
    # Of buckets with the same members only the first counts; a large bucket is compared block by block.
    inside = members.join(large, "comp", "left_semi").select("cid", "size", "bands")
    own = inside.select("cid", "size", "bands", F.posexplode("bands").alias("band", "value"))
    own = salted_join(own, held, ["band", "value"], pairs)
    firsts = buckets.groupBy("whose", "members", "least").agg(F.min("band").alias("band"))
    own = own.join(firsts, ["whose", "members", "least", "band"], "left_semi")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, F.col("total") / BLOCK_GRAMS)).cast("int")
    own = own.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select(
        F.col("value").alias("group"), "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side",
        "cid", "size", "bands",
    )
    threshold_exact = Fraction(str(threshold))
    verify = VerifyBlock(threshold_exact.numerator, threshold_exact.denominator)
    compared = small.unionByName(own).join(sets, "cid")
    links = scratch.save(compared.groupBy("group", "band", "i", "j").applyInArrow(lambda block: verify(block), LINKS), "links")

    reached = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")), scratch, "verified")
    totals = links.groupBy("cid").agg(F.sum("links").alias("links"))
    heads = heads_of(reached, classes.select(F.col("cid").alias("node"), F.col("rep").alias("rank")), scratch)
    linked = heads.select(F.col("node").alias("cid"), "head").join(totals, "cid")
    known = classes.join(linked, "cid", "left").filter("size > 1 OR links IS NOT NULL").select(
        "key", "rep", "size", F.coalesce("head", "rep").alias("head"), F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )
    known = scratch.save(known.withColumn("n", F.col("size")), "known")
    scratch.keep("signed", "known")
    rows = signed.select("doc_id", "sha", "key", "rid")
    # Texts without words have no key and aren't dealt with the others.
    met = salted_join(rows.filter("key IS NOT NULL"), known, ["key"], signed.count(), "left")
    lone = F.col("size").isNull()
    linked = met.select(
        "doc_id", "sha",
        F.when(lone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0).cast("long")).alias("n_links"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (lone | (F.col("rid") == F.col("head.rid"))).alias("kept"),
    )
    empty = rows.filter("key IS NULL").select(
        "doc_id", "sha", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"),
    )
    return linked.unionByName(empty)
