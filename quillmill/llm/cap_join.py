"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction; a vector matches it if their cosine reaches alpha. Directions are products: after a random
rotation the space is cut into parts, each with its own random code, and a direction takes one word from each. So all
directions that a vector matches are found by list decoding: partial sums over the parts, dropped as soon as the best
words of the remaining parts can't reach alpha. Vectors that share a filter are compared by exact cosine.

alpha follows from the number of vectors, so that unrelated vectors meet in buckets of about ``bucket`` rows; where few
components would make that need too many filters for each vector, alpha is as large as MOST_SHARES allows. The number of
directions follows from alpha and the recall wanted for pairs at the threshold. They are dealt over many small codes, as
directions of one code share words and miss pairs together; how many codes it takes is simulated with random pairs at
the threshold, for every size and number of components.

Equal vectors are one class. A bucket is compared in pairs of blocks of bounded size, each in a task of its own, twice:
first by sketches, some turned components in bytes, with a bound that no pair at the threshold exceeds; then vectors
that may have a partner are sent whole and verified. A pair counts in the first filter that it shares. No pair is ever
a row: a block returns, for each member, how many vectors it is linked with and the least member that it reaches.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of different lengths don't link. Repeated rows are copies that link with each other. Null identifiers come last when a
component is named. Tables may be empty, and other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, heads_of
from .ngram_join import LINKS, least_reached
from .shared import Scratch, salted_join

BLOCK_ROWS = 1024
DECODED_AT_ONCE = 256
COMPARED_AT_ONCE = 256
#: Components of a sketch.
SKETCHED = 32
#: A vector matches at most so many filters for each that a pair at the threshold shares.
MOST_SHARES = 4.0
#: Where codes of very few components go on missing, no more are drawn.
MOST_CODES = 256


def cap_shares(dim: int, alpha: float, cosine: float, steps: int = 4000) -> tuple[float, float]:
    """The chance that a random direction is within alpha of one vector, and of both of two at ``cosine``."""
    if dim == 2:
        own, apart = math.acos(alpha), math.acos(cosine)
        return own / math.pi, max(0.0, 2 * own - apart) / (2 * math.pi)
    angle = (np.arange(steps) + 0.5) * (math.acos(alpha) / steps)  # within the cap of the one
    density = np.sin(angle) ** (dim - 2)
    whole = (np.arange(steps) + 0.5) * (math.pi / steps)
    total = (np.sin(whole) ** (dim - 2)).sum() * math.pi / steps
    turn = np.linspace(0, math.pi, steps + 1)  # of the direction around it
    tail = np.r_[0.0, np.cumsum(np.sin(turn[:-1] + math.pi / steps / 2) ** (dim - 3))]
    need = (alpha - np.cos(angle) * cosine) / (math.sqrt(1 - cosine**2) * np.sin(angle))
    second = np.interp(np.arccos(np.clip(need, -1, 1)), turn, tail / tail[-1])
    each = math.acos(alpha) / steps / total
    return float(density.sum() * each), float((density * second).sum() * each)


def _alpha_for(dim: int, rows: int, threshold: float, bucket: int) -> float:
    """The cosine at which buckets have ``bucket`` rows, or the largest that MOST_SHARES allows."""
    wanted = min(0.25, bucket / max(rows, 1))
    low, high = 0.0, 0.9999
    for _ in range(40):
        middle = (low + high) / 2
        own, both = cap_shares(dim, middle, threshold)
        low, high = (middle, high) if own > wanted and own <= MOST_SHARES * both else (low, middle)
    return low


@dataclass(frozen=True)
class ProductCode:
    """``words[p]`` (words, part size): the code of each part; rotation (dim, dim); alpha: the least cosine."""

    rotation: np.ndarray
    words: tuple[np.ndarray, ...]
    alpha: float

    @staticmethod
    def fitted(
        dim: int, rows: int, threshold: float, recall: float, bucket: int = 64, most_words: int = 4096, seed: int = 5, alpha: float | None = None
    ) -> ProductCode:
        """For ``rows`` vectors of ``dim`` components."""
        alpha = (0.0 if dim == 1 else _alpha_for(dim, rows, threshold, bucket)) if alpha is None else alpha
        directions = 2 if dim == 1 else -math.log1p(-recall) / cap_shares(dim, alpha, threshold)[1]
        parts = min(dim, max(2, math.ceil(math.log(max(directions, 2)) / math.log(most_words))))
        count = max(2, math.ceil(directions ** (1 / parts)))
        rng = np.random.default_rng(seed)
        rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        words = []
        for part in np.array_split(np.arange(dim), parts):
            # a part of one component has two words, whatever is asked for
            code = rng.normal(size=(count, len(part))) if len(part) > 1 else np.array([[1.0], [-1.0]])
            words.append(code / np.linalg.norm(code, axis=1, keepdims=True))
        return ProductCode(rotation, tuple(words), alpha)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (vector, filter) with a cosine of alpha or more, sorted by vector and filter."""
        turned = unit @ self.rotation
        parts = np.array_split(np.arange(unit.shape[1]), len(self.words))
        near = [turned[:, part] @ code.T for part, code in zip(parts, self.words, strict=True)]
        rest = np.zeros((len(unit), len(near) + 1))
        for p in range(len(near) - 1, -1, -1):
            rest[:, p] = rest[:, p + 1] + near[p].max(axis=1)
        goal = self.alpha * math.sqrt(len(near))
        vector, name, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for p, here in enumerate(near):
            sums = total[:, None] + here[vector]
            row, word = np.nonzero(sums + rest[vector, p + 1][:, None] >= goal)
            total = sums[row, word]
            name = name[row] * here.shape[1] + word
            vector = vector[row]
        return vector, name


def pairs_at(dim: int, cosine: float, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors (of two components at least) at one cosine."""
    rng = np.random.default_rng(seed)
    x, other = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * other


def pairs_met(code: ProductCode, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each pair shares a filter of ``code``."""
    met = np.zeros(len(x), bool)
    for at in range(0, len(x), DECODED_AT_ONCE):
        met[at + np.intersect1d(*((v << 40) + n for v, n in (code.decode(z[at : at + DECODED_AT_ONCE]) for z in (x, y)))).astype(int) // 2**40] = True
    return met


def codes_for(dim: int, rows: int, threshold: float, miss: float, missed: float, codes: int, bucket: int, pairs: int = 400) -> tuple[ProductCode, ...]:
    """Independent codes, each with a ``codes``-th of the directions that ``miss`` asks for: as many as it takes until
    simulated pairs at the threshold meet in none of them with a chance of ``missed`` at most."""
    if dim == 1:  # directions are the two signs, and there are no pairs at a cosine between them
        return (ProductCode.fitted(1, rows, threshold, 0.5),)
    share, drawn, chance = 1 - miss ** (1 / codes), [], 1.0
    alpha = _alpha_for(dim, rows, threshold, bucket)
    while len(drawn) < MOST_CODES and chance > missed:
        drawn.append(ProductCode.fitted(dim, rows, threshold, share, bucket, seed=len(drawn), alpha=alpha))
        met = pairs_met(drawn[-1], *pairs_at(dim, threshold, pairs, 1000 + len(drawn)))
        chance *= max(1 - met.mean(), 0.5 / pairs)
    return tuple(drawn)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Vectors of one length as rows of doubles; each is held in floats or in doubles."""
    held = column.to_pylist()
    dim = dim or max(1, len(held[0]) // 8)
    if len({len(v) for v in held}) == 1:
        kind = np.float32 if len(held[0]) == 4 * dim else np.float64
        return np.frombuffer(b"".join(held), dtype=kind).reshape(len(held), dim).astype(np.float64)
    return np.array([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dim else np.float64) for v in held], dtype=np.float64)


@dataclass(frozen=True)
class Usable:
    """Batches of (id, vector) to (id, key, dim, vector bytes); unusable vectors have a null key.

    Vectors whose components all are floats are held as such, others as doubles, scaled so that squares don't overflow.
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            usable = lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0; nulls aren't numbers
            with np.errstate(over="ignore", under="ignore"):
                floats = flat.astype(np.float32)
                fits = (floats == flat) & ((flat == 0) | (np.abs(flat) > 1e-30))
            keys, dims, held = [], [], []
            for ok, low, high in zip(usable, ends[:-1], ends[1:], strict=True):
                x = flat[low:high]
                key = raw = None
                if ok and high > low and np.isfinite(x).all() and x.any():
                    whole = x / np.abs(x).max()
                    key = hashlib.blake2b(whole.tobytes(), digest_size=16).digest()
                    raw = (floats[low:high] if fits[low:high].all() else whole).tobytes()
                keys.append(key)
                dims.append(0 if raw is None else high - low)
                held.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(held, pa.binary())],
                ["id", "key", "dim", "vector"],
            )


def sketches(unit: np.ndarray) -> np.ndarray:
    """Rows of bytes: some turned components as one byte each, after their scale and the lengths of what they leave out.

    ``unit`` is turned already. The first length is that of the components left out, the second that of rounding.
    """
    kept = unit[:, :SKETCHED]
    scale = np.maximum(np.abs(kept).max(axis=1), 1e-30) / 127
    near = np.rint(kept / scale[:, None]).astype(np.int8)
    left = np.linalg.norm(unit[:, SKETCHED:], axis=1)
    rounded = np.linalg.norm(kept - near * scale[:, None], axis=1)
    numbers = np.stack([scale, left, rounded], axis=1).astype(np.float32)
    return np.concatenate([numbers.view(np.uint8).reshape(len(unit), 12), near.view(np.uint8)], axis=1)


def may_link(held: np.ndarray, threshold: float, apart: np.ndarray | None = None) -> np.ndarray:
    """Whether each vector, by its sketch, may have a partner at the threshold; with ``apart``, one of another side."""
    numbers = np.ascontiguousarray(held[:, :12]).view(np.float32).astype(np.float64)
    near = np.ascontiguousarray(held[:, 12:]).view(np.int8) * numbers[:, :1]
    left, rounded, size = numbers[:, 1], numbers[:, 2], np.linalg.norm(near, axis=1)
    out = np.zeros(len(held), bool)
    for low in range(0, len(held), COMPARED_AT_ONCE):
        at = slice(low, low + COMPARED_AT_ONCE)
        bound = near[at] @ near.T + np.outer(left[at], left) + np.outer(size[at], rounded) + np.outer(rounded[at], size + rounded)
        may = bound >= threshold - 1e-5
        may[np.arange(len(may)), np.arange(low, low + len(may))] = False
        if apart is not None:
            may &= apart[at, None] != apart[None, :]
        out[at] = may.any(axis=1)
    return out


@dataclass(frozen=True)
class Decode:
    """Batches of (cid, vector) to (cid, sketch, filters); the filters of code k are numbered from k * 2**40."""

    codes: tuple[ProductCode, ...]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(self.codes[0].rotation)
        for batch in batches:
            for at in range(0, len(batch), DECODED_AT_ONCE):
                part = batch.slice(at, DECODED_AT_ONCE)
                x = _matrix(part.column("vector"), dim)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                found = [code.decode(unit) for code in self.codes]
                vector = np.concatenate([v for v, _ in found])
                name = np.concatenate([n + (k << 40) for k, (_, n) in enumerate(found)])
                order = np.lexsort((name, vector))
                vector, name = vector[order], name[order]
                ends = np.searchsorted(vector, np.arange(len(part) + 1)).astype(np.int32)
                held = [row.tobytes() for row in sketches(unit @ self.codes[0].rotation)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), pa.array(held, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(name))],
                    ["cid", "sketch", "filters"],
                )


BLOCK = ["filter", "i", "j"]
MAY = "filter long, i int, j int, side int, cid long"


@dataclass(frozen=True)
class Prune:
    """Two blocks of one bucket to its members that may be linked, by their sketches."""

    threshold: float

    def __call__(self, table: pa.Table) -> pa.Table:
        held = table.column("sketch").to_pylist()
        held = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
        apart = None if table.column("i")[0].as_py() == table.column("j")[0].as_py() else table.column("side").to_numpy()
        return table.select([c.split()[0] for c in MAY.split(", ")]).filter(pa.array(may_link(held, self.threshold, apart)))


@dataclass(frozen=True)
class VerifyBucket:
    """Two blocks of one bucket to (cid, links, root). ``earlier`` are a member's filters before the bucket's own."""

    threshold: float

    def __call__(self, table: pa.Table) -> pa.Table:
        ids, side, weight = (table.column(n).to_numpy() for n in ("cid", "side", "size"))
        x = _matrix(table.column("vector"), table.column("dim")[0].as_py())
        norm = np.sqrt((x * x).sum(axis=1))
        linked = np.zeros((len(x), len(x)), bool)
        for low in range(0, len(x), COMPARED_AT_ONCE):
            at = slice(low, low + COMPARED_AT_ONCE)
            linked[at] = (x[at] @ x.T) / (norm[at, None] * norm[None, :]) >= self.threshold
        linked |= linked.T  # sums of products may be rounded in either order
        np.fill_diagonal(linked, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            linked &= side[:, None] != side[None, :]
        some = np.flatnonzero(linked.any(axis=1))
        if len(some):  # a pair counts in the first filter that it shares
            lists = table.column("earlier").take(pa.array(some)).combine_chunks()
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
            known, column, often = np.unique(flat, return_inverse=True, return_counts=True)
            shared = often[column] > 1
            column, owner = (np.cumsum(often > 1) - 1)[column[shared]], owner[shared]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            met = np.zeros((len(some), len(some)), np.float32)
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_ROWS):
                a, b = np.searchsorted(column, (low, low + BLOCK_ROWS))
                held = np.zeros((len(some), BLOCK_ROWS), np.float32)
                held[owner[a:b], column[a:b] - low] = 1
                met += held @ held.T
            linked[np.ix_(some, some)] &= met < 0.5
        left = linked.any(axis=1)
        return pa.table({"cid": ids[left], "links": (linked @ weight)[left], "root": least_reached(linked, ids)[left]})


def _on_blocks(step):
    return lambda block: step(block)  # Spark counts a callable object's own argument too


def cap_join(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, miss: float = 1e-4,
    codes: int = 32, bucket: int = 512, missed: float = 1e-4,
) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id.

    n_links counts the other vectors whose cosine is at least ``threshold``, component_id is the least id reachable
    over links. ``miss`` is the chance that a pair just at the threshold meets in no filter, if directions were drawn
    one by one; it sets the directions of ``codes`` codes. The words of a code are shared by many directions, so more
    pairs are missed than that: codes are drawn until the chance simulated with them is ``missed`` at most.
    """
    scratch = Scratch(vectors.sparkSession, "cap-join")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    rows = rows.mapInArrow(Usable(), "id long, key binary, dim int, vector binary")
    rows = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid", "dim", "vector"))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(first.alias("rep"), F.count("*").alias("size"))
    classes = scratch.save(classes.select("key", F.col("rep.rid").alias("cid"), "rep.dim", "size", "rep"), "classes")
    rows = rows.select("id", "key")

    links = None
    sizes = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}  # lengths of vectors: a handful
    for dim, count in sorted(sizes.items()):
        drawn = codes_for(dim, count, threshold, miss, missed, codes, bucket)
        own = classes.filter(F.col("dim") == dim).select("cid", "size", "dim", F.col("rep.vector").alias("vector"))
        decoded = own.select("cid", "vector").mapInArrow(Decode(drawn), "cid long, sketch binary, filters array<long>")
        decoded = scratch.save(decoded, f"decoded-{dim}")
        # Buckets of more than a block are cut to blocks; each pair of blocks is a group of its own.
        large = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("members"))
        large = large.filter(F.col("members") > BLOCK_ROWS).select("filter", F.ceil(F.col("members") / BLOCK_ROWS).cast("int").alias("blocks"))
        met = decoded.select("cid", "sketch", F.explode("filters").alias("filter")).join(large, "filter", "left")
        met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        met = met.withColumn("side", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("filter", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "cid", "sketch")
        may = scratch.save(met.groupBy(*BLOCK).applyInArrow(_on_blocks(Prune(threshold)), MAY), f"may-{dim}")
        full = own.join(decoded.select("cid", "filters").join(may.select("cid").distinct(), "cid"), "cid")
        here = may.join(full, "cid").withColumn("earlier", F.filter("filters", lambda f: f < F.col("filter"))).drop("filters")
        found = here.groupBy(*BLOCK).applyInArrow(_on_blocks(VerifyBucket(threshold)), LINKS)
        found = scratch.save(found, f"links-{dim}")
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    rep = F.struct("rep.none", "rep.id", "rep.rid").alias("rep")
    classes = classes.select("key", "cid", "size", rep)
    reached = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")), scratch, "verified")
    totals = links.groupBy("cid").agg(F.sum("links").alias("links"))
    heads = heads_of(reached, classes.select(F.col("cid").alias("node"), F.col("rep").alias("rank")), scratch)
    linked = heads.select(F.col("node").alias("cid"), "head").join(totals, "cid")
    known = classes.join(linked, "cid", "left").filter("size > 1 OR links IS NOT NULL").select(
        "key", "size", F.coalesce("head", "rep")["id"].alias("head"), F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )
    known = scratch.save(known.withColumn("n", F.col("size")), "known")
    scratch.keep("rows", "known")
    # Vectors that can't be used have no key and aren't dealt with the others.
    usable = salted_join(rows.filter("key IS NOT NULL"), known, ["key"], rows.count(), "left").select(
        "id", F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("head")).alias("component_id"),
    )
    alone = rows.filter("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usable.unionByName(alone)
