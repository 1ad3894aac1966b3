"""Packing documents into sequences of fixed length, as a cutting-stock problem.

A document becomes the ids of its text and an end id. Whole sequences are cut off its front; the rest is one piece.
The pieces' lengths, in classes of ``grain`` ids, form a histogram of bounded size. Column generation plans patterns
of classes over that histogram (see cutting_stock). Pieces are ranked within their class and take the patterns'
places in that order. A rank is the number of rows in earlier buckets of the class plus the rank within the bucket; a
class has as many buckets as its rows ask for, so that one that a third of all pieces share is dealt over many tasks.

Only piece records (a few numbers each) are written and shuffled, never texts or ids.

Defined results. A null or empty text is a document of the end id alone. Repeated rows and repeated identifiers are
documents of their own. An empty table gives an empty result. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cutting_stock import plan
from .shared import Scratch, tasks_of, text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rows of a class that are ranked in one group at most.
BUCKET_ROWS = 1 << 15

_encoders: dict[str, object] = {}


class Encoder:
    """Ids of the vocabulary in ``path`` (a file of the library tokenizers), with that library's special tokens.

    Where the file's vocabulary also lies beside it as ranks, the same merges are run by tiktoken, which gives the
    same ids in a seventh of the time (this is tested); otherwise, and for texts that it can't take, tokenizers runs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        try:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        except (ImportError, OSError):
            return
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except (ValueError, OverflowError):  # a run that its splitter can't take
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_counter(path: str):
    """A Column function from text to its number of ids, with the end id."""

    @F.arrow_udf("long")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path)
        for batch in texts:
            yield pa.array([len(encode.ids(t.as_py() or "")) + 1 for t in batch], pa.int64())

    return counted


@dataclass(frozen=True)
class CutIntoPieces:
    """Batches of (id, text) to batches of pieces."""

    tokenizer: str
    capacity: int
    end_id: int

    def pieces(self, doc_id: int | None, text: str, encode: Encoder) -> Iterator[tuple]:
        ids = np.append(encode.ids(text), np.uint32(self.end_id)).astype("<u4")
        for start in range(0, len(ids), self.capacity):
            part = ids[start : start + self.capacity]
            yield doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(self.tokenizer)
        types = [pa.int64()] * 5
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.extend(self.pieces(doc_id, text.as_py(), encode))
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


@dataclass(frozen=True)
class TakePlaces:
    """Batches of (pid, class, rank in its bucket, bucket) to (pid, sequence_id); all tables are of bounded size.

    ``before``: for each class the number of pieces in earlier buckets, by bucket. ``places``: for each class the first
    rank, first sequence and items a bin of each pattern that holds it.
    """

    before: dict[int, np.ndarray]
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank, bucket = (batch.column(n).to_numpy() for n in ("size", "rank", "bucket"))
            sequence = np.zeros(len(size), dtype=np.int64)
            for one in np.unique(size):
                at = size == one
                first, base, each = self.places[int(one)]
                place = rank[at] + self.before[int(one)][bucket[at]]
                k = np.searchsorted(first, place, side="right") - 1
                sequence[at] = base[k] + (place - first[k]) // each[k]
            columns = [batch.column(n) for n in _KEPT]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence)], [*_KEPT, "sequence_id"])


_KEPT = ["pid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def _places(patterns: list) -> tuple[dict, int]:
    spans: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern in patterns:
        for size, count in zip(pattern.sizes, pattern.counts, strict=True):
            spans.setdefault(size, []).append((taken.get(size, 0), sequence, count))
            taken[size] = taken.get(size, 0) + count * pattern.times
        sequence += pattern.times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for s, v in spans.items()}, sequence


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    grain: int = 8,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``grain`` divides ``capacity``; a class of lengths is planned at its largest length, so a sequence may end with up
    to grain - 1 unused ids for each of its pieces.
    """
    if capacity % grain:
        raise ValueError("grain divides capacity")
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    pieces = texts.mapInArrow(CutIntoPieces(tokenizer, capacity, end_id), PIECES)
    pieces = pieces.withColumn("pid", F.monotonically_increasing_id())
    pieces = scratch.save(pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int")), "pieces")

    rest = pieces.filter(F.col("length") < capacity)
    units = capacity // grain
    demand = {size: int(n) for size, n in rest.groupBy("size").count().collect()}  # at most units rows
    share = max(1, min(BUCKET_ROWS, sum(demand.values()) // (2 * tasks_of(docs.sparkSession))))  # half a task's even part at most
    buckets = {size: -(-n // share) for size, n in demand.items()}
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(buckets.items()) for x in pair]), F.col("size")), F.lit(1)) if buckets else F.lit(1)
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "pid"), many).cast("int"))
    counts = {size: np.zeros(n, np.int64) for size, n in buckets.items()}
    for size, bucket, n in rest.groupBy("size", "bucket").count().collect():  # at most units + 2 * tasks + rows / BUCKET_ROWS rows
        counts[size][bucket] = n
    places, sequences = _places(plan(demand, units))
    before = {size: np.cumsum(n) - n for size, n in counts.items()}

    ranking = Window.partitionBy("size", "bucket").orderBy(F.desc("length"), "doc_id", "start", "pid")
    ranked = rest.withColumn("rank", F.row_number().over(ranking).cast("long") - 1)
    taken = ranked.mapInArrow(TakePlaces(before, places), "pid long, " + PIECES + ", sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, -1)
    shared = taken.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long")))
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("pid") + sequences)
    full = full.withColumn("offset", F.lit(0).cast("long"))
    columns = [*_KEPT[1:], "sequence_id", "offset"]
    return full.select(*columns).unionByName(shared.select(*columns))
