"""What the operators share: scratch tables in the shared folder, table reading, hashing."""

from __future__ import annotations

import ctypes
import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own.

    Only a session in local mode that names neither gets one of its own, under /tmp/checkpoints.
    """
    context = spark.sparkContext
    if root := context.getConf().get("spark.checkpoint.dir"):
        return root
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if (held := context._jsc.sc().getCheckpointDir()).isDefined():
        return held.get()
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("/tmp/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written below the shared folder, so that no later job depends on an executor that was lost.

    An operator keeps only the tables that its lazy result reads; ``close_scratch`` deletes those too.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/quillmill/{label}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        _open.setdefault(spark.sparkContext.applicationId, []).append(self)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self.names.discard(name)
        _delete(self.spark, f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Delete all tables but ``names``."""
        for name in self.names.difference(names):
            self.drop(name)

    def close(self) -> None:
        """Delete everything; results that read its tables can't be read again."""
        self.names.clear()
        _delete(self.spark, self.root)


_open: dict[str, list[Scratch]] = {}


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def close_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of all operators that this application has run, once their results have been used."""
    for scratch in _open.pop(spark.sparkContext.applicationId, []):
        scratch.close()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks, and several idle ones share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def crc_of_id(column: Column) -> Column:
    """crc32 of an id's decimal text, unsigned."""
    return F.crc32(column.cast("string").cast("binary"))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def tasks_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_join(rows: DataFrame, by_key: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key`` on ``keys``; a key that many rows share is dealt over several tasks.

    ``by_key`` is a written table with one row for each key and ``n``, how many of the ``total`` rows share it. A key
    with more than half a task's even part gets more parts; there are at most 2 * tasks such keys, so that
    their table may go to every task.
    """
    share = max(1, total // (2 * tasks_of(rows.sparkSession)))
    parts = by_key.withColumn("__parts", F.ceil(F.col("n") / share).cast("int"))
    hot = parts.filter("__parts > 1").select(*keys, F.col("__parts").alias("__of"))
    salt = F.pmod(F.xxhash64(*rows.columns, F.lit(3)), F.coalesce("__of", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__of")
    each = parts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__parts"), F.lit(1)) - 1))).drop("__parts", "n")
    return rows.join(each, [*keys, "__salt"], how).drop("__salt")


@dataclass(frozen=True)
class _Bits:
    """Batches of digests to the words of a filter in which they have set bits: (block, bits)."""

    blocks: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(self.blocks * BLOCK_BITS, bool)
        for batch in batches:
            held[_places(batch.column(0), len(held))] = True
        some = np.flatnonzero(held.reshape(self.blocks, -1).any(axis=1))
        bits = [np.packbits(held[b * BLOCK_BITS : (b + 1) * BLOCK_BITS]).tobytes() for b in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(bits, pa.binary())], ["block", "bits"])


def _places(digests: pa.Array, size: int) -> np.ndarray:
    """(digests, 4) places of a filter of ``size`` bits, from a digest's own bytes; short digests are filled up."""
    raw = b"".join((d or b"")[:16].ljust(16, b"\0") for d in digests.to_pylist())
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64) % size


def _any_of(blocks: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in blocks.column("bits").to_pylist()])
    return pa.table({"block": blocks.column("block")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})


BLOCK_BITS = 1 << 19


class DigestFilter:
    """A Bloom filter of digests, built by tasks and held by all: at most ``most_blocks`` times 64 KB, whatever is in it.

    A full one lets more through, and never holds back a digest that is in it. Digests are evenly distributed bytes.
    """

    def __init__(self, digests: DataFrame, count: int, most_blocks: int = 128):
        blocks = min(most_blocks, max(1, math.ceil(count * 12 / BLOCK_BITS)))
        found = digests.mapInArrow(_Bits(blocks), "block int, bits binary")
        whole = found.groupBy("block").applyInArrow(lambda t: _any_of(t), "block int, bits binary").collect()  # at most most_blocks rows
        self.bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
        for block, bits in whole:
            self.bits[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = np.frombuffer(bits, np.uint8)

    def may_hold(self, digest: Column) -> Column:
        bits = self.bits

        @F.arrow_udf("boolean")
        def held(digests: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in digests:
                at = _places(batch, len(bits) * 8)
                yield pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1))

        return held(digest)


def rows_that_stay(docs: DataFrame, decided: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, sha, kept: a row for each row) keeps, with all their columns.

    Identifiers and digests of rows that go, or that are repeated, are the marks. A filter of their digests lets all
    other rows through without a shuffle. Of rows alike in identifier and text one stays, the first in the order of
    their columns as text.
    """
    marks = decided.groupBy("doc_id", "sha").agg(F.max("kept").alias("stays"), F.count("*").alias("alike"))
    marks = scratch.save(marks.filter("NOT stays OR alike > 1"), "marks")
    count = marks.count()
    if not count:
        return docs
    marked = DigestFilter(marks.select("sha"), count)
    whole = F.col("__row")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    rows = rows.withColumn("__sha", sha256(text_or_empty(whole.getField(text_col))))
    rows = rows.withColumn("__marked", marked.may_hold(F.col("__sha")))
    same = (F.col("__sha") == F.col("sha")) & whole.getField(id_col).eqNullSafe(F.col("doc_id"))
    looked = rows.filter("__marked").drop("__marked")
    stay = rows.filter("NOT __marked").select("__row").unionByName(looked.join(marks, same, "left_anti").select("__row"))
    repeated = scratch.save(marks.filter("stays AND alike > 1"), "repeated")
    if repeated.take(1):
        again = looked.join(repeated, same).groupBy("doc_id", "sha").agg(F.min_by("__row", whole.cast("string")).alias("__row"))
        stay = stay.unionByName(again.select("__row"))
    return stay.select(*[whole.getField(c).alias(c) for c in docs.columns])
