"""Exact deduplication with a log-structured merge index of text digests.

Tasks gather the digests of the rows that they read in memtables of bounded size. A full memtable is sorted, equal
digests are combined to one entry with the identifier that survives and the number of rows, and it is flushed as a
sorted run. Compaction deals the entries of several runs by ranges of the digest and merges them in order, an entry at
a time, to a run of the next level; a digest that a third of all rows share has one entry in each run, however many rows it
stands for. Batches that come later are flushed to the same index, and levels of ``fanout`` runs are compacted on the way.

Digests that two or more rows have are hits. A filter of the hits, of bounded size, is looked up before texts are read
again: only texts that it lets through are compared byte by byte, as grouping by the text itself, combined in
each task first. Digests under which texts differ are split by text, so a collision never merges two documents.

Defined results. A null text counts as empty. Null identifiers lose to any other; among rows with the same
identifier the one that was read first stays. Repeated rows are copies like any other. An empty table gives an empty
result. Only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import DigestFilter, Scratch, rows_that_stay, salted_join, sha256, tasks_of, text_or_empty

ENTRY = "digest binary, id long, rid long, n long"
MEMTABLE_ROWS = 1 << 17


def _order(keep: str) -> list[tuple[str, str]]:
    return [("digest", "ascending"), ("id", "descending" if keep == "max" else "ascending"), ("rid", "ascending")]


def _combined(entries: pa.Table) -> pa.Table:
    """Sorted entries as one for each digest: the first survives, the numbers of rows are summed."""
    if not len(entries):
        return entries
    digest = entries.column("digest").combine_chunks()
    first = np.flatnonzero(np.r_[True, pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)])
    n = np.add.reduceat(entries.column("n").to_numpy(), first)
    return entries.take(pa.array(first)).set_column(3, "n", pa.array(n))


@dataclass(frozen=True)
class Memtable:
    """Batches of (digest, id, rid) to sorted runs of at most ``most`` rows each."""

    keep: str
    most: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, self.most - size))
                size += len(held[-1])
                batch = batch.slice(len(held[-1]))
                if size == self.most:
                    yield from self._flushed(held)
                    held, size = [], 0
        if size:
            yield from self._flushed(held)

    def _flushed(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        rows = rows.append_column("n", pa.array(np.ones(len(rows), np.int64)))
        indices = pc.sort_indices(rows, sort_keys=_order(self.keep), null_placement="at_end")
        yield from _combined(rows.take(indices)).combine_chunks().to_batches()


@dataclass(frozen=True)
class MergeRuns:
    """Entries of several runs in order to one run: what has the digest of the entry before joins it."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if len(batch):
                merged = _combined(pa.Table.from_batches([batch] if last is None else [last, batch]))
                merged = merged.combine_chunks().to_batches()[0]
                last = merged.slice(len(merged) - 1)
                if len(merged) > 1:
                    yield merged.slice(0, len(merged) - 1)
        if last is not None:
            yield last


class DigestLog:
    """A log-structured merge index from digest to (surviving row, number of rows).

    ``keep`` says which identifier survives compaction, "min" or "max". ``fanout`` flushed batches on a level are merged
    to one on the next level. ``memtable`` is the number of rows of a run of the lowest level.
    """

    def __init__(self, scratch: Scratch, keep: str = "min", fanout: int = 8, memtable: int = MEMTABLE_ROWS):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.scratch, self.keep, self.fanout, self.memtable = scratch, keep, fanout, memtable
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.written = 0

    def _write(self, entries: DataFrame, level: int) -> DataFrame:
        name = f"run-{level}-{self.written}"
        self.written += 1
        run = self.scratch.save(entries, name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, run))
        return run

    def flush(self, rows: DataFrame) -> None:
        """Sorted runs of ``rows`` (digest, id, rid), one for each full memtable and each task's last."""
        self._write(rows.select("digest", "id", "rid").mapInArrow(Memtable(self.keep, self.memtable), ENTRY), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            held, self.levels[level] = self.levels[level], []
            self._merge(held, level + 1)
            level += 1

    def _merge(self, held: list[tuple[str, DataFrame]], level: int) -> DataFrame:
        entries = _union([run for _, run in held])
        id_order = F.col("id").desc_nulls_last() if self.keep == "max" else F.col("id").asc_nulls_last()
        dealt = entries.repartitionByRange(tasks_of(entries.sparkSession), "digest").sortWithinPartitions("digest", id_order, "rid")
        run = self._write(dealt.mapInArrow(MergeRuns(), ENTRY), level)
        for name, _ in held:
            self.scratch.drop(name)
        return run

    def compact(self) -> DataFrame:
        """Merge all levels into one run and return it: digest, best (id, rid), n."""
        held = [entry for level in self.levels for entry in level]
        last = len(self.levels)
        self.levels = [[] for _ in range(last + 1)]
        return self._merge(held, last).select("digest", F.struct("id", "rid").alias("best"), "n")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = sha256,
    batches: list[DataFrame] | None = None,
    memtable: int = MEMTABLE_ROWS,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, sha256 (binary).

    ``batches`` are later batches with the same columns, flushed to the same index as runs of their own. ``digest``
    may be any function of the text; a weak one only costs byte comparisons.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    log = DigestLog(scratch, keep, memtable=memtable)
    texts, narrow = [], []
    for k, batch in enumerate([docs, *(batches or [])]):
        text = batch.select(batch[id_col].alias("id"), text_or_empty(batch[text_col]).alias("text"))
        texts.append(text.select("id", "text", digest(F.col("text")).alias("digest")))
        rows = text.select(F.col("id").cast("long").alias("id"), digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"))
        rows = rows.withColumn("rid", F.monotonically_increasing_id() * 64 + k)
        narrow.append(scratch.save(rows, f"rows-{k}"))
        log.flush(narrow[-1].select("digest", "id", "rid"))
    rows, text = _union(narrow), _union(texts)
    hits = scratch.save(log.compact().filter("n > 1"), "hits")
    counted = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    single = rows.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "digest")
    if not counted[0]:
        return single.drop("digest")

    # Rows that the filter holds back have a digest of their own. Byte verification: the texts that it lets through,
    # each once for each task, then the digests that have several.
    marks = DigestFilter(hits.select("digest"), counted[0])
    texts_met = text.filter(marks.may_hold(F.col("digest"))).groupBy("digest", "text").agg(F.count("*").alias("count"))
    mixed = scratch.save(texts_met.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("count").alias("n")).filter("texts > 1"), "mixed")
    alone = single.filter(~marks.may_hold(F.col("digest")))
    found = salted_join(rows.filter(marks.may_hold(F.col("digest"))), hits.withColumn("size", F.col("n")), ["digest"], counted[1], "left")
    none = F.col("size").isNull()
    found = found.select(
        "id", F.when(none, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (none | (F.col("rid") == F.col("best.rid"))).alias("kept"), "sha", "digest",
    )
    if not mixed.take(1):
        scratch.keep("hits", *(f"rows-{k}" for k in range(len(narrow))))
        return alone.unionByName(found).drop("digest")
    clash = mixed.agg(F.sum("n")).first()[0]
    split = salted_join(text, mixed.select("digest", "n"), ["digest"], clash)
    split = scratch.save(split.withColumn("rid", F.monotonically_increasing_id()), "split")
    rank = F.struct(F.col("id").isNotNull(), "id", -F.col("rid")) if keep == "max" else F.struct(F.col("id").isNull(), "id", "rid")
    pick = F.max_by if keep == "max" else F.min_by
    groups = split.groupBy("text").agg(pick(F.struct("id", "rid"), rank).alias("best"), F.count("*").alias("n"))
    groups = scratch.save(groups.withColumn("size", F.col("n")), "split-groups")
    apart = salted_join(split, groups, ["text"], clash).select(
        "id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"),
        sha256(F.col("text")).alias("sha"),
    )
    whole = salted_join(found, mixed.select("digest", "n", F.lit(True).alias("mixed")), ["digest"], clash, "left").filter("mixed IS NULL")
    return alone.unionByName(whole.drop("mixed")).drop("digest").unionByName(apart)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = exact_dedup(docs, id_col, text_col, keep).withColumnRenamed("id", "doc_id")
    return rows_that_stay(docs, decided, Scratch(docs.sparkSession, "exact-dedup-rows"), id_col, text_col)
