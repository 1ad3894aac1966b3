"""Fixity audit of web archives with Merkle trees.

Records lie in files by offset. Every record has a digest; the records of an offset range, in order, make a leaf; a
fixed number of neighbouring nodes makes a node of the next level, up to a root for each file and one for the
replica. Two replicas whose roots are equal hold the same bytes. Otherwise the audit descends: at each level it compares
only the children of nodes that differ, down to the records. What is read from a replica is its digests; nodes are
built by aggregation from leaves of bounded size. Offsets are running sums in two steps, over parts of a file and within
them, and records that are alike are counted first and laid out one after another, so that no file, identifier or content
that a third of all records share is gathered in one place.

Defined results. Null columns of a page are empty in its record. Pages without an identifier go to files of their own,
by content. Repeated rows are records of their own at their own offsets. A replica without records differs in every
file; two empty replicas are equal. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, text_or_empty

RANGE_BYTES = 64 * 1024
FANOUT = 16
#: Levels above the leaves within a file, then levels above the files, then the root.
FILE_LEVELS, ARCHIVE_LEVELS = 4, 4
PAGES_PER_FILE = 4096
NULL_FILES = 64
#: Records that are alike which one task writes out at once.
LOT = 1 << 14


def warc_record(page_id: Column, url: Column, payload: Column) -> Column:
    """A resource record as text."""
    payload = text_or_empty(payload)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text_or_empty(page_id), F.lit(">\r\nWARC-Target-URI: "),
        text_or_empty(url), F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def file_of(page_id: Column, record: Column) -> Column:
    """The archive file: PAGES_PER_FILE neighbouring identifiers share one."""
    lost = -1 - F.conv(F.substring(F.md5(record.cast("binary")), 1, 2), 16, 10).cast("long") % NULL_FILES
    return F.coalesce(F.floor(page_id / F.lit(PAGES_PER_FILE)).cast("long"), lost)


def digest_of(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def laid_out(records: DataFrame, order: list[str]) -> DataFrame:
    """``records`` (file, length and more) with each one's offset in its file, in the order of ``order``.

    The last column of ``order`` is text, and a file has a bounded number of values of the first. Records that are
    alike in all columns lie side by side.
    """
    columns = records.columns
    alike = records.groupBy(*columns).agg(F.count("*").alias("__n"))
    first, prefix = F.col(order[0]).alias("__first"), F.substring(order[-1], 1, 2).alias("__prefix")
    alike = alike.select(*columns, "__n", first, prefix).withColumn("__bytes", F.col("length") * F.col("__n"))
    part = ["file", "__first", "__prefix"]
    before = Window.partitionBy("file").orderBy(*part[1:]).rowsBetween(Window.unboundedPreceding, -1)
    parts = alike.groupBy(*part).agg(F.sum("__bytes").alias("__bytes"))
    parts = parts.select(*[F.col(c).alias(f"{c}_") for c in part], F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("__within", F.coalesce(F.sum("__bytes").over(within), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in part]
    placed = placed.join(parts, same).withColumn("__start", F.col("__base") + F.col("__within"))
    # Long runs of records that are alike are cut, so that several tasks write them out.
    lots = placed.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / LOT))))
    lots = lots.withColumn("__last", F.least((F.col("__lot") + 1) * LOT, F.col("__n")) - 1)
    lots = lots.repartition(*[F.col(c) for c in part], "__lot").withColumn("__k", F.explode(F.sequence(F.col("__lot") * LOT, F.col("__last"))))
    return lots.select(*columns, (F.col("__start") + F.col("__k") * F.col("length")).cast("long").alias("offset"))


def _node(keys: list[str], rows: DataFrame, position: str, line: Column) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct(position, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(digest_of(F.array_join(lines, "\n")).alias("digest"))


def trees(records: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Node tables (replica, file, node, digest) of all replicas in ``records``, leaves first, root last.

    ``records``: replica, file, offset, length, digest. Above the files, ``file`` is the number of the group of files.
    """
    line = F.concat_ws(":", "offset", "length", "digest")
    leaves = records.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long"))
    levels = [scratch.save(_node(["replica", "file", "node"], leaves, "offset", line), "level-0")]
    child = F.concat_ws(":", "place", "digest")
    for k in range(1, FILE_LEVELS + ARCHIVE_LEVELS + 2):
        below = levels[-1]
        if k < FILE_LEVELS:
            up = below.withColumn("place", F.col("node")).withColumn("node", F.floor(F.col("node") / FANOUT).cast("long"))
        elif k == FILE_LEVELS:  # a file's root
            up = below.withColumn("place", F.col("node")).withColumn("node", F.lit(0).cast("long"))
        elif k <= FILE_LEVELS + ARCHIVE_LEVELS:
            up = below.withColumn("place", F.col("file")).withColumn("file", F.floor(F.col("file") / (FANOUT * FANOUT)).cast("long"))
        else:  # the replica's root
            up = below.withColumn("place", F.col("file")).withColumn("file", F.lit(0).cast("long"))
        levels.append(scratch.save(_node(["replica", "file", "node"], up, "place", child), f"level-{k}"))
    return levels


def _parent(level: int) -> tuple[Column, Column]:
    """(file, node) of the node above a node of ``level``."""
    if level + 1 < FILE_LEVELS:
        return F.col("file"), F.floor(F.col("node") / FANOUT).cast("long")
    if level + 1 == FILE_LEVELS:
        return F.col("file"), F.lit(0).cast("long")
    if level + 1 <= FILE_LEVELS + ARCHIVE_LEVELS:
        return F.floor(F.col("file") / (FANOUT * FANOUT)).cast("long"), F.col("node")
    return F.lit(0).cast("long"), F.col("node")


def _differing(nodes: DataFrame, keys: list[str]) -> DataFrame:
    sides = nodes.groupBy(*keys).agg(
        F.max(F.when(F.col("replica") == 0, F.col("digest"))).alias("own"), F.max(F.when(F.col("replica") == 1, F.col("digest"))).alias("other")
    )
    return sides.filter(~F.col("own").eqNullSafe(F.col("other")))


def differing_leaves(levels: list[DataFrame], scratch: Scratch) -> tuple[DataFrame | None, list[tuple[int, int]]]:
    """Leaves (file, node) that differ, and for each level visited how many nodes differ, root first."""
    top = len(levels) - 1
    differs = scratch.save(_differing(levels[top], ["file", "node"]).select("file", "node"), f"differs-{top}")
    report = [(top, differs.count())]
    for level in range(top - 1, -1, -1):
        if not report[-1][1]:
            return None, report
        file, node = _parent(level)
        children = levels[level].withColumn("up_file", file).withColumn("up_node", node)
        parents = differs.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
        visited = children.join(parents, ["up_file", "up_node"], "left_semi")
        differs = scratch.save(_differing(visited, ["file", "node"]).select("file", "node"), f"differs-{level}")
        report.append((level, differs.count()))
    return differs if report[-1][1] else None, report


def audit(original: DataFrame, replica: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Every record of both replicas with its state, and the descent's report.

    Both hold file, offset, length, digest; original may hold more columns, which stay. State is ok, corrupt (the slot
    holds other bytes), missing (the replica lacks the slot) or extra (only the replica has it).
    """
    scratch = Scratch(original.sparkSession, "fixity")
    own = original.select(F.lit(0).alias("replica"), "file", "offset", "length", "digest")
    other = replica.select(F.lit(1).alias("replica"), "file", "offset", "length", "digest")
    both = scratch.save(own.unionByName(other), "records")
    leaves, report = differing_leaves(trees(both, scratch), scratch)
    if leaves is None:
        return original.withColumn("replica_digest", F.col("digest")).withColumn("state", F.lit("ok")), report
    inside = both.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(leaves, ["file", "node"], "left_semi")
    slots = scratch.save(_differing(inside, ["file", "offset"]), "slots")
    scratch.keep("slots")
    state = F.when(F.col("other").isNull(), F.lit("missing")).when(F.col("own").isNull(), F.lit("extra")).otherwise(F.lit("corrupt"))
    slots = slots.withColumn("state", state)
    known = original.join(slots.filter("own IS NOT NULL").select("file", "offset", "other", "state"), ["file", "offset"], "left")
    columns = original.columns
    known = known.select(
        *columns, F.when(F.col("state").isNull(), F.col("digest")).otherwise(F.col("other")).alias("replica_digest"),
        F.coalesce("state", F.lit("ok")).alias("state"),
    )
    extra = slots.filter("own IS NULL").select("file", "offset", F.col("other").alias("replica_digest"), "state")
    return known.unionByName(extra, allowMissingColumns=True), report
