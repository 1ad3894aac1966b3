"""Connected components of an edge table: each task contracts its own edges, alternating large and small stars the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, salted_join

EDGES = "u long, v long"
HELD_EDGES = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the least of its component of these edges, and that least node."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while True:
        after = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of edges to stars over the edges that a task holds at once."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        u, v = contracted(edges.column("u").to_numpy(), edges.column("v").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= HELD_EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def _large_star(edges: DataFrame, scratch: Scratch, name: str, count: int) -> DataFrame:
    """Every node's larger neighbours, linked to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    least = scratch.save(least, f"{name}-large")
    return salted_join(both, least, ["u"], 2 * count).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch, name: str, count: int) -> DataFrame:
    """Every node and its smaller neighbours, linked to the least of them."""
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-small")
    moved = salted_join(edges, least, ["u"], count).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars."""
    roles = edges.select("u", F.lit(1).alias("below")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("below")))
    nodes = roles.groupBy("u").agg(F.sum("below").alias("below"), F.count("*").alias("n"))
    odd = F.count(F.when((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("n") > 1)), 1))
    return tuple(nodes.agg(F.coalesce(F.sum("below"), F.lit(0)), odd).first())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of ``edges`` (u long, v long); component is the least node that it reaches.

    Rounds go on until the edges are stars; each is written to the scratch folder, and the one before it dropped.
    The number of rounds grows with the logarithm of the nodes. Least components stand for themselves.
    """
    k = 0
    held = scratch.save(_downward(edges.select("u", "v").mapInArrow(_contract, EDGES)).mapInArrow(_contract, EDGES), f"{name}-{k}")
    count, odd = _state(held)
    while odd:
        k += 1
        large = scratch.save(_downward(_large_star(held, scratch, f"{name}-{k}", count)), f"{name}-{k}-between")
        after = _downward(_small_star(large, scratch, f"{name}-{k}", large.count())).mapInArrow(_contract, EDGES)
        held = scratch.save(after, f"{name}-{k}")
        count, odd = _state(held)
        for done in (f"{name}-{k}-large", f"{name}-{k}-small", f"{name}-{k}-between", f"{name}-{k - 1}"):
            scratch.drop(done)
    stars = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def heads_of(reached: DataFrame, ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, rank, head): each node's rank, and the least rank in its component; ``ranks`` has node and rank."""
    groups = scratch.save(reached.join(ranks, "node"), "component-groups")
    heads = groups.groupBy("component").agg(F.min("rank").alias("head"), F.count("*").alias("n"))
    heads = scratch.save(heads, "component-heads")
    return salted_join(groups, heads, ["component"], groups.count()).select("node", "rank", "head")
