"""Connected components of an edge table, by alternating stars.

Every round hooks the neighbours of each node to the least of them (the larger
ones, then the smaller ones); minima are pre-aggregated and meet the edges by a
join, so no task gathers a node's neighbours. Rounds are written to the shared
folder and end when a round changes nothing; their number grows with the
logarithm of the longest path. What is left of the edges is counted in every round:
once they are few enough for the memory of one task, one task ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

#: Edges (16 bytes each) that one task unites.
FEW = 1 << 17


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[label]


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        nodes, component = united(*(np.concatenate(x) for x in zip(*held)))
        for a in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (nodes, component)], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hooked = down.join(least, "u")
    return hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, component (the least node of its component) for every node of an edge (columns a, b)."""
    state = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    current = scratch.keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), f"{label}-0")
    before = state(current)
    k = 0
    while before.n:
        if before.n <= FEW:
            return scratch.keep(current.coalesce(1).mapInArrow(_in_one, "node long, component long"), f"{label}-end")
        k += 1
        current = scratch.keep(_small_star(_large_star(current)), f"{label}-{k}")
        after = state(current)
        scratch.drop(f"{label}-{k - 1}")
        if after == before:
            break
        before = after
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
