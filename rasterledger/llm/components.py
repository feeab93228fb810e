"""Connected components of a graph whose links are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterledger.session import pin

#: Links that one task contracts, 16 bytes each. A longer list is contracted in rounds over all tasks, with the same roots.
TASK_LINKS = 1_000_000


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the smallest node reached.

    The links are counted first. Up to ``TASK_LINKS`` of them go to one task, as rounds over
    all tasks would cost more than the work. More are contracted in
    rounds of stars: each node hands its larger neighbours to the smallest
    one it knows, then its smaller ones. A link list shrinks or stays each time, and
    rounds grow with the logarithm of the graph's size. Groups are only ever reduced to
    their minimum before a join, so a node with very many links is added up before the
    shuffle.
    """
    edges = pin(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    if edges.count() <= TASK_LINKS:
        return pin(_in_one_task(edges))
    while True:
        # Large star: larger neighbours of a node go to the smallest of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = pin(small.where("u > v").distinct())
        same = after.exceptAll(edges).isEmpty() and after.count() == edges.count()
        edges = after
        if same:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links (u, v), sorted, and the smallest node that each of them reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        # Roots that a link joins point to the lowest of them; then every node points to its root again.
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of a pinned list of links (u, v) that is known to be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if held:
            nodes, roots = smallest_reached(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for start in range(0, len(nodes), 65_536):
                part = slice(start, start + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(roots[part])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")
