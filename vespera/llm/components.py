"""Connected components of a graph given as links, by contraction; nothing comes to the driver but counts.

Links that are left over once they are few are resolved in one task, as each round costs several
shuffles however few links it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import map_arrow, written

#: So many links, of 16 bytes each, may be resolved in one task.
FEW = 1 << 18


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, and of each the smallest node reachable: two rounds halve the roots at least."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if links:
        found = smallest_reachable(*(np.concatenate(ends) for ends in zip(*links, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "p"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links (a, b) -> (node, component), component: the smallest node reachable.

    Each round sends every node to its smallest neighbour (or itself) and contracts the links; a
    group of any size around one node takes two rounds, a chain a logarithmic number. At most `few`
    links that are left take one round, in one task.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    if edges.count() > few:
        edges = written(edges.distinct(), "links")
    label: DataFrame | None = None
    while left := edges.count():
        if left <= few:
            parent = written(map_arrow(edges.coalesce(1), _resolved, "a long, p long"), "parents")
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            parent = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("a").alias("component"), "p")
            label = written(label.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        if left <= few:
            break
        ends = [parent.select(F.col("a").alias(x), F.col("p").alias(f"p{x}")) for x in "ab"]
        edges = written(reduce(lambda df, e: df.join(e, e.columns[0]), ends, edges).where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return label
