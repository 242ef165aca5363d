"""Connected components by forests within partitions and pointer jumping between them.

Edges are dealt by their greater node, and each partition replaces its own by a forest of stars at the
least nodes, so a node has one edge left in the partition that owns it. Then each edge's lesser node is
replaced by that one's own parent, which shortens every path by half. When neither step changes
anything, every edge leads to the least node of its component.

Partitions are contracted before the first exchange as well, and in chunks of CHUNK edges, so neither
memory nor an exchange grows with a node's degree; the join by parent keeps only Spark's own exchanges,
whose skewed partitions are split at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that are contracted at once.
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node that the edges reach, and the node, of every node but those least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[i] == label[j]).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


SCHEMA = "a long, b long, moved boolean"


def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) in any order to a forest of each chunk, as components() takes them."""

    def ordered() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            a, b = ends.min(0), ends.max(0)
            use = a < b
            yield pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(b[use]), pa.array(np.zeros(use.sum(), bool))], ["a", "b", "moved"])

    return _contract(ordered(), by_node=False)


def _contract(batches: Iterator[pa.RecordBatch], by_node: bool = True) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, moved), in the order of b if by_node, to a forest of each chunk; moved says whether anything has changed."""
    held: list[np.ndarray] = []
    moved, n = False, 0

    def close(edges: np.ndarray) -> pa.RecordBatch:
        label, node = forest(edges[0], edges[1])
        order = np.lexsort((edges[0], edges[1]))
        a, b = edges[:, order]
        fresh = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]))[: len(a)]
        same = fresh.sum() == len(node) and (a[fresh] == label).all() and (b[fresh] == node).all()
        return pa.RecordBatch.from_arrays([pa.array(label), pa.array(node), pa.array(np.full(len(node), moved or not same))], ["a", "b", "moved"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        moved |= bool(np.any(batch.column(2).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= CHUNK:
            edges = np.concatenate(held, axis=1)
            cut = int(np.flatnonzero(edges[1] == edges[1, -1])[0]) or n if by_node else n  # the last node's run may go on
            yield close(edges[:, :cut])
            held, n = [edges[:, cut:]], n - cut
    if n:
        yield close(np.concatenate(held, axis=1))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node that it reaches, for every node of edges (a, b) but the least of each component. Edges that local() has made come with moved."""
    parts = common.shuffle_partitions(edges.sparkSession)
    plan = edges if "moved" in edges.columns else edges.select("a", "b").mapInArrow(local, SCHEMA)
    jumped = False
    while True:
        rooted = common.checkpointed(plan.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(_contract, SCHEMA))
        if jumped and not rooted.where("moved").limit(1).count():
            return rooted.select(F.col("b").alias("node"), F.col("a").alias("label"))
        parents = rooted.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("parent"))
        plan = rooted.select("a", "b").join(parents, "a", "left").select(F.coalesce("parent", "a").alias("a"), "b", F.col("parent").isNotNull().alias("moved"))
        jumped = True
