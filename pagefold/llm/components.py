"""Connected components of an edge table by repeated hook and contract.

Every round first contracts what a partition of bounded size holds; then each vertex takes the least of
its neighbours and itself - by id in the first rounds, as edges here mostly point at the
first member of a group, and by a random rank after that, so that long paths shrink as well.
The edges are rewritten to those labels, and what is left is a smaller graph. Each round is
written to the shared checkpoint folder; edges and labels stay in Spark throughout. A hub
only meets a partial aggregate and joins that adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.blocks import saved

BY_ID = 4
#: Edges that one task contracts; more edges make more partitions.
PARTITION_EDGES = 1 << 20


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside one task -> (node, least node of its component) for all their nodes."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[x], label[y]
        differ = x != y
        if not differ.any():
            return nodes, nodes[label]
        x, y = x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _contracted(batches):
    """The edges of one partition as edges to the least node of their component in it."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, root = local_components(*(np.concatenate(x) for x in zip(*held)))
        far = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], names=["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, label long) for every node of an edge; nodes of one
    component, and no others, share a label, itself a node of the component. Loops and
    repeated edges do no harm; no edges give no rows."""
    left, rounds = saved(edges.select("a", "b").where("a <> b").distinct()), []
    while (size := left.count()) > 0:
        parts = -(-size // PARTITION_EDGES)
        left = saved(left.coalesce(parts).mapInArrow(_contracted, "a long, b long"))
        if parts == 1:  # one partition held all that was left, so its components are whole
            rounds.append(left.union(left.select("b", "b").distinct()).toDF("node", "label"))
            break
        seed = len(rounds)
        if seed < BY_ID:
            rank, best = F.col, lambda m: m
        else:
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("r"), F.col(c).alias("n"))
            best = lambda m: m["n"]
        ends = left.union(left.select("b", "a")).toDF("node", "other")
        label = (ends.groupBy("node").agg(F.min(rank("other")).alias("m"))
                 .select("node", best(F.least(rank("node"), F.col("m"))).alias("label")))
        to = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to"))
        done = saved(left.join(to("a"), "a").join(to("b"), "b"))
        rounds.append(done.select("a", "a_to").union(done.select("b", "b_to")).distinct().toDF("node", "label"))
        left = saved(done.where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct())
    if not rounds:
        return left.toDF("node", "label")
    # a vertex that no later round knows has found its label
    found = rounds[-1]
    for label in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = label.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return saved(found)
