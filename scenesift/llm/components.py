"""Connected components by contraction: the graph shrinks every round, so its edges are joined about once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenesift.llm.common import stored

#: Edges (sixteen bytes each) that one task finishes by itself; a larger graph is contracted by joins until it has no more.
TASK_EDGES = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of one task: each node takes the least label next to it, then the label of its label."""
    parts = [(b.column("lo").to_numpy(), b.column("hi").to_numpy()) for b in batches]
    lo, hi = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    a, b = at[: len(lo)], at[len(lo) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        # Hook the labels themselves, so that a whole group moves with its label.
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        while (jumped := after[after] != after).any():
            after[jumped] = after[after[jumped]]
        if (after == label).all():
            break
        label = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def connected(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (lo, hi).

    Every round each node goes to the neighbour that is first in an order drawn anew for the round, if that is before
    itself; edges between nodes that met are gone, the others are joined to the nodes that are left. Once no more than
    ``task_edges`` are left, one task finishes them. Loops and repeated edges count for nothing; nodes without another
    end have no row.
    """
    edges = stored(edges.select("lo", "hi").filter("lo <> hi").distinct())
    rounds = []
    while edges.count() > task_edges:
        place = lambda c, turn=len(rounds): F.xxhash64(c, F.lit(turn))
        both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(edges.select("hi", "lo"))
        best = both.groupBy("node").agg(F.min(F.struct(place("other").alias("place"), "other")).alias("best"))
        moved = stored(best.select("node", F.when(F.col("best.place") < place("node"), F.col("best.other")).otherwise(F.col("node")).alias("up")))
        rounds.append(moved)
        ends = edges.join(moved.toDF("lo", "a"), "lo").join(moved.toDF("hi", "b"), "hi").filter("a <> b")
        edges = stored(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    labels = edges.coalesce(1).mapInArrow(_united, "node long, root long")
    if not rounds:
        return stored(labels)
    # Back through the rounds: a node has the root of the node that it went to.
    for moved in reversed(rounds):
        known = labels.select(F.col("node").alias("up"), "root")
        labels = stored(moved.join(known, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.least("least", "root").alias("root"))


def extended(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, root) after further links (lo, hi): only links between different roots are contracted."""
    known = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.select("lo", "hi").join(known("lo"), "lo", "left").join(known("hi"), "hi", "left")
    ends = ends.select(F.coalesce("lo_root", "lo").alias("lo"), F.coalesce("hi_root", "hi").alias("hi"))
    step = stored(connected(ends))
    moved = groups.join(step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    fresh = step.join(groups.select("node"), "node", "left_anti")
    return stored(moved.unionByName(fresh.select("node", "root")))
