"""Connected components by alternating large-star and small-star steps.

Edges stay distributed: each round is two aggregates and two joins by node, written to the shared folder. A node with
very many neighbours is pre-aggregated for its minimum and skew-joined for the rewrite, so no task gathers it. Few edges
(at most EDGES_A_TASK, 16 MB) are united in one task, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import materialise, release


EDGES_A_TASK = 1 << 20


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): each u's smallest neighbour (or u itself) takes over u's larger (large) or smaller neighbours."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(low, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(low.select("u", F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest-label union of the pairs (i, j) into label."""
    while True:
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        if (a == b).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            down = label[label]
            if (down == label).all():
                break
            label = down


def _united(batches):
    """(node, component) of all edges of one task."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = hook(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (u, v) of longs; component is the smallest node of its class.

    Loops and null ends are ignored; repeated and reversed edges count once; no edge gives an empty table.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    seen = _print(edges)
    if seen[0] <= EDGES_A_TASK:
        return materialise(edges.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        after = materialise(_star(_star(both, True).distinct(), False).distinct(), "edges")
        now = _print(after)
        release(edges)
        edges = after
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
