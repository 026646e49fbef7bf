"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Links stay distributed: every step is a group-by and a join, and the lineage is cut by a checkpoint after each. Up to
FEW links are put together in one task instead, with the same result: steps of many small shuffles cost more than that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, trimmed

#: Distinct links that one task holds at most, in 16 bytes each.
FEW = 1 << 20


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: the larger neighbours of a node go to its least neighbour (itself included);
    small: the smaller neighbours and the node itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u > v holds for every edge
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) -> (node, component): roots hook to lesser roots until no link joins two."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    node, at = np.unique(np.r_[u, v], return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while len(i):
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root != (up := root[root])).any():
            root = up
        i, j = root[i], root[j]
        apart = i != j
        i, j = i[apart], j[apart]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, component): component is the least node that can be reached.

    Only nodes with an edge appear; loops, repeated and reversed edges and nulls do no harm."""
    now = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(trimmed(_in_one_task), "node long, component long")
    before = None
    while True:  # to the fixed point
        now = cut(_stars(_stars(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
