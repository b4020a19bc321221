"""Connected components by Spark joins: alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour, so components shrink to stars in a
number of rounds that grows with the logarithm of their diameter. Nothing but two counters of a
round reaches the driver. Every round is written to the shared checkpoint folder.

Up to ``ONE_TASK`` distinct edges, which is checked, are united in one task on an executor instead: the
result is the same, without the rounds' many small jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import durable

#: Edges that one task unites at most (16 bytes each).
ONE_TASK = 100_000


def _united(batches):
    """All edges -> (node, component)."""
    import pyarrow as pa

    from graincart.llm.simhash import _forest

    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    _forest(at[: len(u)], at[len(u) :], parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[parent], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int | None = None) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Edges have no direction; loops, repeats and edges with a null end count for nothing. An empty
    edge table gives an empty result.
    """
    known = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stars, before = durable(known.distinct()), None
    limit = ONE_TASK if one_task is None else one_task
    if stars.limit(limit + 1).count() <= limit:
        return durable(stars.coalesce(1).mapInArrow(_united, "node long, component long"))
    while True:
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or state == before:
            break
        before = state
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before the join, so that both sides are plain exchanges whose hot keys can be split
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = durable(small.union(down).distinct())
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
