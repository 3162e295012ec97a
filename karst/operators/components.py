"""Connected components of an edge list: alternating large-star and small-star rounds.

Each round rewires every node to the smallest node it can see; after O(log^2) rounds every component is a star around its
smallest node. Every round is written to the shared folder, which cuts lineage and survives lost executors. Edges are counted
before each round; once at most ONE_TASK are left (16 bytes each), one task on an executor finishes them by union-find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.blocks import Forest
from karst.sources.shared import cut, drop_cut

ONE_TASK = 2_000_000


def _large(e: DataFrame) -> DataFrame:
    """For each node, its larger neighbours are linked to the smallest of its neighbours and itself."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """For each node, its smaller neighbours and itself are linked to the smallest of them. a > b in every edge."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    near = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _stars(batches):
    """The stars of all edges (a, b), which are long integers."""
    parts = [(rb.column(0).to_numpy(), rb.column(1).to_numpy()) for rb in batches if rb.num_rows]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.add(at[: len(a)], at[len(a) :])
        for rows in np.array_split(np.stack(forest.edges()), max(len(nodes) // 100_000, 1), axis=1):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[x]) for x in rows], ["a", "b"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node with an edge. Self loops and nulls are ignored."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct()
    e = cut(e, "cc")
    small = {kind for _, kind in e.dtypes} == {"bigint"}
    before = None
    for _ in range(rounds):
        if small and e.count() <= ONE_TASK:
            new = cut(e.repartition(1).mapInArrow(_stars, "a long, b long"), "cc")
            drop_cut(e)
            e = new
            break
        new = cut(_small(_large(e)), "cc")
        drop_cut(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def with_singletons(items: DataFrame, edges: DataFrame, item: str = "item_id") -> DataFrame:
    """item, component of every item; edge ends that are no items are added as nodes."""
    cc = connected_components(edges)
    nodes = items.select(F.col(item).alias("node")).union(cc.select("node")).distinct()
    return nodes.join(cc, "node", "left").select(F.col("node").alias(item), F.coalesce("component", "node").alias("component"))
