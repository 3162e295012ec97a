"""Rows packed into blocks, and pairs of blocks that meet in a task of their own.

A cell holds the rows that may match each other or the rows of neighbouring cells. A cell of many rows is spread over several
blocks, so no task holds more than two blocks however the rows are distributed. Blocks are written once; only the pairs of
blocks (a few numbers each) are joined before the blocks themselves travel, once for each pair that they take part in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.sources.shared import cut


def packed(rows: DataFrame, size: int, *by: str, n: int | None = None) -> DataFrame:
    """cell, part, rows: the rows of a cell (column cell), dealt by the columns `by` to arrays of about `size`. n: the number of
    rows, where all are of one cell."""
    if n is None:
        many = rows.groupBy("cell").count().where(F.col("count") > size).select("cell", F.ceil(F.col("count") / size).alias("parts"))
        rows, parts = rows.join(many, "cell", "left"), F.coalesce("parts", F.lit(1))
    else:
        parts = F.lit(-(-n // size) or 1)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*by), parts))
    held = F.collect_list(F.struct(*[c for c in rows.columns if c not in ("cell", "parts")]))
    return cut(dealt.groupBy("cell", "part").agg(held.alias("rows")), "blocks")


def meetings(blocks: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """c1, p1, c2, p2: every pair of blocks of a cell, each block with itself included, and of a cell and its neighbours (cell,
    other), where those are given. Of two orders one is kept."""
    one = blocks.select(F.col("cell").alias("c1"), F.col("part").alias("p1"))
    two = blocks.select(F.col("cell").alias("c2"), F.col("part").alias("p2"))
    at = one.withColumn("c2", F.col("c1")) if neighbours is None else one.join(neighbours.select(F.col("cell").alias("c1"), F.col("other").alias("c2")), "c1")
    return at.join(two, "c2").where("c1 < c2 or c1 = c2 and p1 <= p2").select("c1", "p1", "c2", "p2")


def meet(blocks: DataFrame, pairs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `run` makes of rows (c1, p1, c2, p2, l, r): the pairs of blocks with their contents."""
    pairs = cut(pairs, "meetings")
    k, keys = max(pairs.count(), 1), ["c1", "p1", "c2", "p2"]
    n = min(k, max(4 * pairs.sparkSession.sparkContext.defaultParallelism, -(-k // 64)))
    left = blocks.select(F.col("cell").alias("c1"), F.col("part").alias("p1"), F.col("rows").alias("l")).join(pairs, ["c1", "p1"]).repartition(n, *keys)
    right = blocks.select(F.col("cell").alias("c2"), F.col("part").alias("p2"), F.col("rows").alias("r")).join(pairs, ["c2", "p2"]).repartition(n, *keys)
    return left.join(right, keys).select(*keys, "l", "r").mapInArrow(run, schema)


def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.StructArray, pa.StructArray]]:
    """cell, whether both are one block, and the rows of both, for each row of meet()."""
    for rb in batches:
        keys = [rb.column(c).to_pylist() for c in ("c1", "p1", "c2", "p2")]
        for c1, p1, c2, p2, l, r in zip(*keys, rb.column("l"), rb.column("r"), strict=True):
            yield c1, (c1, p1) == (c2, p2), l.values, r.values


class Forest:
    """Components of links that arrive in batches: label[i] is the smallest node known to be joined with node i."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            on = x != y
            if not on.any():
                return
            a, b, x, y = a[on], b[on], x[on], y[on]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Fewer edges than nodes, with the components of all links added."""
        a = np.flatnonzero(self.label != np.arange(len(self.label)))
        return a, self.label[a]
