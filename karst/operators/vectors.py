"""Nearest-neighbour joins over embeddings: flat (exact), inverted lists, product-quantised with exact re-ranking.

Every plan multiplies blocks of vectors in Arrow batches. Blocks bound what a task holds; two blocks meet in a task of their
own, which leaves the best k of either side, so no task ever sees all vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.blocks import Forest, block_pairs, meet, meetings, packed
from karst.sources.shared import cut

FLAT_MOST, IVF_MOST = 1_000_000, 10_000_000
LEAST_BLOCK, BLOCK_BYTES = 2048, 4 << 20
STRIP = 256
BLOCK = 4096
PAIR = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
KIND = "q long, v long, sim double"


def matrix(column: pa.Array) -> np.ndarray:
    """List column to a double matrix, rows of unit length (zero rows stay zero)."""
    n = len(column)
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best(q_ids, v_ids, sim, k: int, least: float | None) -> pa.RecordBatch:
    """The k best of each row of sim (ties: smaller v), not below `least`."""
    mask = np.isfinite(sim) if least is None else sim >= least
    if k < sim.shape[1]:
        mask &= sim >= np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None]
    i, j = np.nonzero(mask)
    s, q, v = sim[i, j], q_ids[i], v_ids[j]
    order = np.lexsort((v, -s, i))
    i = i[order]
    order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
    return pa.RecordBatch.from_arrays([pa.array(q[order]), pa.array(v[order]), pa.array(s[order])], schema=PAIR)


def blocks(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """Blocks of all vectors: enough for all cores, and of at most about BLOCK_BYTES, since each travels once for every other."""
    v = vectors.where("embedding is not null").select("vec_id", "embedding")
    n = v.count()
    if size is None:
        first = v.select(F.size("embedding")).first()
        size = max(LEAST_BLOCK, min(BLOCK_BYTES // (4 * max(first[0] if first else 1, 1)), n // 12))
    return packed(v.withColumn("cell", F.lit(0).cast("long")), size, "vec_id", n=n)


def flat_knn(vectors: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """q, v, sim, rank: exact k best by inner product of unit vectors, the query itself among them. vectors: vec_id, embedding."""

    def run(batches):
        for _, same, l, r in block_pairs(batches):
            q, v = l.field("vec_id").to_numpy(), r.field("vec_id").to_numpy()
            a, c = matrix(l.field("embedding")), matrix(r.field("embedding"))
            for x, y, m, n in ((q, v, a, c), (v, q, c, a))[: 1 if same else 2]:
                for at in range(0, len(x), STRIP):
                    yield _best(x[at : at + STRIP], y, m[at : at + STRIP] @ n.T, k, least)

    b = blocks(vectors)
    near = meet(b, meetings(b), run, KIND)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "v")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def range_join(vectors: DataFrame, least: float, link: bool = False) -> DataFrame:
    """src < dst: every pair of vectors with an inner product of unit vectors of at least `least`, however many a vector has.
    With link, a spanning forest of the pairs of each two blocks instead."""

    def run(batches):
        for _, same, l, r in block_pairs(batches):
            q, v = l.field("vec_id").to_numpy(), r.field("vec_id").to_numpy()
            a, c = matrix(l.field("embedding")), matrix(r.field("embedding"))
            n = 0 if same else len(q)
            forest = Forest(n + len(v))
            for at in range(0, len(q), STRIP):  # bounds the pairs held at once
                x, y = np.nonzero(a[at : at + STRIP] @ c.T >= least)
                x += at
                if same:  # both orders are here
                    x, y = x[x < y], y[x < y]
                if link:
                    forest.add(x, y + n)
                else:
                    s, d = q[x], v[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, d)), pa.array(np.maximum(s, d))], ["src", "dst"])
            if link:
                both = v if same else np.concatenate([q, v])
                s, d = (both[e] for e in forest.edges())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, d)), pa.array(np.maximum(s, d))], ["src", "dst"])

    b = blocks(vectors)
    return meet(b, meetings(b), run, "src long, dst long")


def linking_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """Edges with the components of range_join's (least <= 1): equal vectors are linked to the first of them only, and a pair of
    blocks gives a spanning forest of its pairs."""
    v = vectors.where("embedding is not null and exists(embedding, x -> x <> 0)").select("vec_id", "embedding")
    first = cut(v.groupBy("embedding").agg(F.min("vec_id").alias("src")), "distinct-vectors")
    copies = v.withColumnRenamed("vec_id", "dst").join(first, "embedding").where("src < dst").select("src", "dst")
    return range_join(first.withColumnRenamed("src", "vec_id"), least, link=True).union(copies)


def flagged_pairs(knn: DataFrame, threshold: float) -> DataFrame:
    """Unordered pairs of neighbours at or above the threshold."""
    near = knn.where((F.col("q") != F.col("v")) & (F.col("sim") >= threshold))
    return near.select(F.least("q", "v").alias("src"), F.greatest("q", "v").alias("dst")).distinct()


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + BLOCK] @ c.T, axis=1) for i in range(0, len(x), BLOCK)])
        total, n = np.zeros_like(c), np.bincount(at, minlength=k)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def sample(vectors: DataFrame, most: int, seed: int = 42) -> np.ndarray:
    """At most `most` vectors, by the smallest hashes of their ids."""
    n = vectors.count()
    v = vectors.where("embedding is not null")
    if n > most:
        v = v.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return matrix(v.orderBy("vec_id").select("embedding").toArrow().column(0).combine_chunks())


def auto_nlist(n: int) -> int:
    return max(1, min(65536, int(4 * math.sqrt(n))))


def _parts(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """cell, name: the rows of each cell as lists of about BLOCK or fewer, by the counted rows of that very cell, so a cell that
    holds a third of all vectors is many lists. A row per cell is broadcast: there are nlist of them."""
    parts = df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    salted = df.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return salted.groupBy("cell", "part").agg(F.collect_list(F.struct("vec_id", *columns)).alias(name)).drop("part")


def ivf_knn(vectors: DataFrame, k: int, nlist: int, nprobe: int, least: float | None = None, seed: int = 42) -> DataFrame:
    """k best among the vectors of the nprobe cells nearest to each query."""
    n = vectors.count()
    nlist = max(1, min(nlist, n))
    centres = vectors.sparkSession.sparkContext.broadcast(kmeans(sample(vectors, max(50_000, 40 * nlist), seed), nlist, seed=seed))

    def cells(m: int):
        def run(batches):
            for rb in batches:
                if rb.num_rows:
                    c = centres.value
                    d = (c * c).sum(1) - 2 * matrix(rb.column("embedding")) @ c.T
                    at = np.argsort(d, axis=1, kind="stable")[:, :m]
                    i = pa.array(np.repeat(np.arange(rb.num_rows), at.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1).astype(np.int32)), rb.column("vec_id").take(i), rb.column("embedding").take(i)], ["cell", "vec_id", "embedding"])

        return vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, "cell int, vec_id long, embedding array<float>")

    def run(batches):
        for rb in batches:
            for l, r in zip(rb.column("l"), rb.column("r"), strict=True):
                l, r = l.values, r.values
                yield _best(l.field("vec_id").to_numpy(), r.field("vec_id").to_numpy(), matrix(l.field("embedding")) @ matrix(r.field("embedding")).T, k, least)

    pairs = _parts(cells(min(nprobe, nlist)), "l", "embedding").join(_parts(cells(1), "r", "embedding"), "cell")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "v")
    return pairs.select("l", "r").mapInArrow(run, KIND).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pq_knn(vectors: DataFrame, k: int, nlist: int, nprobe: int, m: int, nbits: int = 8, rerank: bool = True, rerank_k: int = 100, seed: int = 42) -> DataFrame:
    """Shortlist by product-quantised distances inside the probed cells, then exact similarities of the shortlist."""
    first = vectors.where("embedding is not null").select(F.size("embedding")).first()
    dim = first[0] if first else m
    if dim % m:
        raise ValueError(f"dim {dim} is not divisible by m {m}")
    n = vectors.count()
    nlist = max(1, min(nlist, n))
    some = sample(vectors, max(50_000, 40 * nlist), seed)
    coarse = kmeans(some, nlist, seed=seed)
    books = [kmeans(some[:, i * (dim // m) : (i + 1) * (dim // m)], 1 << nbits, seed=seed) for i in range(m)]
    shared = vectors.sparkSession.sparkContext.broadcast((coarse, books))
    d = dim // m

    def encode(batches):
        coarse, books = shared.value
        for rb in batches:
            if rb.num_rows:
                x = matrix(rb.column("embedding"))
                cell = np.argmin((coarse * coarse).sum(1) - 2 * x @ coarse.T, axis=1).astype(np.int32)
                code = np.stack([np.argmin((b * b).sum(1) - 2 * x[:, i * d : (i + 1) * d] @ b.T, axis=1) for i, b in enumerate(books)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(cell), rb.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "vec_id", "code"])

    def probe(batches):
        coarse, _ = shared.value
        for rb in batches:
            if rb.num_rows:
                at = np.argsort((coarse * coarse).sum(1) - 2 * matrix(rb.column("embedding")) @ coarse.T, axis=1, kind="stable")[:, :nprobe]
                i = pa.array(np.repeat(np.arange(rb.num_rows), at.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1).astype(np.int32)), rb.column("vec_id").take(i), rb.column("embedding").take(i)], ["cell", "vec_id", "embedding"])

    short = max(rerank_k, k) if rerank else k

    def run(batches):
        _, books = shared.value
        for rb in batches:
            for l, r in zip(rb.column("l"), rb.column("r"), strict=True):
                l, r = l.values, r.values
                x, code = matrix(l.field("embedding")), np.frombuffer(b"".join(r.field("code").to_pylist()), np.uint8).reshape(-1, m)
                sim = sum((x[:, i * d : (i + 1) * d] @ b.T)[:, code[:, i]] for i, b in enumerate(books))
                yield _best(l.field("vec_id").to_numpy(), r.field("vec_id").to_numpy(), sim, short, None)

    v = vectors.where("embedding is not null").select("vec_id", "embedding")
    pairs = _parts(v.mapInArrow(probe, "cell int, vec_id long, embedding array<float>"), "l", "embedding").join(_parts(v.mapInArrow(encode, "cell int, vec_id long, code binary"), "r", "code"), "cell")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "v")
    got = pairs.select("l", "r").mapInArrow(run, KIND).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= short)
    if not rerank:
        return got
    exact = got.select("q", "v").join(v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("l")), "q").join(v.select(F.col("vec_id").alias("v"), F.col("embedding").alias("r")), "v")

    def again(batches):
        for rb in batches:
            if rb.num_rows:
                sim = (matrix(rb.column("l")) * matrix(rb.column("r"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([rb.column("q"), rb.column("v"), pa.array(sim)], schema=PAIR)

    return exact.select("q", "v", "l", "r").mapInArrow(again, KIND).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_index(n: int, dim: int, index_type: str = "auto", ram_budget_gb: float = 24.0) -> str:
    """flat, ivfflat or ivfpq, by number, memory of single-precision vectors, or choice."""
    if index_type != "auto":
        if index_type not in ("flat", "ivfflat", "ivfpq"):
            raise ValueError(f"unknown index type {index_type!r}")
        return index_type
    fits = n * dim * 4 / 1024**3 <= ram_budget_gb
    return "flat" if n < FLAT_MOST and fits else "ivfflat" if n < IVF_MOST and fits else "ivfpq"


def search(vectors: DataFrame, k: int, index: str, nlist: int = 0, nprobe: int = 16, m: int = 8, nbits: int = 8, rerank_k: int = 100, least: float | None = None, rerank: bool = True, seed: int = 42) -> DataFrame:
    if index == "flat":
        return flat_knn(vectors, k, least)
    nlist = nlist or auto_nlist(vectors.count())
    return ivf_knn(vectors, k, nlist, nprobe, least, seed) if index == "ivfflat" else pq_knn(vectors, k, nlist, nprobe, m, nbits, rerank, rerank_k, seed)
