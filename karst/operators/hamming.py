"""Pairs of codes within a Hamming distance: three plans with the same result, and the choice between them.

All three compare blocks of codes in Arrow batches, and differ in which blocks meet: all of them; those that share a chunk of
the code up to a few bits; those at like distances from a few pivots.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions.codes import hamming
from karst.operators.blocks import Forest, block_pairs, meet, meetings, packed
from karst.sources.shared import cut

BRUTE_FORCE_MOST = 5000
LEAST_BLOCK, MOST_BLOCK = 2048, 65536
#: Seconds that a row of a block, a comparison and a pair of blocks take, for the choice of chunks.
ROW_S, COMPARE_S, MEETING_S = 3e-6, 5e-9, 2e-3
MOST_NEIGHBOURS = 2000
PIVOTS = 3


@dataclass(frozen=True)
class Chunk:
    """Bits [shift, shift + width) of a code; codes within the threshold differ in at most `radius` of them for some chunk."""

    shift: int
    width: int
    radius: int

    def masks(self) -> list[int]:
        """All differences of at most `radius` bits of the chunk, as values of the chunk."""
        return [sum(1 << b for b in bits) for k in range(min(self.radius, self.width) + 1) for bits in itertools.combinations(range(self.width), k)]

    def n_masks(self) -> int:
        return sum(math.comb(self.width, k) for k in range(min(self.radius, self.width) + 1))


ALL = [Chunk(0, 0, 64)]


def split_bits(m: int, t: int, bits: int = 64) -> list[Chunk]:
    """m near-equal chunks. With t = m * q + s, codes within t differ in at most q bits in one of s + 1 chunks, or in at most
    q - 1 in one of the others (else they would differ in (s + 1)(q + 1) + (m - s - 1) q = t + 1)."""
    q, s = divmod(t, m)
    out, shift = [], 0
    for i in range(m):
        width = bits // m + (i < bits % m)
        radius = q if i <= s else q - 1
        if radius >= 0:
            out.append(Chunk(shift, width, radius))
        shift += width
    return out


def cost(chunks: list[Chunk], n: int, size: int) -> float:
    """Seconds of one core for n codes of evenly distributed bits."""
    out = len(chunks) * n * ROW_S
    for c in chunks:
        cells = min(2.0**c.width, n)
        out += n * n / 2 * c.n_masks() / 2.0**c.width * COMPARE_S + cells * max(1.0, c.n_masks() * cells / 2.0**c.width / 2) * math.ceil(n / cells / size) ** 2 * MEETING_S
    return out


def choose_chunks(n: int, t: int, bits: int = 64) -> list[Chunk]:
    """The cheapest division: few wide chunks with some bits free for many codes, more and narrower ones for fewer. Where any
    division makes more comparisons than there are pairs (large t), one chunk of no bits: all blocks meet."""
    if t >= bits:
        return ALL
    ways = (split_bits(m, t, bits) for m in range(2, max(t, 1) + 2))
    return min([ALL, *(w for w in ways if all(c.n_masks() <= MOST_NEIGHBOURS for c in w))], key=lambda w: cost(w, max(n, 1), block_size(n)))


def block_size(n: int) -> int:
    """Blocks enough for all cores, and no more than needed, since each travels once for every other."""
    return max(LEAST_BLOCK, min(MOST_BLOCK, n // 16))


def _compare(codes: int, t: int, chunks: list[Chunk], link: bool):
    """Pairs within t by all of their codes, out of the first chunk of the first code that brings them together; with `link`,
    edges that join the same items instead, fewer than the items of the two blocks."""
    rows, cols = 64, 8192

    def within(l: list, r: list, same: bool, pos: int):
        xor, count = np.empty((rows, cols), np.uint64), np.empty((rows, cols), np.uint8)
        for i in range(0, len(l[0]), rows):
            a = l[0][i : i + rows]
            for j in range(i // cols * cols if same else 0, len(r[0]), cols):
                b = r[0][j : j + cols]
                x, c = xor[: len(a), : len(b)], count[: len(a), : len(b)]
                np.bitwise_count(np.bitwise_xor(a[:, None], b[None, :], out=x), out=c)
                p, q = np.nonzero(c <= t)
                p, q = p + i, q + j
                if same:
                    p, q = p[p < q], q[p < q]
                for k in range(1, codes):
                    on = np.bitwise_count(l[k][p] ^ r[k][q]) <= t
                    p, q = p[on], q[on]
                if pos:
                    apart, on = l[0][p] ^ r[0][q], np.ones(len(p), bool)
                    for c in chunks[:pos]:
                        on &= np.bitwise_count(apart & np.uint64(((1 << c.width) - 1) << c.shift)) > c.radius
                    p, q = p[on], q[on]
                if len(p):
                    yield p, q

    def run(batches):
        for cell, same, left, right in block_pairs(batches):
            l, r = ([v.field(f"code{k}").to_numpy().view(np.uint64) for k in range(codes)] for v in (left, right))
            ids, other = left.field("item_id"), right.field("item_id")
            found = within(l, r, same, 0 if link else cell >> 56)
            if link:
                n = 0 if same else len(ids)
                forest = Forest(n + len(other))
                for p, q in found:
                    forest.add(p, q + n)
                both = ids if same else pa.concat_arrays([ids, other])
                p, q = forest.edges()
                found, ids, other = [(p, q)], both, both
            for p, q in found:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), other.take(pa.array(q))], ["x", "y"])

    return run


ONE = None


def _pairs(items: DataFrame, t: int, cells, neighbours=None, chunks: list[Chunk] = ALL, link: bool = False) -> DataFrame:
    """items: item_id and code0, code1, ... ; cells: a column of cells, or ONE cell of all."""
    codes = len(items.columns) - 1
    n = items.count()
    blocks = packed(items.select((F.lit(0).cast("long") if cells is ONE else cells).alias("cell"), "*"), block_size(n), "item_id", n=n if cells is ONE else None)
    around = None if neighbours is None else neighbours(blocks.select("cell").distinct())
    kind = dict(items.dtypes)["item_id"]
    met = meet(blocks, meetings(blocks, around), _compare(codes, t, chunks, link), f"x {kind}, y {kind}")
    return met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def _items(codes: DataFrame) -> DataFrame:
    return cut(codes.where("code is not null and item_id is not null").select("item_id", F.col("code").alias("code0")), "codes")


def brute_force(codes: DataFrame, t: int) -> DataFrame:
    """src < dst: all pairs of items, compared. codes: item_id, code."""
    return _pairs(_items(codes), t, ONE)


def _by_chunks(items: DataFrame, t: int, bits: int, link: bool = False, chunks: list[Chunk] | None = None) -> DataFrame:
    chunks = chunks or choose_chunks(items.count(), t, bits)
    if chunks == ALL:
        return _pairs(items, t, ONE, link=link)
    value = lambda c: F.shiftrightunsigned("code0", c.shift).bitwiseAND(F.lit((1 << c.width) - 1).cast("long"))
    cells = F.explode(F.array(*[value(c) + F.lit(k << 56).cast("long") for k, c in enumerate(chunks)]))
    masks = items.sparkSession.createDataFrame([(k, m) for k, c in enumerate(chunks) if c.radius for m in c.masks()], "pos long, mask long")

    def neighbours(cells: DataFrame) -> DataFrame:
        """At most chunks * MOST_NEIGHBOURS masks are broadcast."""
        near = cells.join(F.broadcast(masks), F.shiftright("cell", 56) == F.col("pos")).select("cell", F.col("cell").bitwiseXOR(F.col("mask")).alias("other"))
        return near.union(cells.select("cell", F.col("cell").alias("other"))).where("other >= cell").distinct()

    return _pairs(items, t, cells, neighbours if any(c.radius for c in chunks) else None, chunks, link)


def multi_index(codes: DataFrame, t: int, bits: int = 64, chunks: list[Chunk] | None = None) -> DataFrame:
    """src < dst: pairs whose codes agree, up to a few bits, in one of several chunks, compared. A pair comes out of its first
    such chunk only, so nothing has to be made distinct."""
    return _by_chunks(_items(codes), t, bits, chunks=chunks)


def pivot(codes: DataFrame, t: int, n_pivots: int = PIVOTS) -> DataFrame:
    """By the triangle inequality, codes within t differ by at most t in their distance to any pivot: cells of t + 1 distances
    to several pivots taken from the data meet their neighbours. The first pivot is any code, each next one is the code
    farthest from those before it."""
    items = _items(codes)
    pivots: list[int] = []
    for _ in range(n_pivots):
        far = F.least(*[hamming(F.col("code0"), F.lit(p).cast("long")) for p in pivots], F.lit(64)) if pivots else F.xxhash64("code0")
        found = items.agg(F.max_by("code0", F.struct(far.alias("far"), "code0")).alias("p")).first()[0]
        if found is None or found in pivots:
            break
        pivots.append(found)
    cell = F.lit(0).cast("long")
    for p in pivots:
        cell = cell * 256 + F.floor(hamming(F.col("code0"), F.lit(p).cast("long")) / (t + 1)).cast("long") + 1
    steps = [sum(s * 256**k for k, s in enumerate(move)) for move in itertools.product((-1, 0, 1), repeat=len(pivots))]
    offsets = F.array(*[F.lit(s).cast("long") for s in steps])

    def neighbours(cells: DataFrame) -> DataFrame:
        return cells.select("cell", F.explode(F.transform(offsets, lambda s: F.col("cell") + s)).alias("other")).where("other >= cell")

    return _pairs(items, t, cell, neighbours)


STRATEGIES = {"bruteforce": brute_force, "multiindex": multi_index, "bktree": pivot}


def choose_strategy(name: str, n_items: int) -> str:
    """The strategy of a name, which may hold underscores; auto goes by the number of items."""
    name = name.replace("_", "")
    if name == "auto":
        return "bruteforce" if n_items <= BRUTE_FORCE_MOST else "multiindex"
    if name not in STRATEGIES:
        raise ValueError(f"unknown search strategy {name!r}")
    return name


def linking_pairs(codes: DataFrame, t: int, bits: int = 64) -> DataFrame:
    """Edges with the components of multi_index(): items of equal codes are linked to the first of them only, and a pair of
    blocks gives a spanning forest of its pairs, so a group of any size costs few edges."""
    items = _items(codes)
    first = cut(items.groupBy("code0").agg(F.min("item_id").alias("src")), "distinct-codes")
    copies = items.withColumnRenamed("item_id", "dst").join(first, "code0").where("src < dst").select("src", "dst")
    return _by_chunks(first.select(F.col("src").alias("item_id"), "code0"), t, bits, link=True).union(copies)


def pairs_on_all(codes: DataFrame, algos: list[str], t: int, bits: int = 64) -> DataFrame:
    """src < dst: pairs within t by every one of the algorithms, decided where blocks meet by the first. codes: item_id, algo,
    code (one of an algorithm each); an item that lacks one has no pairs."""
    wide = codes.where("item_id is not null").groupBy("item_id").agg(*[F.first(F.when(F.col("algo") == a, F.col("code")), ignorenulls=True).alias(f"code{k}") for k, a in enumerate(algos)])
    return _by_chunks(cut(wide.na.drop(), "codes"), t, bits)


def combine(pair_sets: list[DataFrame], mode: str) -> DataFrame:
    """Pairs of any, or of all, of the sets; of no sets, none."""
    if mode not in ("any", "all"):
        raise ValueError(f"unknown combine mode {mode!r}")
    if not pair_sets:
        return SparkSession.active().createDataFrame([], "src long, dst long")
    sets = [p.select("src", "dst") for p in pair_sets]
    return reduce(DataFrame.union, sets).distinct() if mode == "any" else reduce(DataFrame.intersect, sets)
