"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks of block_bytes bytes. Block j of a source of weight w may take an output slot from its
release floor(j / w) and must have one before its deadline ceil((j + 1) / w). Earliest deadline first then never lets a
source lead or lag its weight by a whole block, as long as every source has blocks left. Weights are fractions of a common
denominator D (largest remainders), so after D slots the schedule repeats: the driver schedules one period, D slots
whatever the data's size, and the slot of any block follows from its number by a join with that table.

Block numbers come from prefix sums: bytes per (source, bucket), sums over the buckets of a source, then an order inside each
bucket of a few thousand documents. A source that holds most rows is spread over as many buckets as it needs.

Edge cases: a null source is a source of its own; null or empty texts take no bytes and share a slot with their neighbour; a
text longer than a block leaves the slots it covers; a source that ends leaves its slots empty, and the rest goes on in
order. All rows are kept.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.sources.shared import cut, own_names, spread, text_hash

BLOCK_BYTES = 1 << 16
BUCKET_ROWS = 4096


def quantise(weights: dict, d: int) -> dict:
    """Integer shares of d, at least 1 each, nearest to the weights (largest remainders; ties by name)."""
    total = sum(Fraction(w).limit_denominator(10**9) for w in weights.values())
    names = sorted(weights, key=lambda s: (s is None, s))
    exact = {s: Fraction(weights[s]).limit_denominator(10**9) / total * d for s in names}
    out = {s: max(1, int(exact[s])) for s in names}
    while (left := d - sum(out.values())) != 0:
        if left > 0:
            out[max(names, key=lambda s: (exact[s] - out[s]))] += 1
        else:
            out[max((s for s in names if out[s] > 1), key=lambda s: (out[s] - exact[s]))] -= 1
    return out


def one_period(shares: dict) -> list[tuple]:
    """(source, block, release, deadline, slot) for the D slots of a period, by earliest deadline first."""
    d = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, s))
    later, ready, out = [], [], []
    for i, s in enumerate(names):
        heapq.heappush(later, (0, i, 0))
    for t in range(d):
        while later and later[0][0] <= t:
            _, i, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-(j + 1) * d // shares[names[i]]), i, j))
        deadline, i, j = heapq.heappop(ready)
        q = shares[names[i]]
        out.append((names[i], j, j * d // q, deadline, t))
        if j + 1 < q:
            heapq.heappush(later, ((j + 1) * d // q, i, j + 1))
    return out


def target_weights(docs: DataFrame, power: float = 0.5) -> dict:
    """Weights that flatten the sources' sizes: bytes to the given power. One row per source comes to the driver."""
    rows = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("b")).collect()
    return {r.source: max(r.b, 1) ** power for r in rows}


def mix(docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES, period: int = 1000) -> DataFrame:
    """doc_id, source, n_bytes, block, release, deadline, slot, at, in_balance and th (the text's hash) for every row.

    slot: the block's place in the output; at: the bytes of its source before the document, its order inside a slot.
    in_balance: no source had run out before this slot, so every prefix up to here deviates by less than one block."""
    spark = docs.sparkSession
    docs = spread(docs)
    weights = weights or target_weights(docs)
    if not weights:
        return docs.select("doc_id", "source", F.lit(0).cast("long").alias("n_bytes"), *[F.lit(0).cast("long").alias(c) for c in ("block", "release", "deadline", "slot", "at")], F.lit(True).alias("in_balance"), text_hash().alias("th"))
    shares = quantise(weights, max(period, 16 * len(weights)))
    d = sum(shares.values())
    plan = spark.createDataFrame([(s, shares[s], j, r, z, t) for s, j, r, z, t in one_period(shares)], "_s string, share long, j long, r long, z long, t long")

    rows = docs.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), text_hash().alias("_th"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "_th"))
    n = docs.count()
    buckets = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = rows.groupBy("source", "_b").agg(F.sum("n_bytes").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_k"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), (F.coalesce(F.sum("_sum").over(before), F.lit(0)) + F.col("_sum")).alias("_to"))
    bases = cut(bases, "mix-bases")
    within = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "_th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n_bytes").over(within), F.lit(0)))
    rows = rows.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_k"))).drop("_s", "_k")
    rows = rows.withColumn("at", F.col("_base") + F.col("_in")).withColumn("block", F.floor(F.col("at") / block_bytes).cast("long"))

    share = F.broadcast(plan.select("_s", "share").distinct())  # one row a source
    rows = rows.join(share, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumns({"_j": F.col("block") % F.col("share"), "_p": F.floor(F.col("block") / F.col("share")).cast("long")})
    slots = F.broadcast(plan.drop("share"))  # one row a slot of the period
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_j") == F.col("j")))
    shift = F.col("_p") * F.lit(d)

    ends = bases.groupBy("_s").agg(F.ceil(F.max("_to") / block_bytes).cast("long").alias("blocks")).collect()  # one row a source
    offset = {(s, j): t for s, j, _, _, t in one_period(shares)}
    horizon = min(((e.blocks // shares[e._s]) * d + offset[e._s, e.blocks % shares[e._s]] for e in ends if e._s in shares), default=0)
    return rows.select("doc_id", "source", "n_bytes", "block", (F.col("r") + shift).alias("release"), (F.col("z") + shift).alias("deadline"), (F.col("t") + shift).alias("slot"), "at", (F.col("t") + shift < horizon).alias("in_balance"), F.col("_th").alias("th"))


@own_names
def in_order(docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of docs, range-partitioned and sorted by the schedule, so that files written from it hold the mix."""
    d = docs.withColumn("_th", text_hash())
    key = mix(docs, weights, block_bytes).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("slot").alias("_slot"), F.col("at").alias("_at")).dropDuplicates(["_d", "_t"])
    out = d.join(key, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    order = ["_slot", "_at", "doc_id", "_th"]
    return out.repartitionByRange(n, *order).sortWithinPartitions(*order).select(docs.columns)
