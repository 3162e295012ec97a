"""Benchmark decontamination with DataFrame functions only.

Benchmark items become normalised word windows (13 words; a shorter item is one window of its own length). Training texts are
scanned window by window; the windows' 64-bit hashes meet the benchmark's in a hash join, and each meeting is verified word
for word in the join condition. The benchmark side is written first and broadcast only if its measured bytes are at most
BROADCAST_BYTES; a larger benchmark is joined by a shuffle on the hash. Hits of a text are merged to spans.

Edge cases: null texts have no words; items without words have no windows; repeated items share windows and are all named;
rows that repeat a doc_id with the same text are each judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.sources.shared import cut, own_names, spread, text_hash

# Letters lowered, and the characters between words (every ASCII character but lower-case letters and digits).
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


BROADCAST_BYTES = 32 << 20


def words(text: str = "text") -> F.Column:
    """Normalised words. lower() is right for ASCII texts and cheap; others get only A-Z lowered."""
    t = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWERED))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _windows(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One row per run of `size` words: keys, pos (from 0), w0 .. w{size-1}, h. df has the column w."""
    n = F.size("w") - (size - 1)
    zipped = F.arrays_zip(*[F.slice("w", j + 1, n).alias(f"w{j}") for j in range(size)])
    long = df.where(F.size("w") >= size)
    return long.select(*keys, F.posexplode(zipped).alias("pos", "z")).select(*keys, "pos", *[F.col(f"z.w{j}").alias(f"w{j}") for j in range(size)]).withColumn("h", F.xxhash64(*[f"w{j}" for j in range(size)]))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, th, pos, size, items: each place of a text where a benchmark window occurs, and the items that have it."""
    items = cut(benchmark.select("item_id", words().alias("w")).withColumn("size", F.least(F.size("w"), F.lit(window))).where("size > 0"), "bench-words")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most `window` numbers
    rows = docs.select("doc_id", text_hash().alias("th"), words().alias("w"))
    found = []
    for k in sizes:
        own = _windows(items.where(F.col("size") == k), ["item_id"], k)
        same = [f"w{j}" for j in range(k)]
        own = cut(own.groupBy("h", *same).agg(F.collect_set("item_id").alias("items")), "bench-windows")
        size = own.agg(F.sum(sum((F.octet_length(w) for w in same), F.lit(64 + 24 * k)) + 8 * F.size("items"))).first()[0]
        if (size or 0) <= BROADCAST_BYTES:
            own = F.broadcast(own)
        a, b = _windows(rows, ["doc_id", "th"], k).alias("a"), own.alias("b")
        on = F.col("a.h") == F.col("b.h")
        for w in same:
            on = on & (F.col(f"a.{w}") == F.col(f"b.{w}"))
        found.append(a.join(b, on).select("a.doc_id", "a.th", "a.pos", F.lit(k).alias("size"), "b.items"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, pos int, size int, items array<long>")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def find_spans(hits: DataFrame) -> DataFrame:
    """doc_id, th, spans (merged word ranges, end excluded), n_hit, items: one row per text with a hit."""
    per = hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("size")).alias("end")))).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    kind = "array<struct<a:int,b:int>>"
    merged = F.aggregate(
        "at",
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["pos"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["end"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["pos"].alias("a"), x["end"].alias("b"))))).cast(kind),
    )
    return per.select("doc_id", "th", merged.alias("spans"), "items").withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]).cast("long")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05) -> DataFrame:
    """Every row of docs with its word count, spans, items and verdict: contaminated if at least `share` of its words are hit.

    Texts are scanned twice but never shuffled: only ids, counts and hits are."""
    docs = spread(docs)
    spans = find_spans(find_hits(docs, benchmark, window))
    every = docs.select("doc_id", text_hash().alias("th"), F.size(words()).cast("long").alias("n_words"))
    out = every.join(spans.withColumnRenamed("doc_id", "_d"), every.doc_id.eqNullSafe(F.col("_d")) & (every.th == spans.th), "left").drop(spans.th).drop("_d")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * share))


@own_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """docs without contaminated documents; all columns are kept."""
    hits = find_spans(find_hits(docs, benchmark, window)).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "n_hit")
    d = docs.withColumns({"_th": text_hash(), "_nw": F.size(words()).cast("long")})
    bad = cut(d.select("doc_id", "_th", "_nw").join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))).where(F.col("n_hit") * 100 >= F.col("_nw") * percent).select("_d", "_t").distinct(), "contaminated")
    return docs.withColumn("_th", text_hash()).join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_anti").select(docs.columns)
