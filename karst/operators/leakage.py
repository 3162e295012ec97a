"""Evaluation items with a near copy in the training split, and partitions that straddle splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.codes import fraction


def leaked_items(items: DataFrame, edges: DataFrame, train: str = "train") -> DataFrame:
    """item_id, split, leaked of items outside the training split: a direct edge to a training item. items: item_id, split."""
    sym = edges.select("src", "dst").union(edges.select("dst", "src"))
    bad = sym.join(items.where(F.col("split") == train).select(F.col("item_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("item_id")).distinct().withColumn("leaked", F.lit(True))
    return items.where(F.col("split") != train).join(bad, "item_id", "left").select("item_id", "split", F.coalesce("leaked", F.lit(False)).alias("leaked"))


def leakage_by_split(items: DataFrame, edges: DataFrame, train: str, evals: list[str], examples: int = 10) -> DataFrame:
    """split, eval_images, leaked_images, leaked_fraction, examples (the first by id)."""
    rows = leaked_items(items, edges, train).where(F.col("split").isin(evals))
    counts = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if("leaked").alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy("split").orderBy("item_id")
    ex = rows.where("leaked").withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("split").agg(F.transform(F.array_sort(F.collect_list("item_id")), lambda i: i.cast("string")).alias("e"))
    spark = items.sparkSession
    named = reduce(DataFrame.union, [spark.range(1).select(F.lit(s).alias("split")) for s in evals])
    out = named.join(counts, "split", "left").join(ex, "split", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    return out.select("split", n.alias("eval_images"), k.alias("leaked_images"), fraction(k, n).alias("leaked_fraction"), F.coalesce(F.array_join("e", ","), F.lit("")).alias("examples"))


def partition_violations(items: DataFrame, train: str, evals: list[str]) -> DataFrame:
    """partition, splits (sorted, comma-joined) of partitions in the training split and in an evaluation split."""
    per = items.where("coalesce(partition_key, '') <> '' and split is not null").groupBy(F.col("partition_key").alias("partition")).agg(F.array_sort(F.collect_set("split")).alias("s"))
    both = F.array_contains("s", train) & F.arrays_overlap("s", F.array(*[F.lit(e) for e in evals]))
    return per.where(both).select("partition", F.array_join("s", ",").alias("splits"))


def train_twice_sets(items: DataFrame, removed: DataFrame, train: str, evals: list[str], limit: int | None = None) -> DataFrame:
    """role (raw, reduced, test), item_id: the lists to train on before and after deduplication, and to test on. items: item_id,
    split; removed: item_id. limit, where given, is the length of the raw and of the test list: the first items by id."""

    def first(rows: DataFrame) -> DataFrame:
        ids = rows.select("item_id")
        return ids if limit is None else ids.orderBy("item_id").limit(limit)

    raw = first(items.where(F.col("split") == train))
    reduced = raw.join(removed.select("item_id"), "item_id", "left_anti")
    sets = {"raw": raw, "reduced": reduced, "test": first(items.where(F.col("split").isin(evals)))}
    return reduce(DataFrame.union, [ids.select(F.lit(role).alias("role"), "item_id") for role, ids in sets.items()])


def train_twice_counts(sets: DataFrame) -> DataFrame:
    """n_train_raw, n_train_reduced, n_test of train_twice_sets."""
    n = lambda role: F.count_if(F.col("role") == role)
    return sets.agg(n("raw").alias("n_train_raw"), n("reduced").alias("n_train_reduced"), n("test").alias("n_test"))
