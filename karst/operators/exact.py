"""Exact duplicates: groups of equal content, their keeper, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.codes import digest, fraction


def with_key(items: DataFrame, item: str, content: str) -> DataFrame:
    return items.select(F.col(item).alias("item_id"), digest(content).alias("key"))


def exact_keepers(keyed: DataFrame) -> DataFrame:
    """key, kept, n: one row per distinct content. min and count combine map-side, so a content of any frequency is cheap."""
    return keyed.groupBy("key").agg(F.min("item_id").alias("kept"), F.count("*").alias("n"))


def exact_survivors(keyed: DataFrame) -> DataFrame:
    return exact_keepers(keyed).select(F.col("kept").alias("item_id"))


def exact_removed(keyed: DataFrame) -> DataFrame:
    """item_id, kept, key, reason of every item that another stands for."""
    keep = exact_keepers(keyed).where("n > 1").drop("n")
    return keyed.join(keep, "key").where("item_id <> kept").select("item_id", "kept", "key", F.lit("sha256").alias("reason"))


def exact_groups(keyed: DataFrame) -> DataFrame:
    """kept, removed (sorted), reason, key: the reported form, for groups of more than one."""
    g = exact_removed(keyed).groupBy("key", "kept").agg(F.array_sort(F.collect_list("item_id")).alias("removed"))
    return g.select("kept", "removed", F.lit("sha256").alias("reason"), "key")


def profile(keyed: DataFrame) -> DataFrame:
    sizes = keyed.groupBy("key").count()
    total, distinct = F.coalesce(F.sum("count"), F.lit(0)), F.count("*")
    return sizes.agg(total.alias("total_files"), distinct.alias("distinct_files"), (total - distinct).alias("exact_duplicate_files"), fraction(total - distinct, total).alias("exact_duplicate_fraction"))


def histogram(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("key").agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups"))
