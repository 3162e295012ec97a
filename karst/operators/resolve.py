"""Which members of a cluster stay: annotation-aware keepers, conflicts set aside for review, weights, every k-th frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.codes import dot, tie_key

STRATEGIES = ("keep_most_annotated", "keep_highest_res", "keep_central", "weighted_sample")
WEIGHTED_NOTE = "kept all; per-image weight 1/cluster_size"
REVIEW_NOTE = "conflicting class annotations \u2014 kept all, flagged for review"


def conflicts(clusters: DataFrame, annotations: DataFrame) -> DataFrame:
    """component of clusters with two annotated members of whose class sets neither holds the other. Distinct sets only."""
    sets = clusters.join(annotations.where("num_boxes > 0 and size(class_ids) > 0").select("item_id", F.array_sort("class_ids").alias("c")), "item_id").groupBy("component").agg(F.collect_set("c").alias("s"))
    apart = F.exists("s", lambda a: F.exists("s", lambda b: (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)))
    return sets.where(apart).select("component")


def resolve(clusters: DataFrame, annotations: DataFrame, strategy: str, embeddings: DataFrame | None = None) -> DataFrame:
    """item_id, component, size, kept, review, weight for every member. annotations: item_id, num_boxes, num_classes, area,
    class_ids; embeddings: item_id, embedding (keep_central falls back on keep_most_annotated where a member has none;
    similarities to the mean vector that are equal in nine places are ties)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown keep strategy {strategy!r}")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    m = clusters.join(sizes, "component")
    if strategy == "weighted_sample":
        return m.select("item_id", "component", "size", F.lit(True).alias("kept"), F.lit(False).alias("review"), F.when(F.col("size") > 1, F.round(1 / F.col("size"), 6)).alias("weight"))
    ann = annotations.select("item_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("num_boxes", "num_classes", "area")])
    m = m.join(ann, "item_id", "left").na.fill(0, ["num_boxes", "num_classes", "area"])
    tie = tie_key(F.col("item_id").cast("string"))
    order = [F.desc("num_boxes"), F.desc("num_classes"), tie.asc()]
    if strategy == "keep_highest_res":
        order = [F.desc("area"), tie.asc()]
    if strategy == "keep_central" and embeddings is not None:
        e = m.where("size > 1").join(embeddings.select("item_id", "embedding"), "item_id")
        mean = e.select("component", F.posexplode("embedding").alias("pos", "x")).groupBy("component", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        mean = mean.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))
        near = e.join(mean, "component").select("item_id", F.round(dot(F.col("embedding"), F.col("centre")), 9).alias("near"))
        whole = m.where("size > 1").join(near, "item_id", "left").groupBy("component").agg((F.count("near") == F.count("*")).alias("whole"))
        m = m.join(near, "item_id", "left").join(whole, "component", "left")
        order = [F.desc(F.when(F.col("whole"), F.col("near"))), F.when(F.col("whole"), tie).asc(), *order]
    first = F.row_number().over(Window.partitionBy("component").orderBy(*order)) == 1
    m = m.withColumn("first", first).join(conflicts(clusters, annotations).withColumn("review", F.lit(True)), "component", "left")
    review = F.coalesce("review", F.lit(False))
    return m.select("item_id", "component", "size", (F.col("first") | review).alias("kept"), review.alias("review"), F.lit(None).cast("double").alias("weight"))


def cluster_records(members: DataFrame, strategy: str) -> DataFrame:
    """One row per member of each cluster of more than one: item_id, component, size, kept, review, weight, strategy, note. Members
    stay rows of their own, so a cluster of any size fits. members: resolve()'s."""
    note = F.lit(WEIGHTED_NOTE if strategy == "weighted_sample" else "")
    return members.where("size > 1").withColumns({"strategy": F.lit(strategy), "note": F.when(F.col("review"), F.lit(REVIEW_NOTE)).otherwise(note)})


def every_kth(items: DataFrame, k: int, partition: str, order: list) -> DataFrame:
    """Rows 0, k, 2k, ... of each partition in the given order; rows without a partition pass; k <= 1 keeps all."""
    if k <= 1:
        return items
    n = F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1
    known = items.where(F.col(partition).isNotNull()).withColumn("_n", n).where(F.col("_n") % k == 0).drop("_n")
    return known.unionByName(items.where(F.col(partition).isNull()))
