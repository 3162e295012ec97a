"""The cascade: exact, near, semantic, resolution; each stage works on the survivors of the stage before."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators import exact, hamming, leakage, resolve, vectors
from karst.operators.components import connected_components, with_singletons
from karst.plans.config import Config
from karst.sources.shared import cut


log = logging.getLogger("karst")


@dataclass
class StageResult:
    stage: int
    survivors: DataFrame  # item_id
    removed: DataFrame  # item_id
    edges: DataFrame | None = None  # src, dst
    metrics: dict = field(default_factory=dict)


def _result(stage: int, items: DataFrame, survivors: DataFrame, edges=None, began: float = 0.0, **extra) -> StageResult:
    survivors = cut(survivors, f"stage{stage}")
    n, m = items.count(), survivors.count()
    removed = items.select("item_id").join(survivors, "item_id", "left_anti")
    if n and n == m:
        log.warning("stage %d removed none of %d items", stage, n)
    metrics = {"stage": stage, "items_in": n, "items_removed": n - m, "items_out": m, "seconds": round(time.time() - began, 3), "peak_mem_mb": peak_mb(items.sparkSession), **extra}
    log.info("stage %d: %s", stage, metrics)
    return StageResult(stage, survivors, removed, edges, metrics)


def peak_mb(spark) -> float:
    """The most memory that the driver's JVM has used so far, over its pools."""
    pools = spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return round(sum(p.getPeakUsage().getUsed() for p in pools) / 2**20, 1)


def stage1(items: DataFrame, cfg: Config) -> StageResult:
    """items: item_id, content."""
    began = time.time()
    ids = items.select("item_id")
    if not cfg.stage1.enabled:
        return _result(1, ids, ids, began=began)
    return _result(1, ids, exact.exact_survivors(exact.with_key(items, "item_id", "content")), began=began, backend="shuffle")


def _keep_least(items: DataFrame, edges: DataFrame) -> DataFrame:
    cc = connected_components(edges).withColumnRenamed("node", "item_id")
    return items.join(cc.where("item_id <> component"), "item_id", "left_anti")


def stage2(items: DataFrame, codes: DataFrame, cfg: Config) -> StageResult:
    """codes: item_id, algo, code."""
    began, c = time.time(), cfg.stage2
    if not c.enabled:
        return _result(2, items, items, began=began)
    codes = codes.join(items, "item_id", "left_semi")
    n = items.count()
    name = hamming.choose_strategy(c.search_strategy, n)
    log.info("stage 2: %s search (configured: %s) over %d items", name, c.search_strategy, n)
    if c.combine == "all" and name == "multiindex":
        found = hamming.pairs_on_all(codes, c.hashes, c.hamming_threshold)
    else:
        found = hamming.combine([hamming.STRATEGIES[name](codes.where(F.col("algo") == a).select("item_id", "code"), c.hamming_threshold) for a in c.hashes], c.combine)
    edges = cut(found, "stage2-edges")
    return _result(2, items, _keep_least(items, edges), edges, began, search_strategy=name, n_flagged_pairs=edges.count())


def stage3(items: DataFrame, embeddings: DataFrame, cfg: Config) -> StageResult:
    """embeddings: item_id (long), embedding. Items without one have no edges and survive."""
    began, c = time.time(), cfg.stage3
    if not c.enabled:
        return _result(3, items, items, began=began)
    v = embeddings.join(items, "item_id", "left_semi").select(F.col("item_id").alias("vec_id"), "embedding")
    n = v.count()
    first = v.select(F.size("embedding")).first()
    index = vectors.select_index(n, first[0] if first else 1, c.index_type, c.ram_budget_gb)
    log.info("stage 3: %s index (configured: %s) over %d vectors", index, c.index_type, n)
    nlist = c.nlist if c.index_type != "auto" else vectors.auto_nlist(n)
    knn = vectors.search(v, max(1, min(n, 100)), index, nlist, c.nprobe, c.pq_m, c.pq_nbits, c.rerank_k, c.cosine_threshold, c.rerank, cfg.seed)
    edges = cut(vectors.flagged_pairs(knn, c.cosine_threshold), "stage3-edges")
    return _result(3, items, _keep_least(items, edges), edges, began, index_type=index, n_flagged_pairs=edges.count())


def stage4(items: DataFrame, edges: DataFrame, annotations: DataFrame, cfg: Config, embeddings: DataFrame | None = None) -> tuple[StageResult, DataFrame]:
    """items: survivors of stage 1; edges: those of stages 2 and 3. Also returns the resolved members."""
    began = time.time()
    if not cfg.stage4.enabled:
        r = _result(4, items, items, edges, began)
        return r, items.select("item_id", F.col("item_id").alias("component"), F.lit(1).alias("size"), F.lit(True).alias("kept"), F.lit(False).alias("review"), F.lit(None).cast("double").alias("weight"))
    clusters = cut(with_singletons(items, edges), "stage4-clusters")
    members = cut(resolve.resolve(clusters, annotations, cfg.stage4.keep_strategy, embeddings), "stage4-members")
    n = members.agg(F.countDistinct("component").alias("n"), F.count_distinct(F.when(F.col("size") > 1, F.col("component"))).alias("big"), F.count_distinct(F.when(F.col("review"), F.col("component"))).alias("review")).first()
    if n.review:
        log.warning("stage 4: %d clusters with conflicting annotations are kept whole, for review", n.review)
    extra = {"keep_strategy": cfg.stage4.keep_strategy, "n_clusters": n.n, "n_nontrivial_clusters": n.big, "n_review_flagged": n.review}
    return _result(4, clusters.select("item_id"), members.where("kept").select("item_id"), edges, began, **extra), members


def run(items: DataFrame, codes: DataFrame, embeddings: DataFrame, annotations: DataFrame, cfg: Config) -> tuple[list[StageResult], DataFrame]:
    """All four stages. The second value has one row per item: item_id, removed_stage (null: kept)."""
    one = stage1(items, cfg)
    two = stage2(one.survivors, codes, cfg)
    three = stage3(two.survivors, embeddings, cfg)
    edges = [r.edges for r in (two, three) if r.edges is not None]
    both = edges[0].unionByName(edges[1]) if len(edges) == 2 else edges[0] if edges else items.sparkSession.createDataFrame([], "src long, dst long")
    four, _ = stage4(one.survivors, both, annotations, cfg, embeddings)
    gone = one.removed.withColumn("removed_stage", F.lit(1)).unionByName(four.removed.withColumn("removed_stage", F.lit(4)))
    return [one, two, three, four], items.select("item_id").join(gone, "item_id", "left")


def leakage_report(items: DataFrame, edges: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame | None]:
    """items: item_id, split and, for partitions, partition_key."""
    c = cfg.leakage
    per = leakage.leakage_by_split(items, edges, c.train_split, c.eval_splits)
    return per, leakage.partition_violations(items, c.train_split, c.eval_splits) if "partition_key" in items.columns else None
