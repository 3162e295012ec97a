"""The cascade over an image folder, its written results, and what is read from them: profile, report, score, leakage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions.codes import basename, infer_split
from karst.functions.perceptual import hash_images
from karst.operators import exact, leakage, resolve, score
from karst.operators.components import connected_components
from karst.plans import cascade
from karst.plans.config import Config
from karst.sources.images import annotate_items, decode_images, read_annotations, scan_images
from karst.sources.shared import cut, on_workers

BACKBONES: dict = {}
EMPTY = "item_id long, num_boxes long, num_classes long, area long, class_ids array<bigint>"


def register_backbone(name: str):
    def add(f):
        BACKBONES[name] = f
        return f

    return add


@register_backbone("thumbnail")
def thumbnail(x: np.ndarray, side: int = 16) -> np.ndarray:
    """A colour grid without its mean: deterministic, needs no weights."""
    from karst.functions.perceptual import shrink

    v = np.concatenate([shrink(x[..., k].astype(np.float64), side, side).ravel() for k in range(x.shape[2])])
    return v - v.mean()


def one_form(path) -> F.Column:
    """Readers write local paths with one or three slashes; here one."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def embed(images: DataFrame, backbone: str, fp16: bool = False) -> DataFrame:
    """path, embedding of the image source's rows, of unit length; with fp16, of half precision."""
    if backbone not in BACKBONES:
        raise NotImplementedError(f"backbone {backbone!r} is not here; known: {sorted(BACKBONES)}, or give a table of embeddings")
    f = BACKBONES[backbone]

    def run(batches):
        for rb in batches:
            out = []  # path, vector
            for r in rb.column("image").to_pylist():
                if r and r["height"] > 0 and r["data"]:
                    x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                    v = f(np.repeat(x, 3, 2) if r["nChannels"] == 1 else x[..., :3]).astype(np.float64)
                    v /= np.linalg.norm(v) or 1.0
                    out.append((r["origin"], v.astype(np.float16 if fp16 else np.float32).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([v for _, v in out], pa.list_(pa.float32()))], ["path", "embedding"])

    return images.select("image").mapInArrow(run, "path string, embedding array<float>").withColumn("path", one_form("path"))


def number(spark: SparkSession, root: str) -> DataFrame:
    """path, item_id: numbers in the order of paths, so the smallest number of a group is its first path."""
    return cut(scan_images(spark, root, content=False).select(one_form("item_id").alias("path")).orderBy("path").withColumn("item_id", F.monotonically_increasing_id()), "paths")


def digests(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """item_id, key: SHA-256 of every file; contents are not shuffled."""
    return scan_images(spark, root).select(one_form("item_id").alias("path"), F.sha2("content", 256).alias("key")).join(ids, "path").select("item_id", "key")


def profile(spark: SparkSession, cfg: Config) -> tuple[DataFrame, DataFrame]:
    k = cut(digests(spark, cfg.io.image_root, number(spark, cfg.io.image_root)), "digests")
    return exact.profile(k), exact.histogram(k)


def stored(spark: SparkSession, cfg: Config, name: str) -> DataFrame | None:
    """What a run has written under name; None where it has not."""
    try:
        return spark.read.parquet(f"{cfg.io.output_dir}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def needed(spark: SparkSession, cfg: Config, name: str) -> DataFrame:
    out = stored(spark, cfg, name)
    if out is None:
        raise FileNotFoundError(f"{cfg.io.output_dir}/{name}: run the stages before first")
    return out


def save(cfg: Config, df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{cfg.io.output_dir}/{name}")


def by_id(df: DataFrame, path: str, ids: DataFrame) -> DataFrame:
    """df with the item_id of its column path, which becomes the column path."""
    return df.withColumn("path", one_form(path)).drop(*({"item_id"} & set(df.columns))).join(ids, "path")


def pairs(spark: SparkSession, cfg: Config, stages: tuple = (2, 3)) -> DataFrame:
    """src, dst (paths): the pairs of the stages, as written; none of a stage that has not run."""
    found = [p for k in stages if (p := stored(spark, cfg, f"stage{k}/pairs")) is not None]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "src string, dst string"))


def before(spark: SparkSession, cfg: Config, stage: int, ids: DataFrame) -> DataFrame:
    """item_id: what the latest stage before has kept (resolution: what stage 1 has, since it takes up the pairs of stages 2 and
    3 itself); all images where none has run."""
    found = (stored(spark, cfg, f"stage{k}/survivors") for k in ((1,) if stage == 4 else range(stage - 1, 0, -1)))
    kept = next((s for s in found if s is not None), None)
    return ids.select("item_id") if kept is None else kept.join(ids, "path").select("item_id")


def embeddings_of(spark: SparkSession, cfg: Config) -> DataFrame:
    """path, embedding, kept under stage3/embeddings: images that are there are not embedded again. A table of another backbone
    or precision is in a folder of its own."""
    c = cfg.stage3
    name = f"stage3/embeddings-{c.backbone}-{'fp16' if c.fp16_embeddings else 'fp32'}"
    there = stored(spark, cfg, name)
    images = decode_images(spark, cfg.io.image_root)
    if there is not None:
        images = images.withColumn("path", one_form("image.origin")).join(there.select("path"), "path", "left_anti")
    embed(images, c.backbone, c.fp16_embeddings).write.mode("append").parquet(f"{cfg.io.output_dir}/{name}")
    return needed(spark, cfg, name)


def annotations_by_id(spark: SparkSession, cfg: Config, ids: DataFrame) -> DataFrame:
    """The columns of EMPTY and partition_key, of the images that the annotation file names."""
    if not cfg.io.annotations:
        return spark.createDataFrame([], EMPTY + ", partition_key string")
    named = annotate_items(ids.select(F.col("path").alias("item_id")), read_annotations(spark, cfg.io.annotation_format, cfg.io.annotations)).where("image_id is not null")
    return by_id(named, "item_id", ids).select("item_id", "num_boxes", "num_classes", "area", "class_ids", "partition_key")


def partitions(paths: DataFrame, ann: DataFrame, cfg: Config) -> DataFrame:
    """path, item_id, partition_key of rows of path, item_id: the annotation's, or with stage4.partition_key "folder" the folder
    that holds the file."""
    if cfg.stage4.partition_key == "folder":
        return paths.withColumn("partition_key", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return paths.join(ann.select("item_id", "partition_key"), "item_id", "left").select("path", "item_id", "partition_key")


def edges_by_id(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = (ids.select(F.col("path").alias(e), F.col("item_id").alias(f"{e}_id")) for e in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def run_stage(spark: SparkSession, cfg: Config, stage: int, embeddings: DataFrame | None = None, force: bool = False) -> bool:
    """One stage over what the stages before have written; writes survivors, pairs (stages 2 and 3) and, last, metrics as Parquet
    under io.output_dir. A stage whose metrics are there is not run again unless force is set. Returns whether it ran.
    embeddings: path, embedding; without it the configured backbone makes them."""
    if not force and stored(spark, cfg, f"stage{stage}/metrics") is not None:
        return False
    on_workers(spark)
    root = cfg.io.image_root
    ids = number(spark, root)
    if stage == 1:
        r = cascade.stage1(digests(spark, root, ids).withColumnRenamed("key", "content"), cfg)
    else:
        items = cut(before(spark, cfg, stage, ids), "items")
        if stage == 2:
            codes = None
            if cfg.stage2.enabled:
                codes = cut(by_id(hash_images(decode_images(spark, root), cfg.stage2.hashes, cfg.stage2.hash_size), "item_id", ids).select("item_id", "algo", "code"), "codes")
            r = cascade.stage2(items, codes, cfg)
        else:
            vecs = None
            if cfg.stage3.enabled and (stage == 3 or cfg.stage4.keep_strategy == "keep_central"):
                vecs = cut(by_id(embeddings_of(spark, cfg) if embeddings is None else embeddings, "path", ids).select("item_id", "embedding"), "vectors")
            if stage == 3:
                r = cascade.stage3(items, vecs, cfg)
            else:
                ann = cut(annotations_by_id(spark, cfg, ids), "annotations")
                k = cfg.stage4.video_subsample_k
                if k > 1:  # frames left out are among the run's removed, not among this stage's items
                    frames = partitions(items.join(ids, "item_id"), ann, cfg)
                    items = cut(resolve.every_kth(frames, k, "partition_key", [basename(F.col("path")), "path"]).select("item_id"), "frames")
                edges = edges_by_id(pairs(spark, cfg), ids)
                if k > 1:
                    edges = reduce(lambda e, end: e.join(items.select(F.col("item_id").alias(end)), end, "left_semi"), ("src", "dst"), edges)
                r, members = cascade.stage4(items, edges, ann, cfg, vecs)
                save_resolved(cfg, members, ids)
    save(cfg, r.survivors.join(ids, "item_id").select("path"), f"stage{stage}/survivors")
    if stage in (2, 3):
        edges = r.edges if r.edges is not None else spark.createDataFrame([], "src long, dst long")
        a, b = (ids.select(F.col("item_id").alias(e), F.col("path").alias(p)) for e, p in (("src", "a"), ("dst", "b")))
        save(cfg, edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")), f"stage{stage}/pairs")
    shape = "stage int, items_in long, items_removed long, items_out long, seconds double, peak_mem_mb double"
    known = [c.split()[0] for c in shape.split(", ")]
    extra = {k: str(v) for k, v in r.metrics.items() if k not in known}
    save(cfg, spark.createDataFrame([(*[r.metrics[c] for c in known], extra)], shape + ", extra map<string,string>").coalesce(1), f"stage{stage}/metrics")
    return True


def save_resolved(cfg: Config, members: DataFrame, ids: DataFrame) -> None:
    """Writes stage4/clusters (the members of clusters of more than one), stage4/review (those of them set aside) and, with
    weights, stage4/weights; a cluster is named by the path of its first member."""
    named = resolve.cluster_records(members, cfg.stage4.keep_strategy).join(ids, "item_id").join(ids.select(F.col("item_id").alias("component"), F.col("path").alias("cluster")), "component")
    rows = cut(named.select("cluster", "path", "size", "kept", "review", "weight", "strategy", "note"), "clusters")
    save(cfg, rows.drop("weight"), "stage4/clusters")
    save(cfg, rows.where("review").drop("weight"), "stage4/review")
    save(cfg, rows.where("weight is not null").select("path", "weight"), "stage4/weights")


def finish(spark: SparkSession, cfg: Config) -> None:
    """Writes groups, removed, metrics and leakage from what the four stages have written."""
    root = cfg.io.image_root
    ids = number(spark, root)
    keys = cut(digests(spark, root, ids), "digests")
    first = keys.groupBy("key").agg(F.min("item_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    groups = keys.join(first, "key").select(F.lit(1).alias("stage"), F.col("key").alias("group"), "item_id", (F.col("item_id") == F.col("least")).alias("kept"), F.lit("sha256").alias("reason"))
    for k, reason in ((2, f"{'|'.join(cfg.stage2.hashes)}<={cfg.stage2.hamming_threshold}"), (3, f"cosine>={cfg.stage3.cosine_threshold}({cfg.stage3.backbone})")):
        cc = connected_components(cut(edges_by_id(pairs(spark, cfg, (k,)), ids), f"pairs{k}"))
        groups = groups.unionByName(cc.select(F.lit(k).alias("stage"), F.col("component").cast("string").alias("group"), F.col("node").alias("item_id"), (F.col("node") == F.col("component")).alias("kept"), F.lit(reason).alias("reason")))
    save(cfg, groups.join(ids, "item_id").select("stage", "group", "path", basename(F.col("path")).alias("name"), "kept", "reason"), "groups")
    gone = ids.join(needed(spark, cfg, "stage4/survivors"), "path", "left_anti")
    save(cfg, gone.select("path", basename(F.col("path")).alias("name")), "removed")
    metrics = reduce(DataFrame.unionByName, [needed(spark, cfg, f"stage{k}/metrics") for k in (1, 2, 3, 4)])
    if cfg.leakage.enabled:
        kept = cut(partitions(needed(spark, cfg, "stage1/survivors").join(ids, "path").select("path", "item_id"), annotations_by_id(spark, cfg, ids), cfg), "kept")
        items = splits(kept, cfg).where("split is not null")
        if items.isEmpty():
            cascade.log.warning("leakage: no path names one of the splits %s", [cfg.leakage.train_split, *cfg.leakage.eval_splits])
        per, apart = cascade.leakage_report(items, pairs(spark, cfg), cfg)
        save(cfg, per, "leakage")
        save(cfg, apart, "leakage_partitions")
        text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "leaked_fraction")))))  # a row per evaluation split
        leaked = needed(spark, cfg, "leakage").agg(text.alias("leaked"))
        more = F.when(F.col("stage") == 4, F.map_concat("extra", F.create_map(F.lit("leakage"), "leaked"))).otherwise(F.col("extra"))
        metrics = metrics.crossJoin(F.broadcast(leaked)).withColumn("extra", more).drop("leaked")
    save(cfg, metrics, "metrics")


def run(spark: SparkSession, cfg: Config, embeddings: DataFrame | None = None, force: bool = False) -> None:
    """All stages, those already written left out unless force is set, and what is read from them."""
    for stage in (1, 2, 3, 4):
        run_stage(spark, cfg, stage, embeddings, force)
    finish(spark, cfg)


def splits(paths: DataFrame, cfg: Config) -> DataFrame:
    """item_id (the path), split; the root's own name says nothing about splits."""
    inner = F.regexp_replace("path", "^" + one_form_text(cfg.io.image_root), "")
    return paths.select(F.col("path").alias("item_id"), *[c for c in paths.columns if c == "partition_key"], infer_split(inner, [cfg.leakage.train_split, *cfg.leakage.eval_splits]).alias("split"))


def one_form_text(root: str) -> str:
    import re

    return "(file:/)?" + re.escape(re.sub("^file:/+", "/", root).strip("/")) if root.startswith(("/", "file:")) else re.escape(root)


def train_twice(spark: SparkSession, cfg: Config, max_images: int | None = 200) -> DataFrame:
    """Writes the lists to train on with and without what a run has removed, and to test on, as Parquet (role, item_id) and
    returns their counts. max_images is the length of a list; None: all."""
    c = cfg.leakage
    items = splits(number(spark, cfg.io.image_root), cfg)
    gone = spark.read.parquet(f"{cfg.io.output_dir}/removed").select(F.col("path").alias("item_id"))
    sets = leakage.train_twice_sets(items, gone, c.train_split, c.eval_splits, max_images)
    sets.write.mode("overwrite").parquet(f"{cfg.io.output_dir}/train_twice")
    counts = leakage.train_twice_counts(spark.read.parquet(f"{cfg.io.output_dir}/train_twice"))
    n = counts.first()
    if not n.n_train_raw or not n.n_test:
        raise ValueError(f"train-twice needs images of {c.train_split} and of one of {c.eval_splits} in their paths; found {n.n_train_raw} and {n.n_test}")
    return counts


def report(spark: SparkSession, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Totals, and all that is known of each stage."""
    metrics = needed(spark, cfg, "metrics")
    return score.report(metrics)[0], score.report_full(metrics).select("stage", "label", "items_in", "items_removed", "items_out", "fraction_of_initial", "seconds", "peak_mem_mb", "extra")


def score_run(spark: SparkSession, cfg: Config, manifest: str, scope: str = "all") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Recall by tier; precision; the summary of both; the missed files. scope: the removals that precision is over, "all" or
    "stage4", which leaves out those of the exact stage."""
    if scope not in ("all", "stage4"):
        raise ValueError(f"unknown scope {scope!r}")
    p = spark.read.json(manifest, multiLine=True).select(F.explode("planted").alias("p")).select(basename(F.col("p.file")).alias("file"), basename(F.col("p.original")).alias("original"), "p.type", F.col("p.expected_stage").cast("int").alias("expected_stage"))
    out = cfg.io.output_dir
    groups, removed = spark.read.parquet(f"{out}/groups").select("stage", "group", "name"), spark.read.parquet(f"{out}/removed")
    if scope == "stage4":
        removed = removed.join(needed(spark, cfg, "stage1/survivors"), "path", "left_semi")
    removed = removed.select("name")
    return score.recall_by_tier(p, groups), score.precision(p, removed), score.score_summary(p, groups, removed), score.missed_by_tier(p, groups)
