"""Image folders and annotation files as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions.codes import basename, is_image

PARSERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

_ID = "string"
COCO = (f"images array<struct<id:{_ID},file_name:string,width:int,height:int,partition_key:string>>, annotations array<struct<image_id:{_ID},category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>")


def scan_images(spark: SparkSession, root: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """item_id (path) and content of image files. A missing root fails on read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).where(is_image(F.col("path")))
    return df.select(F.col("path").alias("item_id"), *(["content"] if content else []))


def decode_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower()).load(root)


def register_parser(name: str):
    def add(f):
        PARSERS[name] = f
        return f

    return add


def read_annotations(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    if fmt not in PARSERS:
        raise NotImplementedError(f"no annotation parser for {fmt!r}")
    return PARSERS[fmt](spark, path)


def fold_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id and other columns of images, num_boxes, class_ids (sorted, distinct), num_classes. Boxes of unknown images are
    skipped; boxes without a class count but add none. boxes: image_id, category_id."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("num_boxes"), F.array_sort(F.collect_set("category_id")).alias("class_ids"))
    out = images.join(per, "image_id", "left")
    return out.withColumns({"num_boxes": F.coalesce("num_boxes", F.lit(0)).cast("long"), "class_ids": F.coalesce("class_ids", F.array().cast("array<bigint>"))}).withColumn("num_classes", F.size("class_ids").cast("long"))


@register_parser("coco")
def read_coco(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    images = doc.select(F.posexplode("images").alias("pos", "i")).select(F.col("i.id").alias("image_id"), "pos", "i.file_name", "i.width", "i.height", "i.partition_key")
    last = images.groupBy("image_id").agg(F.max_by(F.struct("file_name", "width", "height", "partition_key"), "pos").alias("i")).select("image_id", "i.*")
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id")
    return fold_boxes(last, boxes).withColumn("area", F.coalesce(F.col("width") * F.col("height"), F.lit(0)).cast("long"))


def annotate_items(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of each item by base name; of colliding names the last by image_id is shared by all paths."""
    a = annotations.groupBy(basename(F.col("file_name")).alias("_name")).agg(F.max_by(F.struct(*[c for c in annotations.columns]), "image_id").alias("_a")).select("_name", "_a.*")
    return items.join(a, basename(F.col("item_id")) == F.col("_name"), "left").drop("_name")


def coco_subset(images: DataFrame, boxes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n images by id, and their boxes."""
    first = images.orderBy("image_id").limit(n)
    return first, boxes.join(first.select("image_id"), "image_id", "left_semi")
