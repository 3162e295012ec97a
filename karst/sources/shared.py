"""The folder that all executors share, and lineage cuts written to it."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir, or a folder of our own where that is unset (tests, local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="karst-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._karst_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut that no later plan reads."""
    if path := getattr(df, "_karst_path", None):
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of finished phases that nothing refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def local_path(uri: str) -> str | None:
    """The path behind a file: URI or a bare path, or None if another file system holds it."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def spread(df: DataFrame) -> DataFrame:
    """Give small inputs of few files as many partitions as there are cores; larger inputs keep their splits."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def on_workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path."""
    import karst

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # texts can be long
    root = os.path.dirname(os.path.dirname(os.path.abspath(karst.__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_karst_sent", False):
        return
    import zipfile

    path = os.path.join(tempfile.mkdtemp(prefix="karst-zip-"), "karst_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "karst")):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(d, x)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._karst_sent = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(f):
    """For functions of a table that return its columns: columns whose names begin with an underscore, as those of helper columns
    do, bear other names meanwhile."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        lead = "own"
        while any(c.lower().startswith(lead) for c in docs.columns):
            lead += "0"
        away = {c: f"{lead}{c}" for c in docs.columns if c.startswith("_")}
        return f(docs.withColumnsRenamed(away), *args, **kwargs).withColumnsRenamed({v: k for k, v in away.items()}) if away else f(docs, *args, **kwargs)

    return run


def text_hash() -> F.Column:
    """Tells documents apart that share a doc_id; equal rows share it."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
