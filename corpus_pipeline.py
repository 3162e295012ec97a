"""Training-corpus preparation: quality rules, near-dedup, decontamination, mixing, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), docs being what the stage before has kept, and
returns a DataFrame that is written as Parquet and read again for the next. All but the last return the columns of documents.
The mixing stage keeps every document and decides their order, which its files hold; the last stage reads it from them (file
name and row index), writes the token files in ascending doc_id order and returns each document's place in the mix beside its
place in the files, so that a reader can follow either.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.decontam import decontaminate
from karst.llm.pfair import in_order
from karst.llm.quality_rules import keep_good
from karst.llm.superminhash import keep_one
from karst.llm.token_files import token_files
from karst.sources.shared import cut, on_workers, read_table

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_order(docs)


def mix_index(docs: DataFrame) -> DataFrame:
    """docs with the column mix_index: each row's number in the order of the files it was read from; null for other sources."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files
        return docs.withColumn("mix_index", F.lit(None).cast("long"))
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = rows.groupBy(F.col("_file").alias("_f")).count().select("_f", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(files), F.col("_file") == F.col("_f")).withColumn("mix_index", F.col("_base") + F.col("_row")).select(*docs.columns, "mix_index")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    on_workers(spark)
    docs = docs.drop(*[c for c in ("mix_index", "_file", "_row", "_f", "_base") if c in docs.columns])
    out = token_files(mix_index(docs), public_tokenizers.path(TOKENIZER), mark="mix_index")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", F.col("mark").alias("mix_index"))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", tokens)]

#: Models, signatures and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
