"""Reports over stages and scores against planted duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.codes import fraction

#: What the stages find, fixed values.
STAGE_LABELS = {1: "exact (SHA-256)", 2: "near-duplicate (perceptual)", 3: "semantic (embedding)", 4: "cluster resolution"}
EXAMPLES = 10


def report(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals (initial_images, final_images, removed, reduction_fraction) and, per stage, its share of the initial images.
    metrics: stage, items_in, items_removed."""
    out = F.col("items_in") - F.col("items_removed")
    t = metrics.agg(F.min_by("items_in", "stage").alias("initial_images"), F.max_by(out, F.col("stage")).alias("final_images"))
    gone = F.col("initial_images") - F.col("final_images")
    totals = t.select("initial_images", "final_images", gone.alias("removed"), fraction(gone, F.col("initial_images")).alias("reduction_fraction"))
    per = metrics.crossJoin(F.broadcast(totals.select("initial_images"))).select("stage", "items_in", "items_removed", out.alias("items_out"), fraction(F.col("items_removed"), F.col("initial_images")).alias("fraction_of_initial"))
    return totals, per  # one row meets a few stage rows


def report_full(metrics: DataFrame) -> DataFrame:
    """A row per stage with its label, share of the initial images, time, memory and details, beside the totals, the index of
    stage 3 and the leaked fractions. metrics: stage, items_in, items_removed, seconds, peak_mem_mb, extra (map<string,string>)."""
    totals, per = report(metrics)
    detail = lambda key: F.max(F.col("extra")[key])
    found = metrics.agg(detail("index_type").alias("index_type"), detail("leakage").alias("leakage"))
    label = F.create_map(*[F.lit(x) for kv in STAGE_LABELS.items() for x in kv])[F.col("stage")]
    rows = per.withColumn("label", label).join(metrics.select("stage", "seconds", "peak_mem_mb", "extra"), "stage")
    return rows.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(found))  # one row each meets a few stage rows


def caught(planted: DataFrame, members: DataFrame) -> DataFrame:
    """planted with caught_stage: the earliest stage with one group that holds both file and original. members: stage, group, name."""
    a = members.select("stage", "group", F.col("name").alias("file"))
    b = members.select("stage", "group", F.col("name").alias("original"))
    hits = planted.select("file", "original").join(a, "file").join(b, ["stage", "group", "original"]).groupBy("file", "original").agg(F.min("stage").alias("caught_stage"))
    return planted.join(hits, ["file", "original"], "left")


def recall_by_tier(planted: DataFrame, members: DataFrame) -> DataFrame:
    """tier, total, caught, on_time (caught first at the stage expected), missed, recall."""
    c = caught(planted, members)
    got, on_time = F.count("caught_stage"), F.count_if(F.col("caught_stage") == F.col("expected_stage"))
    return c.groupBy(F.col("type").alias("tier")).agg(F.count("*").alias("total"), got.alias("caught"), on_time.alias("on_time"), (F.count("*") - got).alias("missed"), fraction(got, F.count("*")).alias("recall"))


def precision(planted: DataFrame, removed: DataFrame) -> DataFrame:
    """removed, related, precision: removed names that are planted files or their originals; 1.0 when nothing was removed."""
    related = planted.select(F.col("file").alias("name")).union(planted.select("original")).distinct()
    r = removed.select("name").distinct().join(related.withColumn("ok", F.lit(1)), "name", "left")
    n, ok = F.count("*"), F.count("ok")
    return r.agg(n.alias("removed"), ok.alias("related"), F.when(n == 0, F.lit(1.0)).otherwise(F.round(ok / n, 4)).alias("precision"))


def missed_by_tier(planted: DataFrame, members: DataFrame) -> DataFrame:
    """tier, file of every planted file that no stage caught."""
    return caught(planted, members).where("caught_stage is null").select(F.col("type").alias("tier"), "file")


def score_summary(planted: DataFrame, members: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: planted_total, caught, recall, caught_on_expected_stage; removed_total, true_positive_removals,
    false_positive_removals, precision, and the first false positives and missed files by name, comma-joined."""
    c = caught(planted, members)
    n, got = F.count("*"), F.count("caught_stage")
    on_time = F.count_if(F.col("caught_stage") == F.col("expected_stage"))
    recall = c.agg(n.alias("planted_total"), got.alias("caught"), fraction(got, n).alias("recall"), on_time.alias("caught_on_expected_stage"))
    related = planted.select(F.col("file").alias("name")).union(planted.select("original"))
    wrong = removed.select("name").distinct().join(related, "name", "left_anti")
    p = precision(planted, removed).select(F.col("removed").alias("removed_total"), F.col("related").alias("true_positive_removals"), (F.col("removed") - F.col("related")).alias("false_positive_removals"), "precision")

    def first(rows: DataFrame, name: str, alias: str) -> DataFrame:
        some = rows.select(F.col(name).cast("string").alias(name)).orderBy(name).limit(EXAMPLES)
        return some.agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias(alias))

    out = recall.crossJoin(p)  # one row each, as below
    return out.crossJoin(first(wrong, "name", "false_positive_examples")).crossJoin(first(c.where("caught_stage is null"), "file", "missed_examples"))
