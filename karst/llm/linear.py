"""Labelled rows for the two quality models, and the fits' shared parts.

A model is fitted on about `most` labelled documents, those with the smallest hash of their doc_id: a documented bound of rows.
Their texts are read whole, whatever their lengths. The fit runs in one task on an executor; the driver gets the model only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.arrowtext import release


def held_out(modulus: int = 3, remainder: int = 1) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, quality of the labelled rows that are not held out: all of them, or about `most` with the smallest hashes.
    Of rows that repeat a doc_id the least text counts, of labels the largest."""
    lab = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out())
    n = lab.count()
    if n > most:  # by a threshold on the hash: no sort of all rows
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(lab), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))


def fitted(docs: DataFrame, labels: DataFrame, most: int, fit: Callable[[pa.Array, np.ndarray], object]) -> object:
    """What `fit` makes of the texts and labels, in ascending order of doc_id."""

    def run(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("quality", pa.int64())])).sort_by("doc_id")
        text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.large_string())
        model = pickle.dumps(fit(text, got.column("quality").to_numpy().astype(np.int64)))
        del got, text
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    def typed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.large_string()), b.column(2)], ["doc_id", "text", "quality"])

    rows = labelled(docs, labels, most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("long").alias("quality"))
    got = rows.repartition(1).mapInArrow(lambda batches: run(typed(batches)), "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else fit(pa.array([], pa.large_string()), np.zeros(0, np.int64))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b) by Newton's method on smoothed targets."""
    pos, neg = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s = margin.std() or 1.0
    x = np.stack([margin / s, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - t) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0] / s), float(w[1])
