"""Quality by Naive Bayes support vectors.

Features: indicators of hashed word 1- and 2-grams and byte 3-grams of the whole text. Each is scaled by its class log-count
ratio r = log((p / |p|) / (q / |q|)), p and q the smoothed numbers of good and bad training texts that have it; rows get unit
length. A linear hinge-loss model is fitted by dual coordinate descent, and its margins are mapped to probabilities by a
sigmoid fitted on the fifth of the training rows that an equal model did not see.

Labels reach the fit only from rows that are not held out; texts are the only input of a score. Edge cases: null and empty
texts have no features and get the score of the bias; without labels of both classes every score is the share of good labels
(or 0.5); repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.arrowtext import SLICE, Texts, U, batch, mix, slices
from karst.llm.linear import fitted, held_out, platt, sigmoid
from karst.sources.shared import spread

BITS = 19
FIT_ROWS = 6000  # documented bound of the labelled sample


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, ascending, and the bounds of each text's run."""
    t = Texts(column)
    t.split()
    shift = U(64 - bits)
    h = t.word_hashes()
    two = mix(h[:-1] * U(3) + h[1:])[t.wd[:-1] == t.wd[1:]] if len(h) > 1 else h[:0]
    b = t.buf.astype(np.uint32)
    m = max(len(b) - 2, 0)
    three = (b[:m] | b[1 : m + 1] << np.uint32(8) | b[2 : m + 2] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
    bd = np.repeat(np.arange(t.n), np.diff(t.off))[:m]
    inside = np.arange(m) + 3 <= t.end[bd] + 1  # a 3-gram may end with the space after the text
    key = np.concatenate([(t.wd << bits) | (h >> shift).astype(np.int64), (t.wd[1:][t.wd[:-1] == t.wd[1:]] << bits if len(h) > 1 else t.wd[:0]) | (two >> shift).astype(np.int64), (bd[inside] << bits) | three[inside].astype(np.int64)])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & ((1 << bits) - 1), np.searchsorted(key, np.arange(t.n + 1) << bits)


def _many(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rb = pa.RecordBatch.from_arrays([column], ["text"])
    parts = [features(s.column(0), bits) for s in slices(iter([rb]))]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = np.cumsum([0] + [len(p[0]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0]] + [p[1][1:] + s for p, s in zip(parts, size, strict=False)])


def ratios(f: np.ndarray, bound: np.ndarray, y: np.ndarray, bits: int, alpha: float = 1.0) -> np.ndarray:
    row_y = np.repeat(y, np.diff(bound))
    p = alpha + np.bincount(f[row_y == 1], minlength=1 << bits)
    q = alpha + np.bincount(f[row_y == 0], minlength=1 << bits)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _unit(f, bound, r):
    x = r[f]
    norm = np.sqrt(np.add.reduceat(np.append(x * x, 0.0), np.minimum(bound[:-1], len(x)))) * (np.diff(bound) > 0)
    return x / np.repeat(np.maximum(norm, 1e-12), np.diff(bound))


def dual_coordinate_descent(f, x, bound, y, bits: int, c: float = 1.0, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum c_i max(0, 1 - y_i (w x_i + b)), the classes weighted to balance."""
    n, sign = len(y), np.where(y == 1, 1.0, -1.0)
    most = c * n / (2 * np.maximum(np.where(y == 1, (y == 1).sum(), (y == 0).sum()), 1))
    w, b, a = np.zeros(1 << bits), 0.0, np.zeros(n)
    size = np.array([x[i:j] @ x[i:j] for i, j in zip(bound[:-1], bound[1:], strict=True)]) + 1.0
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            lo, hi = bound[i], bound[i + 1]
            fi, xi = f[lo:hi], x[lo:hi]
            g = sign[i] * (w[fi] @ xi + b) - 1.0
            new = min(max(a[i] - g / size[i], 0.0), most[i])
            if new != a[i]:
                d = (new - a[i]) * sign[i]
                w[fi] += d * xi
                b += d
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w, b


def fit(column: pa.Array, y: np.ndarray, bits: int = BITS, c: float = 1.0) -> dict:
    """bits, weights (of indicators scaled to unit rows), ratios, bias and the sigmoid."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return {"bits": 1, "w": np.zeros(2, np.float32), "r": np.zeros(2, np.float32), "b": 0.0, "a": 1.0, "c": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    f, bound = _many(column, bits)
    fold = np.arange(len(y)) % 5 == 0

    def part(rows):
        keep = np.repeat(rows, np.diff(bound))
        return f[keep], np.concatenate([[0], np.cumsum(np.diff(bound)[rows])]), y[rows]

    def model(rows):
        fi, bo, yi = part(rows)
        r = ratios(fi, bo, yi, bits)
        w, b = dual_coordinate_descent(fi, _unit(fi, bo, r), bo, yi, bits, c)
        return r, w, b

    a, k = 1.0, 0.0
    if len(set(y[fold].tolist())) == 2 and len(set(y[~fold].tolist())) == 2:
        r, w, b = model(~fold)
        fi, bo, yi = part(fold)
        a, k = platt(_margins(fi, bo, r, w, b), yi)
    r, w, b = model(np.ones(len(y), bool))
    return {"bits": bits, "w": (w * r).astype(np.float32), "r": r.astype(np.float32), "b": float(b), "a": a, "c": k}


def _margins(f, bound, r, w, b):
    x = _unit(f, bound, r)
    total = np.concatenate([[0.0], np.cumsum(w[f] * x)])
    return total[bound[1:]] - total[bound[:-1]] + b


def score_column(column: pa.Array, m: dict) -> np.ndarray:
    f, bound = features(column, m["bits"])
    r = m["r"][f].astype(np.float64)
    t1, t2 = np.concatenate([[0.0], np.cumsum(m["w"][f], dtype=np.float64)]), np.concatenate([[0.0], np.cumsum(r * r)])
    norm = np.sqrt(np.maximum(t2[bound[1:]] - t2[bound[:-1]], 0))
    margin = np.where(norm > 1e-9, (t1[bound[1:]] - t1[bound[:-1]]) / np.maximum(norm, 1e-9), 0.0) + m["b"]
    return sigmoid(m["a"] * margin + m["c"])


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fitted(docs, labels, fit_rows, fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the data's size
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        m = shared.value
        for s in slices(batches, most=SLICE // 2):
            p = score_column(s.column("text"), m)
            yield batch(schema, s.column("doc_id"), s.column("held_out"), p, (p >= 0.5).astype(np.int32))

    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
