"""Quality rules: plain counts of every text, and a hashed n-gram logistic regression against a fixed threshold.

The model: frequencies of hashed word 1-grams and of character 2- to 4-grams, both over the text's own totals, so a text's
length does not count. It is fitted with numpy on a bounded sample of labelled rows that are not held out, calibrated by a sigmoid on rows an equal model did not see, and applied to Arrow batches. A text is kept if
no base rule fails and its probability of label 1 reaches `threshold`.

Edge cases: null and empty texts have no words and fail the base rule; without labels of both classes the model keeps
everything and only the base rules decide; repeated rows get equal verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.arrowtext import SLICE, Texts, U, batch, covered, gram_hashes, mix, per_text, release, slices
from karst.llm.linear import fitted, platt, sigmoid
from karst.sources.shared import spread

BITS = 16  # feature numbers are unsigned 16-bit
FIT_ROWS = 6000  # documented bound of the labelled sample
THRESHOLD = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SYMBOLS = np.zeros(256, np.uint8)
SYMBOLS[list(b"#*$%&|<>")] = 1
HEAD = np.ones(256, np.uint8)
HEAD[0x80:0xC0] = 0  # continuation bytes start no character


def counts(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text (t.split() has run)."""
    heads = np.concatenate([[0], np.cumsum(HEAD[t.buf])])
    chars = per_text(heads[t.we] - heads[t.ws], t.wc)
    symbols = per_text(SYMBOLS[t.buf].astype(np.int64), t.off)

    at, g = gram_hashes(t.word_hashes(), t.wd, 5)
    g = mix(g + t.wd[at].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    repeated = _repeated(g, first=True)
    words = per_text(covered(len(t.ws), at[repeated], 5).astype(np.int64), t.wc)

    # lines: between line feeds; the space after each text ends its last line
    feed = np.flatnonzero(t.buf == 10)
    stop = np.sort(np.concatenate([feed, t.end]))
    start = np.concatenate([[0], stop[:-1] + 1])
    ld = np.searchsorted(t.end, stop)
    has = np.searchsorted(t.ws, stop) > np.searchsorted(t.ws, start)
    start, stop, ld = start[has], stop[has], ld[has]
    h = mix(t.hashes(start, stop) + ld.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    dup = np.bincount(ld[_repeated(h, first=False)], minlength=t.n)
    return {"n_words": t.nw, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": words}


def _repeated(h: np.ndarray, first: bool) -> np.ndarray:
    """Positions whose value occurs at another position too; without the first of each value unless `first`."""
    if len(h) < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    mask = np.zeros(len(h), bool)
    mask[order[1:][same]] = True
    if first:
        mask[order[:-1][same]] = True
    return np.flatnonzero(mask)


def characters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each character as one number, and the bounds of texts (the space after a text is its last character)."""
    head = np.flatnonzero(HEAD[t.buf])
    size = np.diff(np.append(head, len(t.buf)))
    x = t.buf[head].astype(np.uint32)
    for j in (1, 2, 3):
        more = np.flatnonzero(size > j)
        x[more] |= t.buf[head[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return x, np.searchsorted(head, t.off)


def _grams(t: Texts, bits: int):
    """(feature numbers in the order of texts, bounds of texts) for words and for runs of 2 to 4 characters of one text."""
    out = [((t.word_hashes() >> U(64 - bits)).astype(np.uint16), t.wc)]
    char, bound = characters(t)
    x = char * np.uint32(0x9E3779B1)
    for k in (2, 3, 4):
        m = max(len(char) - k + 1, 0)
        x = ((x[:m] ^ x[:m] >> np.uint32(15)) + char[k - 1 : k - 1 + m]) * np.uint32(0x85EBCA6B + 2 * k)
        own = np.ones(m, bool)  # not those that run on into the next text
        for j in range(1, k):
            at = bound[1:] - j
            own[at[(at >= 0) & (at < m)]] = False
        out.append(((x >> np.uint32(32 - bits))[own].astype(np.uint16), np.concatenate([[0], np.cumsum(np.maximum(np.diff(bound) - k + 1, 0))])))
    return out


def score_texts(t: Texts, m: dict) -> np.ndarray:
    """Raw margins: for each family of grams, the mean weight over the text."""
    z = np.full(t.n, m["b"])
    for (f, bound), w in zip(_grams(t, m["bits"]), m["w"], strict=True):
        n = np.maximum(np.diff(bound), 1)
        total = np.concatenate([[0.0], np.cumsum(w[f], dtype=np.float64)])
        z += (total[bound[1:]] - total[bound[:-1]]) / n
    return z


def fit(column: pa.Array, y: np.ndarray, bits: int = BITS, epochs: int = 30) -> dict | None:
    """Logistic regression by AdaGrad over rows of gram frequencies, classes weighted to balance, then the sigmoid."""
    if len(set(y.tolist())) < 2:
        return None
    rows = []
    rb = pa.RecordBatch.from_arrays([column], ["text"])
    for s in slices(iter([rb])):
        t = Texts(s.column(0))
        t.split()
        grams = _grams(t, bits)
        for i in range(t.n):
            fs, vs = [], []
            for k, (f, bound) in enumerate(grams):
                u, c = np.unique(f[bound[i] : bound[i + 1]], return_counts=True)
                fs.append(u.astype(np.int32) + np.int32(k << bits))
                vs.append((c / max(bound[i + 1] - bound[i], 1)).astype(np.float32))
            rows.append((np.concatenate(fs), np.concatenate(vs)))

    def train(which):
        w, g2, b = np.zeros(4 << bits), np.full(4 << bits, 1e-8), 0.0
        pos = max((y[which] == 1).sum(), 1)
        neg = max((y[which] == 0).sum(), 1)
        rng = np.random.Generator(np.random.PCG64(3))
        for e in range(epochs):
            rate = 1.0 / (1 + 0.1 * e)
            for i in rng.permutation(which):
                f, v = rows[i]
                err = (sigmoid(w[f] @ v + b) - y[i]) * (len(which) / (2 * (pos if y[i] else neg)))
                g = err * v
                g2[f] += g * g
                w[f] -= rate * g / np.sqrt(g2[f])
                b -= 0.02 * rate * err
        return w, b

    every = np.arange(len(y))
    fold = every % 5 == 0
    a, k = 1.0, 0.0
    if len(set(y[fold].tolist())) == 2 and len(set(y[~fold].tolist())) == 2:
        w, b = train(every[~fold])
        a, k = platt(np.array([w[rows[i][0]] @ rows[i][1] + b for i in every[fold]]), y[fold])
    w, b = train(every)
    rows.clear()
    release()
    return {"bits": bits, "w": w.astype(np.float32).reshape(4, -1), "b": float(b), "a": a, "c": k}


def verdicts(column: pa.Array, m: dict | None, threshold: float) -> tuple:
    """Counts, base_failed, score and kept of each text."""
    t = Texts(column)
    t.split()
    c = counts(t)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    p = np.ones(t.n) if m is None else sigmoid(m["a"] * score_texts(t, m) + m["c"])
    return c, failed, p, ~failed & (p >= threshold)


def judge(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD, columns: list[str] = ()) -> DataFrame:
    """The counts, base_failed, score and kept of every row; other columns that are asked for are carried along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB whatever the data's size
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        m = shared.value
        for s in slices(batches, "_text", SLICE // 2):
            c, failed, p, kept = verdicts(s.column("_text"), m, threshold)
            own = [pa.array(c[k].astype(np.int64)) for k in names] + [pa.array(failed), pa.array(p), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([s.column(x) for x in columns] + own, [*columns, *names, "base_failed", "score", "kept"])

    rows = docs.select(*columns, F.col("text").alias("_text"))
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    out = [*[rows.schema[c] for c in columns], *[StructField(k, LongType()) for k in names], StructField("base_failed", BooleanType()), StructField("score", DoubleType()), StructField("kept", BooleanType())]
    return rows.mapInArrow(run, StructType(out))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns whatever their names."""
    docs = spread(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, FIT_ROWS, fit))

    def run(batches):
        for s in slices(batches, "text", SLICE // 2):
            yield s.filter(pa.array(verdicts(s.column("text"), shared.value, threshold)[3]))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, columns: list[str] = ("doc_id",)) -> DataFrame:
    """The columns asked for, the five counts, base_failed, score and kept of every row of docs."""
    return judge(spread(docs), fitted(docs, labels, FIT_ROWS, fit), threshold, list(columns))
