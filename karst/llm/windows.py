"""Windows of a fixed length that occur more than once in a corpus: what suffix-array and recompression dedup share.

Every window of a text has one anchor, chosen by the window's content alone, so equal windows have equal anchors at equal
offsets. Consecutive windows with the same anchor make a row: a (the anchor's class, a content hash), c (a hash of all bytes
or words the row's windows cover, with the anchor's offset), the document, lo (first window) and n (windows). Rows with equal
(a, c) hold equal windows throughout and need no further look; only where a class has rows of different c are single
windows compared, by the operator's own method, on one row for each c.

Copies inside a slice of text are combined before the shuffle, so that a passage which a third of all documents share leaves
one row per slice; what follows streams over sorted rows and keeps one row per distinct c of the class at hand.

A document is (doc_id, th), th telling texts apart that share a doc_id; rows that repeat both are one document. A null doc_id
stands as the smallest number here and comes back as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.arrowtext import Texts, U, batch, mix, slices
from karst.sources.shared import cut, free_shuffles, spread

NULL_ID = -(2**63)
ROW, FLAG, SEEN, NEED = 0, 1, 2, 3  # SEEN: a row whose windows are known to repeat and are flagged already
SCHEMA = pa.schema([("k", pa.int8()), ("a", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())])
KIND = "k byte, a long, c long, doc_id long, th int, lo int, n int"


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, th, text without nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int").alias("th"), text.alias("text"))


def combine(a, c, doc, th, lo, n, every: bool) -> pa.RecordBatch:
    """Rows of a slice with equal (a, c) become one, their first; the others (with `every` all of them) become flags."""
    order = np.lexsort((lo, th, doc, c, a))
    a, c, doc, th, lo, n = (v[order] for v in (a, c, doc, th, lo, n))
    m = len(a)
    new = np.ones(m, bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    again = np.zeros(m, bool)  # the same place, from a repeated row
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (lo[1:] == lo[:-1])
    a, c, doc, th, lo, n, new = (v[~again] for v in (a, c, doc, th, lo, n, new))
    m = len(a)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, m)) > 1
    k = np.where(many & every, SEEN, ROW).astype(np.int8)
    flag = np.repeat(many, np.diff(np.append(first, m)))
    if not every:
        flag &= ~new
    f = np.flatnonzero(flag)
    salt = mix(doc[f].astype(np.uint64) + lo[f].astype(np.uint64)).view(np.int64)
    join = lambda x: np.concatenate([x[first], x[f]])
    return batch(SCHEMA, np.concatenate([k, np.full(len(f), FLAG, np.int8)]), np.concatenate([a[first].view(np.int64), salt]), join(c).view(np.int64), join(doc), join(th).astype(np.int32), join(lo).astype(np.int32), join(n).astype(np.int32))


def _stream(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows to flags and needs. The rows of the class at hand that are kept: the first of each c."""
    carry = None

    def out(k, a, doc, th, lo, n):
        return batch(SCHEMA, np.full(len(a), k, np.int8), a, np.zeros(len(a), np.int64), doc, th, lo, n)

    def work(k, a, c, doc, th, lo, n, old, last):
        nonlocal carry
        m = len(a)
        new = np.ones(m, bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        again = np.zeros(m, bool)
        again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (lo[1:] == lo[:-1])
        if again.any():
            k, a, c, doc, th, lo, n, old, new = (v[~again] for v in (k, a, c, doc, th, lo, n, old, new))
            m = len(a)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, m))
        many = np.repeat(size > 1, size)
        flag = (many & (k == ROW)) if every else (~new & ~old)
        yield out(FLAG, *(v[flag] for v in (a, doc, th, lo, n)))
        k = np.where(flag & every, SEEN, k).astype(np.int8)
        ka, kk, kd, kt, kl, kn = (v[first] for v in (a, k, doc, th, lo, n))
        kc = c[first]
        done = np.ones(len(first), bool) if last else ka != a[-1]
        same = np.zeros(len(first), bool)
        same[1:] |= ka[1:] == ka[:-1]
        same[:-1] |= ka[1:] == ka[:-1]
        s = done & same
        yield out(NEED, *(v[s] for v in (ka, kd, kt, kl, kn)))
        carry = None if last else tuple(v[~done] for v in (kk, ka, kc, kd, kt, kl, kn))

    for rb in batches:
        if not rb.num_rows:
            continue
        k = rb.column("k").to_numpy()
        if (k == FLAG).any():
            yield rb.filter(pa.array(k == FLAG))
            rb = rb.filter(pa.array(k != FLAG))
            if not rb.num_rows:
                continue
        cols = [rb.column(x).to_numpy() for x in ("k", "a", "c", "doc_id", "th", "lo", "n")]
        old = np.zeros(rb.num_rows, bool)
        if carry is not None:
            # carried rows of another class are complete; those of this class are put in order with the new ones
            old = np.concatenate([np.ones(len(carry[0]), bool), old])
            cols = [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)]
            head = int(np.searchsorted(cols[1] != cols[1][0], True)) if (cols[1] != cols[1][0]).any() else len(old)
            order = np.concatenate([np.lexsort((cols[5][:head], cols[4][:head], cols[3][:head], ~old[:head], cols[2][:head])), np.arange(head, len(old))])
            cols, old = [v[order] for v in cols], old[order]
        yield from work(*cols, old, False)
    if carry is not None:
        yield from work(*carry, np.ones(len(carry[0]), bool), True)


def classify(rows: DataFrame, every: bool, name: str) -> DataFrame:
    """Flags and needs of rows, written: one shuffle by class."""
    by = rows.repartition("a").sortWithinPartitions("a", "c", "doc_id", "th", "lo")
    out = cut(by.mapInArrow(lambda it: _stream(it, every), KIND), name)
    free_shuffles(rows.sparkSession)
    return out


def anchored(docs: DataFrame, anchors: Callable[[Texts], tuple], every: bool, name: str) -> DataFrame:
    """anchors(texts) -> a, c, text number, lo, n. Returns flags and needs."""

    def run(batches):
        for s in slices(batches):
            a, c, d, lo, n = anchors(Texts(s.column("text")))
            yield combine(a, c, s.column("doc_id").to_numpy()[d], s.column("th").to_numpy()[d], lo, n, every)

    return classify(spread(docs).mapInArrow(run, KIND), every, name)


def with_places(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined with all their (a, lo, n) as one array."""
    per = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "lo", "n")).alias("at"))
    return docs.join(per, ["doc_id", "th"], how)


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, a, lo, n of every struct of a list column (null: none)."""
    column = column.fill_null([]) if column.null_count else column
    size = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), size), flat.field("a").to_numpy(), flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def hash_of(*parts: np.ndarray) -> np.ndarray:
    x = parts[0].copy()
    for i, p in enumerate(parts[1:]):
        x += p.astype(np.uint64) * U(0xA0761D6478BD642F + 2 * i)
    return mix(x)
