"""Exact substring dedup by suffix arrays: bytes covered by a `length`-byte string that also starts earlier are removed.

1. Anchors. The anchor of a window of `length` bytes is its least GRAM-byte hash (the last of equal ones), a content-defined
   choice; windows that share an anchor make one row (see karst.llm.windows). About one row in 35 bytes is shuffled, not text.
2. Rows with equal contents: all but the earliest are repeats. Only classes with different contents go on, one row for each.
3. Their texts (the bytes that their windows cover) are dealt by class to shards, and every shard is a text of its own for an
   external induced suffix sort (karst.llm.induced), whose queues spill to disk. Neighbouring suffixes that agree in `length`
   bytes, compared byte by byte, are one string; all but its earliest place are repeats.
4. Repeats are gathered by document and the texts are cut.

All comparisons are on the input, and matches never cross texts. "Earlier" is by doc_id, then start.
Edge cases: null and empty texts have no bytes; a null doc_id is the smallest; rows that repeat doc_id and text are one
document and get equal results; texts shorter than `length` keep everything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from karst.llm.arrowtext import Texts, U, batch, mix, release, slices
from karst.llm.induced import suffix_array
from karst.llm.windows import FLAG, KIND, NEED, SCHEMA, anchored, hash_of, nullable, places, prepared, with_places
from karst.sources.shared import cut, free_shuffles, spread

LENGTH = 100
GRAM = 32
SHARD = 4 << 20  # bytes at which a shard is closed, at the next change of class
_LOW = U((1 << 24) - 1)


def byte_anchors(t: Texts, length: int = LENGTH) -> tuple:
    """a, c, text number, lo, n of rows of windows with one anchor."""
    w = length - GRAM + 1
    m = len(t.buf) - length + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    valid = np.zeros(m + 1, np.int32)
    long = np.flatnonzero(t.end - t.off[:-1] >= length)
    np.add.at(valid, t.off[:-1][long], 1)
    np.add.at(valid, t.end[long] - length + 1, -1)
    valid = np.cumsum(valid[:m]) > 0
    at = np.arange(len(t.buf) - GRAM + 1)
    g = t.hashes(at, at + GRAM)
    anchor = np.empty(m, np.int64)
    chunk = 1 << 22
    for p0 in range(0, m, chunk):  # positions inside a chunk fit the low bits
        p1 = min(p0 + chunk, m)
        x = (g[p0 : p1 + w - 1] & ~_LOW) | (_LOW - np.arange(p1 + w - 1 - p0, dtype=np.uint64))
        k = 1
        while 2 * k <= w:
            x = np.minimum(x[: len(x) - k], x[k:])
            k *= 2
        x = np.minimum(x[: p1 - p0], x[w - k : w - k + p1 - p0])
        anchor[p0:p1] = p0 + (_LOW - (x & _LOW)).astype(np.int64)
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(start)
    # a run ends before the next start or the first window that is not one
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | start[1:]
    hi = np.flatnonzero(stop)
    n = hi - lo + 1
    x = anchor[lo]
    d = np.searchsorted(t.off, lo, side="right") - 1
    return mix(g[x]), hash_of(t.hashes(lo, hi + length), n, x - lo), d, lo - t.off[d], n


def _shard_flags(batches, length: int):
    """Repeated windows among the rows of each shard."""
    held, size = [], 0

    def work(rows):
        a, doc, th, lo, n, text = (np.concatenate([r[i] for r in rows]) if i < 5 else [x for r in rows for x in r[5]] for i in range(6))
        width = np.fromiter(map(len, text), np.int64, len(text))
        off = np.concatenate([[0], np.cumsum(width + 1)])
        t = np.frombuffer(b"\0".join(text) + b"\0", np.uint8)
        shown = np.frombuffer(t, np.uint8).astype(np.uint16) + 1  # 0 is left for the ends of texts
        shown[off[1:] - 1] = 0
        order = suffix_array(shown, length)
        row = np.full(len(t), -1, np.int32)  # the row of every window start
        at = np.arange(n.sum()) + np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        row[at] = np.repeat(np.arange(len(n)), n)
        sa = order[row[order] >= 0]
        view = np.lib.stride_tricks.sliding_window_view(t, length)
        same = np.zeros(len(sa), bool)
        for i in range(1, len(sa), 1 << 15):
            z = min(i + (1 << 15), len(sa))
            same[i:z] = (view[sa[i:z]] == view[sa[i - 1 : z - 1]]).all(axis=1)
        r = row[sa]
        pos = lo[r] + sa - off[r]
        # least place of each group of equal windows
        rank = np.empty(len(sa), np.int64)
        rank[np.lexsort((pos, th[r], doc[r]))] = np.arange(len(sa))
        edge = np.flatnonzero(~same)
        least = np.minimum.reduceat(rank, edge) if len(edge) else rank
        later = rank != np.repeat(least, np.diff(np.append(edge, len(sa))))
        # flagged places that follow each other in one row become one run
        f = np.zeros(len(t), bool)
        f[sa[later]] = True
        starts = np.flatnonzero(f & ~np.concatenate([[False], f[:-1]]))
        ends = np.flatnonzero(f & ~np.concatenate([f[1:], [False]]))
        q = row[starts]
        zero = np.zeros(len(q), np.int64)
        return batch(SCHEMA, np.full(len(q), FLAG, np.int8), zero, zero, doc[q], th[q], (lo[q] + starts - off[q]).astype(np.int32), (ends - starts + 1).astype(np.int32))

    for rb in batches:
        if not rb.num_rows:
            continue
        cols = [rb.column(x).to_numpy() for x in ("a", "doc_id", "th", "lo", "n")]
        text = rb.column("s").to_pylist()
        edges = np.append(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, rb.num_rows)
        at = 0
        for z in edges.tolist():
            if held and size >= SHARD and held[-1][0][-1] != cols[0][at]:
                yield work(held)
                held, size = [], 0
            held.append([*(v[at:z] for v in cols), text[at:z]])
            size += sum(map(len, text[at:z]))
            at = z
    if held:
        yield work(held)
    release()


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, lo, n: runs of window starts whose strings also start earlier. docs is prepared()."""
    found = anchored(docs, lambda t: byte_anchors(t, length), False, "suffix-rows")
    needs = found.where(f"k = {NEED}").select("a", "doc_id", "th", "lo", "n")

    def take(batches):
        kind = pa.schema([("a", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("s", pa.binary())])
        for s in slices(batches):
            d, a, lo, n = places(s.column("at"))
            raw = [x.encode() for x in s.column("text").to_pylist()]
            text = [raw[i][p : p + k - 1 + length] for i, p, k in zip(d.tolist(), lo.tolist(), n.tolist(), strict=True)]
            yield batch(kind, a, s.column("doc_id").to_numpy()[d], s.column("th").to_numpy()[d], lo.astype(np.int32), n.astype(np.int32), pa.array(text, pa.binary()))

    rows = with_places(docs, needs, "inner").mapInArrow(take, "a long, doc_id long, th int, lo int, n int, s binary")
    later = cut(rows.repartition("a").sortWithinPartitions("a").mapInArrow(lambda it: _shard_flags(it, length), KIND), "suffix-flags")
    free_shuffles(docs.sparkSession)
    return found.where(f"k = {FLAG}").unionByName(later)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with keep_text the kept bytes."""
    docs = prepared(spread(docs))
    flags = repeats(docs, length).select("a", "doc_id", "th", "lo", "n")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_text else [])])

    def run(batches):
        for s in slices(batches):
            d, _, lo, n = places(s.column("at"))
            raw = [x.encode() for x in s.column("text").to_pylist()]
            order = np.lexsort((lo, d))
            d, lo, hi = d[order], lo[order], (lo + n - 1 + length)[order]
            bound = np.searchsorted(d, np.arange(len(raw) + 1))
            size, removed, spans, sha, kept = [], [], [], [], []
            for i, x in enumerate(raw):
                a, z = bound[i], bound[i + 1]
                out, at, gone, k = [], 0, 0, 0
                if z > a:
                    end = np.maximum.accumulate(hi[a:z])
                    first = np.flatnonzero(np.concatenate([[True], lo[a + 1 : z] > end[:-1]]))
                    last = np.append(first[1:], z - a) - 1
                    for p, q in zip(lo[a:z][first].tolist(), end[last].tolist(), strict=True):
                        out.append(x[at:p])
                        at, gone, k = q, gone + q - p, k + 1
                out.append(x[at:])
                left = b"".join(out)
                size.append(len(x))
                removed.append(gone)
                spans.append(k)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield batch(schema, nullable(s.column("doc_id").to_numpy()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if keep_text else []))

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return with_places(docs, flags, "left").select("doc_id", "text", "at").mapInArrow(run, kind)
