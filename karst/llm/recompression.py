"""Substring dedup by recompression: words covered by a window of `length` words that also starts anywhere else are removed.

Each text is a sequence of word names. A round names maximal runs of equal symbols, then pairs: a bit of each name sends it
left or right, and a left symbol before a right one becomes one symbol. Names are hashes of what they stand for, so a round
names alike everywhere without a shuffle, and equal substrings get equal symbols in their interior. With every symbol goes the
range of words that decides it; a window owns the symbols whose range lies inside it. The anchor of a window is the least
hash among the symbols that it owns on the highest level where it owns any (words themselves are level 0, so there is one).

With the anchor go the words that all windows with the anchor at about the same place cover (half a window), so that a
class is not shared by chance. Rows of windows with one anchor are counted by Spark over the whole corpus (karst.llm.windows): shared symbols with equal
contents are repeats at once; classes of unequal contents are verified window by window on 128-bit content hashes.

Edge cases: null and empty texts have no words; a null doc_id comes back as null; rows that repeat doc_id and text are one
document and get equal results; texts with fewer words than `length` keep everything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from karst.llm.arrowtext import Texts, U, batch, mix, powers, slices
from karst.llm.windows import FLAG, KIND, NEED, anchored, classify, combine, hash_of, nullable, places, prepared, with_places
from karst.sources.shared import spread

LENGTH = 35
ROUNDS = 3


class Level:
    """Symbols of one round over a slice: name, first word, and the word range [lo, hi) that decides each."""

    def __init__(self, name, start, lo, hi, doc):
        self.name, self.start, self.lo, self.hi, self.doc = name, start, lo, hi, doc


def _edges(v: Level, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo of the left and hi of the right neighbour; beyond a text's edge, a place outside it."""
    left = np.concatenate([[-1], v.lo[:-1]])
    right = np.concatenate([v.hi[1:], [0]])
    new = np.concatenate([[True], v.doc[1:] != v.doc[:-1]])
    left = np.where(new, bounds[v.doc] - 1, left)
    right = np.where(np.concatenate([new[1:], [True]]), bounds[v.doc + 1] + 1, right)
    return left, right


def name_runs(v: Level, bounds: np.ndarray) -> Level:
    if not len(v.name):
        return v
    first = np.flatnonzero(np.concatenate([[True], (v.name[1:] != v.name[:-1]) | (v.doc[1:] != v.doc[:-1])]))
    size = np.diff(np.append(first, len(v.name)))
    left, right = _edges(v, bounds)
    last = first + size - 1
    name = np.where(size > 1, mix(v.name[first] * U(0xD1342543DE82EF95) + size.astype(np.uint64)), v.name[first])
    return Level(name, v.start[first], left[first], right[last], v.doc[first])


def name_pairs(v: Level, bounds: np.ndarray, turn: int) -> Level:
    if not len(v.name):
        return v
    goes_right = (mix(v.name ^ U(0x2545F4914F6CDD1D + turn)) & U(1)).astype(bool)
    left, right = _edges(v, bounds)
    pair = np.zeros(len(v.name), bool)
    pair[:-1] = ~goes_right[:-1] & goes_right[1:] & (v.doc[1:] == v.doc[:-1])
    second = np.concatenate([[False], pair[:-1]])
    # alone: a left symbol depends on what follows it, a right one on what stands before it
    lo, hi = np.where(goes_right & ~second, left, v.lo), np.where(~goes_right & ~pair, right, v.hi)
    name = v.name.copy()
    p = np.flatnonzero(pair)
    name[p] = mix(v.name[p] * U(0x9FB21C651E98DF25) + v.name[p + 1] * U(0xC2B2AE3D27D4EB4F) + U(turn + 1))
    hi[p] = v.hi[p + 1]
    keep = ~second
    return Level(name[keep], v.start[keep], lo[keep], hi[keep], v.doc[keep])


def levels(h: np.ndarray, wd: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    at = np.arange(len(h))
    out = [Level(h, at, at, at + 1, wd)]
    for r in range(rounds):
        v = out[-1]
        out.append(name_pairs(name_runs(v, bounds) if r == 0 else v, bounds, r))
    return out


def word_prefix(h: np.ndarray) -> np.ndarray:
    pw, _ = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * pw[: len(h)], out=total[1:])
    return total


def word_anchors(t: Texts, length: int = LENGTH, rounds: int = ROUNDS) -> tuple:
    """a, c, text number, lo, n of rows of windows with one anchor."""
    t.split()
    h = t.word_hashes()
    none = np.zeros(0, np.int64)
    m = len(h) - length + 1
    if m <= 0 or not (t.nw >= length).any():
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    p = np.flatnonzero(t.wd[:m] == t.wd[length - 1 :])
    where = np.full(len(p), -1, np.int64)  # first word of the anchor
    name = np.zeros(len(p), np.uint64)
    todo = np.arange(len(p))
    for k, v in reversed(list(enumerate(levels(h, t.wd, t.wc, rounds)))):
        if not len(todo):
            break
        q = p[todo]
        below = np.cumsum(np.bincount(np.clip(v.lo, -1, len(h)) + 1, minlength=len(h) + 2))  # symbols with lo < x: below[x]
        upto = np.cumsum(np.bincount(np.clip(v.hi, 0, len(h) + 1), minlength=len(h) + 2))  # symbols with hi <= x: upto[x]
        f, g = below[q], upto[q + length] - 1
        own = g >= f
        if own.any():
            f, g = f[own], g[own]
            x = (mix(v.name ^ U(0xA24BAED4963EE407 + k)) & ~U(0xFFFFFFFF)) | np.arange(len(v.name), dtype=np.uint64)
            table = [x]
            while 2 << (len(table) - 1) <= int((g - f).max()) + 1:
                s = 1 << (len(table) - 1)
                y = table[-1].copy()
                y[:-s] = np.minimum(table[-1][:-s], table[-1][s:])
                table.append(y)
            depth = np.frexp((g - f + 1).astype(np.float64))[1] - 1
            best = np.empty(len(f), np.uint64)
            for e in range(len(table)):
                i = np.flatnonzero(depth == e)
                best[i] = np.minimum(table[e][f[i]], table[e][g[i] - (1 << e) + 1])
            sym = (best & U(0xFFFFFFFF)).astype(np.int64)
            where[todo[own]] = v.start[sym] * (rounds + 1) + k
            name[todo[own]] = mix(v.name[sym] + U(k))
        todo = todo[~own]
    # windows are told apart further by where the anchor stands in them, in steps of `step` words: those of one step all
    # cover the same `length - step + 1` words, whose hash makes the class as rare as a text of that length
    step = length // 2 + 1
    slot = (where // (rounds + 1) - p) // step
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (slot[1:] != slot[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.append(first[1:], len(p)) - 1
    lo, n = p[first], last - first + 1
    total = word_prefix(h)
    _, ip = powers(len(h) + 1)
    core = where[first] // (rounds + 1) - slot[first] * step
    a = hash_of((total[core + length - step + 1] - total[core]) * ip[core], name[first].view(np.int64), slot[first])
    c = hash_of((total[lo + n - 1 + length] - total[lo]) * ip[lo], n, where[first] // (rounds + 1) - lo)
    d = t.wd[lo]
    return a, c, d, lo - t.wc[d], n


def repeats(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, th, lo, n: runs of window starts whose words also start elsewhere. docs is prepared()."""
    found = anchored(docs, lambda t: word_anchors(t, length, rounds), True, "recompression-rows")
    needs = found.where(f"k = {NEED}").select("a", "doc_id", "th", "lo", "n")

    def windows(batches):
        for s in slices(batches):
            t = Texts(s.column("text"))
            t.split()
            d, _, lo, n = places(s.column("at"))
            h = t.word_hashes()
            one, two = word_prefix(h), word_prefix(mix(h ^ U(0x8EBC6AF09C88C6E3)))
            _, ip = powers(len(h) + 1)
            at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            d = np.repeat(d, n)
            p = at + t.wc[d]
            a, c = (mix((x[p + length] - x[p]) * ip[p]) for x in (one, two))
            yield combine(a, c, s.column("doc_id").to_numpy()[d], s.column("th").to_numpy()[d], at, np.ones(len(at), np.int64), True)

    rows = with_places(docs, needs, "inner").select("doc_id", "th", "text", "at").mapInArrow(windows, KIND)
    single = classify(rows, True, "recompression-windows")
    return found.where(f"k = {FLAG}").unionByName(single.where(f"k = {FLAG}"))


def dedup_windows(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and with keep_text the kept words."""
    docs = prepared(spread(docs))
    flags = repeats(docs, length, rounds).select("a", "doc_id", "th", "lo", "n")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_text else [])])

    def run(batches):
        for s in slices(batches):
            t = Texts(s.column("text"))
            t.split()
            d, _, lo, n = places(s.column("at"))
            delta = np.zeros(len(t.ws) + 1, np.int64)
            np.add.at(delta, lo + t.wc[d], 1)
            np.add.at(delta, lo + t.wc[d] + n - 1 + length, -1)
            keep = np.cumsum(delta[:-1]) == 0
            data = t.buf.tobytes()
            left = np.concatenate([[0], np.cumsum(keep)])
            bound = left[t.wc].tolist()
            ws, we = t.ws[keep].tolist(), t.we[keep].tolist()
            kept = [b" ".join([data[x:y] for x, y in zip(ws[a:z], we[a:z], strict=True)]) for a, z in zip(bound[:-1], bound[1:], strict=True)]
            gone = t.nw - np.diff(left[t.wc])
            yield batch(schema, nullable(s.column("doc_id").to_numpy()), t.nw.astype(np.int64), gone.astype(np.int64), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), *([pa.array(kept, pa.binary())] if keep_text else []))

    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * keep_text
    return with_places(docs, flags, "left").select("doc_id", "text", "at").mapInArrow(run, kind)
