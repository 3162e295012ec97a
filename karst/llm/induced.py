"""Suffix arrays by external induced sorting.

The text is cut at its leftmost-S suffixes. Their substrings are sorted by one round of induction and named; if names repeat,
the reduced text of names is ordered by doubling its ranks up to `depth` bytes; a second round of induction then orders all
suffixes. Induction takes suffixes in order from a priority queue keyed by first character and order of arrival and puts each
one's predecessor back: since keys of a character arrive in order, the queue is one sequence for each character, whole runs of
which are taken, mapped and distributed at once. Sequences beyond `memory` entries are appended to a file and mapped back, so
the text and the queues can exceed memory (give the text as a memory map).

Ties beyond `depth` bytes are left in arbitrary order: suffixes that agree that far are neighbours, which is all dedup needs.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

import numpy as np

from karst.llm.arrowtext import TABLE, U, mix, powers

MEMORY = 8 << 20


class BucketQueue:
    """First-in-first-out sequences of positions by character; the oldest spill to one file when memory is full."""

    def __init__(self, n: int, folder: str, memory: int = MEMORY):
        self.items: list[list] = [[] for _ in range(n)]
        self.held, self.memory, self.folder, self.file, self.path = 0, memory, folder, None, None

    def push(self, keys: np.ndarray, positions: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for a, z in zip(edge.tolist(), np.append(edge[1:], len(keys)).tolist(), strict=True):
            self.items[keys[a]].append(positions[a:z])
        self.held += len(keys)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            fd, self.path = tempfile.mkstemp(dir=self.folder)
            self.file = os.fdopen(fd, "wb")
        for q in self.items:
            for i, x in enumerate(q):
                if not isinstance(x, tuple):
                    q[i] = (self.file.tell(), len(x))
                    self.file.write(x.astype(np.int64).tobytes())
        self.file.flush()
        self.held = 0

    def pop(self, key: int) -> np.ndarray | None:
        q = self.items[key]
        if not q:
            return None
        x = q.pop(0)
        if isinstance(x, tuple):
            return np.fromfile(self.path, np.int64, x[1], offset=x[0])
        self.held -= len(x)
        return x

    def close(self) -> None:
        if self.file:
            self.file.close()
            with contextlib.suppress(OSError):
                os.remove(self.path)


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor (S); the last position counts as S before an end that is larger than nothing."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    s = np.zeros(n, bool)
    nxt = np.searchsorted(differs, np.arange(n))
    ok = nxt < len(differs)
    d = differs[nxt[ok]]
    s[ok] = t[d] < t[d + 1]
    return s  # a final run of equal characters is L: the end is the smallest


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int, folder: str, memory: int) -> np.ndarray:
    """All suffixes in induced order, given leftmost-S suffixes in order."""
    n = len(t)
    lq, sq = BucketQueue(sigma, folder, memory), BucketQueue(sigma, folder, memory)
    starts = BucketQueue(sigma, folder, memory)
    starts.push(t[lms].astype(np.int64), lms)
    if not s[n - 1]:
        lq.push(t[n - 1 :].astype(np.int64), np.array([n - 1]))
    large: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma):
        for q in (lq, starts):
            while (x := q.pop(c)) is not None:
                if q is lq:
                    large[c].append(x)
                p = x[x > 0] - 1
                p = p[~s[p]]
                lq.push(t[p].astype(np.int64), p)
    small: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma - 1, -1, -1):
        while (x := sq.pop(c)) is not None:
            small[c].append(x)
            p = x[x > 0] - 1
            p = p[s[p]]
            sq.push(t[p].astype(np.int64), p)
        for x in reversed(large[c]):
            x = x[::-1]
            p = x[x > 0] - 1
            p = p[s[p]]
            sq.push(t[p].astype(np.int64), p)
    for q in (lq, sq, starts):
        q.close()
    parts = []
    for c in range(sigma):
        parts += large[c]
        parts += [x[::-1] for x in reversed(small[c])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def suffix_array(t: np.ndarray, depth: int, folder: str | None = None, memory: int = MEMORY) -> np.ndarray:
    """Positions of t (small unsigned integers) in the order of their suffixes, exact up to `depth` characters."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    sigma = int(t.max()) + 1
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    with tempfile.TemporaryDirectory(dir=folder) as own:
        if len(lms) > 1:
            first = _induce(t, s, lms, sigma, own, memory)
            is_lms = np.zeros(n, bool)
            is_lms[lms] = True
            order = first[is_lms[first]]
            stop = np.append(lms[1:] + 1, n)
            pw, ip = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(TABLE[t] * pw[:n], out=total[1:])
            h = mix((total[stop] - total[lms]) * ip[lms] + (stop - lms).astype(np.uint64))
            at = np.searchsorted(lms, order)
            hs = h[at]
            name = np.empty(len(lms), np.int64)
            name[at] = np.cumsum(np.concatenate([[0], (hs[1:] != hs[:-1]).astype(np.int64)]))
            lms = lms[_order_names(name, depth)] if name[at[-1]] + 1 < len(lms) else order
        return _induce(t, s, lms, sigma, own, memory)


def _order_names(rank: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of names, each of two characters or more, up to `depth` characters."""
    h, n = 1, len(rank)
    while True:
        nxt = np.full(n, 0, np.int64)
        nxt[: n - h] = rank[h:] + 1 if h < n else 0
        key = (rank << 32) | nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
        h *= 2
        if h * 2 > depth + 2 or rank[order[-1]] + 1 == n or h >= n:
            return order
