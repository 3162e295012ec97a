"""Perceptual hashes of decoded images, as numpy kernels in one pass over Spark's image rows.

Grey = the usual luma weights; resizing averages areas; the transforms are a type-II DCT (phash), horizontal gradients (dhash),
the mean (ahash) and repeated Haar averaging (whash). Codes pack the boolean grid row by row, most significant bit first.
Bits are not promised to equal those of other libraries: equal images are at distance 0, similar ones near.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[..., 0] if channels == 1 else x[..., 2] * 0.299 + x[..., 1] * 0.587 + x[..., 0] * 0.114  # rows are BGR


def shrink(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area averages on an h by w grid."""

    def weights(n, m):
        edge = np.linspace(0, n, m + 1)
        lo, hi = edge[:-1, None], edge[1:, None]
        at = np.arange(n)[None]
        return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) * (m / n)

    return weights(x.shape[0], h) @ x @ weights(x.shape[1], w).T


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None] + 1) / (2 * n))


def phash(x, n):
    m = _dct(4 * n)
    low = (m @ shrink(x, 4 * n, 4 * n) @ m.T)[:n, :n]
    return low > np.median(low)


def dhash(x, n):
    s = shrink(x, n, n + 1)
    return s[:, 1:] > s[:, :-1]


def ahash(x, n):
    s = shrink(x, n, n)
    return s > s.mean()


def whash(x, n):
    if n & (n - 1):
        raise ValueError("whash needs a power of two")
    s = shrink(x, 8 * n, 8 * n)
    s = s - s.mean()
    while len(s) > n:
        s = (s[0::2, 0::2] + s[1::2, 0::2] + s[0::2, 1::2] + s[1::2, 1::2]) / 4
    return s > np.median(s)


ALGORITHMS = {"phash": phash, "dhash": dhash, "ahash": ahash, "whash": whash}


def pack(bits: np.ndarray) -> int:
    raw = np.packbits(bits.reshape(-1)).tobytes()
    return int.from_bytes(raw, "big", signed=True) if len(raw) == 8 else int.from_bytes(raw, "big")


def hash_images(images: DataFrame, algos: list[str], hash_size: int = 8) -> DataFrame:
    """item_id, algo, code of every image row (the image source's struct); rows that were not decoded give none."""
    if bad := [a for a in algos if a not in ALGORITHMS]:
        raise ValueError(f"unknown hash algorithms {bad}")
    if hash_size > 8:
        raise ValueError("codes are 64-bit: hash_size must be at most 8")
    schema = pa.schema([("item_id", pa.string()), ("algo", pa.string()), ("code", pa.int64())])

    def run(batches):
        for rb in batches:
            out = []
            for r in rb.column("image").to_pylist():
                if r and r["height"] > 0 and r["data"]:
                    x = grey(r["data"], r["height"], r["width"], r["nChannels"])
                    out += [(r["origin"], a, pack(ALGORITHMS[a](x, hash_size))) for a in algos]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return images.select("image").mapInArrow(run, "item_id string, algo string, code long")
