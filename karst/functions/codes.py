"""Scalar functions as column expressions: codes, vectors, paths, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image file name extensions, fixed values.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def digest(content: str | Column) -> Column:
    """Lower-case hex SHA-256 of bytes or text."""
    return F.sha2(F.col(content).cast("binary") if isinstance(content, str) else content.cast("binary"), 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column) -> Column:
    """Booleans, most significant first, to a 64-bit code."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def sign_code(vector: str) -> Column:
    """Bit i (from the most significant) is 1 where element i is positive."""
    return pack_bits(F.transform(F.col(vector), lambda x: x > 0))


def chunks(code: Column, n: int, bits: int = 64) -> Column:
    """n near-equal slices of a code, least significant first: structs (pos, value). The first bits mod n get one more bit."""
    out, shift = [], 0
    for i in range(n):
        w = bits // n + (i < bits % n)
        mask = (1 << w) - 1 if w < 64 else -1
        out.append(F.struct(F.lit(i).alias("pos"), F.shiftrightunsigned(code, shift).bitwiseAND(F.lit(mask).cast("long")).alias("value") if w else F.lit(0).cast("long").alias("value")))
        shift += w
    return F.array(*out)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$")


def infer_split(path: Column, splits: list[str], exact_component: bool = False) -> Column:
    """The first split whose name occurs in the lower-cased path (or, on demand, is a whole component of it); else null."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(None).cast("string")
    for s in reversed(splits):
        hit = F.array_contains(F.split(p, "/"), s) if exact_component else F.contains(p, F.lit(s))
        out = F.when(hit, F.lit(s)).otherwise(out)
    return out


def fraction(x: Column, y: Column) -> Column:
    return F.when(y == 0, F.lit(0.0)).otherwise(F.round(x / y, 4))


def tie_key(path: Column) -> Column:
    """Ascending order of this key makes the smallest path win, but a longer path before its own prefix."""
    return F.concat(path, F.lit("\U0010ffff"))
