"""Column builders for embeddings (arrays of numbers); sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the two has no length."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    size = norm(v)
    return F.transform(_doubles(v), lambda x: F.when(size > 0, x / size).otherwise(x))


def blend(image: Column, text: Column, image_weight: float = 0.7) -> Column:
    """Weighted sum of an image and a text embedding, of unit length."""
    mixed = F.zip_with(_doubles(image), _doubles(text), lambda x, y: image_weight * x + (1 - image_weight) * y)
    return unit(mixed)


def text_vector(text: Column, size: int = 512) -> Column:
    """A vector of unit length from hashes of a text: the same for the same text in every process."""
    part = lambda i: F.xxhash64(i, F.coalesce(text, F.lit(""))) / F.lit(float(1 << 63))
    return unit(F.transform(F.sequence(F.lit(1), F.lit(size)), part))
