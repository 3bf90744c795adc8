"""Vectors as arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, let


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def unit(a: Column | str, floor: float = 1e-8) -> Column:
    """The vector over its length, which counts as `floor` at least."""
    # Computed once: within the transform alone, the length would be taken anew for each value.
    return let(col(a), lambda v: let(F.greatest(norm(v), F.lit(floor)), lambda size: F.transform(v, lambda x: x / size)))


def bucket(token: Column | str, dim: int) -> Column:
    """The MD5 of a token as a number modulo dim, a piece of eight hexadecimal digits at a time."""
    digest, out = F.md5(F.encode(col(token), "UTF-8")), F.lit(0).cast("long")
    for i in range(4):
        out = (out * (2**32 % dim) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % dim
    return out


class HashEmbedder:
    """Counts of hashed tokens over their length: deterministic, and needs no model."""

    batch = 512

    def __init__(self, dim: int = 256):
        self.dim, self.model = dim, f"hash-{dim}"

    def embed(self, texts: list[str | None]) -> list[list[float]]:
        """Each distinct token of the texts is hashed once."""
        split = [(text or "").lower().split() for text in texts]
        tokens = pd.Series([x for words in split for x in words], dtype=object)
        codes, distinct = pd.factorize(tokens)
        buckets = np.array([int(hashlib.md5(x.encode()).hexdigest(), 16) % self.dim for x in distinct], dtype=np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        counts = np.bincount(rows * self.dim + buckets[codes], minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64) if len(codes) else np.zeros((len(texts), self.dim))
        sizes = np.linalg.norm(counts, axis=1, keepdims=True)
        return (counts / np.where(sizes == 0, 1, sizes)).tolist()

    def column(self, text: Column | str) -> Column:
        """Vectors of a text column, an Arrow batch at a time."""
        return embedded(self, text)


def embedded(embedder, text: Column | str) -> Column:
    """Vectors from anything with embed(); a batch holds 64 texts, or as many as its `batch` says."""
    size = getattr(embedder, "batch", 64)

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        texts = [x or "" for x in s]
        return pd.Series([v for at in range(0, len(texts), size) for v in embedder.embed(texts[at : at + size])])

    return run(col(text))
