"""Vector expressions and the deterministic hash embedder used without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a zero vector gives 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def l2_normalize(vec: Column) -> Column:
    """Unit-length vector; a zero vector is returned as it is."""
    norm = F.sqrt(_dot(vec, vec))
    return F.when(norm > 0, F.transform(vec, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(vec, lambda x: x.cast("double"))
    )


def hash_embedder(dims: int = 1024) -> Callable[[], Embedder]:
    """Embedder factory: SHA-256 bytes repeated to ``dims``, scaled to unit length."""

    def build() -> Embedder:
        def embed(texts: Sequence[str]) -> np.ndarray:
            digests = b"".join(hashlib.sha256(t.encode("utf-8")).digest() for t in texts)
            rows = np.frombuffer(digests, dtype=np.uint8).reshape(len(texts), 32) / 255.0
            wide = np.tile(rows, (1, -(-dims // 32)))[:, :dims]
            norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
            return np.divide(wide, norms, out=wide.copy(), where=norms > 0)

        return embed

    return build
