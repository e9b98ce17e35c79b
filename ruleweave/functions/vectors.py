"""Vector functions as columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; 0 for empty or zero vectors, null vectors, or unequal lengths."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / norm))).otherwise(0.0)


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(v)) for v in values)) if len(values) else F.array().cast("array<double>")


def cosine_of(a: Sequence[float], b: Sequence[float]) -> float:
    """The same in Python, in single precision."""
    x, y = np.asarray(a, np.float32), np.asarray(b, np.float32)
    if x.size == 0 or x.size != y.size:
        return 0.0
    norm = np.linalg.norm(x) * np.linalg.norm(y)
    return float(np.clip(np.dot(x, y) / norm, -1, 1)) if norm > 0 else 0.0


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64.0
