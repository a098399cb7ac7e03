"""Vector expressions. Sums run in double from the left, so a row's result never depends on its partition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size != 0, size))


def normalised(a: Column | str) -> Column:
    """Unit length in double; a zero vector stays zero."""
    return F.transform(_col(a), lambda x: x.cast("double") / F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a)))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def pack(vector: Sequence[float]) -> bytes:
    """The unit vector as little-endian half precision: how vectors are stored in two bytes a dimension."""
    v = np.asarray(vector, np.float64)
    if v.ndim != 1 or not v.size:
        raise ValueError("a vector has one dimension and at least one number")
    if not np.isfinite(v).all():
        raise ValueError("a vector has finite numbers")
    size = np.sqrt((v * v).sum())
    return (v / size if size else v).astype("<f2").tobytes()


def unpack(blobs: Sequence[bytes], dims: int | None = None) -> np.ndarray:
    """Rows of single precision; all blobs must have one width, dims if given."""
    widths = {len(b) for b in blobs}
    if len(widths) > 1 or any(w % 2 or not w for w in widths) or (dims is not None and widths and widths != {2 * dims}):
        raise ValueError(f"vectors of {sorted(widths)} bytes")
    return np.frombuffer(b"".join(blobs), "<f2").reshape(len(blobs), -1).astype(np.float32) if blobs else np.zeros((0, dims or 0), np.float32)


@F.pandas_udf(T.BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else pack(v))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else unpack([b])[0])
