"""Whole-number vectors for the operators that cluster or encode embeddings exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x). Beyond LARGEST a squared distance of 64 components might not fit a long.
SCALE, LARGEST = 1024, 1 << 27
#: Up to this size products and their sums are exact in double precision, in whatever order they are added.
_EXACT = 1 << 22


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def whole(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length, a row each; x is taken as double."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(values * SCALE)
    if len(out) and np.abs(out).max() > LARGEST:
        raise OverflowError(f"a component of {values[np.abs(out).argmax()]} is too large: squared distances would not fit a long")
    return out.astype(np.int64).reshape(len(column), -1)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of whole-number rows, points by entries."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if most * most * points.shape[1] < _EXACT * _EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (e * e).sum(1)[None, :] - 2 * (p @ e.T)).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], axis=1)


def narrow(rows: np.ndarray) -> bytes:
    """Rows of whole numbers in the narrowest of two, four or eight bytes; the first byte says which."""
    most = np.abs(rows).max(initial=0)
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + rows.astype(f"<i{size}").tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    """What narrow() took, as rows of `width` long integers."""
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, width)


def sums(partial: DataFrame, keys: list[str], width: int) -> list:
    """Rows of keys, n and the componentwise sum s of partial tables of the same columns, added up by Spark."""
    added = [F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)]
    rows = partial.groupBy(*keys).agg(F.sum("n").alias("n"), *added).collect()  # one row for each entry of a codebook
    return [(*(r[k] for k in keys), r["n"], np.array([r[f"s{k}"] for k in range(width)], np.int64)) for r in rows]
