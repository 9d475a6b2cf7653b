"""Integer vectors and exact nearest rows, shared by the operators that train on vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held to this size, so that a squared distance over up to 64 of them fits in 64 bits.
LIMIT = 1 << 27


def integers(vectors: DataFrame, scale: int, vec_col: str, *columns: Column) -> DataFrame:
    """`columns` and v, floor(scale * x) of each component, of rows whose vector is not empty and holds finite numbers only."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where((F.size(vec_col) > 0) & ~F.coalesce(bad, F.lit(False)))
    held = lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return kept.select(*columns, F.transform(x, held).alias("v"))


def rows_of(col: pa.Array, width: int) -> np.ndarray:
    """A list column of `width` numbers a row as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(x: np.ndarray, entries: np.ndarray, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the nearest entry, ties to the lower index, and the squared distance: exact.

    Doubles hold the integers exactly while sums stay under 2**53; larger components are multiplied as 64-bit integers.
    """
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * big * big < 2**53 else np.int64
    e = entries.astype(kind)
    ee = (e * e).sum(1)
    index, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(kind)
        d = ee - 2 * (part @ e.T)
        best = d.argmin(1)
        index[at : at + rows] = best
        dist[at : at + rows] = d[np.arange(len(part)), best] + (part * part).sum(1)
    return index, dist


def digest(rows: np.ndarray) -> str:
    """sha256 of the decimal components in order, joined by commas."""
    return hashlib.sha256(",".join(map(str, rows.ravel().tolist())).encode()).hexdigest()
