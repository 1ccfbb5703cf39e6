"""What the operators on vectors share: reading list columns as matrices, and whole-number components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Whole-number components reach from -LARGEST to LARGEST, so that squared distances of 64 of them fit 64 bits.
LARGEST = 1 << 27


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold exactly `width` components, none null or non-finite; and these rows as doubles."""
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    fit = np.flatnonzero(lengths == width)
    begins = np.cumsum(lengths) - lengths
    rows = flat[begins[fit][:, None] + np.arange(width)]
    finite = np.isfinite(rows).all(1)
    ok = np.zeros(len(column), bool)
    ok[fit[finite]] = True
    return ok, rows[finite]


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def integers(df: DataFrame, vector: str, width: int, scale: float, name: str) -> DataFrame:
    """The rows of df whose vector matrix() takes, as a written table; its components become floor(scale * x).

    Components beyond LARGEST raise: their distances would not fit 64 bits.
    """
    others = [c for c in df.columns if c != vector]

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = matrix(b.column(len(others)), width)
            x = np.floor(scale * x)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST / scale} don't fit")
            yield pa.RecordBatch.from_arrays([*(b.column(k).filter(pa.array(ok)) for k in range(len(others))), lists(x.astype(np.int32), pa.int32())], names=[*others, vector])

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes if c != vector)
    return written(df.select(*others, vector).mapInArrow(floors, f"{schema}, {vector} array<int>"), name)


def first_rows(df: DataFrame, order: list, vector: str, n: int) -> np.ndarray:
    """The vectors of the first n rows in an order; ties go by the vectors themselves."""
    return np.array([r[0] for r in df.orderBy(*order, F.col(vector)).limit(n).select(vector).collect()], np.int64)
