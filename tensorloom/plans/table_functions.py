"""Table functions for SQL: fibers of a tensor and its contraction, a partition for each slice.

    SELECT * FROM csf_fibers(TABLE(SELECT i0, i1, i2 FROM x) PARTITION BY i0 ORDER BY (i1, i2))
    SELECT * FROM ttmc_slices(TABLE(SELECT i0, a, b, v FROM ...) PARTITION BY i0)

Spark partitions and sorts the table argument; the functions take Arrow batches and hold sums or a
run alone. A slice is one task's: where a few hold most of a tensor, use formats.csf and
contract.ttmc with the strategy `salted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from tensorloom.functions.shipping import ship


def _whole(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


@arrow_udtf(returnType="i0 long, i1 long, fiber long, ptr_begin long, ptr_end long")
class CsfFibers:
    """Of a slice (i0, i1, i2, sorted): each fiber's number and the places of its entries, both within the slice."""

    def __init__(self) -> None:
        self.slice, self.fiber, self.number, self.begin, self.seen = None, None, 0, 0, 0

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if not batch.num_rows:
            return
        i1 = _whole(batch, "i1")
        new = np.concatenate([[self.fiber is not None and i1[0] != self.fiber], i1[1:] != i1[:-1]])
        ends = np.flatnonzero(new)
        of = np.where(ends > 0, i1[ends - 1], -1 if self.fiber is None else self.fiber)
        places = self.seen + ends
        if self.slice is None:
            self.slice = int(_whole(batch, "i0")[0])
        if len(ends):
            yield self._rows(of, np.concatenate([[self.begin], places[:-1]]), places)
            self.begin = int(places[-1])
        self.fiber, self.seen = int(i1[-1]), self.seen + len(i1)

    def terminate(self) -> Iterator[pa.Table]:
        if self.fiber is not None:
            yield self._rows(np.array([self.fiber]), np.array([self.begin]), np.array([self.seen]))

    def _rows(self, i1: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
        number = self.number + np.arange(len(i1))
        self.number += len(i1)
        return pa.table({"i0": pa.array(np.full(len(i1), self.slice)), "i1": pa.array(i1), "fiber": pa.array(number), "ptr_begin": pa.array(begin), "ptr_end": pa.array(end)})


@arrow_udtf(returnType="i0 long, r0 long, r1 long, v double")
class TtmcSlices:
    """Of a slice (i0, a, b, v), a and b being the rows of two factors: the sum of v a b' by cell."""

    def __init__(self) -> None:
        self.slice, self.total = None, None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if batch.num_rows:
            at = batch.schema.get_field_index
            a, b = (batch.column(at(c)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in "ab")
            part = (a * batch.column(at("v")).to_numpy(zero_copy_only=False)[:, None]).T @ b
            self.total = part if self.total is None else self.total + part
            self.slice = int(_whole(batch, "i0")[0])
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if self.total is not None:
            r0, r1 = np.indices(self.total.shape)
            yield pa.table({"i0": pa.array(np.full(self.total.size, self.slice)), "r0": pa.array(r0.ravel()), "r1": pa.array(r1.ravel()), "v": pa.array(self.total.ravel())})


def register(spark: SparkSession) -> None:
    """Makes csf_fibers and ttmc_slices known to the session's SQL."""
    ship(spark)
    spark.udtf.register("csf_fibers", CsfFibers)
    spark.udtf.register("ttmc_slices", TtmcSlices)
