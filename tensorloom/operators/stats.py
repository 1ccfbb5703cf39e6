"""Statistics of fibers, slices and blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.runs import runs
from tensorloom.functions.tables import ordinals, written

from .coo import modes
from .formats import block_id

#: Numbers of the bins of slices by non-zeros and fibers, with their upper bounds (fixed values); bins 1 to 4 are part of bin 0, and the last is open.
SLICE_BINS = {0: 1025, 5: 2049, 6: 4097, 7: 8193, 8: 16385, 9: None}


def fiber_stats(x: DataFrame) -> DataFrame:
    """One row: slices, fibers, and the fewest, most and mean non-zeros of a fiber."""
    fibers = x.groupBy(*modes(x)[:-1]).agg(F.count(F.lit(1)).alias("n"))
    slices = fibers.groupBy("i0").agg(F.count(F.lit(1)).alias("f"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("s"))
    return slices.agg(F.count(F.lit(1)).alias("slices"), F.sum("f").alias("fibers"), F.min("lo").alias("min_nnz"), F.max("hi").alias("max_nnz"), (F.sum("s") / F.sum("f")).alias("avg_nnz"))


def slice_nnz(x: DataFrame) -> DataFrame:
    """(i0, nnz, fibers) of each slice; fibers are counted on pre-aggregated rows."""
    fibers = x.groupBy(*modes(x)[:-1]).agg(F.count(F.lit(1)).alias("n"))
    return fibers.groupBy("i0").agg(F.sum("n").alias("nnz"), F.count(F.lit(1)).alias("fibers"))


def slice_bins(x: DataFrame, bins: Mapping[int, int | None] = SLICE_BINS) -> DataFrame:
    """(bin, slices, nnz): slices by nnz + fibers; a bin has what lies below its bound and not below the one before."""
    n = F.col("nnz") + F.col("fibers")
    *closed, last = bins
    number = reduce(lambda other, k: F.when(n < bins[k], k).otherwise(other), reversed(closed), F.lit(last))
    return slice_nnz(x).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("slices"), F.sum("nnz").alias("nnz"))


def imbalance(x: DataFrame) -> DataFrame:
    """(what, mean, sd, cv, imbalance) of fibers per slice and of non-zeros per fiber; imbalance is max / mean - 1."""
    fibers = x.groupBy(*modes(x)[:-1]).agg(F.count(F.lit(1)).alias("n"))
    slices = fibers.groupBy("i0").agg(F.count(F.lit(1)).alias("n"))

    def of(df: DataFrame, what: str) -> DataFrame:
        row = df.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.max("n").alias("most"))
        return row.select(F.lit(what).alias("what"), "mean", "sd", (F.col("sd") / F.col("mean")).alias("cv"), (F.col("most") / F.col("mean") - 1).alias("imbalance"))

    return of(slices, "fibers_per_slice").unionByName(of(fibers, "nnz_per_fiber"))


def density(x: DataFrame, dims: Sequence[int]) -> DataFrame:
    cells = 1.0
    for n in dims:
        cells *= n
    return x.agg((F.count(F.lit(1)) / F.lit(cells)).alias("density"))


def block_histogram(x: DataFrame, dims: Sequence[int], size: Sequence[int]) -> DataFrame:
    """(block, nnz) of the blocks that have any; explicit zeros don't count."""
    return x.where("v <> 0").groupBy(block_id(x, dims, size).alias("block")).agg(F.count(F.lit(1)).alias("nnz"))


def block_summary(x: DataFrame, dims: Sequence[int], size: Sequence[int]) -> DataFrame:
    """One row: blocks of the grid, empty ones, and the most non-zeros in one."""
    total = 1
    for d, s in zip(dims, size, strict=True):
        total *= -(-d // s)
    return block_histogram(x, dims, size).agg(F.lit(total).cast("long").alias("blocks"), (F.lit(total) - F.count(F.lit(1))).cast("long").alias("empty"), F.max("nnz").alias("max_nnz"))


def fiber_runs(x: DataFrame, fibers: int, long_fiber: int) -> DataFrame:
    """(i0, run, fibers, nnz): the short fibers of a slice in runs of `fibers`, and each of more than long_fiber non-zeros by itself, numbered down from -1.

    Places come from range parts, so a slice may have any number of fibers.
    """
    cols = modes(x)
    per = written(x.groupBy(*cols[:-1]).agg(F.count(F.lit(1)).alias("n")).withColumn("long", (F.col("n") > long_fiber).cast("long")), "fiber-counts")
    placed = runs(per, ["i0", "long", *cols[1:-1]], (), [2])
    run = F.when(F.col("long") == 1, -1 - F.col("place2")).otherwise(F.floor(F.col("place2") / fibers)).cast("long")
    return placed.groupBy("i0", run.alias("run")).agg(F.count(F.lit(1)).alias("fibers"), F.sum("n").alias("nnz"))


def blocks_by_size(x: DataFrame, dims: Sequence[int], size: Sequence[int]) -> DataFrame:
    """(block, nnz, place): the blocks that have any entries, largest first; equal ones by number. Explicit zeros are entries."""
    counts = x.groupBy(block_id(x, dims, size).alias("block")).agg(F.count(F.lit(1)).alias("nnz"))
    return ordinals(counts, [F.desc("nnz"), F.col("block")], "place")
