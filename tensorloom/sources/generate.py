"""Synthetic tensors, made by the executors and the same for the same seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.coo import canonical


def _u(seed: int, *cols: Column | str) -> Column:
    """Uniform in (0, 1), from the columns and the seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)


def _count(mean: float, cv: float, most: int, seed: int, *cols: Column | str) -> Column:
    """A count from 1 to most about mean: normal, or log-normal where a normal one would reach below 0."""
    z = F.sqrt(-2 * F.ln(_u(seed, *cols))) * F.cos(2 * 3.141592653589793 * _u(seed + 1, *cols))
    sd = mean * cv
    if mean - 3 * sd > 0:
        drawn = mean + sd * z
    else:
        s2 = F.ln(F.lit(1 + cv * cv))
        drawn = F.exp(F.ln(F.lit(float(mean))) - s2 / 2 + F.sqrt(s2) * z)
    return F.greatest(F.lit(1), F.least(F.lit(most), F.round(drawn))).cast("int")


def sparse_tensor(spark: SparkSession, dims: Sequence[int], density: float = 1e-3, slice_density: float = 1.0, fiber_density: float = 0.01, cv_fibers: float = 0.5, cv_nnz: float = 0.5, seed: int = 1) -> DataFrame:
    """A tensor of about the asked density, with the asked spread of fibers per slice and non-zeros per fiber.

    Slices (i0) are kept with probability slice_density. A slice draws its number of fibers, a
    fiber that of its non-zeros; indices are drawn with replacement and equal ones dropped, so that
    somewhat fewer non-zeros are reached than asked for (`requested` against a count of the rows).
    Values are 0.1 to 1 in steps of 0.1. The last mode is that within fibers.
    """
    middle = dims[1:-1]
    fibers_max = 1
    for d in middle:
        fibers_max *= d
    per_slice = max(1.0, fiber_density * fibers_max / max(slice_density, 1e-12))
    total = density * dims[0] * fibers_max * dims[-1]
    per_fiber = max(1.0, total / max(1.0, dims[0] * slice_density * per_slice))
    x = spark.range(dims[0]).select(F.col("id").alias("i0")).where(_u(seed, "i0") <= slice_density)
    x = x.withColumn("n", _count(per_slice, cv_fibers, fibers_max, seed + 10, "i0"))
    x = x.select("i0", F.explode(F.sequence(F.lit(1), "n")).alias("f")).select("i0", F.floor(_u(seed + 20, "i0", "f") * fibers_max).alias("fiber")).distinct()
    x = x.withColumn("n", _count(per_fiber, cv_nnz, dims[-1], seed + 30, "i0", "fiber"))
    x = x.select("i0", "fiber", F.explode(F.sequence(F.lit(1), "n")).alias("f")).select("i0", "fiber", F.floor(_u(seed + 40, "i0", "fiber", "f") * dims[-1]).alias("last")).distinct()
    left, cols = F.col("fiber"), []
    for d in reversed(middle):
        cols.insert(0, left % d)
        left = F.floor(left / d)
    value = (F.floor(_u(seed + 50, "i0", "fiber", "last") * 9) + 1) / 10
    return x.select("i0", *(c.cast("long").alias(f"i{k + 1}") for k, c in enumerate(cols)), F.col("last").cast("long").alias(f"i{len(dims) - 1}"), value.alias("v"))


def gaussian_tensor(spark: SparkSession, dims: Sequence[int], rates: Sequence[float], seed: int = 1) -> DataFrame:
    """Normal values where every mode's index is kept with its rate; rates of 1 give a dense tensor."""
    x = spark.range(1).select()
    for k, (d, p) in enumerate(zip(dims, rates, strict=True)):
        own = spark.range(d).select(F.col("id").alias(f"i{k}")).where(_u(seed + k, "id") <= p)
        x = own if k == 0 else x.join(own)  # the grid is the result
    cols = [f"i{k}" for k in range(len(dims))]
    return x.select(*cols, (F.sqrt(-2 * F.ln(_u(seed + 60, *cols))) * F.cos(2 * 3.141592653589793 * _u(seed + 61, *cols))).alias("v"))


def resampled(x: DataFrame, like: Sequence[int], seed: int = 1) -> DataFrame:
    """x with each index moved to a random place of its mode: the same counts, another pattern."""
    cols = [f"i{k}" for k in range(len(like))]
    return canonical(x.select(*(F.floor(_u(seed + k, c) * d).cast("long").alias(c) for k, (c, d) in enumerate(zip(cols, like, strict=True))), "v"))
