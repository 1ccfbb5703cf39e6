"""Factor matrices as tables (x, u0, ..., u{R-1})."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def closed_form(spark: SparkSession, n: int, r: int, cell: Callable[[Column, int], Column]) -> DataFrame:
    """n rows whose cells are given by an expression of the row's number."""
    return spark.range(n).select(F.col("id").alias("x"), *(cell(F.col("id"), k).cast("double").alias(f"u{k}") for k in range(r)))


def modular(spark: SparkSession, n: int, r: int, a: int, b: int, m: int) -> DataFrame:
    """Cells (a x + b r) mod m: exact in double, and the same in any engine."""
    return closed_form(spark, n, r, lambda x, k: (x * a + b * k) % m)


def identity(spark: SparkSession, n: int) -> DataFrame:
    """The identity as (row, col, v)."""
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("v"))


def _uniform(x: Column, k: int, seed: int) -> Column:
    """A number in (0, 1) that hangs on row, column and seed alone."""
    return (F.pmod(F.xxhash64(x, F.lit(k), F.lit(seed)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)


def uniform(spark: SparkSession, n: int, r: int, seed: int = 42) -> DataFrame:
    return closed_form(spark, n, r, lambda x, k: _uniform(x, k, seed))


def normal(x: Column, k: int, seed: int) -> Column:
    """A standard normal number that hangs on row, column and seed alone, by the Box-Muller transform."""
    return F.sqrt(-2 * F.ln(_uniform(x, 2 * k, seed))) * F.cos(2 * np.pi * _uniform(x, 2 * k + 1, seed))


def gaussian(spark: SparkSession, n: int, r: int, seed: int = 42) -> DataFrame:
    """Standard normal cells."""
    return closed_form(spark, n, r, lambda x, k: normal(x, k, seed))


def orthonormal(spark: SparkSession, n: int, r: int, seed: int = 42) -> DataFrame:
    """A random factor with orthonormal columns: normal cells, times the inverse of their Gram matrix's root."""
    from tensorloom.operators.linalg import gram, local, project

    raw, names = gaussian(spark, n, r, seed), [f"u{k}" for k in range(r)]
    half = np.linalg.cholesky(local(gram(raw, names), r) + 1e-12 * np.eye(r))
    return project(raw, names, np.linalg.inv(half).T)


def extended(factor: DataFrame, extra: int, seed: int = 42) -> DataFrame:
    """factor with extra columns that are orthonormal among themselves and to the ones there.

    The new columns start as normal cells under column numbers that the factor's own makers don't
    use with the same seed. Where what the factor leaves of them is singular, they are drawn again.
    """
    from tensorloom.operators.linalg import gram, local, project

    spark, r = factor.sparkSession, len(factor.columns) - 1
    names, rows = [f"u{k}" for k in range(r + extra)], int(factor.agg(F.max("x")).first()[0]) + 1
    for draw in range(seed, seed + 4):
        new = closed_form(spark, rows, extra, lambda x, k: normal(x, r + k, draw))  # noqa: B023
        both = factor.join(new.toDF("x", *names[r:]), "x")
        g = local(gram(both, names), r + extra)
        old = np.linalg.pinv(g[:r, :r]) @ g[:r, r:]
        free = g[r:, r:] - g[r:, :r] @ old
        if np.linalg.eigvalsh(free)[0] > 1e-9 * max(1.0, np.trace(g[r:, r:])):
            break
    else:
        raise ValueError(f"{extra} more columns don't fit beside {r} in {rows} rows")
    out = np.linalg.inv(np.linalg.cholesky(free)).T
    turn = np.zeros((r + extra, r + extra))
    turn[:r, :r], turn[:r, r:], turn[r:, r:] = np.eye(r), -old @ out, out
    return project(both, names, turn)
