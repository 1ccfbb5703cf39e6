"""Singular values and vectors of long, wide and sparse matrices.

Three ways. By the Gram matrix of the shorter side, where neighbouring eigenvalues can be told apart
(linalg.resolved). By TSQR, a QR decomposition in each task and a tree over their triangles, which
never squares the condition number. By block power iteration where both sides are long: two joins
a step and no Gram matrix at all. Only matrices of the shorter side, or of the wanted rank, reach
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.factors import extended, normal
from tensorloom.functions.shipping import ship
from tensorloom.functions.tables import dealt, small, written

from . import linalg
from .contract import spmm
from .coo import transpose, unfold

#: Triangles that one task of the tree puts together.
FAN = 8
#: Directions whose singular value is below this share of the greatest count as absent.
ABSENT = 1e-13


@dataclass
class Svd:
    """u (x, u0, ...) and sigma, falling; v is a matrix (one row per column) or, by power iteration, a factor like u."""

    u: DataFrame
    sigma: np.ndarray
    v: np.ndarray | DataFrame
    way: str


def triangle(y: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """R of Y = QR for a table with one row per row of Y: a QR for each task, then FAN triangles at a time.

    columns are numbers, or one array of them. Raises if R has more than linalg.GRAM_CELLS cells.
    """
    ship(y.sparkSession)
    names = ["part", "i", "r"]

    def rows(r: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), part)), pa.array(np.arange(len(r))), pa.array(list(r), pa.list_(pa.float64()))], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            m = linalg.block(b.columns)
            for at in range(0, len(m), step := max(256, 2 * m.shape[1])):
                part = m[at : at + step]
                r = np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
        if r is not None:
            yield rows(r, TaskContext.get().partitionId())

    def joined(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("i", "ascending")]).combine_chunks()
        return pa.Table.from_batches([rows(np.linalg.qr(linalg.block([t.column("r").chunk(0)]), mode="r"), key[0].as_py())])

    schema = "part long, i long, r array<double>"
    tree = written(y.select(*columns).mapInArrow(local, schema), "triangles")
    left = len(tree.inputFiles())
    while left > 1:
        left = math.ceil(left / FAN)
        tree = tree.groupBy(F.pmod("part", F.lit(left)).alias("to")).applyInArrow(joined, schema)
    top = tree.orderBy("i").collect()
    width = len(top[0]["r"]) if top else (len(columns) if len(columns) > 1 else 0)
    if width * width > linalg.GRAM_CELLS:
        raise ValueError(f"a triangle of {width} columns is too large for the driver")
    return np.array([r["r"] for r in top]).reshape(len(top), width)


def tall(y: DataFrame, columns: Sequence[str], r: int, row: str = "x", complete: bool = False) -> Svd:
    """The top r of Y by TSQR. u's columns are made orthonormal once more where rounding has bent them.

    Directions without weight get zero columns or, with complete, columns that are orthonormal to the
    others; those need as many rows.
    """
    triangular = triangle(y, columns)
    if not triangular.size:
        return Svd(linalg.project(y, columns, np.zeros((triangular.shape[1], 0)), row), np.zeros(0), np.zeros((triangular.shape[1], 0)), "tsqr")
    _, sigma, vt = np.linalg.svd(triangular, full_matrices=False)
    sigma, v = sigma[:r], signed(vt[:r].T)
    held = int((sigma > ABSENT * max(sigma[0], 1e-300)).sum())
    u = linalg.project(y, columns, v[:, :held] / sigma[:held], row)
    if held:
        u = written(u, "left-vectors")
        bent = triangle(u, u.columns[1:])
        if np.abs(bent.T @ bent - np.eye(held)).max() > 1e-12:
            u = linalg.project(u, u.columns[1:], np.linalg.inv(bent) * np.sign(np.diag(bent)))
    return Svd(_filled(u, held, len(sigma), complete), sigma, v, "tsqr")


def _filled(u: DataFrame, held: int, r: int, complete: bool) -> DataFrame:
    """u with columns for the directions from held to r."""
    if held == r:
        return u
    if complete and held:
        return extended(u, r - held)
    return u.withColumns({f"u{k}": F.lit(0.0) for k in range(held, r)})


def signed(v: np.ndarray) -> np.ndarray:
    """v with the largest component of each column positive."""
    if not v.size:
        return v
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign)


def singular(y: DataFrame, columns: Sequence[str], r: int, row: str = "x", complete: bool = False, width: int | None = None) -> Svd:
    """The top r of Y, one row per row of Y: by the Gram matrix of its columns if that tells the eigenvalues apart, else by TSQR.

    columns are numbers, or one array of `width` of them.
    """
    n = width or len(columns)
    g, rows = linalg.counted_gram(y, columns, width)
    values, vectors = linalg.top_eigen(g, min(r + 1, n))
    if not linalg.resolved(values, rows, n, float(np.trace(g))):
        return tall(y, columns, r, row, complete)
    values, vectors = values[:r], vectors[:, :r]
    sigma = np.sqrt(np.maximum(values, 0))
    held = int((values > 1e-12 * max(values.max(initial=0), 1e-300)).sum())
    u = linalg.project(y, columns, vectors[:, :held] / sigma[:held], row)
    return Svd(_filled(u, held, len(sigma), complete), sigma, vectors, "gram")


def iterated(m: DataFrame, r: int, extra: int = 8, steps: int = 40, tolerance: float = 1e-12, seed: int = 42) -> Svd:
    """The top r of a sparse matrix (row, col, v) whose both sides may be long, by block power iteration.

    A step multiplies a block of r + extra columns by the matrix and by its transpose, two joins, and
    makes it orthonormal by TSQR. The block starts as normal numbers by column. Rayleigh-Ritz turns
    the last block into singular vectors. Steps end when no wanted value changes by more than
    tolerance times the greatest. The matrix is dealt once, by its longer side, and a small block of
    the other side comes by broadcast, so that a step shuffles sums alone. Rows and columns without entries are absent from u and v.
    """
    spark = m.sparkSession
    m = written(m.select("row", "col", "v"), "iterated-matrix")
    right = written(m.select(F.col("col").alias("x")).distinct(), "iterated-columns")
    rows, cols = m.select("row").distinct().count(), right.count()
    k = min(r + extra, rows, cols)
    if not k:
        return Svd(spark.createDataFrame([], "x long"), np.zeros(0), spark.createDataFrame([], "x long"), "power")
    m = dealt(m, "row" if rows >= cols else "col", "iterated-matrix")
    back = transpose(m)

    def near(block: DataFrame, n: int) -> DataFrame:
        return small(block, n) if n == min(rows, cols) else block

    names = [f"u{c}" for c in range(k)]
    q = _orthonormal(right.select("x", *(normal(F.col("x"), c, seed).alias(f"u{c}") for c in range(k))), names)
    known = np.zeros(min(r, k))
    for _ in range(steps):
        z = written(spmm(m, near(q, cols)).withColumnRenamed("row", "x"), "iterated-left")
        ours = triangle(z, names)
        sigma = np.linalg.svd(ours, compute_uv=False)[: len(known)]
        done = np.abs(sigma - known).max() <= tolerance * max(sigma[0], 1e-300)
        known = sigma
        if done:
            break
        q = _orthonormal(spmm(back, near(z, rows)).withColumnRenamed("row", "x"), names)
    _, sigma, vt = np.linalg.svd(ours)
    turn, sigma = signed(vt[: len(known)].T), sigma[: len(known)]
    held = int((sigma > ABSENT * max(sigma[0], 1e-300)).sum())
    u = linalg.project(z, names, turn[:, :held] / sigma[:held])
    return Svd(_filled(u, held, len(sigma), False), sigma, linalg.project(q, names, turn), "power")


def _orthonormal(y: DataFrame, names: Sequence[str]) -> DataFrame:
    """Y R^-1, twice where R is ill conditioned, so that its columns are orthonormal; directions without weight become zero."""
    for _ in range(2):
        y = written(y, "iterated-block")
        left, sigma, vt = np.linalg.svd(triangle(y, names), full_matrices=False)
        held = sigma > ABSENT * max(sigma[0], 1e-300)
        y = linalg.project(y, names, (vt.T * np.where(held, 1 / np.maximum(sigma, 1e-300), 0)) @ left.T)
        if sigma[0] < 1e4 * sigma[-1]:
            break
    return y


def left_vectors(m: DataFrame, rows: int, cols: int, r: int, complete: bool = True, cells: int | None = None) -> Svd:
    """The top r left singular vectors of a sparse matrix (row, col, v) of rows x cols, by what its sizes allow.

    A side whose Gram matrix has `cells` cells at most (linalg.GRAM_CELLS) is the short one. Rows
    short: their Gram matrix, by outer products over column keys; if it can't tell the eigenvalues
    apart, TSQR over the columns as rows. Columns short: singular() of the rows. Both long: iterated().
    """
    cells, r = cells or linalg.GRAM_CELLS, min(r, rows, cols)
    spark = m.sparkSession
    if rows <= cols and rows * rows <= cells:
        m = written(m.select("row", "col", "v"), "left-matrix")
        g = linalg.local(linalg.gram_self_join(transpose(m)), rows)
        values, vectors = linalg.top_eigen(g, min(r + 1, rows))
        way, sigma, u = "gram", np.sqrt(np.maximum(values[:r], 0)), vectors[:, :r]
        if not linalg.resolved(values, rows, cols, float(np.trace(g))):
            triangular = triangle(_dense(transpose(m), rows), ["y"])
            _, sigma, vt = np.linalg.svd(triangular if triangular.size else np.zeros((1, rows)), full_matrices=True)
            sigma = np.concatenate([sigma, np.zeros(max(0, r - len(sigma)))])[:r]
            way, u = "tsqr", signed(vt[:r].T)
        if not complete:
            u = u * (sigma > ABSENT * max(sigma.max(initial=0), 1e-300))
        table = spark.createDataFrame([(x, *map(float, u[x])) for x in range(rows)], ", ".join(["x long", *(f"u{k} double" for k in range(r))]))
        return Svd(table, sigma, np.zeros((0, r)), way)
    if cols * cols <= cells:
        return singular(written(_dense(m, cols), "left-rows"), ["y"], r, complete=complete, width=cols)
    return iterated(m, r)


def power_sums(m: DataFrame, rows: int, cols: int, cells: int | None = None) -> tuple[float, float]:
    """The sums of the second and fourth powers of all singular values of a sparse matrix (row, col, v).

    From the values, where a side's Gram matrix has `cells` cells at most (linalg.GRAM_CELLS). Beyond
    that all values would need a dense decomposition of both sides, but their power sums don't: they
    are the trace and the squared norm of M M', whose cells stay in a table.
    """
    cells = cells or linalg.GRAM_CELLS
    if min(rows, cols) ** 2 <= cells:
        s = left_vectors(m, rows, cols, min(rows, cols), cells=cells).sigma
        return float((s**2).sum()), float((s**4).sum())
    g = linalg.gram_self_join(transpose(m), both=False)
    v, diagonal = F.col("v"), F.col("row") == F.col("col")
    found = g.agg(F.sum(F.when(diagonal, v)), F.sum(F.when(diagonal, v * v).otherwise(2 * v * v))).first()
    return float(found[0] or 0), float(found[1] or 0)


def _dense(m: DataFrame, cols: int) -> DataFrame:
    """(x, y) of a matrix whose rows, `cols` long, fit a task: y is a row's array."""
    entries = m.groupBy(F.col("row").alias("x")).agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("e"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))
    return entries.select("x", F.transform(at, lambda c: F.coalesce(F.try_element_at("e", c), F.lit(0.0))).alias("y"))


def nvecs(x: DataFrame, dims: Sequence[int], mode: int, r: int, complete: bool = True) -> Svd:
    """The first r left singular vectors of a tensor's unfolding along a mode."""
    rest = math.prod(d for m, d in enumerate(dims) if m != mode)
    return left_vectors(unfold(x, mode, dims), dims[mode], rest, r, complete)
