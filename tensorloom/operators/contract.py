"""Contractions: joins of a tensor's non-zeros with factor matrices, and sums over what they share.

Factors are wide tables (x, u0, ..., u{R-1}), one row per index; matrices are (row, col, v).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .coo import modes

#: Products that a task holds at a time where the cells of an index are one array.
HELD = 1 << 20


def rank(factor: DataFrame) -> int:
    return len(factor.columns) - 1


def wide(long: DataFrame, r: int) -> DataFrame:
    """(row, col, v) as a factor of rank r; absent cells are 0."""
    cells = (F.sum(F.when(F.col("col") == c, F.col("v")).otherwise(0.0)).alias(f"u{c}") for c in range(r))
    return long.groupBy(F.col("row").alias("x")).agg(*cells)


def narrow(factor: DataFrame) -> DataFrame:
    """A factor as (row, col, v)."""
    pairs = F.array(*(F.struct(F.lit(c).cast("long").alias("col"), F.col(f"u{c}").alias("v")) for c in range(rank(factor))))
    return factor.select(F.col("x").alias("row"), F.explode(pairs).alias("p")).select("row", "p.col", "p.v")


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices (row, col, v), sparse or dense."""
    joined = a.select("row", F.col("col").alias("k"), F.col("v").alias("x")).join(b.select(F.col("row").alias("k"), "col", F.col("v").alias("y")), "k")
    return joined.groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def affine(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """a b + c."""
    return gemm(a, b).unionByName(c.select("row", "col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"))


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """A sparse matrix times a factor: (row, u0, ...); the dense side fans nothing out."""
    joined = a.join(b, a["col"] == b["x"])
    return joined.groupBy("row").agg(*(F.sum(F.col("v") * F.col(f"u{c}")).alias(f"u{c}") for c in range(rank(b))))


def ttm(x: DataFrame, factor: DataFrame, mode: int) -> DataFrame:
    """x times a factor along mode: the mode's index becomes the factor's column, 0 to R-1.

    Sums are taken for all columns at once, on one row per fiber, and then laid out one below the other.
    """
    c, rest, r = f"i{mode}", [m for m in modes(x) if m != f"i{mode}"], rank(factor)
    summed = _along(x.withColumnRenamed(c, "x"), factor, rest)
    pairs = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"s{k}").alias("v")) for k in range(r)))
    return summed.select(*rest, F.explode(pairs).alias("p")).select(*(F.col("p.k").alias(m) if m == c else m for m in modes(x)), F.col("p.v").alias("v"))


def _along(x: DataFrame, factor: DataFrame, keep: Sequence[str]) -> DataFrame:
    return x.join(factor, "x").groupBy(*keep).agg(*(F.sum(F.col("v") * F.col(f"u{k}")).alias(f"s{k}") for k in range(rank(factor))))


def ttm_chain(x: DataFrame, factors: Mapping[int, DataFrame], order: Sequence[int] | None = None) -> DataFrame:
    """ttm() along several modes, in the given order (that of factors otherwise)."""
    return reduce(lambda y, m: ttm(y, factors[m], m), order or list(factors), x)


def _columns(names: Sequence[str], ranks: Sequence[int]) -> list[tuple[tuple[int, ...], str]]:
    cells: list[tuple[int, ...]] = [()]
    for r in ranks:
        cells = [(*c, k) for c in cells for k in range(r)]
    return [(c, "_".join([names[0], *map(str, c)])) for c in cells]


def ttmc(x: DataFrame, factors: Mapping[int, DataFrame], keep: int, strategy: str = "fused", order: Sequence[int] | None = None, salt: int = 16, wide: bool = False) -> DataFrame:
    """x times a factor along each mode but `keep`: (i{keep}, r0, r1, ..., v), ranks in mode order.

    With wide, one row for each index: (i{keep}, y0_0, y0_1, ...), a column for each cell of the ranks.

    aao: one join after the other, one sum at the end. fused: after each join the sums over the
    joined mode, so that the next join meets one row per fiber, not per non-zero. salted: fused,
    with the last sums split by a hash of the fiber first, for slices that hold much of the tensor.
    """
    kept, gone = f"i{keep}", list(order or [m for m in sorted(factors, reverse=True) if m != keep])
    ranks = {m: rank(factors[m]) for m in gone}
    if strategy == "aao":
        y = x
        for m in gone:
            y = y.join(factors[m].select(F.col("x").alias(f"i{m}"), *(F.col(f"u{k}").alias(f"u{m}_{k}") for k in range(ranks[m]))), f"i{m}")
        cells = _columns(["s"], [ranks[m] for m in gone])
        y = y.groupBy(kept).agg(*(F.sum(reduce(lambda p, mk: p * F.col(f"u{mk[0]}_{mk[1]}"), zip(gone, c, strict=True), F.col("v"))).alias(n) for c, n in cells))
        return (_wide if wide else _long)(y, kept, gone, cells)
    y, held, ranks_so_far = x, [((), "v")], []
    left = [c for c in modes(x) if c != kept]
    for n, m in enumerate(gone):
        left = [c for c in left if c != f"i{m}"]
        ranks_so_far.append(ranks[m])
        cells = _columns(["s"], ranks_so_far)
        by = {c: name for c, name in held}
        joined = y.join(factors[m].withColumnRenamed("x", f"i{m}"), f"i{m}")
        sums = [F.sum(F.col(by[c[:-1]]) * F.col(f"u{c[-1]}")).alias(name) for c, name in cells]
        if strategy == "salted" and n == len(gone) - 1:
            part = joined.groupBy(kept, F.pmod(F.xxhash64(f"i{m}"), F.lit(salt)).alias("salt")).agg(*sums)
            y = part.groupBy(kept).agg(*(F.sum(name).alias(name) for _, name in cells))
        else:
            y = joined.groupBy(kept, *left).agg(*sums)
        held = cells
    return (_wide if wide else _long)(y, kept, gone, held)


def ttmc_rows(x: DataFrame, factors: Mapping[int, DataFrame], keep: int, strategy: str = "fused", salt: int = 16) -> DataFrame:
    """(i{keep}, y): ttmc() with one row for each index, whose cells are one array, ranks in mode order.

    For ranks whose product is large: a column for each cell would be too many for generated code.
    After each join, rows are dealt by what they keep, sorted, and summed run by run, so a task holds
    one array and a bounded block of products, however long the slice. salted: slices are dealt by
    a hash of the last fiber, too, and the parts of a slice are added up.
    """
    ship(x.sparkSession)
    kept, gone = f"i{keep}", [m for m in sorted(factors, reverse=True) if m != keep]
    left = [c for c in modes(x) if c != kept]
    y = x.withColumn("y", F.array("v")).drop("v")
    for m in gone:
        left = [c for c in left if c != f"i{m}"]
        cells = factors[m].select(F.col("x").alias(f"i{m}"), F.array(*(F.col(f"u{k}").cast("double") for k in range(rank(factors[m])))).alias("u"))
        joined, by = y.join(cells, f"i{m}"), [kept, *left]
        if strategy == "salted" and m == gone[-1]:
            parts = _run_sums(joined.withColumn("salt", F.pmod(F.xxhash64(f"i{m}"), F.lit(salt))), [*by, "salt"])
            y = _run_sums(parts.withColumn("u", F.array(F.lit(1.0))), by)
        else:
            y = _run_sums(joined, by)
    return y


def _run_sums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y): the sums of the outer products of u and y, two arrays of a row, over rows that agree in by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .linalg import block

        def made(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            ends = pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32())
            return pa.RecordBatch.from_arrays([*(pa.array(keys[:, k]) for k in range(len(by))), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=[*by, "y"])

        last = None  # the run that may go on
        for b in batches:
            if not b.num_rows:
                continue
            step = max(1, HELD // max(1, len(b.column(len(by))[0]) * len(b.column(len(by) + 1)[0])))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                keys = np.column_stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(by))])
                u, y = block([part.column(len(by))]), block([part.column(len(by) + 1)])
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
                sums = np.add.reduceat((u[:, :, None] * y[:, None, :]).reshape(len(u), -1), first, axis=0)
                keys = keys[first]
                if last is not None:
                    if (last[0] == keys[0]).all():
                        sums[0] += last[1][0]
                    else:
                        yield made(*last)
                if len(keys) > 1:
                    yield made(keys[:-1], sums[:-1])
                last = keys[-1:], sums[-1:]
        if last is not None:
            yield made(*last)

    dealt = df.select(*(F.col(c).cast("long").alias(c) for c in by), "u", "y").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, ", ".join([*(f"{c} long" for c in by), "y array<double>"]))


def _wide(y: DataFrame, kept: str, gone: Sequence[int], cells: list[tuple[tuple[int, ...], str]]) -> DataFrame:
    """The columns of sums, named and ordered by their ranks in mode order."""
    at = sorted(range(len(gone)), key=lambda n: gone[n])
    named = sorted((tuple(c[n] for n in at), name) for c, name in cells)
    return y.select(kept, *(F.col(name).alias("y" + "_".join(map(str, c))) for c, name in named))


def _long(y: DataFrame, kept: str, gone: Sequence[int], cells: list[tuple[tuple[int, ...], str]]) -> DataFrame:
    """The columns of sums as rows, ranks in mode order."""
    at = sorted(range(len(gone)), key=lambda n: gone[n])
    pairs = F.array(*(F.struct(*(F.lit(c[n]).cast("long").alias(f"r{k}") for k, n in enumerate(at)), F.col(name).alias("v")) for c, name in cells))
    return y.select(kept, F.explode(pairs).alias("p")).select(kept, *(f"p.r{k}" for k in range(len(gone))), "p.v")


def mttkrp(x: DataFrame, factors: Mapping[int, DataFrame], keep: int, strategy: str = "fused", order: Sequence[int] | None = None) -> DataFrame:
    """x times the Khatri-Rao product of all factors but that of mode keep: (i{keep}, r, v)."""
    kept, gone = f"i{keep}", list(order or [m for m in sorted(factors, reverse=True) if m != keep])
    r = rank(factors[gone[0]])
    y, left = x.select(*modes(x), *(F.col("v").alias(f"s{k}") for k in range(r))), [c for c in modes(x) if c != kept]
    for m in gone:
        y = y.join(factors[m].withColumnRenamed("x", f"i{m}"), f"i{m}")
        products = [(F.col(f"s{k}") * F.col(f"u{k}")).alias(f"s{k}") for k in range(r)]
        left = [c for c in left if c != f"i{m}"]
        if strategy == "fused" or m == gone[-1]:
            y = y.groupBy(kept, *left).agg(*(F.sum(F.col(f"s{k}") * F.col(f"u{k}")).alias(f"s{k}") for k in range(r)))
        else:
            y = y.select(kept, *left, *products)
    pairs = F.array(*(F.struct(F.lit(k).cast("long").alias("r"), F.col(f"s{k}").alias("v")) for k in range(r)))
    return y.select(kept, F.explode(pairs).alias("p")).select(kept, "p.r", "p.v")
