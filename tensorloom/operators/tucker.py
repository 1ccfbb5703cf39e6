"""Tucker decompositions: alternating steps that are Spark jobs, around rank-sized solves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.factors import orthonormal
from tensorloom.functions.tables import SMALL, dealt, small, written

from .contract import rank, ttm_chain, ttmc, ttmc_rows
from .coo import linear, modes
from .linalg import GRAM_CELLS, gram, local, ridge_rows
from .svd import Svd, left_vectors, singular

#: Cells of the other ranks that are columns, each with its own sum; more of them are one array.
COLUMNS = 64
#: Cells of a core that the driver takes.
MOST_CELLS = 1 << 22


@dataclass
class Tucker:
    """Factors (x, u0, ...), the core as an array, and the fit after each sweep."""

    factors: list[DataFrame]
    core: np.ndarray
    fits: list[float] = field(default_factory=list)


def _spread(y: DataFrame, kept: str, ranks: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """(kept, r0, .., v) with one column per cell of the ranks."""
    cells = list(np.ndindex(*ranks))
    names = ["y" + "_".join(map(str, c)) for c in cells]
    at = reduce(lambda n, kr: n * ranks[kr] + F.col(f"r{kr}"), range(len(ranks)), F.lit(0))
    return y.groupBy(F.col(kept).alias("x")).agg(*(F.sum(F.when(at == n, F.col("v")).otherwise(0.0)).alias(name) for n, name in enumerate(names))), names


def core(x: DataFrame, factors: Sequence[DataFrame], strategy: str = "fused") -> DataFrame:
    """(r0, r1, ..., v): x times the transposed factors along all modes, one mode after the other."""
    n = len(factors)
    y = ttmc(x, dict(enumerate(factors)), 0, strategy)
    joined = y.join(factors[0].withColumnRenamed("x", "i0"), "i0")
    rest = [f"r{k}" for k in range(n - 1)]
    sums = joined.groupBy(*rest).agg(*(F.sum(F.col("v") * F.col(f"u{k}")).alias(f"g{k}") for k in range(rank(factors[0]))))
    pairs = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"g{k}").alias("v")) for k in range(rank(factors[0]))))
    return sums.select(*rest, F.explode(pairs).alias("p")).select(F.col("p.k").alias("r0"), *(F.col(f"r{k}").alias(f"r{k + 1}") for k in range(n - 1)), "p.v")


def core_array(g: DataFrame, ranks: Sequence[int]) -> np.ndarray:
    """A core table as an array; it has one cell per combination of ranks, MOST_CELLS at most."""
    if math.prod(ranks) > MOST_CELLS:
        raise ValueError(f"a core of {math.prod(ranks)} cells doesn't fit the driver")
    out = np.zeros(ranks)
    for row in g.collect():
        out[tuple(row[f"r{k}"] for k in range(len(ranks)))] = row["v"]
    return out


def fit_of_core(norm_sq: float, core_sq: float) -> float:
    """The share of the norm that orthonormal factors explain."""
    return 1 - math.sqrt(max(0.0, norm_sq - core_sq)) / math.sqrt(norm_sq) if norm_sq else 1.0


def _longest(dims: Sequence[int]) -> int:
    """The longest mode, by which x is dealt: joins with its factor, and sums by it, leave x in its place."""
    return max(range(len(dims)), key=lambda m: dims[m])


def _hinted(factors: Sequence[DataFrame], dims: Sequence[int]) -> list[DataFrame]:
    """The factors, those of all but the longest mode to be broadcast where they are small."""
    return [f if m == _longest(dims) else small(f, dims[m]) for m, f in enumerate(factors)]


def _order(factors: Sequence[DataFrame], dims: Sequence[int], mode: int) -> list[int]:
    """The other modes, the longest last, so that sums before its join stay in their buckets."""
    return sorted((m for m in range(len(factors)) if m != mode), key=lambda m: (m == _longest(dims), dims[m]))


def _projected(x: DataFrame, factors: Sequence[DataFrame], dims: Sequence[int], mode: int, strategy: str, columns: int) -> tuple[DataFrame, list[str], int]:
    """x times all factors but that of mode, a row for each index, its columns and cells; `chain` takes one factor after the other."""
    rest = [m for m in range(len(factors)) if m != mode]
    ranks = [rank(factors[m]) for m in rest]
    width = math.prod(ranks)
    if width > columns:
        return ttmc_rows(x, dict(enumerate(factors)), mode, strategy).withColumnRenamed(f"i{mode}", "x"), ["y"], width
    order, hinted = _order(factors, dims, mode), _hinted(factors, dims)
    if strategy != "chain":
        # Where all joins are in place, sums between them would only fill memory.
        near = all(m == _longest(dims) or dims[m] * len(factors[m].columns) <= SMALL for m in rest)
        y = ttmc(x, dict(enumerate(hinted)), mode, "aao" if near and strategy == "fused" else strategy, order, wide=True).withColumnRenamed(f"i{mode}", "x")
        return y, y.columns[1:], width
    y = ttm_chain(x, {m: hinted[m] for m in rest}, order)
    return *_spread(y.select(f"i{mode}", *(F.col(f"i{m}").alias(f"r{k}") for k, m in enumerate(rest)), "v"), f"i{mode}", ranks), width


def _update(x: DataFrame, factors: Sequence[DataFrame], dims: Sequence[int], ranks: Sequence[int], mode: int, strategy: str, cells: int, columns: int) -> Svd:
    """A mode's new factor and singular values; where the other ranks are many, from entries, without a Gram matrix of theirs."""
    others = [rank(factors[m]) for m in range(len(factors)) if m != mode]
    if math.prod(others) ** 2 > cells:
        y = ttmc(x, dict(enumerate(factors)), mode, "fused" if strategy == "chain" else strategy)
        entries = y.select(F.col(f"i{mode}").alias("row"), linear([F.col(f"r{k}") for k in range(len(others))], others).alias("col"), "v")
        return left_vectors(entries, dims[mode], math.prod(others), ranks[mode], complete=False, cells=cells)
    y, names, width = _projected(x, factors, dims, mode, strategy, columns)
    return singular(written(y, "tucker-y"), names, min(ranks[mode], width), width=width)


def _core_of(found: Svd, factors: Sequence[DataFrame], mode: int) -> np.ndarray | None:
    """The core, if the last update's right vectors are at hand: U'Y is S V', so the tensor isn't read again."""
    others = [rank(f) for m, f in enumerate(factors) if m != mode]
    if not isinstance(found.v, np.ndarray) or found.v.shape[0] != math.prod(others):
        return None
    weight = np.where(found.sigma > 1e-6 * found.sigma.max(initial=0), found.sigma, 0) if found.way == "gram" else found.sigma
    return np.moveaxis((found.v * weight).T.reshape(len(weight), *others), 0, mode)


def _fitting(start: Sequence[DataFrame], n: int) -> None:
    if len(start) != n:
        raise ValueError(f"{len(start)} factors to start from, for {n} modes")


def hooi(x: DataFrame, dims: Sequence[int], ranks: Sequence[int], sweeps: int = 25, tolerance: float = 1e-5, seed: int = 42, strategy: str = "fused", order: Sequence[int] | None = None, cells: int = GRAM_CELLS, start: Sequence[DataFrame] | None = None, columns: int = COLUMNS) -> Tucker:
    """Higher-order orthogonal iteration; modes are updated from the last to the first, or in `order`.

    The first factors are random orthonormal ones, or `start`: those of an earlier model, say. They
    give the ranks then, and needn't be orthonormal, as each is replaced before a fit is taken.

    Each update takes the top left singular vectors of the tensor times all other factors. The
    sweeps end when the fit changes by less than tolerance. Rows without non-zeros are absent from
    the factors, as they would be zero. Ranks are cut to the sizes of the modes and to what the
    other ranks allow. Where the squared product of the other ranks is over `cells`, the update
    takes the shorter side's Gram matrix, or none at all (svd.left_vectors); where they are over
    `columns`, the cells of an index are one array (contract.ttmc_rows). x is dealt once, by its
    longest mode; small factors of the others come by broadcast.
    """
    spark, n = x.sparkSession, len(dims)
    if start is not None:
        _fitting(start, n)
        ranks = [rank(f) for f in start]
    ranks = [min(r, d) for r, d in zip(ranks, dims, strict=True)]
    # A chain holds the sums of many fibers in a task, so its buckets are smaller.
    x = dealt(x.select(*modes(x), "v"), f"i{_longest(dims)}", "tucker-x", 1 if strategy == "chain" else 4)
    norm_sq = x.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    factors = list(start) if start is not None else [orthonormal(spark, d, r, seed + m) for m, (d, r) in enumerate(zip(dims, ranks, strict=True))]
    out = Tucker(factors, np.zeros(ranks))
    order = list(order or range(n - 1, -1, -1))
    for _ in range(sweeps):
        for mode in order:
            found = _update(x, factors, dims, ranks, mode, strategy, cells, columns)
            factors[mode] = written(found.u, "tucker-factor")
        core_sq = float((found.sigma**2).sum())
        out.fits.append(fit_of_core(norm_sq, core_sq))
        if len(out.fits) > 1 and abs(out.fits[-1] - out.fits[-2]) < tolerance:
            break
    known = _core_of(found, factors, order[-1]) if sweeps else None
    out.core = core_array(core(x, factors), [rank(f) for f in factors]) if known is None else known
    return out


def hooi_chain(x: DataFrame, dims: Sequence[int], ranks: Sequence[int], sweeps: int = 50, tolerance: float = 1e-5, seed: int = 42, order: Sequence[int] | None = None, start: Sequence[DataFrame] | None = None) -> Tucker:
    """hooi() in ascending mode order, with the tensor times the factors one at a time (a chain of ttm)."""
    return hooi(x, dims, ranks, sweeps, tolerance, seed, "chain", order or range(len(dims)), start=start)


def deltas(x: DataFrame, factors: Sequence[DataFrame], core_: np.ndarray, mode: int) -> DataFrame:
    """x with d0..: for each non-zero the core times the other factors' rows, by column of the mode.

    The core has one cell per combination of ranks, so it is a part of the expressions.
    """
    n = core_.ndim
    rest = [m for m in range(n) if m != mode]
    y = x
    for m in rest:
        y = y.join(factors[m].select(F.col("x").alias(f"i{m}"), *(F.col(f"u{k}").alias(f"u{m}_{k}") for k in range(core_.shape[m]))), f"i{m}")

    def cell(at: tuple[int, ...]):
        return reduce(lambda p, m: p * F.col(f"u{m}_{at[m]}"), rest, F.lit(float(core_[at])))

    sums = []
    for r in range(core_.shape[mode]):
        terms = [cell(at) for at in np.ndindex(*core_.shape) if at[mode] == r and core_[at]]
        sums.append(reduce(lambda p, q: p + q, terms, F.lit(0.0)).alias(f"d{r}"))
    return y.select(*modes(x), "v", *sums)


def reconstruct(x: DataFrame, factors: Sequence[DataFrame], core_: np.ndarray) -> DataFrame:
    """x with vhat, the model's value at each stored coordinate."""
    y = deltas(x, factors, core_, 0).join(factors[0].withColumnRenamed("x", "i0"), "i0")
    return y.select(*modes(x), "v", reduce(lambda p, r: p + F.col(f"d{r}") * F.col(f"u{r}"), range(core_.shape[0]), F.lit(0.0)).alias("vhat"))


def normal_equations(x: DataFrame, factors: Sequence[DataFrame], core_: np.ndarray, mode: int) -> tuple[DataFrame, DataFrame]:
    """(i, r1, r2, b) and (i, r, c): the sums of d d' and of v d for each index of the mode."""
    d, r = deltas(x, factors, core_, mode), core_.shape[mode]
    i = F.col(f"i{mode}").alias("i")
    b = d.groupBy(i).agg(*(F.sum(F.col(f"d{p}") * F.col(f"d{q}")).alias(f"b{p}_{q}") for p in range(r) for q in range(r)))
    c = d.groupBy(i).agg(*(F.sum(F.col(f"d{p}") * F.col("v")).alias(f"c{p}") for p in range(r)))
    lay = lambda df, cells: df.select("i", F.explode(F.array(*cells)).alias("p")).select("i", "p.*")
    long = lambda k: F.lit(k).cast("long")
    return lay(b, [F.struct(long(p).alias("r1"), long(q).alias("r2"), F.col(f"b{p}_{q}").alias("b")) for p in range(r) for q in range(r)]), lay(c, [F.struct(long(p).alias("r"), F.col(f"c{p}").alias("c")) for p in range(r)])


def model_norm_sq(factors: Sequence[DataFrame], core_: np.ndarray) -> float:
    """The squared norm of the whole model: the core against the core times the factors' Gram matrices."""
    y = core_
    for m, f in enumerate(factors):
        g = local(gram(f, f.columns[1:]), rank(f))
        y = np.moveaxis(np.tensordot(g, y, (1, m)), 0, m)
    return float((core_ * y).sum())


def fits(x: DataFrame, factors: Sequence[DataFrame], core_: np.ndarray) -> tuple[float, float]:
    """(observed, full): over stored coordinates alone, and over all, absent ones being 0."""
    row = reconstruct(x, factors, core_).agg(F.sum(F.col("v") ** 2).alias("xx"), F.sum((F.col("v") - F.col("vhat")) ** 2).alias("err"), F.sum(F.col("v") * F.col("vhat")).alias("cross")).first()
    xx = row["xx"] or 0.0
    if not xx:
        return 1.0, 1.0
    full = max(0.0, xx + model_norm_sq(factors, core_) - 2 * row["cross"])
    return 1 - math.sqrt(row["err"]) / math.sqrt(xx), 1 - math.sqrt(full) / math.sqrt(xx)


def als(x: DataFrame, dims: Sequence[int], r: int, sweeps: int = 50, tolerance: float = 1e-5, penalty: float = 1e-4, seed: int = 42, start: Sequence[DataFrame] | None = None, core_: np.ndarray | None = None) -> Tucker:
    """Row-wise ridge regression of the factors on the stored entries, under a fixed core.

    The core is random, or `core_`; the first factors are random orthonormal ones, or `start`. fits has the observed fit after each sweep. Rows without entries stay as they began, at 0 from
    the first update on. x is dealt as in hooi().
    """
    spark, n = x.sparkSession, len(dims)
    x = dealt(x.select(*modes(x), "v"), f"i{_longest(dims)}", "als-x")
    if start is not None:
        _fitting(start, n)
    factors = list(start) if start is not None else [orthonormal(spark, d, min(r, d), seed + 1 + m) for m, d in enumerate(dims)]
    if core_ is None:
        core_ = np.random.RandomState(seed).uniform(size=(r,) * n)[tuple(slice(0, min(r, d)) for d in dims)]
    if core_.shape != tuple(rank(f) for f in factors):
        raise ValueError(f"a core of {core_.shape} for factors of ranks {[rank(f) for f in factors]}")
    out = Tucker(factors, core_)
    for _ in range(sweeps):
        for mode in range(n):
            solved = ridge_rows(deltas(x, _hinted(factors, dims), core_, mode), core_.shape[mode], penalty, f"i{mode}")
            factors[mode] = written(solved, "als-factor")
        row = reconstruct(x, _hinted(factors, dims), core_).agg(F.sum(F.col("v") ** 2).alias("xx"), F.sum((F.col("v") - F.col("vhat")) ** 2).alias("err")).first()
        out.fits.append(1 - math.sqrt((row["err"] or 0.0) / row["xx"]) if row["xx"] else 1.0)
        if len(out.fits) > 1 and abs(out.fits[-1] - out.fits[-2]) <= tolerance:
            break
    return out


def refreshed_core(x: DataFrame, factors: Sequence[DataFrame]) -> np.ndarray:
    """x times all transposed factors, as an array."""
    return core_array(core(x, factors), [rank(f) for f in factors])
