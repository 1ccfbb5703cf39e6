"""Coordinate tensors: one row per non-zero, index columns i0, i1, ... (0-based long) and v (double)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def modes(x: DataFrame) -> list[str]:
    """The index columns of x in mode order."""
    return sorted((c for c in x.columns if re.fullmatch(r"i\d+", c)), key=lambda c: int(c[1:]))


def canonical(x: DataFrame) -> DataFrame:
    """One row per coordinate: the values of equal coordinates are summed."""
    return x.groupBy(*modes(x)).agg(F.sum("v").alias("v"))


def from_columns(df: DataFrame, index: Sequence[str | Column], value: str | Column, base: int = 0) -> DataFrame:
    """A canonical tensor from columns of df, whose indices count from base."""
    cols = [(F.col(c) if isinstance(c, str) else c) for c in index]
    v = F.col(value) if isinstance(value, str) else value
    return canonical(df.select(*((c - base).cast("long").alias(f"i{n}") for n, c in enumerate(cols)), v.cast("double").alias("v")))


def nnz(x: DataFrame) -> DataFrame:
    return x.agg(F.count(F.lit(1)).alias("nnz"))


def dims(x: DataFrame) -> DataFrame:
    """One row: the size of each mode as its greatest index and one."""
    return x.agg(*((F.max(c) + 1).alias(f"dim{c[1:]}") for c in modes(x)))


def ndv(x: DataFrame) -> DataFrame:
    """(mode, ndv): how many different indices each mode has, in one pass."""
    wide = x.agg(*(F.count_distinct(c).alias(c) for c in modes(x)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("mode"), F.col(c).alias("ndv")) for n, c in enumerate(modes(x))))).alias("m")).select("m.*")


def mode_order(x: DataFrame) -> list[int]:
    """Modes by their number of different indices, fewest first; ties by mode."""
    return [r["mode"] for r in ndv(x).orderBy("ndv", "mode").collect()]


def shift(x: DataFrame, by: int) -> DataFrame:
    """All indices moved by `by`: from one base to another."""
    return x.select(*((F.col(c) + by).alias(c) for c in modes(x)), "v")


def permute(x: DataFrame, order: Sequence[int]) -> DataFrame:
    """Modes in the given order."""
    return x.select(*(F.col(f"i{m}").alias(f"i{n}") for n, m in enumerate(order)), "v")


def lexicographic(x: DataFrame) -> DataFrame:
    return x.orderBy(*modes(x))


def crop(x: DataFrame, ranges: Mapping[int, tuple[int | None, int | None]], rebase: bool = False) -> DataFrame:
    """The box with low <= index < high for the given modes; with rebase, indices count from low."""
    for m, (low, high) in ranges.items():
        c = F.col(f"i{m}")
        x = x.where(c >= low) if low is not None else x
        x = x.where(c < high) if high is not None else x
        x = x.withColumn(f"i{m}", c - low) if rebase and low else x
    return x


def squash(x: DataFrame, away: Sequence[int]) -> DataFrame:
    """Sums over the given modes; the others keep their order and are numbered anew."""
    left = [c for c in modes(x) if int(c[1:]) not in away]
    summed = x.groupBy(*left).agg(F.sum("v").alias("v"))
    return summed.select(*(F.col(c).alias(f"i{n}") for n, c in enumerate(left)), "v")


def squash_cube(x: DataFrame) -> DataFrame:
    """Sums over every subset of the modes; null stands for a mode that is summed over."""
    return x.cube(*modes(x)).agg(F.sum("v").alias("v"))


def scale(x: DataFrame, by: float) -> DataFrame:
    return x.withColumn("v", F.col("v") * F.lit(float(by)))


def add(x: DataFrame, y: DataFrame) -> DataFrame:
    """The sum of two tensors, by coordinate."""
    return canonical(x.unionByName(y))


def put(x: DataFrame, y: DataFrame) -> DataFrame:
    """x with the entries of y in place of its own at their coordinates."""
    return x.join(y, modes(x), "left_anti").unionByName(y)


def drop_zero(x: DataFrame) -> DataFrame:
    return x.where(F.col("v") != 0)


def norm(x: DataFrame) -> DataFrame:
    """One row: the squared Frobenius norm and the norm."""
    return x.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("norm_sq")).withColumn("norm", F.sqrt("norm_sq"))


def checksum(x: DataFrame) -> DataFrame:
    """One row: the sum of the values."""
    return x.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("checksum"))


def largest_axis(sizes: Sequence[int]) -> int:
    """The mode of the greatest size; ties go to the first."""
    return max(range(len(sizes)), key=lambda m: (sizes[m], -m))


def linear(cols: Sequence[str | Column], sizes: Sequence[int]) -> Column:
    """The row-major number of a coordinate; the last mode runs fastest."""
    out: Column = F.lit(0).cast("long")
    for c, n in zip(cols, sizes, strict=True):
        out = out * n + (F.col(c) if isinstance(c, str) else c)
    return out


def linearise(x: DataFrame, sizes: Sequence[int]) -> DataFrame:
    return x.select(linear(modes(x), sizes).alias("pos"), "v")


def delinearise(x: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(pos, v) back to coordinates."""
    left, cols = F.col("pos"), []
    for n in reversed(sizes):
        cols.insert(0, left % n)
        left = F.floor(left / n) if n > 1 else left
    return x.select(*(c.cast("long").alias(f"i{m}") for m, c in enumerate(cols)), "v")


def unfold(x: DataFrame, mode: int, sizes: Sequence[int]) -> DataFrame:
    """The matricisation (row, col, v): row is the mode's index, col the row-major number of the others."""
    rest = [m for m in range(len(sizes)) if m != mode]
    return x.select(F.col(f"i{mode}").alias("row"), linear([f"i{m}" for m in rest], [sizes[m] for m in rest]).alias("col"), "v")


def densify(x: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """All coordinates of the box, 0 where x has none. One row per cell: for small boxes."""
    total = 1
    for n in sizes:
        total *= n
    grid = delinearise(x.sparkSession.range(total).select(F.col("id").alias("pos"), F.lit(0.0).alias("v")), sizes).drop("v")
    return grid.join(x, modes(x), "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def top(x: DataFrame, k: int) -> DataFrame:
    """The k greatest values; ties go to the lower coordinate."""
    return x.orderBy(F.desc("v"), *modes(x)).limit(k)


def first(x: DataFrame, k: int) -> DataFrame:
    """The first k entries in lexicographic order."""
    return x.orderBy(*modes(x)).limit(k)


def indices(x: DataFrame, mode: int) -> DataFrame:
    """The different indices of a mode."""
    return x.select(F.col(f"i{mode}").alias("idx")).distinct()


def fill(x: DataFrame, value: float | None = None, seed: int = 0) -> DataFrame:
    """Missing values replaced: by value, or by uniform numbers that hang on the coordinate and seed."""
    uniform = F.pmod(F.xxhash64(F.lit(seed), *modes(x)), F.lit(1 << 53)) / float(1 << 53)
    return x.withColumn("v", F.coalesce("v", uniform if value is None else F.lit(float(value))))


def transpose(m: DataFrame) -> DataFrame:
    """A matrix (row, col, v) with rows and columns exchanged."""
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def inside(x: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The entries whose indices lie in the box; malformed ones (nulls) go as well."""
    return x.where(" AND ".join(f"{c} >= 0 AND {c} < {n}" for c, n in zip(modes(x), sizes, strict=True)) + " AND v IS NOT NULL")


def cast_values(x: DataFrame, to: str) -> DataFrame:
    """Values rounded to a type (float, say) and held as double."""
    return x.withColumn("v", F.col("v").cast(to).cast("double"))


def chunks(x: DataFrame, dense: int, size: int) -> DataFrame:
    """Semi-sparse form: one row per coordinate of the other modes, and the dense mode's values as an array."""
    rest = [c for c in modes(x) if c != f"i{dense}"]
    cells = x.groupBy(*rest).agg(F.map_from_entries(F.collect_list(F.struct(f"i{dense}", "v"))).alias("_m"))
    return cells.select(*rest, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.coalesce(F.try_element_at("_m", r.cast("long")), F.lit(0.0))).alias("chunk"))


def unchunk(x: DataFrame, dense: int) -> DataFrame:
    """The semi-sparse form back to coordinates; zeros of a chunk are kept."""
    return x.select(*modes(x), F.posexplode("chunk").alias("_r", "v")).select(*modes(x), F.col("_r").cast("long").alias(f"i{dense}"), "v")
