"""Compressed formats as tables: fiber trees (CSF), CSR, split fibers, tiles and blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tensorloom.functions.runs import runs
from tensorloom.functions.tables import ordinals, written

from .coo import canonical, linear, modes


def csf(x: DataFrame, top: int = 0) -> list[DataFrame]:
    """The fiber tree of x in its mode order, one table per level, from level top on.

    Level l has (pos, idx, ptr_begin, ptr_end): a node's place among the prefixes of l + 1 indices,
    its own index, and the places of its children; the last level has (pos, idx, v). Coordinates
    are summed first. All levels' places come from one sort and one written table (see runs()); a
    level sums up its nodes, whose rows stand together, so little of it is shuffled.
    """
    cols = modes(x)
    n = len(cols)
    placed = runs(canonical(x), cols, range(top + 1, n + 1))
    levels = [placed.select(F.col(f"run{n}").alias("pos"), F.col(cols[-1]).alias("idx"), "v")]
    for k in range(n - 1, top, -1):
        nodes = placed.groupBy(F.col(f"run{k}").alias("pos"), F.col(cols[k - 1]).alias("idx"))
        levels.insert(0, nodes.agg(F.min(f"run{k + 1}").alias("ptr_begin"), (F.max(f"run{k + 1}") + 1).alias("ptr_end")))
    return levels


def csf_pointers(levels: Sequence[DataFrame], level: int) -> DataFrame:
    """The pointer array of a level below the root as (pos, ptr), with the closing one; level 0 has 0 and the number of roots."""
    if level == 0:
        ends = levels[0].agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("ptr")), F.struct(F.lit(1).cast("long").alias("pos"), F.col("n").alias("ptr")))).alias("p"))
        return ends.select("p.*")
    above = levels[level - 1]
    last = above.agg((F.max("pos") + 1).alias("pos"), F.max("ptr_end").alias("ptr")).where("pos is not null")
    return above.select("pos", F.col("ptr_begin").alias("ptr")).unionByName(last)


def from_csf(levels: Sequence[DataFrame]) -> DataFrame:
    """The coordinates of a fiber tree; children find their parents through the pointers' ranges.

    A node becomes as many rows as it has children, which Spark's size estimates don't see: they
    would have the children of a short level broadcast. So both sides are sorted.
    """
    n = len(levels)
    x = levels[0].select(F.col("idx").alias("i0"), *(["ptr_begin", "ptr_end"] if n > 1 else ["v"]))
    for k in range(1, n):
        below = levels[k].select(F.col("pos").alias("_at"), F.col("idx").alias(f"i{k}"), *(["ptr_begin", "ptr_end"] if k < n - 1 else ["v"]))
        children = x.withColumn("_at", F.explode(F.sequence("ptr_begin", F.col("ptr_end") - 1))).drop("ptr_begin", "ptr_end")
        x = children.hint("merge").join(below.hint("merge"), "_at").drop("_at")
    return x


def csr(m: DataFrame, rows: int) -> DataFrame:
    """(row, ptr) of a matrix (row, col, v), for 0 to rows: empty rows repeat the pointer before them."""
    counts = m.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    grid = m.sparkSession.range(rows + 1).select(F.col("id").alias("row")).join(counts, "row", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("part", F.floor(F.col("row") / max(4096, math.isqrt(rows))))
    parts = grid.groupBy("part").agg(F.sum("n").alias("t")).select("part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per part
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return grid.withColumn("inside", inside).join(parts, "part").select("row", (F.col("before") + F.col("inside")).cast("long").alias("ptr"))


def split_fibers(x: DataFrame, threshold: int) -> DataFrame:
    """x with part: fibers (all modes but the last) cut after every threshold non-zeros.

    Places within fibers come from range parts, so a fiber may be longer than a task's share.
    """
    cols = modes(x)
    at = len(cols) - 1
    placed = runs(x.select(*cols, "v"), cols, (), [at])
    return placed.select(*cols, "v", F.floor(F.col(f"place{at}") / threshold).cast("long").alias("part"))


def balanced(x: DataFrame, fiber: int = 128, slice_: int = 512) -> DataFrame:
    """(i0, slice_part, fibers, nnz): slices cut into runs of fiber parts of near equal number.

    Fibers are cut at `fiber` non-zeros; a slice of n non-zeros gets ceil(n / slice_) parts. Places
    of fiber parts within their slice come from range parts, too: no task holds a slice.
    """
    cols = modes(x)
    keys = [*cols[:-1], "part"]
    fibers = written(split_fibers(x, fiber).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "fiber-parts")
    slices = fibers.groupBy("i0").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("of"))
    wide = F.ceil(F.col("of") / F.ceil(F.col("total") / slice_))
    parted = runs(fibers, keys, (), [1]).join(slices, "i0").withColumn("slice_part", F.floor(F.col("place1") / wide).cast("long"))
    return parted.groupBy("i0", "slice_part").agg(F.count(F.lit(1)).alias("fibers"), F.sum("n").alias("nnz"))


def k_tiles(x: DataFrame, size: int) -> DataFrame:
    """x with tile: the last mode cut every `size` indices. The union of the tiles is x."""
    return x.withColumn("tile", F.floor(F.col(modes(x)[-1]) / size).cast("long"))


def root_tiles(x: DataFrame, roots: int) -> DataFrame:
    """x with tile: every `roots` different indices of the first mode, in order, are one tile."""
    nodes = ordinals(x.select("i0").distinct(), ["i0"], "at").select("i0", F.floor(F.col("at") / roots).cast("long").alias("tile"))
    return x.join(nodes, "i0")


def block_id(x: DataFrame, dims: Sequence[int], size: Sequence[int]) -> Column:
    """The row-major number of the block that a non-zero lies in; the last axis runs fastest."""
    grid = [-(-d // s) for d, s in zip(dims, size, strict=True)]
    cols = [F.least(F.floor(F.col(c) / s), F.lit(g - 1)).cast("long") for c, s, g in zip(modes(x), size, grid, strict=True)]
    return linear(cols, grid)


def blocks(x: DataFrame, dims: Sequence[int], size: Sequence[int]) -> DataFrame:
    """x with block and the indices within it."""
    return x.withColumn("block", block_id(x, dims, size)).withColumns({f"local{n}": F.col(c) % s for n, (c, s) in enumerate(zip(modes(x), size, strict=True))})


def semisparse_fibers(x: DataFrame, mode: int) -> DataFrame:
    """(rest indices, n, first, last): the fibers along a mode, with the range that each covers."""
    rest = [c for c in modes(x) if c != f"i{mode}"]
    return x.groupBy(*rest).agg(F.count(F.lit(1)).alias("n"), F.min(f"i{mode}").alias("first"), F.max(f"i{mode}").alias("last"))


def inverted_index(x: DataFrame, mode: int, size: int = 1 << 16) -> DataFrame:
    """(idx, chunk, n, positions): where each index of a mode stands, in lexicographic order of x.

    Positions rise over the chunks of an index, and a chunk has `size` of them at most, so a hot
    index is many rows. n is the chunk's number of positions.
    """
    cols = modes(x)
    first = ordinals(x, cols).select(F.col(f"i{mode}").alias("idx"), "pos")
    placed = runs(first, ["idx", "pos"], (), [1]).withColumn("chunk", F.floor(F.col("place1") / size).cast("long"))
    return placed.groupBy("idx", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("pos")).alias("positions"))
