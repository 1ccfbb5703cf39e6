"""Contractions of streams: they are linear in the tensor, so sums can be kept up as non-zeros arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.contract import rank


def streaming_norm(x: DataFrame) -> DataFrame:
    """One row: non-zeros and the sum of squares so far, for distinct coordinates. Output mode complete."""
    return x.agg(F.count(F.lit(1)).alias("nnz"), F.sum(F.col("v") * F.col("v")).alias("norm_sq"))


def streaming_ttmc(x: DataFrame, factors: Mapping[int, DataFrame], keep: int) -> DataFrame:
    """Wide rows (i{keep}, s..): the tensor so far times all factors but that of mode keep.

    x is a stream of entries, factors are static. One stateful sum per kept index; output mode
    update or complete. Entries of one coordinate add up.
    """
    gone, cells = [m for m in sorted(factors) if m != keep], [()]
    for m in gone:
        x = x.join(factors[m].select(F.col("x").alias(f"i{m}"), *(F.col(f"u{k}").alias(f"u{m}_{k}") for k in range(rank(factors[m])))), f"i{m}")
        cells = [(*c, (m, k)) for c in cells for k in range(rank(factors[m]))]
    sums = []
    for c in cells:
        p = F.col("v")
        for m, k in c:
            p = p * F.col(f"u{m}_{k}")
        sums.append(F.sum(p).alias("s" + "_".join(str(k) for _, k in c)))
    return x.groupBy(f"i{keep}").agg(*sums)
