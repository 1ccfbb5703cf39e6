"""Comparing tensors, and analysing the runs of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coo import modes


def difference(x: DataFrame, reference: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: max_abs, rel (max_abs by the reference's greatest value), n_significant, passed.

    Absent entries are 0. Significant cells differ by more than tolerance, relative to a reference
    value that itself exceeds it.
    """
    cols = modes(x)
    both = x.withColumnRenamed("v", "a").join(reference.withColumnRenamed("v", "b"), cols, "full_outer").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    d, r = F.abs(F.col("a") - F.col("b")), F.abs("b")
    row = both.agg(F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs"), F.coalesce(F.max(r), F.lit(0.0)).alias("max_ref"), F.count_if((r > tolerance) & (d / F.greatest(r, F.lit(1e-300)) > tolerance)).alias("n_significant"))
    rel = F.when(F.col("max_ref") > 0, F.col("max_abs") / F.col("max_ref")).otherwise(F.col("max_abs"))
    return row.select("max_abs", rel.alias("rel"), "n_significant", ((rel < tolerance) & (F.col("n_significant") == 0)).alias("passed"))


def timing(runs: DataFrame) -> DataFrame:
    """runs (dataset, method, time_ms) to mean, sd (of the sample), cv, runs, min and max of each."""
    t = "time_ms"
    stats = runs.groupBy("dataset", "method").agg(F.avg(t).alias("mean"), F.coalesce(F.stddev_samp(t), F.lit(0.0)).alias("sd"), F.count(t).alias("runs"), F.min(t).alias("min"), F.max(t).alias("max"))
    return stats.withColumn("cv_pct", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean") * 100).otherwise(0.0))


def speedup(stats: DataFrame, baseline: str) -> DataFrame:
    """timing() against a method: speedup and its error, 0 where either has one run alone."""
    base = stats.where(F.col("method") == baseline).select("dataset", F.col("mean").alias("b"), F.col("sd").alias("bs"), F.col("runs").alias("bn"))
    both = stats.join(base, "dataset").where("mean > 0")
    ratio = F.col("b") / F.col("mean")
    error = F.when((F.col("runs") > 1) & (F.col("bn") > 1), ratio * F.sqrt((F.col("bs") / F.col("b")) ** 2 + (F.col("sd") / F.col("mean")) ** 2)).otherwise(0.0)
    return both.select("dataset", "method", ratio.alias("speedup"), error.alias("error"))


def status_counts(results: DataFrame) -> DataFrame:
    """results (dataset, status) to the number of each outcome; a missing one is UNKNOWN."""
    return results.groupBy(F.coalesce("status", F.lit("UNKNOWN")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def validation(checks: DataFrame) -> DataFrame:
    """checks (method, max_abs, rel, n_sig) to the means of each method."""
    return checks.groupBy("method").agg(F.avg("max_abs").alias("max_abs"), F.avg("rel").alias("rel"), F.avg("n_sig").alias("n_sig"), F.count(F.lit(1)).alias("runs"))


def occupancy(samples: DataFrame, versions: list[str]) -> DataFrame:
    """samples (dataset, version, value) to (max - min) / mean in percent, a column for each version."""
    spread = (F.max("value") - F.min("value")) / F.avg("value") * 100
    return samples.groupBy("dataset").pivot("version", versions).agg(spread)


def load_by_order(logs: DataFrame) -> DataFrame:
    """logs (tensor, order, block, nnz) to one row per tensor: blocks, max, mean, and max / mean - 1."""
    own = logs.groupBy("order", "tensor").agg(F.count(F.lit(1)).alias("blocks"), F.max("nnz").alias("most"), F.avg("nnz").alias("mean"))
    return own.withColumn("imbalance", F.col("most") / F.col("mean") - 1)


def with_baseline(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """results with the baseline's time of the same dataset; none where it has none."""
    return results.join(baseline.select("dataset", F.col("time_ms").alias("baseline_ms")), "dataset", "left")
