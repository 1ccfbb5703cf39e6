"""Logs of experiments as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_log(text: DataFrame) -> DataFrame:
    """(file, order, block, nnz) of whole logs (value): sections `File:`, `Order:`, ... and lines `block nnz`."""
    parts = text.select(F.explode(F.split("value", r"(?m)^File:\s*")).alias("s")).where("trim(s) <> ''")
    head = parts.select(F.trim(F.substring_index("s", "\n", 1)).alias("file"), F.regexp_extract("s", r"Order:\s*(\d+)", 1).try_cast("int").alias("order"), F.explode(F.regexp_extract_all("s", F.lit(r"(?m)^(\d+\s+\d+)\s*$"))).alias("line"))
    t = F.split("line", r"\s+")
    return head.select("file", "order", t[0].cast("long").alias("block"), t[1].cast("long").alias("nnz"))


def run_log(lines: DataFrame) -> DataFrame:
    """(dataset, method_id, run, method, time_ms) of numbered lines (log, n, value).

    Lines `Running contraction on F...` name the dataset, F's last part without its extension, and
    `Run r/R of method vN...` the run for the lines `Method: M, Time: T` that follow, up to the next.
    T may have an exponent.
    """
    value = F.col("value")
    pick = lambda pattern, k: F.nullif(F.regexp_extract(value, pattern, k), F.lit(""))
    marked = lines.select("log", "n", "value", F.regexp_replace(F.regexp_extract(F.trim(pick(r"Running contraction on (.*?)\.\.\.?$", 1)), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "").alias("dataset"), pick(r"Run (\d+)/\d+ of method", 1).alias("run"), pick(r"of method v(\d+)", 1).alias("method_id"))
    w = W.partitionBy("log").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    filled = marked.select("log", "n", "value", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in ("dataset", "run", "method_id")))
    time = r"Time: (\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    found = filled.where(F.col("value").rlike(r"Method: .*" + time))
    return found.select("dataset", F.col("method_id").cast("int").alias("method_id"), F.col("run").cast("int").alias("run"), F.trim(F.regexp_extract("value", r"Method: ([^,]+),", 1)).alias("method"), F.regexp_extract("value", time, 1).cast("double").alias("time_ms"))


def kernel_time(text: DataFrame, runs: int = 1) -> DataFrame:
    """One row: the sum of all times `N ms` in whole logs (value), by the number of runs."""
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*ms"))).alias("t")).agg((F.sum(F.col("t").cast("double")) / runs).alias("ms"))


def results(rows: DataFrame) -> DataFrame:
    """(dataset, time_ms, status) of result rows whose time may be a word such as ERROR."""
    time = F.col("time").try_cast("double")
    status = F.when(time.isNull(), F.col("time")).otherwise(F.coalesce("status", F.lit("UNKNOWN")))
    return rows.select("dataset", time.alias("time_ms"), status.alias("status"))


def human_bytes(n):
    """A size in words, as an expression."""
    n = F.col(n) if isinstance(n, str) else n
    out = F.concat(F.format_string("%d", n.cast("long")), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30), ("TB", 1 << 40)):
        out = F.when(n >= size, F.concat(F.format_string("%.2f", n / size), F.lit(f" {unit}"))).otherwise(out)
    return out
