"""Quality by hierarchical empirical Bayes: document evidence, shrunken host and path posteriors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written
from .language import held_out

#: Labelled rows that the document classifier is fitted on, as expected by a hash of the id.
TRAIN_ROWS = 20_000
FEATURES = ("words", "distinct", "length", "upper", "signs", "digits", "lines", "stop")


def _features(text: Column) -> list[Column]:
    """Measures of a text: size, repetition of words and lines, word length, shares of kinds of signs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 3))
    share = lambda pattern: F.sqrt(F.regexp_count(text, F.lit(pattern)) / chars)
    return [
        F.log1p(n.cast("double")), F.size(F.array_distinct(words)) / F.sqrt(n), F.log(chars / n), share("[A-Z]"), share("[^\\p{L}\\p{N}\\s.,]"),
        share("[0-9]"), F.size(F.array_distinct(lines)) / F.size(lines), short / n,
    ]


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x**2])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights of a logistic regression on the measures and their squares."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    d = _design(np.clip((x - mean) / scale, -4, 4))
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.eye(len(w)), d.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(p, F.lit(1 - 1e-6)))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, expected: Column) -> float:
    """How many rows the prior is worth: the spread within groups over that between them.

    groups has n, s (sum) and q (sum of squares) of the evidence; expected is each group's prior.
    """
    mean = F.col("s") / F.col("n")
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("q") - F.col("s") * mean).alias("within"), F.sum(F.col("n") * (mean - expected) ** 2).alias("between")).first()
    if not row["n"]:
        return 1.0
    within = max(row["within"] / max(1, row["n"] - row["k"]), 1e-9)
    between = max(row["between"] / row["n"] - within * row["k"] / row["n"], 1e-6)
    return min(max(within / between, 1.0), 1e5)


def document_evidence(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """doc_id, the kept columns and p, the classifier's probability that the text is good."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    measured = written(docs.select(F.col(id_col).alias("doc_id"), *keep, *(x.alias(n) for n, x in zip(FEATURES, _features(text), strict=True))), "quality-measures")
    total = labels.count()
    sample = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < (1 << 30) * min(1.0, rows / max(1, total)))
    known = measured.join(sample, "doc_id").select("quality", *FEATURES).toPandas()
    y = known["quality"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return measured.withColumn("p", F.lit(float(share))).drop(*FEATURES)
    mean, scale, w = _fit(known[list(FEATURES)].to_numpy(float), y)
    z = F.lit(float(w[0]))
    for i, name in enumerate(FEATURES):
        x = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col(name) - float(mean[i])) / float(scale[i])))
        z = z + x * float(w[1 + i]) + x * x * float(w[1 + len(FEATURES) + i])
    return measured.withColumn("p", 1 / (1 + F.exp(-z))).drop(*FEATURES)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", rows: int = TRAIN_ROWS, least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, doc_score, host_posterior, path_posterior, score, kept.

    A classifier of the text's measures, fitted on about `rows` labelled rows that aren't held out
    (crc32 of the id mod 5 is not 0), gives doc_score. Its sums by path and by host give posteriors:
    a host's mean is shrunk toward the global mean, and a path's (a section of its host) toward its
    host's, each by as many rows as the spread within groups outweighs that between them. score
    adds the log odds of the row's path over the global ones to the document's, with the row itself
    left out of its path and host, so that its evidence counts once; kept is score >= least.

    Null hosts and paths are groups of their own. Null texts count as empty, very long ones are
    measured whole; several labels of one id count as the highest, null ones not at all. Rows that
    repeat count one by one. Without labels of both classes doc_score is the share of good labels.
    An empty table gives no rows.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 5, 0))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("quality"))
    keep = [F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path")]
    seen = written(document_evidence(docs, known, rows, id_col, text_col, keep), "quality-evidence")
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = written(seen.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    top = float(total if total is not None else 0.5)
    k = _strength(hosts, F.lit(top))
    k_host, shrunk = k, lambda s_, n_, k_, prior: (s_ + k_ * prior) / (n_ + k_)
    hosts = hosts.select(F.col("host").alias("of"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), shrunk(F.col("s"), F.col("n"), k_host, top).alias("host_posterior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    k = _strength(paths, F.col("host_posterior"))
    named = [F.col("host").alias("of_host"), F.col("path").alias("of_path"), "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_posterior"]
    paths = written(paths.select(*named, shrunk(F.col("s"), F.col("n"), k, F.col("host_posterior")).alias("path_posterior")), "quality-posteriors")
    top_odds = math.log(max(top, 1e-6) / max(1 - top, 1e-6))
    scored = seen.join(paths, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    others = shrunk(F.col("host_s") - F.col("p"), F.col("host_n") - 1, k_host, top)
    others = shrunk(F.col("path_s") - F.col("p"), F.col("path_n") - 1, k, others)
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(others) - top_odds)))
    scored = scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("p").alias("doc_score"), "host_posterior", "path_posterior", score.alias("score"))
    return scored.withColumn("kept", F.col("score") >= least)
