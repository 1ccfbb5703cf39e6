"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tensorloom.functions.tables import fresh

from .common import WORD, digits_for, row_keys, written


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """sizes (source, source_size) with source_no and the target words of each source.

    Sources in code point order, null last, get the weights in turn. Together they get
    share * all sizes, in proportion to the weights; no target passes max_epochs * its source's
    size, and what that cuts off is dealt among the others, by weight, until none is above.
    One row per source; the driver sees sums only.
    """
    parts = 8
    ranged = sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "mix-sources")
    firsts = ranged.groupBy("part").count().withColumn("first", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = ranged.withColumn("own", own).join(F.broadcast(firsts.drop("count")), "part").select("source", "source_size", (F.col("first") + F.col("own")).alias("source_no"))
    weighed = written(numbered.withColumn("weight", weight).withColumn("most", F.lit(float(max_epochs)) * F.col("source_size")), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget, level, fixed = share * float(total), None, -1
    while True:
        # A source whose share passes its limit is fixed there; the level of the others rises.
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        row = weighed.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if row["n"] == fixed or not row["open"]:
            break
        fixed, level = row["n"], (budget - row["used"]) / row["open"]
    level = math.inf if level is None or not row["open"] else level
    target = F.when(F.lit(level) == float("inf"), F.col("most")).otherwise(F.least(F.col("weight") * F.lit(level), F.col("most")))
    return weighed.select("source", "source_no", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken.

    size is the number of words (null: 0). Rows get hash-random keys from their ids; within a
    source they are sorted by key, their sizes are summed up over the whole source, and the
    source's budget, its target without the fraction, is cut exactly there. A budget of more than
    the source's size takes whole epochs first and the rest in a last one. taken counts repeats;
    the row at the cut is taken in part. No row is taken more than max_epochs times its size.

    Null ids share one key. Ties (equal ids) go by size, so reruns agree as a set of rows. Empty
    and null texts have size 0 and take 0. An empty table gives no rows. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    cell = F.substring("key", 1, digits_for(sized.count(), 20_000))
    rows = sized.withColumn("cell", cell).withColumnRenamed("source", "of")
    rows = rows.join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    cells = rows.groupBy("source_no", "cell").agg(F.sum("size").alias("words"))
    cells = cells.select("source_no", "cell", F.coalesce(F.sum("words").over(W.partitionBy("source_no").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_cell"))
    inside = F.sum("size").over(W.partitionBy("source_no", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(cells, ["source_no", "cell"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_cell") - F.col("inside")))
    rows = rows.withColumn("budget", budget).withColumn("epochs", epochs)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves as the mix takes them: a row for each epoch that takes a document.

    A document that the cut meets is taken whole in that epoch, so that no text is torn. Documents
    that are not taken go. Documents without words weigh nothing, and stay once if their source has
    a target above 0 or no words at all. Rows whose ids are null or repeat are taken one by one; null texts
    have no words, null sources are a source, long texts count whole. An empty table gives no rows.
    All columns keep their names and values, whatever they are called.
    """
    rows, key = row_keys(docs, id_col)
    plan = mix(rows, weights, share, max_epochs, key, text_col, source_col)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.when((F.col("target") > 0) | (F.col("source_size") == 0), 1).otherwise(0))
    of, times, copy = fresh(rows, "mixed_id", "mixed_times", "mixed_copy")
    wanted = plan.select(F.col("doc_id").alias(of), copies.cast("int").alias(times)).where(F.col(times) > 0)
    joined = rows.join(wanted, F.col(key) == F.col(of))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS most FROM src
), t AS (SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) AS budget FROM src),
lv AS (
  SELECT w.*, budget,
    (budget - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w, t
), c AS (SELECT *, weight * level >= most AS capped FROM lv),
lvl AS (SELECT (any_value(budget) - coalesce(sum(most) FILTER (capped), 0)) / sum(weight) FILTER (NOT capped) AS level FROM c),
tg AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE weight * (SELECT level FROM lvl) END AS target FROM c),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM sized s JOIN tg ON s.source IS NOT DISTINCT FROM tg.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST((budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) AS BIGINT) END AS taken
FROM p
"""
