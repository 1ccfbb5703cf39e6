"""Connected components of a link table, by passing on the least label and jumping over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id in links, the least id that it reaches.

    Every step writes its labels to the shared folder; labels reach across the square of the
    distance from step to step, so that the number of steps grows with its logarithm.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).select("id", F.least("id", "component").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = written(lower, "cc-labels")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        following = written(lower.join(jump, "component").select("id", "old", F.least("component", "further").alias("component")), "cc-labels")
        if following.where("component < old").isEmpty():
            return following.select("id", "component")
        labels = following.drop("old")
