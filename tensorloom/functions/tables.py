"""Tables in the folder that driver and executors share, and numbering across partitions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spark's setting that shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of tables for each shuffle partition, and of a task's read and of what Spark puts together to one task.
SHARE, READ = 8 << 20, 16 << 20
#: Spark's settings of the latter two.
READS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def _bytes(size: str) -> int:
    """A size as Spark's settings have it: 16m, 64MB, 134217728b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def sized(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> SparkSession:
    """A session whose tasks get no more to hold as the tables grow: more shuffle partitions, smaller reads.

    Where the session's own partitions are enough for the tables, and its reads and merged partitions are small or
    the tables are one read, that session; its settings stay as they are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sf_dir)
    ours = F.col("path").rlike(rf"/({'|'.join(names)})\.parquet(/|$)")
    total = files.where(ours).agg(F.sum("length")).first()[0] or 0
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, large = max(given, -(-total // SHARE)), [key for key in READS if total > READ and _bytes(spark.conf.get(key)) > READ]
    if parts == given and not large:
        return spark
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set("spark.sql.shuffle.partitions", parts)
    for key in large:
        other.conf.set(key, READ)
    return other


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset, and the master is local (tests), a temporary folder is taken; a cluster
    without the setting raises, as no folder of the driver's machine would do.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        own = tempfile.mkdtemp(prefix="tensorloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", own)
        return own
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write go with its end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as a Parquet table in the shared folder and read again.

    Cuts the lineage, so that a lost executor costs no more than the step that it was in. The
    shuffle files of the step go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Cells of a table that joins with a dealt() one may broadcast, at most.
SMALL = 1 << 22


def dealt(df: DataFrame, key: str, name: str, share: int = 4) -> DataFrame:
    """written(), in buckets by a column: joins and sums by that column don't shuffle these rows again.

    A bucket has the rows of `share` shuffle partitions where there are more of these than the cores
    take in two rounds: sums by another column are fewer that way, as each bucket has its own. The catalog forgets the table at once, as its path alone is read.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(parts, 2 * spark.sparkContext.defaultParallelism), -(-parts // share))
    own = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    with cleaning(spark):
        df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own)
    found = spark.table(own)
    spark.sql(f"DROP TABLE {own}")
    return found


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has SMALL cells at most; else as it is."""
    return F.broadcast(df) if rows * len(df.columns) <= SMALL else df


def ordinals(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """df with the place of each row, from 0, in the order of unique columns.

    Rows are range-partitioned, sorted and numbered within their part, and written once; the
    counts of the parts, one row each, give where a part begins. No task sees all rows.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id of a row is its part, and in the lower 33 bits its place there.
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_ordinal_id", F.monotonically_increasing_id())
    ranged = written(ranged, "ordinals").withColumn("_ordinal_part", F.shiftright("_ordinal_id", 33))
    begins = F.coalesce(F.sum("count").over(W.orderBy("_ordinal_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = ranged.groupBy("_ordinal_part").count().select("_ordinal_part", begins.alias("_ordinal_first"))  # one row per part
    place = F.col("_ordinal_first") + F.col("_ordinal_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(firsts, "_ordinal_part").withColumn(name, place.cast("long")).drop("_ordinal_part", "_ordinal_id", "_ordinal_first")
