"""What the corpus operators share: shared tables, distributed numbering, text rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tensorloom.functions.tables import fresh, ordinals, written

#: A word: a run of anything but ASCII white space (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a worker holds few texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def digits_for(rows: int, per_cell: int) -> int:
    """Hex digits of a hash that split rows into cells of about per_cell; at least two."""
    k = 2
    while 16**k * per_cell < rows:
        k += 1
    return k


def numbered(df: DataFrame, group: Sequence[str], cell: Column, order: Sequence[Column], name: str) -> DataFrame:
    """df with a gapless number `name` from 0 within each group, without gathering a group in a task.

    Rows are counted by group and cell, the counts are summed up over the cells of a group, and
    rows are numbered within their cell. cell must rise with order, or be free of it if any
    numbering will do.
    """
    df = df.withColumn("_cell", cell)
    keys = [*group, "_cell"]
    before = W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return local.join(cells.drop("_n"), keys).withColumn(name, (F.col("_first") + F.col("_local")).cast("long")).drop("_cell", "_local", "_first")


def row_keys(docs: DataFrame, id_col: str, nulls_last: bool = False) -> tuple[DataFrame, str]:
    """docs, and the column that tells its rows apart: the ids, where they differ and none is null.

    Else the rows are written with a number each, which rises with the id; rows of one id are
    numbered by a hash of their columns, and equal rows one by one. Nulls come first or last. The
    columns that are added have names that docs lacks.
    """
    if docs.groupBy(F.col(id_col).alias("of")).agg(F.count(F.lit(1)).alias("times")).where("times > 1 or of is null").isEmpty():
        return docs, id_col
    key, at, hash_ = fresh(docs, "row_key", "row_at", "row_hash")
    hashed = F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map<" not in t])
    rows = written(docs.withColumns({hash_: hashed, at: F.monotonically_increasing_id()}), "row-hashes")
    by_id = F.col(id_col).asc_nulls_last() if nulls_last else F.col(id_col).asc_nulls_first()
    places = ordinals(rows.select(id_col, hash_, at), [by_id, hash_, at], key)
    return written(rows.join(places.select(at, key), at).select(*docs.columns, key), "row-keys"), key


def chosen(rows: DataFrame, key: str, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of those rows whose key is among keys, a table of one column."""
    (name,) = fresh(rows, "chosen")
    return rows.join(keys.toDF(name), F.col(key) == F.col(name), "left_semi").select(*columns)
