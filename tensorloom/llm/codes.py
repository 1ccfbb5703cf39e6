"""Vector code compression: product codes whose codebooks are learned by Lloyd's rounds over resident members.

A vector is cut into parts; a part is a row, and rows live with the owner of (position, entry, salt),
which adds up its members where they are. When codebooks have changed, owners judge their members
again: rows that keep their entry stay in place, and only those that change it are shuffled, to
their new owners.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship
from tensorloom.functions.tables import shared_dir

from .clustering import _numbers, squares
from .common import written
from .vectors import first_rows, integers, lists

#: Rows that are held against a codebook side by side.
SIDE_BY_SIDE = 4096


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest number of the nearest entries for each row, and the squared distance."""
    number, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), SIDE_BY_SIDE):
        d = squares(x[at : at + SIDE_BY_SIDE], book)
        number[at : at + SIDE_BY_SIDE] = d.argmin(1)
        best[at : at + SIDE_BY_SIDE] = d.min(1)
    return number, best


def _judged(books: np.ndarray):
    """Members (row, position, entry, salt, x) with the nearest entry now, its squared distance, and whether they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, position, entry = _numbers(b.column(4)), b.column(1).to_numpy(), b.column(2).to_numpy()
            now, error = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            for p in np.unique(position):
                rows = np.flatnonzero(position == p)
                now[rows], error[rows] = _nearest(x[rows], books[p])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(now), b.column(3), b.column(4), pa.array(error), pa.array(now != entry)], names=["row", "position", "entry", "salt", "x", "error", "moved"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(position, entry, n, total) of a task's members."""
    total: dict[tuple[int, int], list] = {}
    for b in batches:
        x, keys = _numbers(b.column(4)), np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1).astype(np.int64)
        for key in np.unique(keys, axis=0) if len(x) else ():
            rows = (keys == key).all(1)
            held = total.setdefault((int(key[0]), int(key[1])), [0, 0])
            held[0], held[1] = held[0] + int(rows.sum()), held[1] + x[rows].sum(0)
    if total:
        keys = np.array(list(total))
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([n for n, _ in total.values()]), lists(np.stack([t for _, t in total.values()]), pa.int64())], names=["position", "entry", "n", "total"])


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, components: int = 64, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each vector with `components` finite components.

    Components are floor(scale * x); each position's codebook begins as that part of the vectors with
    the `entries` smallest ids (repeated ids: by their vectors; null ids come last). After each round
    an entry is the floor of its members' means; one without members stays. code has two hexadecimal
    digits a part. Null and empty vectors, those of another length, and those with null or non-finite
    components take no part, long ones too. Equal distances go to the lower entry; repeated rows are
    rows of their own. With fewer vectors than `entries` the codebooks are shorter, and without any
    there are no rows. Null labels are summed together. Other columns aren't read, so their names
    can't clash. Components beyond 2^27 raise.

    Salts are as many as shuffle partitions, so an entry that a third of all parts share is dealt
    evenly. The driver takes codebooks and their sums: parts * entries rows.
    """
    if components % parts or entries > 256:
        raise ValueError("parts must divide the components, and an entry's number has two hexadecimal digits")
    spark = vectors.sparkSession
    ship(spark)
    salts, width = int(spark.conf.get("spark.sql.shuffle.partitions")), components // parts
    named = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kept = written(integers(named, "v", components, scale, "codes-vectors").withColumn("row", F.monotonically_increasing_id()), "codes-rows")
    first = first_rows(kept, [F.col("id").asc_nulls_last()], "v", entries)
    if not len(first):
        return kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    books = np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2))
    start = books.copy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _numbers(b.column(1))
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), p, np.int32)), pa.array(_nearest(part, start[p])[0].astype(np.int32)), lists(part.astype(np.int32), pa.int32())], names=["row", "position", "entry", "x"])

    def owned(members: DataFrame) -> DataFrame:
        """Members with their owners."""
        return members.repartition(salts, "position", "entry", "salt").sortWithinPartitions("position", "entry")

    member = ["row", "position", "entry", "salt", "x"]
    dealt = kept.select("row", "v").mapInArrow(cut, "row long, position int, entry int, x array<int>").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    resident = written(owned(dealt.select(member)), "codes-members")
    judged_schema = "row long, position int, entry int, salt int, x array<int>, error long, moved boolean"
    for turn in range(rounds):
        if turn:
            at = f"{shared_dir(spark)}/codes-judged-{uuid.uuid4().hex}"
            resident.select(member).mapInArrow(_judged(books), judged_schema).write.partitionBy("moved").parquet(at)
            judged = spark.read.schema(judged_schema).parquet(at)
            arrived = written(owned(judged.where("moved").select(member)), "codes-arrived")
            resident = judged.where("not moved").select(member).unionByName(arrived)
        sums = resident.select(member).mapInArrow(_sums, "position long, entry long, n long, total array<long>").select("position", "entry", "n", F.posexplode("total").alias("at", "t"))
        books = books.copy()
        for r in sums.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():
            books[r["position"], r["entry"], r["at"]] = r["t"] // r["n"]
    final = resident.select(member).mapInArrow(_judged(books), judged_schema).select("row", "position", "entry", "error")
    digits = (F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("entry"))))), 2, "0") for p in range(parts))
    coded = final.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
    coded = written(kept.select("row", "id", "label").join(coded, "row").drop("row"), "codes-coded")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 4) -> str:
    """The codes by comparing each part with all entries of its codebook."""
    n = parts * width
    dist = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, width + 1))
    out = [
        f"kept AS (SELECT row_number() OVER () AS row_, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n})",
        f"part AS (SELECT row_, p, v[p * {width} + 1 : p * {width} + {width}] AS x FROM kept CROSS JOIN (SELECT unnest(range(0, {parts})) AS p))",
        f"c0 AS (SELECT p, e, x AS c FROM part JOIN (SELECT row_, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept) USING (row_) WHERE e < {entries})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS (SELECT row_, p, any_value(x) AS x, min({{'d': {dist}, 'e': e}}) AS b FROM part JOIN c{r} USING (p) GROUP BY row_, p)")
        if r < rounds:
            cell = f"(SELECT p, e, i, (s - ((s % m) + m) % m) // m AS x FROM (SELECT p, b.e AS e, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS m FROM a{r} CROSS JOIN (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY 1, 2, 3))"
            out.append(f"c{r + 1} AS (SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT p, e, list(CAST(x AS BIGINT) ORDER BY i) AS c FROM {cell} GROUP BY p, e) n ON n.p = o.p AND n.e = o.e)")
    out.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} JOIN kept USING (row_) GROUP BY row_, vec_id, label)")
    out.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded CROSS JOIN digest"
