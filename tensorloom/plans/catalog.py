"""The tensor queries by name, and the SQL that each must agree with.

Tensors are views of the given tables: X3 (supplier, part, line number) of the order lines with
summed quantities, X4 with the month of shipment besides, S2 (customer, supplier), XE (user, kind of
event, hour) of the events, and M, the embeddings as a matrix. Factors have whole-number cells,
(a x + b r) mod m, so that sums are exact in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions import factors as fac
from tensorloom.functions.shipping import ship
from tensorloom.functions.tables import cleaning, shared_dir, sized, written
from tensorloom.operators import compare, contract, coo, formats, linalg, stats, svd, tucker
from tensorloom.plans import expected, planner, table_functions
from tensorloom.sources import binary, factor_source, generate, logs, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The tables that tensors are made of; tasks are sized by them.
GROWING = ("lineitem", "orders", "events", "customer")
#: Sizes of the modes of X3 and X4 are read from the tables; ranks of the factors A, B, C.
RANKS = (3, 2, 2)


def query(name: str, sql: str | None = None):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(sized(spark, sf_dir, GROWING), sf_dir)

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in VIEWS.items() if _used(n, sql)) + " " + sql if any(_used(n, sql) for n in VIEWS) else sql
        return f

    return put


def _used(name: str, sql: str, seen: frozenset[str] = frozenset()) -> bool:
    import re

    if re.search(rf"\b{name}\b", sql):
        return True
    return any(re.search(rf"\b{name}\b", VIEWS[m]) and _used(m, sql, seen | {name}) for m in VIEWS if m != name and m not in seen)


def _factor_sql(name: str, r: int, a: int, b: int, m: int) -> str:
    return f"SELECT x, r, CAST(({a}*x + {b}*r) % {m} AS DOUBLE) AS u FROM (SELECT unnest(range(0, (SELECT 1 + greatest((SELECT max(l_partkey) FROM lineitem), (SELECT max(l_suppkey) FROM lineitem), (SELECT max(o_custkey) FROM orders), 12)))) AS x) CROSS JOIN (SELECT unnest(range(0, {r})) AS r)"


VIEWS = {
    "x3": "SELECT CAST(l_suppkey AS BIGINT) AS i0, CAST(l_partkey AS BIGINT) AS i1, CAST(l_linenumber AS BIGINT) AS i2, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3",
    "x4": "SELECT CAST(l_suppkey AS BIGINT) AS i0, CAST(l_partkey AS BIGINT) AS i1, CAST(l_linenumber AS BIGINT) AS i2, CAST(month(l_shipdate) - 1 AS BIGINT) AS i3, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3, 4",
    "s2": 'SELECT CAST(o_custkey AS BIGINT) AS "row", CAST(l_suppkey AS BIGINT) AS col, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2',
    "xe": "SELECT CAST(user_id AS BIGINT) AS i0, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS i1, CAST(hour(ts) AS BIGINT) AS i2, v FROM (SELECT user_id, event_type, ts, 1.0::DOUBLE AS v FROM events)",
    "fa": _factor_sql("fa", RANKS[0], 7, 3, 11),
    "fb": _factor_sql("fb", RANKS[1], 5, 2, 7),
    "fc": _factor_sql("fc", RANKS[2], 3, 5, 5),
    "dims": "SELECT max(i0) + 1 AS d0, max(i1) + 1 AS d1, max(i2) + 1 AS d2 FROM x3",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coo.from_columns(_table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_linenumber"], "l_quantity")


def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coo.from_columns(_table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_linenumber", F.month("l_shipdate") - 1], "l_quantity")


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").cast("long").alias("row"), F.col("l_suppkey").cast("long").alias("col")).agg(F.sum("l_quantity").cast("double").alias("v"))


def sizes(x: DataFrame) -> list[int]:
    """The sizes of the modes, from one pass."""
    row = coo.dims(x).first()
    return [int(d or 0) for d in row]


def _a(spark: SparkSession, n: int) -> DataFrame:
    return fac.modular(spark, n, RANKS[0], 7, 3, 11)


def _b(spark: SparkSession, n: int) -> DataFrame:
    return fac.modular(spark, n, RANKS[1], 5, 2, 7)


def _c(spark: SparkSession, n: int) -> DataFrame:
    return fac.modular(spark, n, RANKS[2], 3, 5, 5)


def _factors(spark: SparkSession, x: DataFrame, keep: int | None) -> dict[int, DataFrame]:
    """A, B, C on the modes other than keep, in mode order."""
    d = sizes(x)
    makers = iter((_a, _b, _c))
    return {m: next(makers)(spark, n) for m, n in enumerate(d) if m != keep}


# ---- coordinates

query("coo_canonicalise", "SELECT * FROM x3")(x3)
query("coo_nnz", "SELECT count(*) AS nnz FROM x3")(lambda s, d: coo.nnz(x3(s, d)))
query("coo_dims_max", "SELECT max(i0) + 1 AS dim0, max(i1) + 1 AS dim1, max(i2) + 1 AS dim2 FROM x3")(lambda s, d: coo.dims(x3(s, d)))
_NDV = "SELECT 0 AS mode, count(DISTINCT i0) AS ndv FROM x3 UNION ALL SELECT 1, count(DISTINCT i1) FROM x3 UNION ALL SELECT 2, count(DISTINCT i2) FROM x3"
query("mode_ndv", _NDV)(lambda s, d: coo.ndv(x3(s, d)))


@query("mode_order", f"SELECT CAST(row_number() OVER (ORDER BY ndv, mode) - 1 AS INTEGER) AS place, mode FROM ({_NDV})")
def _mode_order(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(coo.mode_order(x3(spark, sf_dir)))), "place int, mode int")


query("coo_shift", "SELECT i0 + 1 AS i0, i1 + 1 AS i1, i2 + 1 AS i2, v FROM x3")(lambda s, d: coo.shift(x3(s, d), 1))
query("coo_permute_sorted", "SELECT i2 AS i0, i0 AS i1, i1 AS i2, v FROM x3")(lambda s, d: coo.lexicographic(coo.permute(x3(s, d), [2, 0, 1])))
query("coo_crop", "SELECT i0 - 10 AS i0, i1, i2, v FROM x3 WHERE i0 >= 10 AND i0 < 50 AND i2 < 4")(lambda s, d: coo.crop(x3(s, d), {0: (10, 50), 2: (None, 4)}, rebase=True))
query("coo_squash", "SELECT i0, i2 AS i1, sum(v) AS v FROM x3 GROUP BY i0, i2")(lambda s, d: coo.squash(x3(s, d), [1]))
query("coo_squash_cube", "SELECT coalesce(i0, -1) AS i0, coalesce(i1, -1) AS i1, coalesce(i2, -1) AS i2, sum(v) AS v FROM (SELECT i0, i1, i3 AS i2, v FROM x4) GROUP BY CUBE (i0, i1, i2)")(lambda s, d: coo.squash_cube(coo.squash(x4(s, d), [2])).na.fill(-1))
query("coo_scale", "SELECT i0, i1, i2, v * 2.5 AS v FROM x3")(lambda s, d: coo.scale(x3(s, d), 2.5))
query("coo_add", "SELECT i0, i1, i2, sum(v) AS v FROM (SELECT * FROM x3 UNION ALL SELECT i0, i1, i2 % 3, v * 2 FROM x3) GROUP BY 1, 2, 3")(lambda s, d: coo.add(x3(s, d), coo.scale(x3(s, d).withColumn("i2", F.col("i2") % 3), 2)))
query("coo_put", "SELECT i0, i1, i2, CASE WHEN i2 = 1 THEN 1.0::DOUBLE ELSE v END AS v FROM x3")(lambda s, d: coo.put(x3(s, d), x3(s, d).where("i2 = 1").withColumn("v", F.lit(1.0))))
query("coo_drop_zero", "SELECT i0, i1, i2, v % 5 AS v FROM x3 WHERE v % 5 <> 0")(lambda s, d: coo.drop_zero(x3(s, d).withColumn("v", F.col("v") % 5)))
query("coo_inside", "SELECT * FROM x3 WHERE i0 < 50 AND i1 < 100 AND i2 < 5")(lambda s, d: coo.inside(x3(s, d), [50, 100, 5]))
query("coo_cast", "SELECT i0, i1, i2, CAST(CAST(v / 3 AS FLOAT) AS DOUBLE) AS v FROM x3")(lambda s, d: coo.cast_values(x3(s, d).withColumn("v", F.col("v") / 3), "float"))
query("checksum", "SELECT sum(v) AS checksum FROM x3")(lambda s, d: coo.checksum(x3(s, d)))
query("largest_axis", "SELECT CAST(CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS INTEGER) AS mode FROM dims")(lambda s, d: s.createDataFrame([(coo.largest_axis(sizes(x3(s, d))),)], "mode int"))
query("frob_norm", "SELECT sum(v * v) AS norm_sq, sqrt(sum(v * v)) AS norm FROM x3")(lambda s, d: coo.norm(x3(s, d)))
for _m, _col in ((0, "i1 * d2 + i2"), (1, "i0 * d2 + i2"), (2, "i0 * d1 + i1")):
    query(f"unfold_mode{_m}", f'SELECT i{_m} AS "row", CAST({_col} AS BIGINT) AS col, v FROM x3, dims')(lambda s, d, m=_m: coo.unfold(x := x3(s, d), m, sizes(x)))
query("linearise", "SELECT CAST((i0 * d1 + i1) * d2 + i2 AS BIGINT) AS pos, v FROM x3, dims")(lambda s, d: coo.linearise(x := x3(s, d), sizes(x)))
query("delinearise", "SELECT * FROM x3")(lambda s, d: coo.delinearise(coo.linearise(x := x3(s, d), sizes(x)), sizes(x)))
_MONTHS = "SELECT CAST(month(l_shipdate) - 1 AS BIGINT) AS i0, CAST(l_linenumber AS BIGINT) AS i1, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"


@query("densify_months", f"WITH m AS ({_MONTHS}) SELECT a AS i0, b AS i1, coalesce(v, 0) AS v FROM (SELECT unnest(range(0, (SELECT max(i0) + 1 FROM m))) AS a) CROSS JOIN (SELECT unnest(range(0, (SELECT max(i1) + 1 FROM m))) AS b) LEFT JOIN m ON a = i0 AND b = i1")
def _densify_months(spark, sf_dir):
    """All order lines by month and line number, a tensor that is small as a whole."""
    x = coo.from_columns(_table(spark, sf_dir, "lineitem"), [F.month("l_shipdate") - 1, "l_linenumber"], "l_quantity")
    return coo.densify(x, sizes(x))


_KINDS = "SELECT i1 AS a, i2 AS b, sum(v) AS v FROM xe GROUP BY 1, 2"


@query("densify_small", f"SELECT a AS i0, b AS i1, coalesce(v, 0) AS v FROM (SELECT unnest(range(0, (SELECT max(a) + 1 FROM ({_KINDS})))) AS a) CROSS JOIN (SELECT unnest(range(0, (SELECT max(b) + 1 FROM ({_KINDS})))) AS b) LEFT JOIN ({_KINDS}) USING (a, b)")
def _densify_small(spark, sf_dir):
    """All events by kind and hour."""
    x = coo.squash(_events(spark, sf_dir), [0])
    return coo.densify(x, sizes(x))


query("chunks_roundtrip", "SELECT i0, i1, c AS i2, coalesce(v, 0) AS v FROM (SELECT DISTINCT i0, i1 FROM x3) CROSS JOIN (SELECT unnest(range(0, 8)) AS c) LEFT JOIN (SELECT i0, i1, i2 AS c, v FROM x3) USING (i0, i1, c)")(lambda s, d: coo.unchunk(coo.chunks(x3(s, d), 2, 8), 2))
query("topk_values", "SELECT * FROM x3 ORDER BY v DESC, i0, i1, i2 LIMIT 100")(lambda s, d: coo.top(x3(s, d), 100))
query("limit_sorted", "SELECT * FROM x3 ORDER BY i0, i1, i2 LIMIT 50")(lambda s, d: coo.first(x3(s, d), 50))
query("distinct_index", "SELECT DISTINCT i1 AS idx FROM x3")(lambda s, d: coo.indices(x3(s, d), 1))
query("missing_fill", "SELECT i0, i1, i2, CASE WHEN i2 % 2 = 0 THEN 0.5::DOUBLE ELSE v END AS v FROM x3")(lambda s, d: coo.fill(x3(s, d).withColumn("v", F.when(F.col("i2") % 2 == 1, F.col("v"))), 0.5))
query("transpose", 'SELECT col AS "row", "row" AS col, v FROM s2')(lambda s, d: coo.transpose(s2(s, d)))
query("event_tensor", "SELECT i0, i1, i2, sum(v) AS v FROM xe GROUP BY 1, 2, 3")(lambda s, d: _events(s, d))


def _events(spark, sf_dir):
    """Counts by user, kind of event and hour; the few kinds are numbered by name."""
    events = _table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    from tensorloom.functions.tables import ordinals

    return coo.from_columns(events.join(ordinals(kinds, ["event_type"], "kind"), "event_type"), ["user_id", "kind", F.hour("ts")], F.lit(1.0))


# ---- formats

_N1 = "SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS pos FROM (SELECT DISTINCT i0, i1 FROM x3)"
_LEAF = "SELECT i0, i1, i2, v, row_number() OVER (ORDER BY i0, i1, i2) - 1 AS pos FROM x3"
_CSF0 = f"SELECT row_number() OVER (ORDER BY i0) - 1 AS pos, i0 AS idx, min(pos) AS ptr_begin, max(pos) + 1 AS ptr_end FROM ({_N1}) GROUP BY i0"
_CSF1 = f"SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS pos, i1 AS idx, min(pos) AS ptr_begin, max(pos) + 1 AS ptr_end FROM ({_LEAF}) GROUP BY i0, i1"
query("csf_level0", _CSF0)(lambda s, d: formats.csf(x3(s, d))[0])
query("csf_level1", _CSF1)(lambda s, d: formats.csf(x3(s, d), 1)[0])
query("csf_level2", f"SELECT pos, i2 AS idx, v FROM ({_LEAF})")(lambda s, d: formats.csf(x3(s, d), 2)[0])
query("csf_ptr1", f"SELECT pos, ptr_begin AS ptr FROM ({_CSF0}) UNION ALL SELECT max(pos) + 1, max(ptr_end) FROM ({_CSF0})")(lambda s, d: formats.csf_pointers(formats.csf(x3(s, d)), 1))
query("csf_ptr2", f"SELECT pos, ptr_begin AS ptr FROM ({_CSF1}) UNION ALL SELECT max(pos) + 1, max(ptr_end) FROM ({_CSF1})")(lambda s, d: formats.csf_pointers(formats.csf(x3(s, d)), 2))
query("csf_roundtrip", "SELECT * FROM x3")(lambda s, d: formats.from_csf(formats.csf(x3(s, d))))
query("csf4_roundtrip", "SELECT * FROM x4")(lambda s, d: formats.from_csf(formats.csf(x4(s, d))))
query("csr_rowptr", 'SELECT r AS "row", (SELECT count(*) FROM s2 WHERE "row" < r) AS ptr FROM (SELECT unnest(range(0, (SELECT max("row") + 2 FROM s2))) AS r)')(lambda s, d: formats.csr(m := s2(s, d), int(m.agg(F.max("row")).first()[0]) + 1))
query("hcsr_fiber_split", "SELECT i0, i1, i2, v, CAST((row_number() OVER (PARTITION BY i0, i1 ORDER BY i2) - 1) // 2 AS BIGINT) AS part FROM x3")(lambda s, d: formats.split_fibers(x3(s, d), 2))
query("bcsf_parts", """SELECT i0, CAST(floor(place / ceil(of / ceil(total / 64.0))) AS BIGINT) AS slice_part, count(*) AS fibers, CAST(sum(n) AS BIGINT) AS nnz FROM (
  SELECT i0, n, row_number() OVER (PARTITION BY i0 ORDER BY i1, part) - 1 AS place, sum(n) OVER (PARTITION BY i0) AS total, CAST(count(*) OVER (PARTITION BY i0) AS DOUBLE) AS of FROM (
    SELECT i0, i1, part, count(*) AS n FROM (SELECT i0, i1, (row_number() OVER (PARTITION BY i0, i1 ORDER BY i2) - 1) // 2 AS part FROM x3) GROUP BY 1, 2, 3)) GROUP BY 1, 2""")(lambda s, d: formats.balanced(x3(s, d), 2, 64))
query("ktile", "SELECT *, i2 // 3 AS tile FROM x3")(lambda s, d: formats.k_tiles(x3(s, d), 3))
query("root_tiles", "SELECT x3.*, CAST((dense_rank() OVER (ORDER BY i0) - 1) // 7 AS BIGINT) AS tile FROM x3")(lambda s, d: formats.root_tiles(x3(s, d), 7))
_BLOCK = "CAST(((i0 // 16) * ((d1 + 127) // 128) + i1 // 128) * ((d2 + 3) // 4) + i2 // 4 AS BIGINT)"
query("block_id", f"SELECT i0, i1, i2, v, {_BLOCK} AS block, i0 % 16 AS local0, i1 % 128 AS local1, i2 % 4 AS local2 FROM x3, dims")(lambda s, d: formats.blocks(x := x3(s, d), sizes(x), [16, 128, 4]))
query("block_hist", f"SELECT {_BLOCK} AS block, count(*) AS nnz FROM x3, dims WHERE v <> 0 GROUP BY 1")(lambda s, d: stats.block_histogram(x := x3(s, d), sizes(x), [16, 128, 4]))
_GRID = "((d0 + 15) // 16) * ((d1 + 127) // 128) * ((d2 + 3) // 4)"
query("block_summary", f"SELECT CAST(any_value({_GRID}) AS BIGINT) AS blocks, CAST(any_value({_GRID}) - count(*) AS BIGINT) AS empty, max(n) AS max_nnz FROM dims, (SELECT {_BLOCK} AS b, count(*) AS n FROM x3, dims GROUP BY 1)")(lambda s, d: stats.block_summary(x := x3(s, d), sizes(x), [16, 128, 4]))
query("blocks_by_size", f"SELECT block, nnz, row_number() OVER (ORDER BY nnz DESC, block) - 1 AS place, CAST((row_number() OVER (ORDER BY nnz DESC, block) - 1) % 4 AS BIGINT) AS worker FROM (SELECT {_BLOCK} AS block, count(*) AS nnz FROM x3, dims GROUP BY 1)")(lambda s, d: stats.blocks_by_size(x := x3(s, d), sizes(x), [16, 128, 4]).withColumn("worker", F.col("place") % 4))
query("semisparse_fibers", "SELECT i0, i2, count(*) AS n, min(i1) AS first, max(i1) AS last FROM x3 GROUP BY i0, i2")(lambda s, d: formats.semisparse_fibers(x3(s, d), 1))
query("inverted_index", f"SELECT i1 AS idx, place // 16 AS chunk, count(*) AS n, list(pos ORDER BY pos) AS positions FROM (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY pos) - 1 AS place FROM ({_LEAF})) GROUP BY 1, 2")(lambda s, d: formats.inverted_index(x3(s, d), 1, 16))

# ---- statistics

_FIB = "SELECT i0, i1, count(*) AS n FROM x3 GROUP BY i0, i1"
_SLC = f"SELECT i0, CAST(sum(n) AS BIGINT) AS nnz, count(*) AS fibers FROM ({_FIB}) GROUP BY i0"
query("fiber_stats", f"SELECT count(DISTINCT i0) AS slices, count(*) AS fibers, min(n) AS min_nnz, max(n) AS max_nnz, sum(n) / count(*) AS avg_nnz FROM ({_FIB})")(lambda s, d: stats.fiber_stats(x3(s, d)))
query("slice_nnz", _SLC)(lambda s, d: stats.slice_nnz(x3(s, d)))
query("slice_bins", f"SELECT CASE WHEN nnz + fibers < 1025 THEN 0 WHEN nnz + fibers < 2049 THEN 5 WHEN nnz + fibers < 4097 THEN 6 WHEN nnz + fibers < 8193 THEN 7 WHEN nnz + fibers < 16385 THEN 8 ELSE 9 END AS bin, count(*) AS slices, CAST(sum(nnz) AS BIGINT) AS nnz FROM ({_SLC}) GROUP BY 1")(lambda s, d: stats.slice_bins(x3(s, d)))
_IMB = "SELECT '{0}' AS what, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, round(stddev_pop(n) / avg(n), 6) AS cv, round(max(n) / avg(n) - 1, 6) AS imbalance FROM ({1})"
query("imbalance_cv", _IMB.format("fibers_per_slice", f"SELECT fibers AS n FROM ({_SLC})") + " UNION ALL " + _IMB.format("nnz_per_fiber", _FIB))(lambda s, d: stats.imbalance(x3(s, d)).select("what", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "cv", "imbalance"))))
query("density", "SELECT round(count(*) / CAST(any_value(d0 * d1 * d2) AS DOUBLE), 12) AS density FROM x3, dims")(lambda s, d: stats.density(x := x3(s, d), sizes(x)).select(F.round("density", 12).alias("density")))
query("fiber_runs", f"SELECT i0, CAST(CASE WHEN big THEN -1 - place ELSE place // 32 END AS BIGINT) AS run, count(*) AS fibers, CAST(sum(n) AS BIGINT) AS nnz FROM (SELECT i0, n, n > 2 AS big, row_number() OVER (PARTITION BY i0, n > 2 ORDER BY i1) - 1 AS place FROM ({_FIB})) GROUP BY 1, 2")(lambda s, d: stats.fiber_runs(x3(s, d), 32, 2))

# ---- contractions

_LINES = "SELECT CAST(l_suppkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS col, CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2"


@query("gemm", f'SELECT s2."row", l.col, sum(v * w) AS v FROM s2 JOIN ({_LINES}) l ON s2.col = k GROUP BY 1, 2')
def _gemm(spark, sf_dir):
    """S2 times the quantities by supplier and line number: an entry meets several of the other side."""
    lines = coo.from_columns(_table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"], "l_quantity")
    return contract.gemm(s2(spark, sf_dir), lines.toDF("row", "col", "v"))


@query("gemv_affine", 'SELECT x AS "row", r AS col, sum(v) AS v FROM (SELECT col AS x, r, v * ((5 * "row" + 2 * r) % 7) AS v FROM s2 CROSS JOIN (SELECT unnest(range(0, 2)) AS r) UNION ALL SELECT x, r, CAST((5 * x + 2 * r) % 7 AS DOUBLE) FROM (SELECT unnest(range(0, (SELECT max(col) + 1 FROM s2))) AS x) CROSS JOIN (SELECT unnest(range(0, 2)) AS r)) GROUP BY 1, 2')
def _gemv_affine(spark, sf_dir):
    """S2 transposed times B, and an offset for each supplier."""
    rows, cols = sizes((m := coo.transpose(s2(spark, sf_dir))).select(F.col("row").alias("i0"), F.col("col").alias("i1"), "v"))
    return contract.affine(m, contract.narrow(_b(spark, cols)), contract.narrow(_b(spark, rows)))



@query("gemm_nations", 'SELECT s2.col AS "row", CAST(c_nationkey AS BIGINT) AS col, sum(v) AS v FROM s2 JOIN customer ON c_custkey = s2."row" GROUP BY 1, 2')
def _gemm_nations(spark, sf_dir):
    """All of S2, transposed, times the nations of the customers."""
    nations = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("row"), F.col("c_nationkey").cast("long").alias("col"), F.lit(1.0).alias("v"))
    return contract.gemm(coo.transpose(s2(spark, sf_dir)), nations)


@query("gemv_affine_all", 'SELECT "row", r AS col, sum(v) AS v FROM (SELECT "row", r, v * ((7 * col + 3 * r) % 11) AS v FROM s2 CROSS JOIN (SELECT unnest(range(0, 3)) AS r) UNION ALL SELECT x, r, CAST((7 * x + 3 * r) % 11 AS DOUBLE) FROM (SELECT unnest(range(0, (SELECT max("row") + 1 FROM s2))) AS x) CROSS JOIN (SELECT unnest(range(0, 3)) AS r)) GROUP BY 1, 2')
def _gemv_affine_all(spark, sf_dir):
    """S2 times A, and an offset for each row of S2."""
    rows, cols = sizes((m := s2(spark, sf_dir)).select(F.col("row").alias("i0"), F.col("col").alias("i1"), "v"))
    return contract.affine(m, contract.narrow(_a(spark, cols)), contract.narrow(_a(spark, rows)))


query("spmm", 'SELECT "row", r AS col, sum(v * u) AS v FROM s2 JOIN fa ON col = x GROUP BY 1, 2')(lambda s, d: contract.narrow(contract.spmm(m := s2(s, d), _a(s, int(m.agg(F.max("col")).first()[0]) + 1)).withColumnRenamed("row", "x")))
query("spmm_identity", "SELECT * FROM s2")(lambda s, d: contract.gemm(m := s2(s, d), fac.identity(s, int(m.agg(F.max("col")).first()[0]) + 1)))
for _m in range(3):
    _keep = ", ".join("r AS i" + str(_m) if k == _m else f"i{k}" for k in range(3))
    query(f"ttm_mode{_m}", f"SELECT {_keep}, sum(v * u) AS v FROM x3 JOIN fa ON i{_m} = x GROUP BY ALL")(lambda s, d, m=_m: contract.ttm(x := x3(s, d), _a(s, sizes(x)[m]), m))
query("ttm_chain", "SELECT i0, fa.r AS i1, fb.r AS i2, sum(v * fa.u * fb.u) AS v FROM x3 JOIN fa ON i1 = fa.x JOIN fb ON i2 = fb.x GROUP BY ALL")(lambda s, d: contract.ttm_chain(x := x3(s, d), _factors(s, x, 0), [2, 1]))
_TTMC = {m: "SELECT i{0}, fa.r AS r0, fb.r AS r1, sum(v * fa.u * fb.u) AS v FROM x3 JOIN fa ON i{1} = fa.x JOIN fb ON i{2} = fb.x GROUP BY ALL".format(m, *[k for k in range(3) if k != m]) for m in range(3)}
for _m in range(3):
    query(f"ttmc_aao_m{_m}", _TTMC[_m])(lambda s, d, m=_m: contract.ttmc(x := x3(s, d), _factors(s, x, m), m, "aao"))
    query(f"ttmc_fnf_m{_m}", _TTMC[_m])(lambda s, d, m=_m: contract.ttmc(x := x3(s, d), _factors(s, x, m), m, "fused"))
query("ttmc_salted", _TTMC[2])(lambda s, d: contract.ttmc(x := x3(s, d), _factors(s, x, 2), 2, "salted"))
query("ttmc_auto", _TTMC[0])(lambda s, d: planner.ttmc_auto(x := x3(s, d), _factors(s, x, 0), 0))
for _m in range(4):
    _r = [k for k in range(4) if k != _m]
    query(f"ttmc4_m{_m}", f"SELECT i{_m}, fa.r AS r0, fb.r AS r1, fc.r AS r2, sum(v * fa.u * fb.u * fc.u) AS v FROM x4 JOIN fa ON i{_r[0]} = fa.x JOIN fb ON i{_r[1]} = fb.x JOIN fc ON i{_r[2]} = fc.x GROUP BY ALL")(lambda s, d, m=_m: contract.ttmc(x := x4(s, d), _factors(s, x, m), m))


def _f3(spark: SparkSession, x: DataFrame, keep: int) -> dict[int, DataFrame]:
    return {m: fac.modular(spark, n, 3, 7, 3, 11) if m == min(k for k in range(len(sizes_)) if k != keep) else fac.modular(spark, n, 3, 5, 2, 7) for sizes_ in [sizes(x)] for m, n in enumerate(sizes_) if m != keep}


for _m in range(3):
    _r = [k for k in range(3) if k != _m]
    query(f"mttkrp_m{_m}", f"SELECT i{_m}, r, sum(v * ((7 * i{_r[0]} + 3 * r) % 11) * ((5 * i{_r[1]} + 2 * r) % 7)) AS v FROM x3 CROSS JOIN (SELECT unnest(range(0, 3)) AS r) GROUP BY ALL")(lambda s, d, m=_m: contract.mttkrp(x := x3(s, d), _f3(s, x, m), m, "aao"))
query("mttkrp_fnf", "SELECT i0, r, sum(v * ((7 * i1 + 3 * r) % 11) * ((5 * i2 + 2 * r) % 7)) AS v FROM x3 CROSS JOIN (SELECT unnest(range(0, 3)) AS r) GROUP BY ALL")(lambda s, d: contract.mttkrp(x := x3(s, d), _f3(s, x, 0), 0, "fused"))
query("mttkrp4", "SELECT i0, r, sum(v * ((7 * i1 + 3 * r) % 11) * ((5 * i2 + 2 * r) % 7) * ((5 * i3 + 2 * r) % 7)) AS v FROM x4 CROSS JOIN (SELECT unnest(range(0, 3)) AS r) GROUP BY ALL")(lambda s, d: contract.mttkrp(x := x4(s, d), _f3(s, x, 0), 0))

_MANY = (12, 10)
_MANY_SQL = f"SELECT i0, CAST(b.r * {_MANY[1]} + c.r AS INTEGER) AS cell, sum(v * b.u * c.u) AS v FROM x3 JOIN (SELECT x, r, CAST((5 * x + 2 * r) % 7 AS DOUBLE) AS u FROM (SELECT DISTINCT i1 AS x FROM x3) CROSS JOIN (SELECT unnest(range(0, {_MANY[0]})) AS r)) b ON b.x = i1 JOIN (SELECT x, r, CAST((3 * x + 5 * r) % 13 AS DOUBLE) AS u FROM (SELECT DISTINCT i2 AS x FROM x3) CROSS JOIN (SELECT unnest(range(0, {_MANY[1]})) AS r)) c ON c.x = i2 GROUP BY 1, 2"


def _many_ranks(spark, sf_dir, strategy):
    """X3 times factors of ranks 12 and 10: 120 cells for each supplier, in one array."""
    x = x3(spark, sf_dir)
    dims = sizes(x)
    f = {1: fac.modular(spark, dims[1], _MANY[0], 5, 2, 7), 2: fac.modular(spark, dims[2], _MANY[1], 3, 5, 13)}
    return contract.ttmc_rows(x, f, 0, strategy).select("i0", F.posexplode("y").alias("cell", "v"))


query("ttmc_rows_m0", _MANY_SQL)(lambda s, d: _many_ranks(s, d, "fused"))
query("ttmc_rows_salted", _MANY_SQL)(lambda s, d: _many_ranks(s, d, "salted"))

# ---- linear algebra

query("gram", "SELECT a.r AS \"row\", b.r AS col, sum(a.u * b.u) AS v FROM fa a JOIN fa b ON a.x = b.x WHERE a.x < (SELECT d1 FROM dims) GROUP BY 1, 2")(lambda s, d: linalg.gram(f := _a(s, sizes(x3(s, d))[1]), f.columns[1:]))
_SUP = 'SELECT a.col AS "row", b.col AS col, sum(a.v * b.v) AS v FROM s2 a JOIN s2 b ON a."row" = b."row" GROUP BY 1, 2'
query("gram_self_join", _SUP)(lambda s, d: linalg.gram_self_join(s2(s, d)))
query("gram_trace", "SELECT sum(v * v) AS trace FROM s2")(lambda s, d: linalg.gram_trace(s2(s, d)))
query("embedding_gram", 'SELECT CAST(a.p AS BIGINT) AS "row", CAST(b.p AS BIGINT) AS col, round(sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)), 4) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) a JOIN (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) b USING (vec_id) GROUP BY 1, 2')(lambda s, d: _embedding_gram(s, d))


def _embeddings(spark, sf_dir):
    """The embeddings as a factor (x, u0, ...)."""
    e = _table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    return e.select(F.col("vec_id").alias("x"), *(F.coalesce(F.try_element_at("embedding", F.lit(k + 1)).cast("double"), F.lit(0.0)).alias(f"u{k}") for k in range(n)))


def _embedding_gram(spark, sf_dir):
    f = _embeddings(spark, sf_dir)
    return linalg.gram(f, f.columns[1:]).select("row", "col", F.round("v", 4).alias("v"))


@query("svd_topr")
def _svd_topr(spark, sf_dir):
    """The four greatest singular values of the embeddings, by their Gram matrix."""
    f = _embeddings(spark, sf_dir)
    values, _ = linalg.top_eigen(linalg.local(linalg.gram(f, f.columns[1:]), len(f.columns) - 1), 4)
    return spark.createDataFrame([(k, round(float(np.sqrt(max(v, 0))), 6)) for k, v in enumerate(values)], "k int, sigma double")


@query("orthonormal_check", "SELECT round(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), 4) AS energy, 0.0::DOUBLE AS off FROM (SELECT unnest(embedding) AS v FROM embeddings)")
def _orthonormal_check(spark, sf_dir):
    """The left singular vectors of the embeddings: squared lengths times eigenvalues add up to the squared norm, and no two overlap."""
    f = _embeddings(spark, sf_dir)
    u, sigma = linalg.left_singular(written(f, "embeddings"), f.columns[1:], len(f.columns) - 1)
    g = linalg.local(linalg.gram(u, u.columns[1:]), len(sigma))
    off = np.abs(g - np.diag(np.diag(g))).max(initial=0)
    return spark.createDataFrame([(round(float((np.diag(g) * sigma**2).sum()), 4), round(float(off), 6))], "energy double, off double")


_EMB = "SELECT vec_id AS x, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
_EMB_G = f"SELECT a.p AS p, b.p AS q, sum(a.v * b.v) AS g FROM ({_EMB}) a JOIN ({_EMB}) b USING (x) GROUP BY 1, 2"


_EIGHT = f"WITH RECURSIVE g AS MATERIALIZED ({_EMB_G}), {', '.join(expected.eigenpairs('g', 8))}"
SQL["svd_topr"] = f"{_EIGHT} SELECT k, round(sqrt(greatest(0, any_value(l))), 6) AS sigma FROM g_e WHERE k < 4 GROUP BY k"
SQL["resolution_test"] = f"{_EIGHT} SELECT min(gap) > 2 * ((SELECT count(*) FROM embeddings) + (SELECT max(p) + 1 FROM g)) * 1.11e-16 * (SELECT sum(g) FROM g WHERE p = q) AS resolved FROM (SELECT abs(l - lead(l) OVER (ORDER BY k)) AS gap FROM (SELECT DISTINCT k, l FROM g_e))"


@query("tsqr_moments", f"WITH g AS ({_EMB_G}) SELECT 1 AS power, round(sum(g) FILTER (p = q), 4) AS total FROM g UNION ALL SELECT 2, round(sum(g * g), 3) FROM g UNION ALL SELECT 3, round(sum(a.g * b.g * c.g), 2) FROM g a JOIN g b ON a.q = b.p JOIN g c ON b.q = c.p AND c.q = a.p")
def _tsqr_moments(spark, sf_dir):
    """Sums of the second, fourth and sixth powers of all singular values of the embeddings, by TSQR: traces of the Gram matrix's powers."""
    f = _embeddings(spark, sf_dir)
    sigma = np.linalg.svd(svd.triangle(f, f.columns[1:]), compute_uv=False)
    return spark.createDataFrame([(p, round(float((sigma ** (2 * p)).sum()), 5 - p)) for p in (1, 2, 3)], "power int, total double")


_MOMENTS = 16


@query("tsqr_fallback", f"SELECT i0 AS \"row\", k AS col, round(sum(pow(v / 50, k)), 6) AS v, 'tsqr' AS way FROM x3 CROSS JOIN (SELECT unnest(range(0, {_MOMENTS})) AS k) GROUP BY 1, 2")
def _tsqr_fallback(spark, sf_dir):
    """U S V' of the moments of suppliers' quantities, so nearly dependent that the Gram matrix can't tell its eigenvalues apart."""
    x = x3(spark, sf_dir)
    y = written(x.groupBy(F.col("i0").alias("x")).agg(*(F.sum(F.pow(F.col("v") / 50, F.lit(k))).alias(f"u{k}") for k in range(_MOMENTS))), "moments")
    found = svd.singular(y, y.columns[1:], _MOMENTS)
    again = linalg.project(found.u, found.u.columns[1:], (found.v * found.sigma).T)
    return contract.narrow(again).select("row", "col", F.round("v", 6).alias("v"), F.lit(found.way).alias("way"))


_SIDES = {0: ("i0", "i1, i2"), 2: ("i2", "i0, i1")}
_NVECS = " UNION ALL ".join(f"SELECT {m} AS mode, (SELECT sum(v * v) FROM x3) AS second, sum(g * g) AS fourth FROM (SELECT sum(a.v * b.v) AS g FROM x3 a JOIN x3 b USING ({rest}) GROUP BY a.{row}, b.{row})" for m, (row, rest) in _SIDES.items())


@query("nvecs_moments", f"SELECT mode, round(second / 1e6, 4) AS second, round(fourth / 1e12, 4) AS fourth FROM ({_NVECS})")
def _nvecs_moments(spark, sf_dir):
    """All singular values of two unfoldings of X3 with few rows and many columns: their second and fourth powers."""
    x = written(x3(spark, sf_dir), "nvecs-x")
    dims = sizes(x)
    sums = {m: svd.power_sums(coo.unfold(x, m, dims), dims[m], int(np.prod([d for k, d in enumerate(dims) if k != m]))) for m in _SIDES}
    return spark.createDataFrame([(m, round(second / 1e6, 4), round(fourth / 1e12, 4)) for m, (second, fourth) in sums.items()], "mode int, second double, fourth double")


_POWER_STEPS = 12
_POWER = ", ".join(["p0 AS (SELECT DISTINCT col AS x, 1.0::DOUBLE AS u FROM s2)"] + [f"q{k} AS (SELECT \"row\" AS x, sum(v * u) AS u FROM s2 JOIN p{k} ON x = col GROUP BY 1), r{k} AS (SELECT col AS x, sum(v * u) AS u FROM s2 JOIN q{k} ON x = \"row\" GROUP BY 1), p{k + 1} AS (SELECT x, u / (SELECT sqrt(sum(u * u)) FROM r{k}) AS u FROM r{k})" for k in range(_POWER_STEPS)])


@query("svd_power")
def _svd_power(spark, sf_dir):
    """The greatest singular value of S2 by block power iteration: customers and suppliers may both be many."""
    found = svd.iterated(s2(spark, sf_dir), 1, tolerance=1e-10)
    return spark.createDataFrame([(round(float(found.sigma[0]), 4),)], "sigma double")


SQL["svd_power"] = f"WITH s2 AS ({VIEWS['s2']}), {_POWER} SELECT round(sqrt(sum(u * u)), 4) AS sigma FROM (SELECT \"row\", sum(v * u) AS u FROM s2 JOIN p{_POWER_STEPS} ON x = col GROUP BY 1)"


@query("resolution_test")
def _resolution(spark, sf_dir):
    """Whether the greatest eigenvalues of the embeddings' Gram matrix can be told apart."""
    f = _embeddings(spark, sf_dir)
    g = linalg.local(linalg.gram(f, f.columns[1:]), len(f.columns) - 1)
    values, _ = linalg.top_eigen(g, 8)
    return spark.createDataFrame([(bool(linalg.resolved(values, f.count(), len(g), float(np.trace(g)))),)], "resolved boolean")


query("least_squares", "SELECT i0 AS x, round(sum(v * a) / (0.5 + sum(a * a)), 9) AS u0 FROM (SELECT i0, v, CAST((7 * i1) % 11 AS DOUBLE) AS a FROM x3) GROUP BY 1")(lambda s, d: linalg.ridge_rows(x3(s, d).select(F.col("i0").alias("x"), ((F.col("i1") * 7) % 11).cast("double").alias("d0"), "v"), 1, 0.5).select("x", F.round("u0", 9).alias("u0")))

# ---- Tucker

_FULL = "FROM x3 JOIN fa ON i0 = fa.x JOIN fb ON i1 = fb.x JOIN fc ON i2 = fc.x"
_CORE = f"SELECT fa.r AS r0, fb.r AS r1, fc.r AS r2, sum(v * fa.u * fb.u * fc.u) AS v {_FULL} GROUP BY 1, 2, 3"


def _fixed(spark, sf_dir):
    """X3, its factors A, B, C in mode order, and a fixed core of (r0 + 2 r1 + 3 r2) mod 4."""
    x = x3(spark, sf_dir)
    f = list(_factors(spark, x, None).values())
    core = np.array([[[float((p + 2 * q + 3 * r) % 4) for r in range(RANKS[2])] for q in range(RANKS[1])] for p in range(RANKS[0])])
    return x, f, core


query("tucker_core_fixed", _CORE)(lambda s, d: tucker.core(*_fixed(s, d)[:2]))



@query("core_norm_fit_fixed", f"SELECT core_sq, round(1 - sqrt(greatest(0, norm_sq - core_sq / scale)) / sqrt(norm_sq), 9) AS fit FROM (SELECT (SELECT sum(v * v) FROM ({_CORE})) AS core_sq, (SELECT sum(v * v) FROM x3) AS norm_sq, (SELECT sum(u * u) FROM fa WHERE x < (SELECT d0 FROM dims)) * (SELECT sum(u * u) FROM fb WHERE x < (SELECT d1 FROM dims)) * (SELECT sum(u * u) FROM fc WHERE x < (SELECT d2 FROM dims)) AS scale)")
def _core_norm_fit(spark, sf_dir):
    """The squared norm of the core, and the fit that the factors would have, were they orthonormal when divided by their norms."""
    x, f, _ = _fixed(spark, sf_dir)
    core_sq = float(tucker.core(x, f).agg(F.sum(F.col("v") * F.col("v"))).first()[0])
    scale = float(np.prod([linalg.trace(linalg.gram(g, g.columns[1:])).first()[0] for g in f]))
    fit = tucker.fit_of_core(float(coo.norm(x).first()["norm_sq"]), core_sq / scale)
    return spark.createDataFrame([(core_sq, round(fit, 9))], "core_sq double, fit double")



_G = "CAST((p + 2 * q + 3 * t) % 4 AS DOUBLE)"
_RECON = f"SELECT i0, i1, i2, any_value(v) AS v, sum({_G} * fa.u * fb.u * fc.u) AS vhat FROM (SELECT i0, i1, i2, v, fa.r AS p, fb.r AS q, fc.r AS t, fa.u AS ua, fb.u AS ub, fc.u AS uc {_FULL}) GROUP BY 1, 2, 3".replace("fa.u * fb.u * fc.u)", "ua * ub * uc)")
_DELTA = f"SELECT i0, i1, i2, any_value(v) AS v, p AS r, sum({_G} * ub * uc) AS d FROM (SELECT i0, i1, i2, v, p, fb.r AS q, fc.r AS t, fb.u AS ub, fc.u AS uc FROM x3 JOIN fb ON i1 = fb.x JOIN fc ON i2 = fc.x CROSS JOIN (SELECT unnest(range(0, 3)) AS p)) GROUP BY 1, 2, 3, 5"
query("als_delta", f"SELECT i0, i1, i2, max(v) AS v, max(d) FILTER (r = 0) AS d0, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2 FROM ({_DELTA}) GROUP BY 1, 2, 3")(lambda s, d: tucker.deltas(*_fixed(s, d), 0))
query("als_normal_b", f"SELECT a.i0 AS i, a.r AS r1, b.r AS r2, sum(a.d * b.d) AS b FROM ({_DELTA}) a JOIN ({_DELTA}) b USING (i0, i1, i2) GROUP BY 1, 2, 3")(lambda s, d: tucker.normal_equations(*_fixed(s, d), 0)[0])
query("als_normal_c", f"SELECT i0 AS i, r, sum(v * d) AS c FROM ({_DELTA}) GROUP BY 1, 2")(lambda s, d: tucker.normal_equations(*_fixed(s, d), 0)[1])
query("reconstruct_observed", _RECON)(lambda s, d: tucker.reconstruct(*_fixed(s, d)))
_MNORM = f"""SELECT sum(CAST((a.p + 2 * a.q + 3 * a.t) % 4 AS DOUBLE) * CAST((b.p + 2 * b.q + 3 * b.t) % 4 AS DOUBLE) * ga.v * gb.v * gc.v) AS n
 FROM (SELECT * FROM (SELECT unnest(range(0, 3)) AS p), (SELECT unnest(range(0, 2)) AS q), (SELECT unnest(range(0, 2)) AS t)) a, (SELECT * FROM (SELECT unnest(range(0, 3)) AS p), (SELECT unnest(range(0, 2)) AS q), (SELECT unnest(range(0, 2)) AS t)) b,
 (SELECT a.r AS r, b.r AS s, sum(a.u * b.u) AS v FROM fa a JOIN fa b USING (x) WHERE x < (SELECT d0 FROM dims) GROUP BY 1, 2) ga, (SELECT a.r AS r, b.r AS s, sum(a.u * b.u) AS v FROM fb a JOIN fb b USING (x) WHERE x < (SELECT d1 FROM dims) GROUP BY 1, 2) gb, (SELECT a.r AS r, b.r AS s, sum(a.u * b.u) AS v FROM fc a JOIN fc b USING (x) WHERE x < (SELECT d2 FROM dims) GROUP BY 1, 2) gc
 WHERE ga.r = a.p AND ga.s = b.p AND gb.r = a.q AND gb.s = b.q AND gc.r = a.t AND gc.s = b.t"""
query("model_norm_sq", f"SELECT n AS norm_sq FROM ({_MNORM})")(lambda s, d: s.createDataFrame([(tucker.model_norm_sq(*_fixed(s, d)[1:]),)], "norm_sq double"))
_FITS = f"SELECT round(1 - sqrt(sum((v - vhat) * (v - vhat))) / sqrt(sum(v * v)), 6) AS observed, round(1 - sqrt(greatest(0, sum(v * v) + (SELECT n FROM ({_MNORM})) - 2 * sum(v * vhat))) / sqrt(sum(v * v)), 6) AS full_ FROM ({_RECON})"


@query("observed_and_full_fit", _FITS)
def _fits(spark, sf_dir):
    observed, full = tucker.fits(*_fixed(spark, sf_dir))
    return spark.createDataFrame([(round(observed, 6), round(full, 6))], "observed double, full_ double")


#: Decompositions start from cells (a x + b r) mod m, so that SQL can go the same way.
_STARTS = ((7, 3, 11), (5, 2, 7), (3, 5, 5))


def _started(spark, x, ranks):
    """X, written once, its sizes and its first factors."""
    x = written(x, "decomposed-x")
    dims = sizes(x)
    return x, dims, [fac.modular(spark, d, r, *s) for d, r, s in zip(dims, ranks, _STARTS, strict=True)]


def _fit_rows(spark, fits, digits):
    return spark.createDataFrame([(k, round(float(f), digits)) for k, f in enumerate(fits)], "sweep int, fit double")


_X3 = f"WITH RECURSIVE x3 AS MATERIALIZED ({VIEWS['x3']}), "


@query("hooi_fit")
def _hooi(spark, sf_dir):
    """Fits of three sweeps of orthogonal iteration on X3, from the last mode to the first."""
    x, dims, start = _started(spark, x3(spark, sf_dir), (3, 3, 2))
    return _fit_rows(spark, tucker.hooi(x, dims, (3, 3, 2), sweeps=3, tolerance=0.0, start=start).fits, 8)


@query("hooi_rows_fit")
def _hooi_rows(spark, sf_dir):
    """hooi_fit with an array for each index, as ranks with a large product have."""
    x, dims, start = _started(spark, x3(spark, sf_dir), (3, 3, 2))
    return _fit_rows(spark, tucker.hooi(x, dims, (3, 3, 2), sweeps=1, tolerance=0.0, start=start, columns=1).fits, 8)


SQL["hooi_rows_fit"] = _X3 + expected.hooi_fits("x3", _STARTS, (3, 3, 2), 1, (2, 1, 0))
SQL["hooi_fit"] = _X3 + expected.hooi_fits("x3", _STARTS, (3, 3, 2), 3, (2, 1, 0))


@query("hooi_chain_fit")
def _hooi_chain(spark, sf_dir):
    """Fits of two sweeps from the first mode to the last, with one factor after the other."""
    x, dims, start = _started(spark, x3(spark, sf_dir), (3, 3, 2))
    return _fit_rows(spark, tucker.hooi_chain(x, dims, (3, 3, 2), sweeps=2, tolerance=0.0, start=start).fits, 8)


SQL["hooi_chain_fit"] = _X3 + expected.hooi_fits("x3", _STARTS, (3, 3, 2), 2, (0, 1, 2))


@query("als_fit")
def _als(spark, sf_dir):
    """Fits of two sweeps of ridge regression by rows, under a core of 1 + (r0 + 2 r1 + 3 r2) mod 4."""
    x, dims, start = _started(spark, x3(spark, sf_dir), (2, 2, 2))
    core = np.array([[[float(1 + (p + 2 * q + 3 * r) % 4) for r in range(2)] for q in range(2)] for p in range(2)])
    return _fit_rows(spark, tucker.als(x, dims, 2, sweeps=2, tolerance=-1.0, start=start, core_=core).fits, 6)


SQL["als_fit"] = _X3 + expected.als_fits("x3", _STARTS, "1 + (r0 + 2 * r1 + 3 * r2) % 4", 2, 1e-4)


# ---- sources and sinks: what is written from a table is read again


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("tns_parse_header", "SELECT * FROM x3")
def _tns_header(spark, sf_dir):
    """X3 written with its header, and read within the sizes that the header names."""
    x, at = written(x3(spark, sf_dir), "tns-x"), _place(spark, "tns")
    text.write_tns(x, at, text.with_header(x)["dims"])
    found, dims = text.read_tns(spark, at, strict=True)
    return coo.inside(found, dims)


@query("tns_parse_headerless", "SELECT * FROM x4")
def _tns(spark, sf_dir):
    at = _place(spark, "tns")
    text.write_tns(x4(spark, sf_dir), at)
    return text.read_tns(spark, at)[0]


query("header_infer", "SELECT 3 AS ord, d0, d1, d2 FROM dims")(lambda s, d: (lambda h: s.createDataFrame([(h["order"], *h["dims"])], "ord int, d0 long, d1 long, d2 long"))(text.with_header(x3(s, d))))


@query("tns_directory", "SELECT i0 % 3 AS part, count(*) AS nnz, sum(v) AS total FROM x3 GROUP BY 1")
def _tns_directory(spark, sf_dir):
    """X3 in three folders, told apart by their names."""
    at, x = _place(spark, "dir"), written(x3(spark, sf_dir), "dir-x")
    for k in range(3):
        text.write_tns(x.where(F.col("i0") % 3 == k), f"{at}/part{k}")
    rows = text.read_directory(spark, f"{at}/part*", 3, "part-*", named_by=-2)
    return rows.groupBy(F.substring("file", 5, 1).cast("long").alias("part")).agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").alias("total"))


@query("mtx_parse", "SELECT * FROM s2")
def _mtx(spark, sf_dir):
    m, at = s2(spark, sf_dir), _place(spark, "mtx")
    rows, cols = m.agg(F.max("row") + 1, F.max("col") + 1).first()
    text.write_mtx(m, at, rows, cols)
    return text.read_mtx(spark, at)[0]


@query("mtx_symmetric_all", 'SELECT "row", col, v FROM s2 WHERE "row" >= col UNION ALL SELECT col, "row", v FROM s2 WHERE "row" > col')
def _mtx_symmetric_all(spark, sf_dir):
    """All entries of S2 on and below the diagonal, as symmetric storage."""
    m, at = s2(spark, sf_dir).where("row >= col"), _place(spark, "mtx")
    size = m.agg(F.max("row") + 1).first()[0]
    text.write_mtx(m, at, size, size, symmetric=True)
    return text.read_mtx(spark, at)[0]


@query("mtx_symmetric", _SUP)
def _mtx_symmetric(spark, sf_dir):
    """The Gram matrix of S2, written as its lower half and read whole."""
    upper, at = linalg.gram_self_join(s2(spark, sf_dir), both=False), _place(spark, "mtx")
    text.write_mtx(upper.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"), at, symmetric=True, compression="gzip")
    return text.read_mtx(spark, at)[0]


@query("csf_text_roundtrip", "SELECT * FROM x4")
def _csf_text(spark, sf_dir):
    """X4 as a labelled text whose arrays take many lines, and read again."""
    x, at = x4(spark, sf_dir), _place(spark, "csf")
    with cleaning(spark):
        text.csf_lines(x, sizes(x), size=1024).select("value").write.text(at)
    return text.csf_to_coo(text.parse_csf(spark.read.text(at)), 4)


_FLAGS = "SELECT CAST(month(l_shipdate) - 1 AS BIGINT) AS i0, CAST(l_linenumber AS BIGINT) AS i1, CAST(l_discount * 100 AS BIGINT) AS i2, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3"


@query("csf_positional_roundtrip", _FLAGS.replace("CAST(l_discount * 100 AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)"))
def _csf_positional(spark, sf_dir):
    """All order lines by month, line number and discount, as the seven lines of a small tree."""
    x = coo.from_columns(_table(spark, sf_dir, "lineitem"), [F.month("l_shipdate") - 1, "l_linenumber", F.round(F.col("l_discount") * 100)], "l_quantity")
    numbers = text.csf_lines(x, sizes(x)).where("n >= 10").select("n", F.substring_index("value", ": ", -1).alias("value"))
    lines = numbers.select(F.when(F.col("n") == 1000, 6).otherwise(F.col("n") - 10).alias("n"), "value")
    return text.csf_to_coo(text.parse_positional_csf(lines), 3)


@query("dense_tensor_roundtrip", f"WITH m AS ({_MONTHS}) SELECT a AS i0, b AS i1, coalesce(v, 0) AS v FROM (SELECT unnest(range(0, (SELECT max(i0) + 1 FROM m))) AS a) CROSS JOIN (SELECT unnest(range(0, (SELECT max(i1) + 1 FROM m))) AS b) LEFT JOIN m ON a = i0 AND b = i1")
def _dense_tensor(spark, sf_dir):
    """All order lines by month and line number as row-major text of few numbers a line."""
    x, at = coo.from_columns(_table(spark, sf_dir, "lineitem"), [F.month("l_shipdate") - 1, "l_linenumber"], "l_quantity"), _place(spark, "dense")
    text.write_dense_tensor(x, sizes(x), at, per_line=5)
    return text.read_dense_tensor(spark, at)[0]


@query("dense_file_or_ones", 'SELECT x AS "row", r AS col, CASE WHEN r = 2 THEN 1.0::DOUBLE ELSE u END AS v FROM fb WHERE x < (SELECT d0 FROM dims) UNION ALL SELECT x, 2, 1.0 FROM (SELECT DISTINCT x FROM fb) WHERE x < (SELECT d0 FROM dims)')
def _dense_or_ones(spark, sf_dir):
    """The factor B of the suppliers from a dense text file, and beside it ones, as the other file is absent."""
    n, at = sizes(x3(spark, sf_dir))[0], _place(spark, "dense")
    text.dense_lines(contract.narrow(_b(spark, n)), 2).orderBy("row").select("value").write.text(at)
    ones = text.read_dense(spark, f"{at}-absent", 1, ones=n)
    return text.read_dense(spark, at, 2).unionByName(ones.withColumn("col", F.lit(2).cast("long")))


@query("tns_observed", "SELECT d0, d1, d2, (SELECT count(*) FROM x3) AS entries, (SELECT count(*) FROM x3 WHERE i2 % 2 = 0) AS drawn, 1 AS malformed, (SELECT sum(v) FROM x3 WHERE i2 % 2 = 1) AS total, 0 AS outside FROM dims")
def _tns_observed(spark, sf_dir):
    """X3 as text, every other line number without values, and what one pass over it sees."""
    x, at = x3(spark, sf_dir), _place(spark, "tns")
    value = F.when(F.col("i2") % 2 == 1, F.col("v").cast("string"))
    lines = x.select(F.concat_ws(" ", *((F.col(f"i{k}") + 1).cast("string") for k in range(3)), value).alias("value"))
    lines.unionByName(spark.createDataFrame([("1 one 1 1",)], "value string")).write.text(at)
    found, seen = text.read_observed(spark, at, 3)
    kept = found.agg(F.sum(F.when(F.col("i2") % 2 == 1, F.col("v"))).alias("total"), F.count_if((F.col("i2") % 2 == 0) & ~((F.col("v") > 0) & (F.col("v") < 1))).alias("outside"))
    of = {**{f"d{k}": d for k, d in enumerate(seen["dims"])}, **{k: seen[k] for k in ("entries", "drawn", "malformed")}}
    return kept.select(*(F.lit(v).cast("long").alias(k) for k, v in of.items()), "total", "outside")


@query("csf_text_roundtrip_all", "SELECT * FROM x3")
def _csf_text_all(spark, sf_dir):
    x = x3(spark, sf_dir)
    return text.csf_to_coo(text.parse_csf(text.csf_lines(x, sizes(x)).select("value")), 3)


@query("dense_text_roundtrip", 'SELECT x AS "row", r AS col, u AS v FROM fa WHERE x < (SELECT d1 FROM dims)')
def _dense_text(spark, sf_dir):
    return text.parse_dense(text.dense_lines(contract.narrow(_a(spark, sizes(x3(spark, sf_dir))[1])), RANKS[0]), RANKS[0])


@query("result_lines", "SELECT -1 AS \"row\", (max(\"row\") + 1) || ' x 3 matrix' AS value FROM s2 UNION ALL SELECT \"row\", string_agg(printf('%.2f', v), chr(9) ORDER BY r) FROM (SELECT \"row\", r, sum(v * u) AS v FROM s2 JOIN fa ON col = x GROUP BY 1, 2) GROUP BY 1")
def _result_lines(spark, sf_dir):
    """The product of S2 and A as text with two decimals."""
    m = contract.narrow(contract.spmm(s := s2(spark, sf_dir), _a(spark, int(s.agg(F.max("col")).first()[0]) + 1)).withColumnRenamed("row", "x"))
    return binary.result_lines(m, m.agg(F.max("row")).first()[0] + 1, RANKS[0])


@query("factor_bin_roundtrip", "SELECT x AS idx, list(u ORDER BY r) AS \"row\" FROM fa WHERE x < (SELECT d1 FROM dims) GROUP BY x")
def _factor_bin(spark, sf_dir):
    """The factor A of the parts as a folder of binary files, written and read in ranges."""
    at = _place(spark, "factor")
    factor_source.write_factor(_a(spark, sizes(x3(spark, sf_dir))[1]), at, rows=500)
    return factor_source.read_factor(spark, at)


@query("model_files_roundtrip", "SELECT 0 AS mode, x AS idx, list(u ORDER BY r) AS \"row\" FROM fa WHERE x < (SELECT d0 FROM dims) GROUP BY x UNION ALL SELECT 1, x, list(u ORDER BY r) FROM fb WHERE x < (SELECT d1 FROM dims) GROUP BY x UNION ALL SELECT 2, x, list(u ORDER BY r) FROM fc WHERE x < (SELECT d2 FROM dims) GROUP BY x UNION ALL SELECT -1, p, list(CAST((p + 2 * q + 3 * t) % 4 AS DOUBLE) ORDER BY q, t) FROM (SELECT unnest(range(0, 3)) AS p) CROSS JOIN (SELECT unnest(range(0, 2)) AS q) CROSS JOIN (SELECT unnest(range(0, 2)) AS t) GROUP BY p")
def _model_files(spark, sf_dir):
    """A model of X3 as mode0.bin, mode1.bin, mode2.bin and core.bin, written and read: all rows of the factors, and the core's (-1)."""
    _, f, core = _fixed(spark, sf_dir)
    at = _place(spark, "model")
    factor_source.write_model_files(tucker.Tucker(f, core), at)
    model = factor_source.read_model_files(spark, at)
    out = spark.createDataFrame([(-1, p, [float(v) for v in model.core[p].ravel()]) for p in range(len(model.core))], "mode int, idx long, row array<double>")
    for m, g in enumerate(model.factors):
        out = out.unionByName(g.select(F.lit(m).alias("mode"), F.col("x").alias("idx"), F.array(*g.columns[1:]).alias("row")))
    return out


@query("flat_vector", "SELECT list(n ORDER BY i0) AS flat FROM (SELECT i0, count(*) AS n FROM x3 GROUP BY i0)")
def _flat_vector(spark, sf_dir):
    """The non-zeros of each slice as one line of numbers."""
    lines = text.flat_lines(stats.slice_nnz(x3(spark, sf_dir)), "i0", "nnz")
    return lines.groupBy().agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("begin", "value"))), lambda c: F.transform(F.split(c["value"], " "), lambda n: n.cast("long")))).alias("flat"))


# ---- table functions


@query("udtf_fibers", "SELECT i0, i1, row_number() OVER (PARTITION BY i0 ORDER BY i1) - 1 AS fiber, CAST(sum(n) OVER w AS BIGINT) - n AS ptr_begin, CAST(sum(n) OVER w AS BIGINT) AS ptr_end FROM (SELECT i0, i1, count(*) AS n FROM x3 GROUP BY i0, i1) WINDOW w AS (PARTITION BY i0 ORDER BY i1)")
def _udtf_fibers(spark, sf_dir):
    """The fibers of X3 by a table function, a partition for each slice."""
    table_functions.register(spark)
    return spark.sql("SELECT * FROM csf_fibers(TABLE(SELECT i0, i1, i2 FROM {x}) PARTITION BY i0 ORDER BY (i1, i2))", x=x3(spark, sf_dir))


@query("udtf_ttmc", _TTMC[0])
def _udtf_ttmc(spark, sf_dir):
    """X3 times A and B by a table function, as ttmc_fnf_m0."""
    table_functions.register(spark)
    x = x3(spark, sf_dir)
    f = _factors(spark, x, 0)
    wide = lambda m: f[m].select("x", F.array(*f[m].columns[1:]).alias("u"))
    return spark.sql("SELECT * FROM ttmc_slices(TABLE(SELECT i0, a.u AS a, b.u AS b, v FROM {x} JOIN {a} a ON i1 = a.x JOIN {b} b ON i2 = b.x) PARTITION BY i0)", x=x, a=wide(1), b=wide(2))


# ---- generators

query("gen_closed_form", "SELECT x AS \"row\", r AS col, u AS v FROM fb WHERE x < (SELECT d1 FROM dims)")(lambda s, d: contract.narrow(_b(s, sizes(x3(s, d))[1])))


@query("gen_like_sparse")
def _gen_sparse(spark, sf_dir):
    """A tensor of the sizes and density of X3: its counts by slice."""
    x = x3(spark, sf_dir)
    dims = sizes(x)
    made = generate.sparse_tensor(spark, dims, density=x.count() / float(np.prod(dims)), fiber_density=stats.fiber_stats(x).first()["fibers"] / float(dims[0] * dims[1]))
    return stats.slice_nnz(made)


query("gen_resampled")(lambda s, d: stats.imbalance(generate.resampled(x := x3(s, d), sizes(x))))
query("gen_factor_uniform")(lambda s, d: contract.narrow(fac.uniform(s, sizes(x3(s, d))[1], 3)).groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
query("gen_factor_orthonormal")(lambda s, d: linalg.gram(f := fac.orthonormal(s, sizes(x3(s, d))[1], 4), f.columns[1:]).select("row", "col", F.round("v", 6).alias("v")))

# ---- comparing, and the analysis of runs (orders and events stand in for logs)

_DIFF = "SELECT max(abs(a - b)) AS max_abs, max(abs(a - b)) / max(abs(b)) AS rel, count(*) FILTER (abs(b) > 1e-4 AND abs(a - b) / abs(b) > 1e-4) AS n_significant, (max(abs(a - b)) / max(abs(b)) < 1e-4 AND count(*) FILTER (abs(b) > 1e-4 AND abs(a - b) / abs(b) > 1e-4) = 0) AS passed FROM (SELECT coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM (SELECT i0, i1, i2, CASE WHEN i2 = 3 THEN v + 1 ELSE v END AS v FROM x3) a FULL JOIN (SELECT * FROM x3 WHERE i1 % 7 <> 0) b USING (i0, i1, i2))"
query("error_summary", _DIFF)(lambda s, d: compare.difference((x := x3(s, d)).withColumn("v", F.when(F.col("i2") == 3, F.col("v") + 1).otherwise(F.col("v"))), x.where("i1 % 7 <> 0")))
_R0, _R1 = "CROSS JOIN (SELECT unnest(range(0, 3)) AS r0)", "CROSS JOIN (SELECT unnest(range(0, 2)) AS r1)"
_TWO_WAYS = f"""
SELECT max(abs(a.v - b.v)) AS max_abs, max(abs(a.v - b.v)) / max(abs(b.v)) AS rel, count(*) FILTER (abs(b.v) > 1e-4 AND abs(a.v - b.v) / abs(b.v) > 1e-4) AS n_significant,
  (max(abs(a.v - b.v)) / max(abs(b.v)) < 1e-4 AND count(*) FILTER (abs(b.v) > 1e-4 AND abs(a.v - b.v) / abs(b.v) > 1e-4) = 0) AS passed
FROM (SELECT i0, r0, r1, sum(v * ((7 * i1 + 3 * r0) % 11) * ((5 * i2 + 2 * r1) % 7)) AS v FROM x3 {_R0} {_R1} GROUP BY ALL) a
JOIN (
  SELECT i0, r0, r1, sum(v * ((7 * i1 + 3 * r0) % 11)) AS v
  FROM (SELECT i0, i1, r1, sum(v * ((5 * i2 + 2 * r1) % 7)) AS v FROM x3 {_R1} GROUP BY ALL) {_R0} GROUP BY ALL
) b USING (i0, r0, r1)"""
query("ttmc_agreement", _TWO_WAYS)(lambda s, d: _agreement(s, d))


def _agreement(spark, sf_dir):
    """All-at-once against fused: the same tensor."""
    x = x3(spark, sf_dir)
    f = _factors(spark, x, 0)
    ways = [contract.ttmc(x, f, 0, w).select(F.col("i0"), F.col("r0").alias("i1"), F.col("r1").alias("i2"), "v") for w in ("aao", "fused")]
    return compare.difference(*ways)


def _runs(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id") % 20).alias("dataset"), F.col("event_type").alias("method"), F.round(F.col("value") * 100).alias("time_ms"))


_RUNS = "SELECT 'd' || (user_id % 20) AS dataset, event_type AS method, round(value * 100) AS time_ms FROM events"
_TIMING = f"SELECT dataset, method, avg(time_ms) AS mean, coalesce(stddev_samp(time_ms), 0) AS sd, count(time_ms) AS runs, min(time_ms) AS min, max(time_ms) AS max FROM ({_RUNS}) GROUP BY 1, 2"
query("timing_stats", f"SELECT dataset, method, round(mean, 6) AS mean, round(sd, 6) AS sd, runs, min, max, round(CASE WHEN mean <> 0 THEN sd / mean * 100 ELSE 0 END, 6) AS cv_pct FROM ({_TIMING})")(lambda s, d: compare.timing(_runs(s, d)).select("dataset", "method", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "runs", "min", "max", F.round("cv_pct", 6).alias("cv_pct")))
query("speedup_vs_baseline", f"SELECT a.dataset, a.method, round(b.mean / a.mean, 6) AS speedup, round(CASE WHEN a.runs > 1 AND b.runs > 1 THEN b.mean / a.mean * sqrt((b.sd / b.mean) * (b.sd / b.mean) + (a.sd / a.mean) * (a.sd / a.mean)) ELSE 0 END, 6) AS error FROM ({_TIMING}) a JOIN ({_TIMING}) b ON a.dataset = b.dataset AND b.method = 'click' WHERE a.mean > 0")(lambda s, d: compare.speedup(compare.timing(_runs(s, d)), "click").select("dataset", "method", F.round("speedup", 6).alias("speedup"), F.round("error", 6).alias("error")))
query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: compare.status_counts(_table(s, d, "orders").select(F.lit("x").alias("dataset"), F.col("o_orderstatus").alias("status"))))
query("validation_means", "SELECT event_type AS method, round(avg(value), 6) AS max_abs, round(avg(value / 2), 6) AS rel, round(avg(user_id), 6) AS n_sig, count(*) AS runs FROM events GROUP BY 1")(lambda s, d: compare.validation(_table(s, d, "events").select(F.col("event_type").alias("method"), F.col("value").alias("max_abs"), (F.col("value") / 2).alias("rel"), F.col("user_id").alias("n_sig"))).select("method", F.round("max_abs", 6).alias("max_abs"), F.round("rel", 6).alias("rel"), F.round("n_sig", 6).alias("n_sig"), "runs"))
query("occupancy_pivot", 'SELECT l_returnflag AS dataset, ' + ", ".join(f"round((max(l_quantity) FILTER (l_linestatus = '{v}') - min(l_quantity) FILTER (l_linestatus = '{v}')) / avg(l_quantity) FILTER (l_linestatus = '{v}') * 100, 6) AS \"{v}\"" for v in "FO") + " FROM lineitem GROUP BY 1")(lambda s, d: compare.occupancy(_table(s, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("version"), F.col("l_quantity").alias("value")), ["F", "O"]).select("dataset", F.round("F", 6).alias("F"), F.round("O", 6).alias("O")))
query("load_by_order", "SELECT CAST(i2 AS BIGINT) AS \"order\", i0 AS tensor, count(*) AS blocks, max(n) AS most, round(avg(n), 6) AS mean, round(max(n) / avg(n) - 1, 6) AS imbalance FROM (SELECT i2, i0, i1 // 100 AS b, count(*) AS n FROM x3 GROUP BY 1, 2, 3) GROUP BY 1, 2")(lambda s, d: compare.load_by_order(x3(s, d).groupBy(F.col("i2").alias("order"), F.col("i0").alias("tensor"), F.floor(F.col("i1") / 100).alias("block")).agg(F.count(F.lit(1)).alias("nnz"))).select("order", "tensor", "blocks", "most", F.round("mean", 6).alias("mean"), F.round("imbalance", 6).alias("imbalance")))
query("baseline_join", f"SELECT a.dataset, a.method, round(a.mean, 6) AS time_ms, round(b.mean, 6) AS baseline_ms FROM ({_TIMING}) a LEFT JOIN ({_TIMING}) b ON a.dataset = b.dataset AND b.method = 'click'")(lambda s, d: _baseline(s, d))


def _baseline(spark, sf_dir):
    mean = compare.timing(_runs(spark, sf_dir)).select("dataset", "method", F.round("mean", 6).alias("time_ms"))
    return compare.with_baseline(mean, mean.where("method = 'click'"))


@query("log_regex_extract", "SELECT event_type || ' set' AS dataset, CAST(user_id % 9 AS INTEGER) AS method_id, CAST(event_id % 5 AS INTEGER) AS run, 'm' || (user_id % 9) AS method, CASE WHEN event_id % 3 = 0 THEN round(abs(value), 3) * 1e4 ELSE round(abs(value), 3) END AS time_ms FROM events")
def _run_log(spark, sf_dir):
    """Events written as the lines of a log, one log for each event, and parsed again; data sets have folders, blanks and extensions, and some times exponents."""
    e = _table(spark, sf_dir, "events")
    t = F.concat(F.format_string("%.3f", F.round(F.abs("value"), 3)), F.when(F.col("event_id") % 3 == 0, "e+04").otherwise(""))
    lines = F.array(F.concat(F.lit("Running contraction on /data/v1.5/"), "event_type", F.lit(" set.tns...")), F.concat(F.lit("Run "), F.col("event_id") % 5, F.lit("/5 of method v"), F.col("user_id") % 9, F.lit("...")), F.concat(F.lit("Method: m"), F.col("user_id") % 9, F.lit(", Time: "), t, F.lit(" ms")))
    return logs.run_log(e.select(F.col("event_id").alias("log"), F.posexplode(lines).alias("n", "value")))


@query("results_parse", "SELECT event_type || event_id AS dataset, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS DOUBLE) END AS time_ms, CASE WHEN event_id % 4 = 0 THEN 'ERROR' ELSE 'PASS' END AS status FROM events")
def _results(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return logs.results(e.select(F.concat("event_type", F.col("event_id").cast("string")).alias("dataset"), F.when(F.col("event_id") % 4 == 0, "ERROR").otherwise(F.col("event_id").cast("string")).alias("time"), F.lit("PASS").alias("status")))


@query("block_log_parse", "SELECT 'supplier' || i0 AS file, 3 AS \"order\", i1 // 100 AS block, count(*) AS nnz FROM x3 GROUP BY 1, 3")
def _block_log(spark, sf_dir):
    """Block counts written as a log for each supplier, and parsed again."""
    counts = x3(spark, sf_dir).groupBy("i0", F.floor(F.col("i1") / 100).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    body = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "b", "n"))), "\n")
    return logs.block_log(counts.groupBy("i0").agg(body.alias("s")).select(F.concat(F.lit("File: supplier"), "i0", F.lit("\nOrder: 3\n"), "s", F.lit("\n")).alias("value")))


query("kernel_time", "SELECT sum(round(abs(value), 2)) / 10 AS ms FROM events")(lambda s, d: logs.kernel_time(_table(s, d, "events").select(F.concat(F.lit("kernel took "), F.format_string("%.2f", F.round(F.abs("value"), 2)), F.lit(" ms\n")).alias("value")), 10).select(F.round("ms", 6).alias("ms")))
SQL["kernel_time"] = "SELECT round(sum(round(abs(value), 2)) / 10, 6) AS ms FROM events"


@query("scalar_functions", "SELECT i0, i1, i2, round(1 / sqrt(greatest(v - 30, 1e-12)), 6) AS inverse, (CAST(v AS BIGINT) << 2) AS shifted, CAST(ceil(v / 7) AS BIGINT) AS up, round(ln(v), 6) AS log FROM x3")
def _scalars(spark, sf_dir):
    v = F.col("v")
    return x3(spark, sf_dir).select("i0", "i1", "i2", F.round(1 / F.sqrt(F.greatest(v - 30, F.lit(1e-12))), 6).alias("inverse"), F.shiftleft(v.cast("long"), 2).alias("shifted"), F.ceil(v / 7).alias("up"), F.round(F.ln(v), 6).alias("log"))


query("human_sizes", "SELECT i0, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', round(b / 1073741824.0, 2)) WHEN b >= 1048576 THEN printf('%.2f MB', round(b / 1048576.0, 2)) WHEN b >= 1024 THEN printf('%.2f KB', round(b / 1024.0, 2)) ELSE b || ' B' END AS size FROM (SELECT i0, count(*) * 32 AS b FROM x3 GROUP BY 1)")(lambda s, d: x3(s, d).groupBy("i0").agg((F.count(F.lit(1)) * 32).alias("b")).select("i0", logs.human_bytes("b").alias("size")))
