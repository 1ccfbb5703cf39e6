"""Steps whose memory, time or shuffles once grew faster than their input."""

import os

import numpy as np
from pyspark.sql import functions as F

from tensorloom.functions import blocks, cells
from tensorloom.functions import factors as factor_makers
from tensorloom.functions import runs as runs_module
from tensorloom.functions import tables
from tensorloom.operators import contract, coo, formats, linalg, stats, svd, tucker
from tensorloom.plans import catalog
from tensorloom.sources import text

SMALLEST = os.environ.get("SMALLEST_SF_DIR", "/root/testdata/sf0.001")


def _tensor(spark, n=60):
    r = np.random.RandomState(3)
    cells = {tuple(map(int, r.randint(0, 9, 3))) for _ in range(n)}
    return spark.createDataFrame([(*c, float(k + 1)) for k, c in enumerate(sorted(cells))], "i0 long, i1 long, i2 long, v double")


def _matrix(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, v double")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def test_children_are_not_broadcast(spark):
    x = _tensor(spark)
    back = formats.from_csf(formats.csf(x))
    assert sorted(back.collect()) == sorted(x.collect())
    assert not any("BroadcastHashJoin" in line and "_at" in line for line in _plan(back))


def test_parts_of_runs_are_a_table(spark):
    x = _tensor(spark)
    placed = runs_module.runs(x, ["i0", "i1", "i2"], [1, 2], [1])
    rows = sorted(placed.collect(), key=lambda r: r[:3])
    firsts = sorted({r["i0"] for r in rows})
    assert [r["run1"] for r in rows] == [firsts.index(r["i0"]) for r in rows]
    assert [r["place1"] for r in rows] == [sum(q["i0"] == r["i0"] for q in rows[:k]) for k, r in enumerate(rows)]
    assert not any("element_at" in line for line in _plan(placed))


def test_partitions_follow_the_tables(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert tables.sized(spark, str(tmp_path), ["lineitem"]) is spark
    monkeypatch.setattr(tables, "SHARE", 64)
    given = spark.conf.get("spark.sql.shuffle.partitions")
    other = tables.sized(spark, str(tmp_path), ["lineitem"])
    assert int(other.conf.get("spark.sql.shuffle.partitions")) > int(given) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert other.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")


def test_reads_are_small_where_partitions_are_many(spark, tmp_path, monkeypatch):
    """Enough partitions say nothing of what a task reads, or of what Spark merges to one."""
    spark.range(1000).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(tables, "READ", 1 << 10)
    given = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", *tables.READS)}
    other = tables.sized(spark, str(tmp_path), ["lineitem"])
    assert other.conf.get("spark.sql.shuffle.partitions") == given["spark.sql.shuffle.partitions"]
    assert [tables._bytes(other.conf.get(key)) for key in tables.READS] == [1 << 10] * 2
    assert given == {key: spark.conf.get(key) for key in given}
    other.conf.set(tables.READS[0], "1k")
    other.conf.set(tables.READS[1], "100b")
    assert tables.sized(other, str(tmp_path), ["lineitem"]) is other
    assert [tables._bytes(x) for x in ("16m", "64MB", "134217728b", "3 GiB", "7")] == [16 << 20, 64 << 20, 128 << 20, 3 << 30, 7]


def test_power_sums_of_two_long_sides(spark):
    m = np.random.RandomState(1).randint(-2, 3, (12, 15)).astype(float)
    s = np.linalg.svd(m, compute_uv=False)
    for cells in (4, 1000):
        assert np.allclose(svd.power_sums(_matrix(spark, m), 12, 15, cells), ((s**2).sum(), (s**4).sum()))


def test_blocks_count_explicit_zeros(spark):
    x = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0), (5, 1, 0.0)], "i0 long, i1 long, v double")
    assert sorted(stats.blocks_by_size(x, [6, 2], [2, 2]).collect()) == [(0, 2, 0), (2, 1, 1)]


def test_gram_is_summed_in_tasks(spark):
    m = np.random.RandomState(2).randint(-1, 3, (30, 14)).astype(float)
    for chunk, held in ((3, 14), (3, 4), (100, 14), (100, 1)):
        got = np.zeros((14, 14))
        for r in linalg.gram_self_join(_matrix(spark, m), chunk, held=held).collect():
            got[r["row"], r["col"]] += r["v"]
        assert np.array_equal(got, m.T @ m)


def test_cells_are_packed(spark):
    draw = np.random.RandomState(5)
    far = 1 << 40
    for top, parts, v in ((50, 1, [1.0, -2.0]), (1 << 20, 7, [0.1, 3.0]), (far, 3, [-0.0, np.nan]), (5, 1000, [1e300, 1.0])):
        row, col = (np.sort(draw.randint(-2 if top == far else 0, top, 300)) for _ in range(2))
        order = np.lexsort((col, row))
        row, col, v = row[order], col[order], draw.choice(v, 300)
        batch = cells.pack(row, col, v, parts)
        back = [cells.unpack(x.as_buffer()) for x in batch.column(1)]
        assert sum(len(x[0]) for x in back) == 300 and all(np.all(cells.part_of(x[0], x[1], parts) == p) for p, x in zip(batch.column(0).to_pylist(), back, strict=True))
        got = [np.concatenate(x) for x in zip(*back, strict=True)]
        order = np.lexsort((np.signbit(got[2]), np.nan_to_num(got[2], nan=7), got[1], got[0]))
        own = np.lexsort((np.signbit(v), np.nan_to_num(v, nan=7), col, row))
        assert all(np.array_equal(x[order], y[own], equal_nan=x.dtype == float) for x, y in zip(got, (row, col, v), strict=True))
    assert cells.pack(*(np.zeros(0, t) for t in (np.int64, np.int64, float)), 3).num_rows == 0
    apart = cells.summed(np.array([far, 0, far]) << 20, np.array([far, 0, far]) << 20, np.array([1.0, 2.0, 4.0]))
    assert [x.tolist() for x in apart] == [[0, far << 20], [0, far << 20], [2.0, 5.0]]


def test_gram_shuffles_packed_cells(spark, monkeypatch):
    """Products of rows that share no columns are summed where their parts meet, not sorted as rows by Spark."""
    m = np.random.RandomState(6).randint(-1, 3, (40, 18)).astype(float)
    monkeypatch.setattr(linalg, "PART", 500)
    for chunk in (5, 100):
        g = linalg.gram_self_join(_matrix(spark, m), chunk, held=1)
        plan = _plan(g)
        assert sum("Exchange" in line and "part#" in line for line in plan) == 1 and not any("sum(v#" in line for line in plan)
        got = np.zeros((18, 18))
        for r in g.collect():
            got[r["row"], r["col"]] += r["v"]
        assert g.count() == 18 * 18 and np.array_equal(got, m.T @ m)
    assert linalg.gram_self_join(_matrix(spark, m).where("v > 9")).collect() == []


def test_a_matrix_is_made_once_to_be_written(spark, tmp_path):
    """Its entries and sizes are told by the pass that writes it; shuffle files go with that."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    for name, m, sizes in (("some", [(2, 0, 1.5), (2, 2, -1.0), (4, 1, 0.0)], (5, 5, 3)), ("none", [], (0, 0, 0))):
        table = spark.createDataFrame(m, "row long, col long, v double").mapInArrow(seen, "row long, col long, v double")
        before = made.value
        text.write_mtx(table, str(tmp_path / name), symmetric=True, compression="gzip")
        assert made.value - before == len(m)
        assert all(p.name.endswith(".txt.gz") for p in (tmp_path / name).glob("part-*"))
        back, found = text.read_mtx(spark, str(tmp_path / name))
        assert found == sizes and sorted(back.collect()) == sorted({*m, *((c, r, v) for r, c, v in m)})
    given = tmp_path / "given"
    text.write_mtx(spark.createDataFrame([(0, 1, 2.0)], "row long, col long, v double"), str(given), 3, 4)
    assert text.read_mtx(spark, str(given))[1] == (3, 4, 1)
    catalog.QUERIES["mtx_symmetric"](spark, SMALLEST)
    assert not [p for p in os.listdir(tables.shared_dir(spark).removeprefix("file:")) if p.startswith("gram-") and not p.startswith("gram-entries")]


def test_the_trace_makes_no_products(spark):
    m = np.random.RandomState(4).randint(-1, 3, (20, 11)).astype(float)
    got = linalg.gram_trace(_matrix(spark, m))
    assert got.first()["trace"] == linalg.trace(linalg.gram_self_join(_matrix(spark, m))).first()["trace"] == np.trace(m.T @ m)
    assert linalg.gram_trace(_matrix(spark, m).where("v > 9")).first()["trace"] == 0
    plan = _plan(catalog.QUERIES["gram_trace"](spark, SMALLEST))
    assert not any("MapInArrow" in line for line in plan)


def test_lines_are_read_once(spark, tmp_path):
    x = _tensor(spark)
    text.write_tns(x, str(tmp_path / "t"), [9, 9, 9])
    found, _ = text.read_tns(spark, str(tmp_path / "t"), strict=True)
    assert sorted(found.collect()) == sorted(x.collect())
    m = spark.createDataFrame([("2 1 3.5",), ("\t1  1\t2 ",), ("% no",), ("  # no",), ("3 2",)], "value string")
    both = text.parse_mtx(m, symmetric=True)
    assert sorted(both.collect()) == [(0, 0, 2.0), (0, 1, 3.5), (1, 0, 3.5), (1, 2, 1.0), (2, 1, 1.0)]
    assert not any("Union" in line for line in _plan(both))


def test_labels_and_tokens_are_cut_once_a_line(spark, tmp_path):
    x = _tensor(spark)
    text.write_tns(x, str(tmp_path / "t"), [9, 9, 9])
    found = text.read_tns(spark, str(tmp_path / "t"), strict=True)[0]
    plan = coo.inside(found, [9, 9, 9])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    arrays = text.parse_csf(text.csf_lines(x, [9, 9, 9], size=4).select("value"))
    top = arrays._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "regexp_extract" not in top
    assert sorted(text.csf_to_coo(arrays, 3).collect()) == sorted(x.collect())


def test_trees_are_shuffled_packed(spark):
    """Blocks of 4 places: nodes with more children than a block, and arrays that lack a number."""
    x = spark.createDataFrame([(i, j, k, i - j / 8) for i, j, k in ((0, 0, 0), (0, 3, 1), *((2, 5, k) for k in range(19)), (2, 6, 0), (1 << 40, 0, 7))], "i0 long, i1 long, i2 long, v double")
    arrays = text.parse_csf(text.csf_lines(x, [1 << 41, 7, 19], size=4).select("value"))
    back = blocks.tree_to_coo(arrays, 3, size=4)
    assert back.columns == x.columns and sorted(back.collect()) == sorted(x.collect())
    for plan in (_plan(back), _plan(text.csf_lines(x, [1 << 41, 7, 19], size=4))):
        assert not any(word in line for line in plan for word in ("SortMergeJoin", "collect_list"))
    without = arrays.where("NOT (level = 1 AND kind = 'idx' AND pos = 2)")
    assert sorted(blocks.tree_to_coo(without, 3, size=4).collect()) == sorted(r for r in x.collect() if r[:2] != (2, 5))
    assert blocks.tree_to_coo(arrays.where("level > 9"), 3).collect() == []
    values = text.csf_lines(x.where("i0 > 9").withColumn("v", F.lit(12).cast("long")), [1, 1, 1]).where("n >= 10").collect()
    assert {r["value"] for r in values} == {"mode_0_ptr: 0 1", "mode_0_idx: 1099511627776", "mode_1_ptr: 0 1", "mode_1_idx: 0", "mode_2_ptr: 0 1", "mode_2_idx: 7", "values: 12"}
    assert [r["value"] for r in text.csf_lines(x.where("i0 < 0"), [0, 0, 0]).where("n >= 10").collect()] == ["mode_0_ptr: 0 0"]
    for numbers in (np.array([3, -5, 1 << 62, 0]), np.array([0.1, -0.0, np.nan, np.inf]), np.array([1.0, 7.0, -4.0]), np.array([-0.0, 1.0]), np.zeros(0)):
        for differences in (True, False):
            got = blocks.release(blocks.press(numbers, differences))
            assert got.dtype == numbers.dtype and got.tobytes() == numbers.tobytes()


def _shuffled(df):
    """What the exchanges of a plan are by, before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line.split("hashpartitioning(")[1].split("#")[0] for line in plan if " Exchange hashpartitioning(" in line]


def _dealt_tensor(spark, n):
    return tables.dealt(_tensor(spark), f"i{n}", "test-dealt"), [9, 9, 9]


def test_dealt_tables_stay_in_place(spark):
    x = _tensor(spark)
    y = tables.dealt(x, "i1", "test-dealt")
    assert sorted(y.collect()) == sorted(x.collect())
    assert _shuffled(y.groupBy("i0", "i1").count()) == []
    assert not [t for t in spark.catalog.listTables() if "test_dealt" in t.name]
    assert "Broadcast" in str(_plan(y.join(tables.small(spark.range(9).toDF("i1"), 9), "i1").groupBy("i1").count()))


def test_hooi_leaves_the_tensor_in_place(spark):
    x, dims = _dealt_tensor(spark, 1)
    dims[1] = 10  # the longest
    factors = [factor_makers.modular(spark, d, 2, 7, 3, 11) for d in dims]
    for mode, strategy in ((0, "fused"), (1, "fused"), (1, "chain")):
        wanted = {(r[0], r["r0"], r["r1"]): r["v"] for r in contract.ttmc(_tensor(spark), dict(enumerate(factors)), mode).collect()}
        y, names, width = tucker._projected(x, factors, dims, mode, strategy, 64)
        moved = _shuffled(y)
        assert width == 4 and {(r["x"], k // 2, k % 2): r[n] for r in y.collect() for k, n in enumerate(names)} == wanted
        # The tensor's rows never are: only sums by another mode leave their tasks.
        assert moved == (["i0"] if mode == 0 else [])


def test_ridge_rows_leave_the_tensor_in_place(spark):
    x, dims = _dealt_tensor(spark, 1)
    dims[1] = 10  # the longest
    factors, core = [factor_makers.modular(spark, d, 2, 7, 3, 11) for d in dims], np.arange(1.0, 9).reshape(2, 2, 2)
    for mode in (0, 1):
        wanted = {r["x"]: r[1:] for r in linalg.ridge_rows(tucker.deltas(_tensor(spark), factors, core, mode), 2, 1e-4, f"i{mode}").collect()}
        solved = linalg.ridge_rows(tucker.deltas(x, tucker._hinted(factors, dims), core, mode), 2, 1e-4, f"i{mode}")
        assert _shuffled(solved) == (["i0"] if mode == 0 else [])
        got = {r["x"]: r[1:] for r in solved.collect()}
        assert got.keys() == wanted.keys() and all(np.allclose(got[i], wanted[i]) for i in wanted)


def test_power_iteration_deals_the_longer_side(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(svd, "dealt", lambda m, key, name: seen.append(key) or tables.dealt(m, key, name))
    for shape in ((7, 4), (4, 7)):
        m = np.random.RandomState(4).randint(1, 9, shape).astype(float)
        assert np.allclose(svd.iterated(_matrix(spark, m), 2).sigma, np.linalg.svd(m, compute_uv=False)[:2])
    assert seen == ["row", "col"]
