"""Small tensors whose results can be checked by hand or with numpy."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import factors as fac
from tensorloom.operators import compare, contract, coo, formats, linalg, stats, svd, tucker
from tensorloom.plans import planner, table_functions
from tensorloom.sources import binary, factor_source, generate, logs, text

TOY = [(0, 0, 0, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 10.0), (1, 0, 2, 7.0), (1, 2, 0, 6.0), (1, 2, 1, 5.0), (2, 0, 2, 3.0), (2, 1, 1, 11.0)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "i0 long, i1 long, i2 long, v double").cache()


@pytest.fixture(scope="module")
def ab(spark):
    return fac.modular(spark, 3, 2, 7, 3, 11), fac.modular(spark, 3, 2, 5, 2, 7)


def dense(df, shape, cols):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[c] for c in cols)] = r["v"]
    return out


def array():
    out = np.zeros((3, 3, 3))
    for i, j, k, v in TOY:
        out[i, j, k] = v
    return out


A, B = np.array([[0, 3], [7, 10], [3, 6]], float), np.array([[0, 2], [5, 0], [3, 5]], float)


@pytest.mark.parametrize("strategy", ["aao", "fused", "salted"])
@pytest.mark.parametrize("keep,spec", [(0, "ijk,jr,ks->irs"), (1, "ijk,ir,ks->jrs"), (2, "ijk,ir,js->krs")])
def test_ttmc(toy, ab, strategy, keep, spec):
    rest = [m for m in range(3) if m != keep]
    got = contract.ttmc(toy, dict(zip(rest, ab)), keep, strategy)
    assert np.array_equal(dense(got, (3, 2, 2), [f"i{keep}", "r0", "r1"]), np.einsum(spec, array(), A, B))


@pytest.mark.parametrize("strategy", ["aao", "fused"])
def test_mttkrp(toy, ab, strategy):
    got = contract.mttkrp(toy, {1: ab[0], 2: ab[1]}, 0, strategy)
    assert dense(got, (3, 2), ["i0", "r"]).tolist() == [[70, 126], [75, 177], [385, 45]]


def test_ttm_keeps_absent_fibers_absent(toy, ab):
    got = contract.ttm(toy, ab[1], 2)
    assert got.count() == 7 * 2
    assert np.array_equal(dense(got, (3, 3, 2), ["i0", "i1", "i2"]), np.einsum("ijk,ks->ijs", array(), B))


def test_planner(toy, ab):
    plan = planner.plan_ttmc(toy, {1: ab[0], 2: ab[1]}, 0)
    assert plan.strategy == "salted"
    assert np.array_equal(dense(planner.ttmc_auto(toy, {1: ab[0], 2: ab[1]}, 0), (3, 2, 2), ["i0", "r0", "r1"]), np.einsum("ijk,jr,ks->irs", array(), A, B))
    assert planner.plan_ttmc(toy.limit(0), {1: ab[0], 2: ab[1]}, 0).why == "empty"


def test_csf(toy):
    levels = formats.csf(toy)
    ptr = [[r["ptr"] for r in formats.csf_pointers(levels, n).orderBy("pos").collect()] for n in range(3)]
    idx = [[r["idx"] for r in level.orderBy("pos").collect()] for level in levels]
    assert ptr == [[0, 3], [0, 3, 5, 7], [0, 1, 2, 3, 4, 6, 7, 8]]
    assert idx == [[0, 1, 2], [0, 1, 2, 0, 2, 0, 1], [0, 1, 0, 2, 0, 1, 2, 1]]
    assert sorted(tuple(r) for r in formats.from_csf(levels).select("i0", "i1", "i2", "v").collect()) == TOY


def test_csf_sums_equal_coordinates_first(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 0, 1.0)], "i0 long, i1 long, v double")
    assert sorted(r["v"] for r in formats.csf(x)[1].collect()) == [1.0, 3.0]


def test_csr_keeps_empty_rows(spark):
    m = spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0), (4, 0, 1.0)], "row long, col long, v double")
    assert [r["ptr"] for r in formats.csr(m, 7).orderBy("row").collect()] == [0, 0, 2, 2, 2, 3, 3, 3]


def test_stats(toy):
    row = stats.fiber_stats(toy).first()
    assert (row["slices"], row["fibers"], row["min_nnz"], row["max_nnz"]) == (3, 7, 1, 2)
    assert row["avg_nnz"] == pytest.approx(8 / 7)
    assert {r["block"]: r["nnz"] for r in stats.block_histogram(toy, [3, 3, 3], [2, 2, 2]).collect()} == {0: 2, 1: 1, 2: 3, 4: 1, 5: 1}
    assert stats.block_summary(toy, [3, 3, 3], [2, 2, 2]).first()["empty"] == 3
    assert coo.norm(toy).first()["norm_sq"] == 345
    assert coo.mode_order(toy) == [0, 1, 2]


def test_layouts(toy):
    assert sorted(map(tuple, coo.delinearise(coo.linearise(toy, [3, 3, 3]), [3, 3, 3]).collect())) == TOY
    back = coo.unchunk(coo.chunks(toy, 2, 3), 2).where("v <> 0")
    assert sorted(tuple(r) for r in back.select("i0", "i1", "i2", "v").collect()) == TOY
    assert coo.densify(toy, [3, 3, 3]).count() == 27
    assert np.allclose(np.linalg.svd(dense(coo.unfold(toy, 0, [3, 3, 3]), (3, 9), ["row", "col"]))[1], [13.58296, 10.63388, 6.88651], atol=1e-5)
    assert coo.fill(toy.withColumn("v", toy["v"] + None)).where("v > 0 and v < 1").count() == 8
    assert {r["part"] for r in formats.split_fibers(toy, 1).collect()} == {0, 1}


def test_empty(spark, ab):
    x = spark.createDataFrame([], "i0 long, i1 long, i2 long, v double")
    assert contract.ttmc(x, {1: ab[0], 2: ab[1]}, 0).count() == 0
    assert formats.from_csf(formats.csf(x)).count() == 0
    assert coo.norm(x).first()["norm"] == 0
    assert stats.slice_bins(x).count() == 0


def test_singular_vectors(spark):
    m = np.random.RandomState(0).standard_normal((40, 5))
    y = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "x long, u0 double, u1 double, u2 double, u3 double, u4 double")
    u, sigma = linalg.left_singular(y, y.columns[1:], 3)
    want = np.linalg.svd(m, full_matrices=False)
    got = np.array([r[1:] for r in u.orderBy("x").collect()])
    assert np.allclose(sigma, want[1][:3])
    assert np.allclose(got @ got.T, want[0][:, :3] @ want[0][:, :3].T)
    assert linalg.resolved(np.array([3.0, 2.0]), 5, 5, 5.0) and not linalg.resolved(np.array([2.0, 2.0]), 5, 5, 4.0)
    with pytest.raises(ValueError):
        linalg.local(y, 3000)


def test_blocks_are_numbered_in_parts(spark):
    x = spark.createDataFrame([(i, j, 1.0) for i in range(40) for j in range(1 + i % 3)], "i0 long, i1 long, v double")
    placed = stats.blocks_by_size(x, [40, 3], [1, 3])
    got = {r["block"]: (r["nnz"], r["place"]) for r in placed.collect()}
    order = sorted(got, key=lambda b: (-got[b][0], b))
    assert len(got) == 40 and [got[b][1] for b in order] == list(range(40))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert all("_ordinal_part" in line for line in plan.splitlines() if "row_number" in line)


def test_slice_bins(spark):
    """Bins 1 to 4 are part of bin 0; bounds are on non-zeros and fibers together."""
    n = {0: 512, 1: 513, 2: 1024, 3: 1025}  # each non-zero is a fiber of its own
    x = spark.createDataFrame([(i, j, 0, 1.0) for i, k in n.items() for j in range(k)], "i0 long, i1 long, i2 long, v double")
    assert {r["bin"]: (r["slices"], r["nnz"]) for r in stats.slice_bins(x).collect()} == {0: (1, 512), 5: (2, 1537), 6: (1, 1025)}


def test_fiber_runs(toy):
    got = sorted(map(tuple, stats.fiber_runs(toy, 2, 1).collect()))
    assert got == [(0, 0, 2, 2), (0, 1, 1, 1), (1, -1, 1, 2), (1, 0, 1, 1), (2, 0, 2, 2)]


def test_orthonormal_factors(spark):
    f = fac.orthonormal(spark, 50, 4)
    got = np.array([r[1:] for r in f.orderBy("x").collect()])
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-6)
    for seed in (42, 43):  # 42 made the factor, too
        more = np.array([r[1:] for r in fac.extended(f, 2, seed).orderBy("x").collect()])
        assert np.allclose(more.T @ more, np.eye(6), atol=1e-6) and np.allclose(more[:, :4], got, atol=1e-9)
    with pytest.raises(ValueError):
        fac.extended(fac.orthonormal(spark, 5, 4), 2)


def test_hooi(toy):
    full = tucker.hooi(toy, [3, 3, 3], [3, 3, 3], sweeps=2)
    assert full.fits[-1] == pytest.approx(1, abs=1e-6)
    model = tucker.hooi(toy, [3, 3, 3], [2, 2, 2], sweeps=4)
    assert 0.2 < model.fits[-1] < 0.5322467  # the best that there is
    assert model.fits == sorted(model.fits)
    chain = tucker.hooi_chain(toy, [3, 3, 3], [2, 2, 2], sweeps=2, order=[2, 1, 0])
    assert chain.fits == pytest.approx(model.fits[:2])
    observed, whole = tucker.fits(toy, model.factors, model.core)
    assert whole == pytest.approx(model.fits[-1], abs=1e-6)
    assert np.allclose(tucker.refreshed_core(toy, model.factors), model.core)
    assert observed >= whole - 1e-9


def test_als(toy):
    model = tucker.als(toy, [3, 3, 3], 2, sweeps=4)
    assert model.fits[-1] > 0.5


def test_ridge_rows(spark):
    x = np.random.RandomState(1).standard_normal((30, 2))
    v = x @ np.array([2.0, -1.0])
    rows = spark.createDataFrame([(0, float(a), float(b), float(c)) for (a, b), c in zip(x, v)], "x long, d0 double, d1 double, v double")
    r = linalg.ridge_rows(rows, 2, 1e-9).first()
    assert (r["u0"], r["u1"]) == pytest.approx((2, -1), abs=1e-6)


def test_text_formats(spark, toy, tmp_path):
    lines = spark.createDataFrame([(x,) for x in ["3", "3 3 3", "# c", "", "1 1 1 1", "1 2 2 2.5", "1 x 2 3", "1 2 3"]], "value string")
    assert sorted(map(tuple, text.parse_coo(lines, 3).collect())) == [(0, 0, 0, 1.0), (0, 1, 1, 2.5)]
    with pytest.raises(Exception, match="malformed"):
        text.parse_coo(lines, 3, strict=True).collect()
    text.write_tns(toy, str(tmp_path / "x"))
    got, sizes = text.read_tns(spark, str(tmp_path / "x"))
    assert sizes is None and sorted(map(tuple, got.collect())) == TOY
    (tmp_path / "h.tns").write_text("3\n3 3 3\n" + "\n".join(f"{i + 1} {j + 1} {k + 1} {v}" for i, j, k, v in TOY))
    got, sizes = text.read_tns(spark, str(tmp_path / "h.tns"))
    assert sizes == [3, 3, 3] and sorted(map(tuple, got.collect())) == TOY
    assert text.read_directory(spark, str(tmp_path), 3, "h.tns").count() == 8
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n2 2 2\n1 1 4\n2 1 3\n")
    m, sizes = text.read_mtx(spark, str(tmp_path / "m.mtx"))
    assert sizes == (2, 2, 2) and sorted(map(tuple, m.collect())) == [(0, 0, 4.0), (0, 1, 3.0), (1, 0, 3.0)]
    (tmp_path / "t.txt").write_text("2\n2 2 1\n\n2 3\n4")
    got, sizes = text.read_dense_tensor(spark, str(tmp_path / "t.txt"))
    assert sizes == [2, 2] and sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    (tmp_path / "short.txt").write_text("2 2 2 1")
    with pytest.raises(ValueError, match="1 values"):
        text.read_dense_tensor(spark, str(tmp_path / "short.txt"))
    text.write_dense_tensor(toy, [3, 3, 3], str(tmp_path / "cells"), per_line=4)
    got, sizes = text.read_dense_tensor(spark, str(tmp_path / "cells"))
    assert sizes == [3, 3, 3] and got.count() == 27 and sorted(map(tuple, got.where("v <> 0").collect())) == TOY
    text.write_tns(toy, str(tmp_path / "y"), [3, 3, 4])
    got, sizes = text.read_tns(spark, str(tmp_path / "y"), strict=True)
    assert sizes == [3, 3, 4] and sorted(map(tuple, got.collect())) == TOY
    drawn = [r["v"] for r in text.parse_coo(lines, 3, missing=F.rand(3)).where("i1 = 1 and i2 = 2").collect()]
    assert len(drawn) == 1 and 0 < drawn[0] < 1
    text.write_mtx(m.where("row >= col"), str(tmp_path / "out.mtx"), 2, 2, symmetric=True)
    again, sizes = text.read_mtx(spark, str(tmp_path / "out.mtx"))
    assert sizes == (2, 2, 2) and sorted(map(tuple, again.collect())) == sorted(map(tuple, m.collect()))
    (tmp_path / "dense").write_text("1 2\n\n3 4\n")
    assert sorted(map(tuple, text.read_dense(spark, str(tmp_path / "dense"), 2).collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert sorted(map(tuple, text.read_dense(spark, str(tmp_path / "absent"), 2, ones=1).collect())) == [(0, 0, 1.0), (0, 1, 1.0)]
    with pytest.raises(Exception, match="ragged row"):
        text.read_dense(spark, str(tmp_path / "dense"), 3).collect()
    rows = {r["value"] for r in text.csf_lines(toy, [3, 3, 3]).collect()}
    assert "mode_2_ptr: 0 1 2 3 4 6 7 8" in rows and "# Dimensions: 3 3 3" in rows
    parts = text.csf_lines(toy, [3, 3, 3], size=3)
    assert {"mode_2_ptr: 0 1 2", "mode_2_ptr[3]: 3 4 6", "values[6]: 3 11".replace("3 11", "3.0 11.0")} <= {r["value"] for r in parts.collect()}
    assert sorted(map(tuple, text.csf_to_coo(text.parse_csf(parts), 3).select("i0", "i1", "i2", "v").collect())) == TOY
    seven = ["0 3", "0 1 2", "0 3 5 7", "0 1 2 0 2 0 1", "0 1 2 3 4 6 7 8", "0 1 0 2 0 1 2 1", "1 2 10 7 6 5 3 11"]
    numbered = spark.createDataFrame(list(enumerate(seven)), "n int, value string")
    assert sorted(map(tuple, text.csf_to_coo(text.parse_positional_csf(numbered), 3).select("i0", "i1", "i2", "v").collect())) == TOY
    assert [r["value"] for r in text.flat_lines(toy, "v", "i0", 5).orderBy("begin").collect()] == ["0 0 2 1 1", "1 0 2"]


def test_observed_in_one_pass(spark, tmp_path):
    (tmp_path / "x.tns").write_text("# c\n1 2 0.5\n3 1\n2 2\none 1 1\n1 2 3 4\n")
    got, seen = text.read_observed(spark, str(tmp_path / "x.tns"), 2)
    rows = {(r["i0"], r["i1"]): r["v"] for r in got.collect()}
    assert seen == {"dims": [3, 2], "entries": 3, "malformed": 2, "drawn": 2}
    assert rows[0, 1] == 0.5 and 0 < rows[2, 0] < 1 and 0 < rows[1, 1] < 1 and rows[2, 0] != rows[1, 1]
    assert {(r["i0"], r["i1"]): r["v"] for r in text.read_observed(spark, str(tmp_path / "x.tns"), 2)[0].collect()} == rows
    (tmp_path / "zero.tns").write_text("0 1 1\n")
    with pytest.raises(ValueError, match="begin at 1"):
        text.read_observed(spark, str(tmp_path / "zero.tns"), 2)


def test_binary_formats(spark, toy, tmp_path):
    f = fac.uniform(spark, 7, 3)
    cells = np.array([r[1:] for r in f.orderBy("x").collect()])
    (tmp_path / "mode0.bin").write_bytes(np.array(cells.shape, "<u8").tobytes() + cells.tobytes())
    (tmp_path / "raw.bin").write_bytes(cells.astype("<f4").tobytes())
    for read in (binary.read_factors, factor_source.read_factor):
        assert np.allclose([r["row"] for r in read(spark, str(tmp_path / "mode0.bin")).orderBy("idx").collect()], cells)
        assert np.allclose([r["row"] for r in read(spark, str(tmp_path / "raw.bin"), 3).orderBy("idx").collect()], cells, atol=1e-6)
    ranged = spark.read.format("factor").option("range", 60).load(str(tmp_path / "mode0.bin"))
    assert ranged.rdd.getNumPartitions() == 4 and np.allclose([r["row"] for r in ranged.orderBy("idx").collect()], cells)
    (tmp_path / "bad.bin").write_bytes(b"1" * 40)
    with pytest.raises(Exception, match="don't fit"):
        factor_source.read_factor(spark, str(tmp_path / "bad.bin")).collect()
    for width in (4, 8):
        factor_source.write_factor(f.where("x not in (0, 3, 4, 5)"), str(tmp_path / f"parts{width}"), width, rows=3)
        assert sorted(p.name for p in (tmp_path / f"parts{width}").iterdir()) == ["part-000000000000000.bin", "part-000000000000006.bin"]
        back = {r["idx"]: r["row"] for r in factor_source.read_factor(spark, str(tmp_path / f"parts{width}")).collect()}
        assert sorted(back) == [0, 1, 2, 6] and back[0] == [0, 0, 0] and np.allclose(back[6], cells[6], atol=1e-6)
    some = f.where("x <> 4")
    files = binary.factor_files(some, "a", rows=3)
    assert sorted(r["first"] for r in files.collect()) == [0, 3, 6]
    back = {r["idx"]: r["row"] for r in binary.parse_factors(files).collect()}
    assert back[4] == [0, 0, 0] and np.allclose([back[x] for x in (0, 3, 6)], [r[1:] for r in f.where("x in (0, 3, 6)").orderBy("x").collect()])
    model = tucker.hooi(toy, [3, 3, 3], [2, 2, 2], sweeps=1)
    binary.write_model(model, str(tmp_path / "model"))
    back = binary.read_model(spark, str(tmp_path / "model"))
    assert np.allclose(back.core, model.core) and back.fits == model.fits
    assert binary.show(toy, 1) == "(0, 0, 0) 1"
    factor_source.write_model_files(model, str(tmp_path / "files"))
    back = factor_source.read_model_files(spark, str(tmp_path / "files"))
    assert np.array_equal(back.core, model.core) and back.fits == model.fits
    assert tucker.fits(toy, back.factors, back.core) == pytest.approx(tucker.fits(toy, model.factors, model.core))


def test_factors_of_a_session_that_is_not_active(spark, tmp_path):
    """A query's own session has the source, and the thread may have another session, or none."""
    other, found = spark.newSession(), {}

    def run(name, active):
        if active is not None:
            active.createDataFrame([(1,)], "x int")  # is the thread's active session by that
        factor_source.write_factor(other.range(7).selectExpr("id AS x", "2D * id AS u0"), str(tmp_path / name), rows=2)
        back = factor_source.read_factor(other, str(tmp_path / name))
        assert back.rdd.getNumPartitions() == 1
        sessions = getattr(spark._jvm, "org.apache.spark.sql.SparkSession")
        found[name] = sorted((r["idx"], r["row"]) for r in back.collect()), sessions.getActiveSession().isDefined()

    for name, active in (("none", None), ("fresh", spark.newSession())):
        thread = threading.Thread(target=run, args=(name, active))
        thread.start()
        thread.join()
    spark.createDataFrame([(1,)], "x int")
    rows = [(x, [2.0 * x]) for x in range(7)]
    assert found == {"none": (rows, False), "fresh": (rows, True)}


def test_model_files_of_a_session_that_is_not_active(spark, tmp_path):
    other = spark.newSession()
    factors = [fac.modular(other, d, 2, 7, 3, 11) for d in (4, 5, 3)]
    spark.newSession().createDataFrame([(1,)], "x int")  # the active one from here on
    factor_source.write_model_files(tucker.Tucker(factors, np.arange(8.0).reshape(2, 2, 2), [0.5]), str(tmp_path / "m"))
    back = factor_source.read_model_files(other, str(tmp_path / "m"))
    spark.createDataFrame([(1,)], "x int")
    assert [sorted(f.collect()) for f in back.factors] == [sorted(f.collect()) for f in factors]
    assert np.array_equal(back.core, np.arange(8.0).reshape(2, 2, 2)) and back.fits == [0.5]


def test_generators(spark):
    a = generate.sparse_tensor(spark, [30, 20, 10], density=0.02, fiber_density=0.1)
    b = generate.sparse_tensor(spark, [30, 20, 10], density=0.02, fiber_density=0.1)
    assert a.exceptAll(b).isEmpty() and a.count() == a.select("i0", "i1", "i2").distinct().count()
    assert 40 < a.count() < 400
    assert generate.gaussian_tensor(spark, [4, 5], [1, 1]).count() == 20


def test_comparison_and_logs(spark, toy):
    assert compare.difference(toy, toy).first()["passed"]
    assert not compare.difference(toy, coo.scale(toy, 1.1)).first()["passed"]
    log = spark.createDataFrame([("File: a\nOrder: 3\nDims: 2 2\n0 5\n3 1\nFile: b\nOrder: 4\n1 2\n",)], "value string")
    assert sorted(map(tuple, logs.block_log(log).collect())) == [("a", 3, 0, 5), ("a", 3, 3, 1), ("b", 4, 1, 2)]
    lines = ["Running contraction on /data/my set.v2.tns...", "Run 1/5 of method v3...", "Method: fused, Time: 1.23e+04 ms", "Running contraction on plain...", "Run 2/5 of method v4...", "Method: aao, Time: 7 ms", "Method: none, Time: soon"]
    runs = logs.run_log(spark.createDataFrame([(0, n, x) for n, x in enumerate(lines)], "log int, n int, value string"))
    assert sorted(map(tuple, runs.collect())) == [("my set.v2", 3, 1, "fused", 12300.0), ("plain", 4, 2, "aao", 7.0)]


def test_table_functions(spark, toy, ab):
    table_functions.register(spark)
    shared = toy.repartition(1)
    got = spark.sql("SELECT * FROM csf_fibers(TABLE(SELECT i0, i1, i2 FROM {x}) PARTITION BY i0 ORDER BY (i1, i2))", x=shared)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 0, 1), (0, 1, 1, 1, 2), (0, 2, 2, 2, 3), (1, 0, 0, 0, 1), (1, 2, 1, 1, 3), (2, 0, 0, 0, 1), (2, 1, 1, 1, 2)]
    a, b = (f.select("x", F.array("u0", "u1").alias("u")) for f in ab)
    got = spark.sql("SELECT * FROM ttmc_slices(TABLE(SELECT i0, a.u AS a, b.u AS b, v FROM {x} JOIN {a} a ON i1 = a.x JOIN {b} b ON i2 = b.x) PARTITION BY i0)", x=shared, a=a, b=b)
    assert np.array_equal(dense(got, (3, 2, 2), ["i0", "r0", "r1"]), np.einsum("ijk,jr,ks->irs", array(), A, B))


def test_streaming(spark, toy, ab, tmp_path):
    from tensorloom.streaming.incremental import streaming_norm, streaming_ttmc

    toy.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(toy.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("norm", streaming_norm(stream())), ("ttmc", streaming_ttmc(stream(), {1: ab[0], 2: ab[1]}, 0))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("norm").first()["norm_sq"] == 345
    want = np.einsum("ijk,jr,ks->irs", array(), A, B)
    for r in spark.table("ttmc").collect():
        assert [r[f"s{p}_{q}"] for p in range(2) for q in range(2)] == want[r["i0"]].ravel().tolist()


def test_decompositions_start_from_given_factors(spark, toy):
    """A sweep from given factors is what numpy finds from them; regression goes on where an earlier run ended."""
    t = array()
    made = [(2, 7, 3, 11), (2, 5, 2, 7), (1, 3, 5, 5)]
    start = [fac.modular(spark, 3, *c) for c in made]
    u = [np.array([[(a * x + b * k) % m for k in range(r)] for x in range(3)], float) for r, a, b, m in made]
    for mode in (2, 1, 0):
        y = t
        for m in range(3):
            if m != mode:
                y = np.moveaxis(np.tensordot(u[m].T, y, (1, m)), 0, m)
        left, sigma, _ = np.linalg.svd(np.moveaxis(y, mode, 0).reshape(3, -1), full_matrices=False)
        u[mode], kept = left[:, : u[mode].shape[1]], sigma[: u[mode].shape[1]]
    want = tucker.fit_of_core(float((t**2).sum()), float((kept**2).sum()))
    model = tucker.hooi(toy, [3, 3, 3], [2, 2, 1], sweeps=1, start=start)
    assert model.fits[0] == pytest.approx(want, abs=1e-9)
    core = np.ones((2, 2, 1))
    first = tucker.als(toy, [3, 3, 3], 2, sweeps=1, start=start, core_=core)
    both = tucker.als(toy, [3, 3, 3], 2, sweeps=2, tolerance=-1.0, start=start, core_=core)
    again = tucker.als(toy, [3, 3, 3], 2, sweeps=1, start=first.factors, core_=core)
    assert again.fits[0] == pytest.approx(both.fits[1], abs=1e-9)
    with pytest.raises(ValueError, match="3 modes"):
        tucker.hooi(toy, [3, 3, 3], [2, 2, 1], start=start[:2])
    with pytest.raises(ValueError, match="core"):
        tucker.als(toy, [3, 3, 3], 2, start=start, core_=np.ones((2, 2, 2)))


def test_ttmc_rows(spark, toy, monkeypatch):
    """An array for each index holds the cells of ttmc(), however runs fall into batches and blocks."""
    f = {m: fac.modular(spark, 3, r, a, b, n) for m, (r, a, b, n) in enumerate([(2, 7, 3, 11), (3, 5, 2, 7), (2, 3, 5, 5)])}
    monkeypatch.setattr(contract, "HELD", 6)
    for keep in range(3):
        want = {r[0]: list(r[1:]) for r in contract.ttmc(toy, f, keep, wide=True).collect()}
        for strategy in ("fused", "salted"):
            got = {r[0]: list(r["y"]) for r in contract.ttmc_rows(toy, f, keep, strategy).collect()}
            assert got == want
    four = toy.selectExpr("i0", "i1", "i2", "(i0 + i2) % 2 as i3", "v")
    g = {**f, 3: fac.modular(spark, 2, 2, 2, 1, 3)}
    assert {r[0]: list(r["y"]) for r in contract.ttmc_rows(four, g, 1).collect()} == {r[0]: list(r[1:]) for r in contract.ttmc(four, g, 1, wide=True).collect()}
    assert contract.ttmc_rows(toy.where("false"), f, 0).count() == 0


def test_core_of_the_last_update(spark, toy):
    """The core that comes with the last update is the tensor times all factors, for columns and for arrays."""
    start = [fac.modular(spark, 3, 2, a, b, m) for a, b, m in ((7, 3, 11), (5, 2, 7), (3, 5, 5))]
    models = [tucker.hooi(toy, [3, 3, 3], [2, 2, 2], sweeps=1, start=start, order=o, columns=c) for o, c in (((2, 1, 0), 64), ((0, 2, 1), 1))]
    for model in models:
        assert np.allclose(tucker.refreshed_core(toy, model.factors), model.core)
