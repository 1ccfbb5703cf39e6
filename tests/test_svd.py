"""Singular values and vectors, sparse Gram matrices, and runs in sorted tables, against numpy and pandas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.runs import runs
from tensorloom.operators import coo, formats, linalg, svd, tucker

TOY = [(0, 0, 0, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 10.0), (1, 0, 2, 7.0), (1, 2, 0, 6.0), (1, 2, 1, 5.0), (2, 0, 2, 3.0), (2, 1, 1, 11.0)]
#: Singular values of TOY's unfoldings.
UNFOLDED = {0: [13.58296, 10.63388, 6.88651], 1: [12.72679, 11.18034, 7.61767], 2: [13.19834, 10.62092, 7.61577]}


def factor(spark, m, parts=5):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], ", ".join(["x long", *(f"u{k} double" for k in range(m.shape[1]))])).repartition(parts)


def array(df):
    return np.array([r[1:] for r in df.orderBy("x").collect()])


def sparse(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, v double").repartition(3)


@pytest.fixture(scope="module")
def entries():
    draw = np.random.RandomState(0)
    m = (draw.uniform(size=(30, 40)) < 0.3) * draw.randint(1, 9, (30, 40))
    m[3] = draw.randint(1, 9, 40)  # a row without gaps
    return m * 2 ** np.maximum(0, 4 - np.arange(30.0))[:, None]  # a few rows outweigh the others


def graded(columns=6):
    """Singular values over ten decades: their squares can't be told apart."""
    draw = np.random.RandomState(1)
    left, right = np.linalg.qr(draw.standard_normal((60, columns)))[0], np.linalg.qr(draw.standard_normal((columns, columns)))[0]
    return left * np.logspace(0, -10, columns) @ right.T


def test_gram_fails_and_tsqr_does_not(spark):
    m = graded()
    y = factor(spark, m)
    g = linalg.local(linalg.gram(y, y.columns[1:]), 6)
    values, _ = linalg.top_eigen(g, 6)
    assert not linalg.resolved(values, 60, 6, float(np.trace(g)))
    want = np.linalg.svd(m)[1]
    assert abs(np.sqrt(max(values[-1], 0)) / want[-1] - 1) > 0.1
    found = svd.singular(y, y.columns[1:], 6)
    u = array(found.u)
    assert found.way == "tsqr" and np.allclose(found.sigma, want, rtol=1e-5, atol=0)
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-12) and np.allclose(u * found.sigma @ found.v.T, m, atol=1e-14)
    assert svd.singular(factor(spark, np.diag([3.0, 2.0, 1.0])), ["u0", "u1", "u2"], 2).way == "gram"


def test_triangles_of_many_parts(spark):
    m = np.random.RandomState(2).standard_normal((200, 4))
    for parts in (1, 2, svd.FAN * 2 + 3):
        r = svd.triangle(factor(spark, m, parts), ["u0", "u1", "u2", "u3"])
        assert np.allclose(r.T @ r, m.T @ m)
    assert svd.triangle(factor(spark, m[:2], 1), ["u0", "u1", "u2", "u3"]).shape == (2, 4)
    assert svd.triangle(factor(spark, m[:1], 1).where("x > 5"), ["u0", "u1", "u2", "u3"]).size == 0
    ys = factor(spark, m).select("x", F.array("u0", "u1", "u2", "u3").alias("y"))
    assert np.allclose(svd.tall(ys, ["y"], 4).sigma, np.linalg.svd(m)[1])


def test_short_of_rank(spark):
    draw = np.random.RandomState(3)
    y = factor(spark, np.outer(draw.standard_normal(20), draw.standard_normal(4)))
    bare, whole = (array(svd.tall(y, y.columns[1:], 3, complete=c).u) for c in (False, True))
    assert np.allclose(whole.T @ whole, np.eye(3), atol=1e-9) and np.allclose(bare[:, 0], whole[:, 0]) and not bare[:, 1:].any()
    m = np.zeros((4, 9))
    m[0, 2], m[2, 5] = 3, 1
    found = svd.left_vectors(sparse(spark, m), 4, 9, 4)
    u = array(found.u)
    assert np.allclose(found.sigma, [3, 1, 0, 0]) and np.allclose(u.T @ u, np.eye(4))
    assert not array(svd.left_vectors(sparse(spark, m), 4, 9, 4, complete=False).u)[:, 2:].any()


@pytest.mark.parametrize("cells,way", [(1 << 20, "gram"), (100, "power")])
def test_left_vectors(spark, entries, cells, way):
    left, sigma, _ = np.linalg.svd(entries)
    for m in (entries, entries.T):
        left, sigma, _ = np.linalg.svd(m)
        found = svd.left_vectors(sparse(spark, m), *m.shape, 3, cells=cells)
        u = array(found.u)
        assert found.way == way and np.allclose(found.sigma, sigma[:3], rtol=1e-9)
        assert np.allclose(u @ u.T, left[:, :3] @ left[:, :3].T, atol=1e-5)


def test_wide_without_a_gram_matrix(spark):
    m = graded().T
    found = svd.left_vectors(sparse(spark, m), 6, 60, 6)
    assert found.way == "tsqr" and np.allclose(found.sigma, np.linalg.svd(m)[1], rtol=1e-5, atol=0)


def test_iterated_of_low_rank_and_of_nothing(spark):
    m = np.outer(np.arange(1.0, 6), np.arange(1.0, 4))
    found = svd.iterated(sparse(spark, m), 2)
    assert np.allclose(found.sigma, [np.linalg.norm(m), 0], atol=1e-9)
    assert svd.iterated(sparse(spark, m).limit(0), 2).sigma.size == 0


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_nvecs(spark, mode):
    toy = spark.createDataFrame(TOY, "i0 long, i1 long, i2 long, v double")
    assert np.allclose(svd.nvecs(toy, [3, 3, 3], mode, 3).sigma, UNFOLDED[mode], atol=1e-5)


@pytest.mark.parametrize("chunk", [3, 512])
def test_sparse_gram(spark, entries, chunk):
    got = np.zeros((40, 40))
    for r in linalg.gram_self_join(sparse(spark, entries), chunk).collect():
        got[r["row"], r["col"]] += r["v"]
    assert np.array_equal(got, entries.T @ entries)


def test_hooi_without_a_column_for_each_rank(spark):
    toy = spark.createDataFrame(TOY, "i0 long, i1 long, i2 long, v double")
    wide, long = (tucker.hooi(toy, [3, 3, 3], [2, 2, 2], sweeps=2, cells=c).fits for c in (1 << 20, 10))
    assert wide == pytest.approx(long, abs=1e-7)


def test_runs(spark):
    draw = np.random.RandomState(4)
    x = coo.canonical(spark.createDataFrame([(int(a), int(b), int(c), 1.0) for a, b, c in zip(draw.randint(0, 3, 900), draw.randint(0, 9, 900), draw.randint(0, 40, 900))], "i0 long, i1 long, i2 long, v double"))
    got = runs(x, ["i0", "i1", "i2"], [1, 2, 3], [0, 1, 2]).toPandas().sort_values(["i0", "i1", "i2"]).reset_index(drop=True)
    assert (got["run3"] == got.index).all() and (got["place0"] == got.index).all()
    assert (got["run1"] == got["i0"].rank(method="dense") - 1).all()
    assert (got["run2"] == got.groupby(["i0", "i1"]).ngroup()).all()
    assert (got["place1"] == got.groupby("i0").cumcount()).all() and (got["place2"] == got.groupby(["i0", "i1"]).cumcount()).all()
    hot = spark.range(1000).select(F.lit(7).cast("long").alias("a"), F.col("id").alias("b"))  # one run over all parts
    assert runs(hot, ["a", "b"], [], [1]).where("place1 <> b").isEmpty()
    assert runs(hot.limit(0), ["a", "b"], [1], [1]).columns == ["a", "b", "run1", "place1"]


def test_long_index_in_chunks(spark):
    x = spark.createDataFrame([(k, 0, 1.0) for k in range(10)], "i0 long, i1 long, v double")
    got = {r["chunk"]: r["positions"] for r in formats.inverted_index(x, 1, 4).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
