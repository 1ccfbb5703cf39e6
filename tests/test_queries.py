"""Every query that has SQL agrees with it, on the smallest tables; the others run."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from tensorloom.plans import catalog

HERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{HERE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    def cell(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and not isinstance(x, (int, float)) and getattr(x, "ndim", 0):
            return tuple(x)
        return None if pd.isna(x) else float(f"{x:.9g}") if isinstance(x, numbers.Number) and not isinstance(x, bool) else x

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(HERE), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, HERE).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(duck.execute(catalog.SQL[name]).df())
    else:
        assert len(got)


@pytest.mark.skipif(not os.path.isdir(HERE), reason="the tables aren't here")
def test_whole_tables(spark, duck):
    """Queries that once took a part of a table take it whole."""
    run = lambda name: catalog.QUERIES[name](spark, HERE).toPandas()
    total, orders = (duck.execute(f"SELECT sum(l_quantity) FROM lineitem {j}").fetchone()[0] for j in ("", "JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"))
    assert run("gemm_nations")["v"].sum() == orders
    assert run("densify_months")["v"].sum() == total and run("dense_tensor_roundtrip")["v"].sum() == total
    assert run("densify_small")["v"].sum() == duck.execute("SELECT count(*) FROM events").fetchone()[0]
    assert run("csf_text_roundtrip")["v"].sum() == total and run("csf_text_roundtrip_all")["v"].sum() == total
    s2 = run("transpose")
    below, diagonal = s2[s2["col"] >= s2["row"]]["v"].sum(), s2[s2["col"] == s2["row"]]["v"].sum()
    assert run("mtx_symmetric_all")["v"].sum() == 2 * below - diagonal
    assert set(run("gemv_affine_all")["row"]) == set(range(int(s2["col"].max()) + 1))
    assert set(run("gemv_affine")["row"]) == set(range(int(s2["row"].max()) + 1))
