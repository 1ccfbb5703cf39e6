"""The operators on vectors against plain versions: clusters, codes and neighbours."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import clustering, codes, neighbours, registry

SCHEMA = "vec_id long, embedding array<float>, label int, id long, label_error long, row long, position int, n long, v string, cluster int, `rank` int, salt int"
SMALL = "/root/testdata/sf0.001"


def table(spark, data):
    """Rows (vec_id, embedding, label) beside columns whose names the operators use inside."""
    return spark.createDataFrame([(*x, 1, 2, 3, 4, 5, "v", 6, 7, 8) for x in data], SCHEMA)


def vectors(n, seed=0, width=64):
    r = np.random.RandomState(seed)
    m = r.standard_normal((n, width)).astype(np.float32) / 8
    m[5] = m[3]  # copies
    m[n // 2 : n // 2 + 20] = m[7]
    return m


def odd(width=64):
    """Vectors that take no part where exactly `width` finite components are due."""
    good = [0.5] * width
    return [None, [], good[:-1], [*good, 0.5], [None, *good[1:]], [float("nan"), *good[1:]], [float("inf"), *good[1:]]]


def rows_of(m, labels=None, first=0):
    return [(first + i, [float(x) for x in v], None if labels is None or labels[i] < 0 else int(labels[i])) for i, v in enumerate(m)]


def brute_clusters(data, k, rounds, width):
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v, _ in data if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda t: (hashlib.sha256(f"1:{'' if t[0] is None else t[0]}".encode()).hexdigest(), list(t[1])))
    c = np.array([v for _, v in order[:k]])
    x = np.array([v for _, v in kept])
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if turn < rounds:
            c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    low = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted([(i, int(j), int(e), int(low[a == j].sum()), int(low.sum()), sha[j]) for (i, _), j, e in zip(kept, a, low, strict=True)], key=str)


@pytest.mark.parametrize("k,leaf", [(16, 4), (5, 1), (40, 2)])
def test_clusters(spark, monkeypatch, k, leaf):
    monkeypatch.setattr(clustering, "LEAF", leaf)
    data = [*rows_of(vectors(150)), *((1000 + i, v, 1) for i, v in enumerate(odd())), (None, [0.25] * 64, 2), (7, [0.125] * 64, 2), (7, [0.125] * 64, 2)]
    got = clustering.cluster(table(spark, data).repartition(3), k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(data, k, 3, 64)


def test_clusters_of_few_and_of_none(spark):
    data = rows_of(vectors(30)[:4])
    assert sorted(map(tuple, clustering.cluster(table(spark, data)).collect()), key=str) == brute_clusters(data, 16, 3, 64)
    assert clustering.cluster(table(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(Exception, match="don't fit"):
        clustering.cluster(table(spark, [(1, [1e30] * 64, 1)])).collect()


def test_tree_keeps_ties_and_equal_centroids():
    """Centroids on a grid, many of them equal or as far: the tree names the smallest number, as all comparisons do."""
    r = np.random.RandomState(1)
    for k in (1, 3, 30, 200):
        c, x = r.randint(-2, 3, (k, 3)).astype(np.int64), r.randint(-3, 4, (400, 3)).astype(np.int64)
        number, best = clustering.nearest(x, c, clustering.vantage_tree(c))
        d = clustering.squares(x, c)
        assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


def brute_codes(data, parts, entries, rounds, width):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(int), label) for i, v, label in data if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, list(kept[n][1])))[:entries]
    book = x[first].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None] - book[:, None]) ** 2).sum(3)
        a = d.argmin(2)
        if turn < rounds:
            book = np.array([[x[a[p] == e, p].sum(0) // (a[p] == e).sum() if (a[p] == e).any() else book[p, e] for e in range(book.shape[1])] for p in range(parts)])
    error = d.min(2).sum(0)
    sha = hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + int(e)
    return sorted([(i, "".join(f"{c:02x}" for c in a[:, n]), int(error[n]), by_label[label], sha) for n, (i, _, label) in enumerate(kept)], key=str)


@pytest.mark.parametrize("parts,entries,rounds", [(16, 64, 2), (4, 9, 3), (64, 256, 1)])
def test_codes(spark, parts, entries, rounds):
    labels = np.random.RandomState(2).randint(-1, 3, 150)
    data = [*rows_of(vectors(150), labels), *((1000 + i, v, 1) for i, v in enumerate(odd())), (None, [0.25] * 64, 2), (7, [0.125] * 64, None), (7, [0.125] * 64, None)]
    got = codes.encode(table(spark, data).repartition(3), parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(data, parts, entries, rounds, 64)


def test_codes_of_few_and_of_none(spark):
    data = rows_of(vectors(30)[:4])
    assert sorted(map(tuple, codes.encode(table(spark, data)).collect()), key=str) == brute_codes(data, 16, 64, 2, 64)
    assert codes.encode(table(spark, [(1, None, 1)])).count() == 0


def brute_neighbours(data, k, every):
    usable = [(i, np.pad(np.array(v, np.float64), (0, 80 - len(v)))) for i, v, _ in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (q, x) in enumerate(usable):
        if q % every == 0:
            others = [(-float(neighbours.products(x[None], y[None])[0]), i) for m, (i, y) in enumerate(usable) if m != n]
            out.setdefault(q, []).append(sorted(others)[:k])
    return out


@pytest.mark.parametrize("leaf,part,block", [(256, 4096, 4096), (8, 40, 7)])
def test_neighbours(spark, monkeypatch, leaf, part, block):
    """With a test that never fails, the same as comparing all; with the usual one nine of ten at least."""
    for name, value in (("LEAF", leaf), ("PART", part), ("BLOCK", block)):
        monkeypatch.setattr(neighbours, name, value)
    m = vectors(300)
    data = [*rows_of(m), *((3000 + i, v, 1) for i, v in enumerate(odd()) if v is None or len(v) != 63), (3100, [0.0] * 64, 1), (3200, [0.5] * 10, 1), (None, [0.5] * 64, 1)]
    want = brute_neighbours(data, 20, 20)
    df = table(spark, data).repartition(3)
    usual = neighbours.neighbours(df).collect()
    got = {}
    for r in usual:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    found = [len({i for i, _ in got[q].values()} & {i for _, i in want[q][0]}) for q in want]
    assert sum(found) / len(found) >= 18
    monkeypatch.setattr(neighbours, "SURE", 1 - 1e-9)
    sure = {}
    for r in neighbours.neighbours(df).collect():
        sure.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert {q: [v[n] for n in sorted(v)] for q, v in sure.items()} == {q: v[0] for q, v in want.items()}


def test_neighbours_of_copies_ties_and_repeats(spark):
    """Many copies of one vector: the smallest ids come first, and a row that repeats finds its other copy."""
    one = [0.5] + [0.0] * 63
    data = [*((i, one, 1) for i in range(100)), (100, [0.25] + [0.0] * 63, 1), (20, one, 1), (200, [0.0, 1.0] + [0.0] * 62, 1)]
    got = {}
    for r in neighbours.neighbours(table(spark, data).repartition(4), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(n + 1, v, 0.25) for n, v in enumerate([1, 2, 3, 4, 5])]
    assert sorted(got[40]) == [(n + 1, n, 0.25) for n in range(5)]
    assert sorted(got[20]) == sorted(2 * [(n + 1, n, 0.25) for n in range(5)])
    assert [v for _, v, _ in sorted(got[100])] == [0, 1, 2, 3, 4] and [s for *_, s in sorted(got[200])] == [0.0] * 5
    few = neighbours.neighbours(table(spark, [(0, one, 1), (1, one, 1), (2, [0.0] * 63 + [1.0], 1)]), k=5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in few) == [(1, 1, 0.25), (2, 2, 0.0)]
    twice = neighbours.neighbours(table(spark, [(0, one, 1), (0, one, 1)]), k=5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in twice] == [(0, 1, 0), (0, 1, 0)]
    assert neighbours.neighbours(table(spark, [(0, None, 1)])).count() == 0


def test_chi_square():
    """Quantiles against drawn sums of squares."""
    drawn = (np.random.RandomState(3).standard_normal((200_000, 16)) ** 2).sum(1)
    for p in (0.1, 0.5, 0.95):
        assert (drawn < neighbours.quantile(p)).mean() == pytest.approx(p, abs=0.005)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't here")
@pytest.mark.parametrize("name", ["op11_clustering", "op12_codes"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(registry.SQL[name])
    got = registry.QUERIES[name](spark, SMALL)
    assert sorted(c[0] for c in want.description) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*(c[0] for c in want.description)).collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't here")
def test_recall(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = {q: {i for _, i in v[0]} for q, v in brute_neighbours(rows, 20, 20).items()}
    got = {r["query_id"]: set(r["ids"]) for r in registry.QUERIES["op13_neighbours"](spark, SMALL).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()}
    assert sum(len(got[q] & want[q]) for q in want) / (20 * len(want)) >= 0.95
