"""Centroid clustering: Lloyd's rounds, with the nearest centroid found in a vantage-point tree.

The tree over the centroids is built anew in each round and broadcast; it has one node for each
centroid at most. Each vector goes through it best first: the node with the least lower bound comes
next, until that bound lies above the best distance so far. Bounds equal to it are followed, so that
ties reach the smaller number. Distances are sums of whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import written
from .vectors import first_rows, integers, lists

#: Centroids of a leaf, at most.
LEAF = 4
#: Centroids that the driver keeps and broadcasts, at most.
MOST_CENTROIDS = 1 << 14
#: Vectors that go through the tree side by side.
SIDE_BY_SIDE = 2048
#: Roots of distances differ from the exact ones by less than this share; bounds are lowered by it.
ROUNDING = 1e-12


@dataclass
class Node:
    """A leaf has centroids alone; else `vantage` is one, and children lie between near and far of it."""

    members: np.ndarray
    vantage: int = -1
    children: tuple[tuple[int, float, float], ...] = ()


def vantage_tree(centroids: np.ndarray) -> list[Node]:
    """The nodes of the tree, root first. The vantage point is the member farthest from the first one; the median parts the rest."""
    nodes: list[Node] = []

    def grow(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(Node(members))
        if len(members) <= LEAF:
            return at
        vantage = int(members[squares(centroids[members[:1]], centroids[members])[0].argmax()])
        rest = members[members != vantage]
        d = np.sqrt(squares(centroids[[vantage]], centroids[rest])[0].astype(float))
        rest, d = rest[np.argsort(d, kind="stable")], np.sort(d, kind="stable")
        half = len(rest) // 2
        children = tuple((grow(np.sort(rest[s])), d[s][0], d[s][-1]) for s in (slice(0, half), slice(half, None)) if len(rest[s]))
        nodes[at] = Node(members[:0], vantage, children)
        return at

    grow(np.arange(len(centroids)))
    return nodes


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of y, exact in 64 bits."""
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - y[None, :, k]
        out += d * d
    return out


def nearest(x: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, the smaller one of equals, and the squared distance."""
    best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(centroids))
    bounds = np.full((len(x), len(nodes)), np.inf)
    bounds[:, 0] = 0

    def meet(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        d = squares(x[rows], centroids[members])
        low = d.min(1)
        first = members[(d == low[:, None]).argmax(1)]  # members rise
        better = (low < best[rows]) | ((low == best[rows]) & (first < number[rows]))
        best[rows[better]], number[rows[better]] = low[better], first[better]
        return d

    while True:
        node = bounds.argmin(1)
        live = np.flatnonzero(bounds[np.arange(len(x)), node] <= np.sqrt(best.astype(float)) * (1 + ROUNDING))
        live = live[np.isfinite(bounds[live, node[live]])]
        if not len(live):
            return number, best
        for n in np.unique(node[live]):
            rows = live[node[live] == n]
            above = bounds[rows, n]
            bounds[rows, n] = np.inf
            if nodes[n].vantage < 0:
                meet(rows, nodes[n].members)
                continue
            d = np.sqrt(meet(rows, np.array([nodes[n].vantage]))[:, 0].astype(float))
            for child, near, far in nodes[n].children:
                gap = np.maximum(d - far, near - d) - ROUNDING * (d + far)
                bounds[rows, child] = np.maximum(above, gap)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with exactly `components` finite components.

    Components are floor(scale * x). The k vectors with the least sha256 of `1:<id>` are the first
    centroids (ids that repeat: by their vectors; no id counts as an empty one). After each round a
    centroid is the floor of its vectors' means; one without vectors stays. Vectors that are null,
    empty, of another length or with null or non-finite components take no part, long ones too.
    Equal distances go to the smaller number; repeated rows are rows of their own. With fewer than k
    vectors there are fewer centroids, and without any no rows. Other columns aren't read, so their
    names can't clash. Components beyond 2^27 raise, and so do more than MOST_CENTROIDS centroids.

    What the driver takes are the centroids and their sums by component; each task adds up its own
    vectors first, so a hot vector or cluster gathers nowhere.
    """
    if k > MOST_CENTROIDS:
        raise ValueError(f"{k} centroids are more than {MOST_CENTROIDS}")
    spark = vectors.sparkSession
    ship(spark)
    kept = integers(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", components, scale, "clustering-vectors")
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = first_rows(kept, [hashed], "v", k)

    def through(centroids: np.ndarray, emit):
        """A pass over the vectors; emit() makes batches of (batch, vectors, numbers, distances)."""
        shared = spark.sparkContext.broadcast((centroids, vantage_tree(centroids)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def met():
                for b in batches:
                    for at in range(0, b.num_rows, SIDE_BY_SIDE):
                        part = b.slice(at, SIDE_BY_SIDE)
                        x = _numbers(part.column(1))
                        yield (part, x, *nearest(x, *shared.value))

            yield from emit(met())

        return shared, run

    def sums(met) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), components), np.int64)
        for _, x, number, _ in met:
            n += np.bincount(number, minlength=len(n))
            order = np.argsort(number, kind="stable")
            held, first = np.unique(number[order], return_index=True)
            total[held] += np.add.reduceat(x[order], first, axis=0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), lists(total[held], pa.int64())], names=["cluster", "n", "total"])

    def rows(met) -> Iterator[pa.RecordBatch]:
        for part, _, number, best in met:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    for _ in range(rounds if len(centroids) else 0):
        shared, run = through(centroids, sums)
        by_cell = kept.mapInArrow(run, "cluster long, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
        for r in by_cell.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            centroids[r["cluster"], r["at"]] = r["x"] // r["n"]
        shared.destroy()
    shared, run = through(centroids, rows)
    assigned = written(kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, cluster int, distance long"), "clustering-assigned")
    shared.destroy()
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, inertia[c], sum(inertia.values()), digests[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each centroid.
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql(k: int = 16, rounds: int = 3) -> str:
    """The clusters by comparing each vector with all centroids."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    out = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept) ORDER BY h, v LIMIT {k})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS (SELECT vec_id, v, min({{'d': {dist}, 'n': number}}) AS b FROM (SELECT row_number() OVER () AS row_, * FROM kept) CROSS JOIN c{r} GROUP BY row_, vec_id, v)")
        if r < rounds:
            cell = f"(SELECT n, i, (s - ((s % m) + m) % m) // m AS x FROM (SELECT b.n AS n, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS m FROM a{r} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2))"
            out.append(f"c{r + 1} AS (SELECT number, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT n, list(CAST(x AS BIGINT) ORDER BY i) AS c FROM {cell} GROUP BY n) n ON n.n = number)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(out)}
SELECT vec_id, CAST(b.n AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.n) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON number = b.n"""
