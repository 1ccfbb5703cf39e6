"""Approximate nearest neighbours by largest inner product: low-dimensional stable projections in kd-trees.

Vectors get one more component, so that all have the length of the longest and the largest inner
product is the least distance. `DIMENSIONS` Gaussian projections take a squared distance d to d times
a chi-square number. Candidates come in the order of their projected distances; a query ends where
a vector as near as its k-th so far would have come before with a probability of SURE.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import written

#: Projections; an even number.
DIMENSIONS = 16
#: The probability by which the stopping test holds.
SURE = 0.95
#: Vectors of a leaf, and of a part of a cell, whose kd-tree one task holds.
LEAF, PART = 256, 4096
#: Queries that meet a part in one task.
BLOCK = 4096
#: Cells that the driver knows, at most, and vectors of the sample that parts them, in expectation.
MOST_CELLS, SAMPLE = 4096, 40_000
#: Pairs that wait for their exact scores, at most, before all but the best of them go.
MOST_FOUND = 1 << 20
#: By this share of the longest product, sums in another order may differ.
ROUNDING = 1e-12


def quantile(p: float, m: int = DIMENSIONS) -> float:
    """Where the chi-square distribution of m (even) degrees of freedom reaches p."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for j in range(1, m // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Space:
    """How vectors are lengthened and projected; longest is the greatest length."""

    longest: float
    matrix: np.ndarray

    def candidates(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, 1 - ((x / self.longest) ** 2).sum(1)))
        return (x / self.longest) @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return unit(q) @ self.matrix[:-1]


def unit(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(1, keepdims=True)
    return q / np.sqrt((q * q).sum(1, keepdims=True))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed up in the same order wherever it stands."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def halves(y: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The leaves of a kd-tree: rows parted at the median of their widest dimension until a leaf has `most` at most."""
    if len(rows) <= most:
        yield rows
        return
    widest = int((y[rows].max(0) - y[rows].min(0)).argmax())
    half = len(rows) // 2
    order = rows[np.argpartition(y[rows, widest], half)]
    yield from halves(y, order[:half], most)
    yield from halves(y, order[half:], most)


def apart(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(y), len(low)))
    for k in range(y.shape[1]):
        d = np.maximum(0, np.maximum(low[None, :, k] - y[:, k, None], y[:, k, None] - high[None, :, k]))
        out += d * d
    return out


def best(space: Space, q: np.ndarray, x: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best of the candidates x for each query, by the stopping test; equal scores go to the first.

    known has each query's k-th best score from elsewhere; what lies below it is left out.
    """
    py, qy, far = space.candidates(x), space.queries(q), quantile(SURE)
    length = np.sqrt((q * q).sum(1))
    slack = ROUNDING * length * space.longest
    leaves = list(halves(py, np.arange(len(x)), LEAF))
    boxes = apart(qy, np.array([py[r].min(0) for r in leaves]), np.array([py[r].max(0) for r in leaves]))
    order = boxes.argsort(1)
    top, bound = np.full((len(q), k), -np.inf), known.copy()
    limit, live = reach(far, bound, length, space.longest), np.arange(len(q))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, member = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        score = products(q[query], x[member])
        at = np.lexsort((member, -score, query))
        place = np.arange(len(at)) - np.searchsorted(query[at], query[at])
        at = at[(place < k) & (score[at] >= (known - slack)[query[at]])]
        return query[at], member[at], score[at]

    for turn in range(len(leaves)):
        live = live[boxes[live, order[live, turn]] <= limit[live]]
        if not len(live):
            break
        at = order[live, turn]
        for leaf in np.unique(at):
            rows, asked = leaves[leaf], live[at == leaf]
            y = py[rows]
            near = (qy[asked] ** 2).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * qy[asked] @ y.T <= limit[asked, None] * (1 + 1e-9) + 1e-9
            score = np.where(near, q[asked] @ x[rows].T, -np.inf)
            query, member = np.nonzero(score >= (bound - slack)[asked, None])
            query, member = (c[np.isfinite(score[query, member])] for c in (query, member))
            found.append((asked[query], rows[member]))
            some = np.unique(query)
            both = np.concatenate([top[asked[some]], score[some]], 1)
            top[asked[some]] = -np.partition(-both, k - 1, axis=1)[:, :k]
        bound[live] = np.maximum(known[live], top[live].min(1))
        limit[live] = reach(far, bound[live], length[live], space.longest)
        if sum(len(c) for c, _ in found) > MOST_FOUND:
            found = [settle()[:2]]
    return settle()


def reach(far: float, score: np.ndarray, length: np.ndarray, longest: float) -> np.ndarray:
    """The squared projected distance at which the stopping test holds for a k-th score."""
    with np.errstate(invalid="ignore"):
        return far * np.maximum(0, 2 - 2 * score / (length * longest))


@dataclass
class Cells:
    """The upper levels of the kd-tree: by level the dimension and the threshold of each node, and what the cells hold."""

    dimensions: list[np.ndarray]
    thresholds: list[np.ndarray]
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    parts: np.ndarray | None = None

    def of(self, y: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(y), np.int64)
        for dimension, threshold in zip(self.dimensions, self.thresholds, strict=True):
            cell = 2 * cell + (y[np.arange(len(y)), dimension[cell]] > threshold[cell])
        return cell


def parted(sample: np.ndarray, wanted: int) -> Cells:
    """Cells of near equal shares of a sample, `wanted` of them or less than twice as many."""
    out, groups = Cells([], []), [sample]
    while len(groups) < wanted:
        dimension = np.array([int((g.max(0) - g.min(0)).argmax()) if len(g) else 0 for g in groups])
        threshold = np.array([float(np.median(g[:, d])) if len(g) else 0.0 for g, d in zip(groups, dimension, strict=True)])
        out.dimensions.append(dimension)
        out.thresholds.append(threshold)
        groups = [side for g, d, t in zip(groups, dimension, threshold, strict=True) for side in (g[g[:, d] <= t], g[g[:, d] > t])]
    return out


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists as the rows of a matrix; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v, square) of vectors with finite components and a length above zero."""
    for b in batches:
        v = b.column(1)
        lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            square = np.bincount(np.repeat(np.arange(len(v)), lengths), flat * flat, len(v))
        ok = pa.array(np.isfinite(square) & (square > 0))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), v.filter(ok), pa.array(square).filter(ok)], names=["id", "v", "square"])


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by `every`, the k rows with the largest inner products.

    A query ends by the stopping test, so that each of its neighbours is found with a probability of
    SURE at least; scores are exact sums of doubles. Equal scores go to the smaller id. Vectors that
    are null, empty, zero (or whose squared length leaves the doubles), or hold null or non-finite
    components take no part, and neither do rows without an id, which nothing could name. Shorter
    vectors count as if zeros followed; long ones are whole. Rows of one id are rows of their own, so
    a repeated row finds its other copies. Fewer candidates than k are all returned; no rows give
    none. Other columns aren't read, so their names can't clash.

    Equal vectors are searched for, and found, as one, with the k + 1 smallest of their ids: a query
    can return no more of them. The driver takes a sample of projections (SAMPLE), the boxes of
    MOST_CELLS cells and counts by cell. A cell is dealt in parts of about PART vectors, each with a
    kd-tree of its own, and its queries in blocks of about BLOCK.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind, most = dict(vectors.dtypes)[vector_col], k + 1
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    rows = named.mapInArrow(_usable, f"id long, v {kind}, square double")
    rows = written(rows.select("*", F.xxhash64("v").alias("h"), F.pmod(F.monotonically_increasing_id(), F.lit(16)).alias("salt")), "neighbours-rows")
    about = rows.agg(F.max("square").alias("square"), F.max(F.size("v")).alias("width")).first()
    if about["square"] is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    width = about["width"]
    space = Space(math.sqrt(about["square"]), np.random.RandomState(13).standard_normal((width + 1, DIMENSIONS)))

    place = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    few = rows.withColumn("place", place("h", "v", "salt")).where(F.col("place") <= most).withColumn("place", place("h", "v")).where(F.col("place") <= most)
    groups = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("n", F.monotonically_increasing_id())
    groups = written(groups.select("n", "h", "v", "ids"), "neighbours-groups")
    asked = written(rows.where(F.col("id") % every == 0).select("id", "h", "v").join(groups.select("n", "h", "v"), ["h", "v"]).select("id", "n"), "neighbours-asked")
    queries = groups.select("n", "v").join(asked.select("n").distinct(), "n", "left_semi")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = space.candidates(padded(b.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(y[:, d]) for d in range(DIMENSIONS)], names=names)

    names = [f"y{d}" for d in range(DIMENSIONS)]
    total = groups.count()
    sample = groups.sample(min(1.0, SAMPLE / total), seed=13).select("v").mapInArrow(projected, ", ".join(f"{c} double" for c in names)).toArrow()
    sample = np.stack([sample.column(c).to_numpy() for c in names], 1)
    cells = parted(sample, min(MOST_CELLS, -(-total // PART)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, at, n, low, high) of a task's vectors."""
        held: dict[int, list] = {}
        for b in batches:
            y = space.candidates(padded(b.column(0), width))
            cell = cells.of(y)
            for c in np.unique(cell):
                of = y[cell == c]
                n, low, high = held.get(c, (0, np.inf, -np.inf))
                held[c] = [n + len(of), np.minimum(low, of.min(0)), np.maximum(high, of.max(0))]
        for c, (n, low, high) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(DIMENSIONS, c)), pa.array(np.arange(DIMENSIONS)), pa.array(np.full(DIMENSIONS, n)), pa.array(low), pa.array(high)], names=["cell", "at", "n", "low", "high"])

    boxes = groups.select("v").mapInArrow(measured, "cell long, at long, n long, low double, high double").groupBy("cell", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    count = 1 << len(cells.dimensions)
    cells.low, cells.high, cells.parts = np.full((count, DIMENSIONS), np.inf), np.full((count, DIMENSIONS), np.inf), np.zeros(count, np.int64)
    for r in boxes:
        cells.low[r["cell"], r["at"]], cells.high[r["cell"], r["at"]], cells.parts[r["cell"]] = r["low"], r["high"], -(-r["n"] // PART)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(n, v, ids, cell, part)."""
        for b in batches:
            n, cell = b.column(0).to_numpy(), cells.of(space.candidates(padded(b.column(1), width)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(n % cells.parts[cell])], names=["n", "v", "ids", "cell", "part"])

    def visits(home: bool, whole: bool):
        """(cell, part, n[, v, known]) of queries (n, v, known): their own cell, or the others that the test doesn't rule out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    q, known = padded(part.column(1), width), part.column(2).to_numpy()
                    own = cells.of(space.candidates(q))
                    if home:
                        row, cell = np.arange(len(q)), own
                    else:
                        length = np.sqrt((q * q).sum(1))
                        near = apart(space.queries(q), cells.low, cells.high) <= reach(quantile(SURE), known, length, space.longest)[:, None]
                        near[np.arange(len(q)), own] = False
                        near[:, cells.parts == 0] = False
                        row, cell = np.nonzero(near)
                    row, cell, of = np.repeat(row, cells.parts[cell]), np.repeat(cell, cells.parts[cell]), [np.arange(cells.parts[c]) for c in cell]
                    out = [pa.array(cell), pa.array(np.concatenate(of) if len(of) else np.zeros(0, np.int64)), part.column(0).take(pa.array(row))]
                    yield pa.RecordBatch.from_arrays([*out, *((part.column(c).take(pa.array(row)) for c in (1, 2)) if whole else ())], names=["cell", "part", "n", *(["v", "known"] if whole else ())])

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of a part's candidates for a block of queries."""
        left, right = left.sort_by("first").combine_chunks(), right.combine_chunks()
        if not (left.num_rows and right.num_rows):
            return pa.table({"n": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "of": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
        q, x = (padded(t.column("v").chunk(0), width) for t in (right, left))
        query, member, score = best(space, q, x, most, right.column("known").to_numpy())
        return pa.table({"n": right.column("n").take(pa.array(query)), "score": pa.array(score), "of": left.column("n").take(pa.array(member)), "ids": left.column("ids").take(pa.array(member))})

    def found(queries: DataFrame, home: bool) -> DataFrame:
        """(n, score, of, ids) of queries (n, v, known)."""
        queries = queries.select("n", "v", "known")
        per = queries.mapInArrow(visits(home, False), "cell long, part long, n long").where("part = 0").groupBy("cell").count().collect()
        blocks = np.ones(count, np.int64)
        for r in per:
            blocks[r["cell"]] = -(-r["count"] // BLOCK)
        of = F.element_at(F.lit(blocks.tolist()), (F.col("cell") + 1).cast("int"))
        keys = ["cell", "part", "block"]
        held = groups.select("n", "v", "ids").mapInArrow(candidates, f"n long, v {kind}, ids array<long>, cell long, part long")
        held = held.withColumn("first", F.col("ids")[0]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), of - 1)))
        sent = queries.mapInArrow(visits(home, True), f"cell long, part long, n long, v {kind}, known double").withColumn("block", F.pmod(F.xxhash64("n"), of))
        return written(held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, "n long, score double, of long, ids array<long>"), "neighbours-found")

    lowest = F.lit(float("-inf"))
    home = found(queries.withColumn("known", lowest), True)
    known = home.withColumn("place", F.row_number().over(W.partitionBy("n").orderBy(F.desc("score")))).where(F.col("place") == most).select("n", F.col("score").alias("known"))
    away = found(queries.join(known, "n", "left").withColumn("known", F.coalesce("known", lowest)), False)
    each = home.unionByName(away).select("n", "score", "of", F.explode("ids").alias("id"))
    first = each.withColumn("place", F.row_number().over(W.partitionBy("n").orderBy(F.desc("score"), "id", "of"))).where(F.col("place") <= most)
    tops = first.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score", "of", "id"))), lambda t: F.struct(t["score"].alias("score"), t["of"].alias("of"), t["id"].alias("id"))).alias("tops"))
    own = F.array_position(F.transform("tops", lambda t: (t["of"] == F.col("n")) & (t["id"] == F.col("query_id"))), True)
    ranked = asked.withColumnRenamed("id", "query_id").join(tops, "n").withColumn("own", own)
    others = F.slice(F.filter("tops", lambda t, at: (F.col("own") == 0) | (at != F.col("own") - 1)), 1, k)
    return ranked.select("query_id", F.posexplode(others).alias("rank", "t")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.score").alias("score"))
