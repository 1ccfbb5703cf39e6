"""Near-duplicate documents by b-bit MinHash, confirmed on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import chosen, row_keys, slices, written
from .components import components

#: Most bands, but for the least similarities, and the share of pairs on the threshold that may share none of them.
BANDS, MISSES = 32, 3.1e-6
#: Minima of a signature, of which it keeps the lowest bit, and the 64-bit words that hold them.
MINIMA = 2048
WORDS = MINIMA // 64
#: How far below the threshold 0.8 an estimate may lie: five standard errors.
SLACK = 0.067
#: Members of a bucket outside its largest component that are tried in one round.
ALL_AT_ONCE = 1000
_RNG = np.random.RandomState(20_240_501)


def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = _RNG.randint(1, 2**62, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, _RNG.randint(0, 2**62, n, dtype=np.int64).astype(np.uint64)


_OF_BANDS, _OF_SIGNATURES = _hashers(160), _hashers(MINIMA)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest rows of minima with which BANDS bands miss few enough pairs of percent; from 80 on, 32 and 5.

    Where even rows of one minimum need more bands, there are as many as that takes.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"a similarity of {percent} percent isn't above 0 and up to 100")
    if percent >= 80:
        return BANDS, 5
    need = lambda rows: math.ceil(math.log(MISSES) / math.log1p(-((percent / 100) ** rows)))
    rows = max((r for r in range(2, 6) if need(r) <= BANDS), default=1)
    return need(rows), rows


def band_hashers(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The hash functions of the bands, the first of them the same for any shape."""
    a, b = _OF_BANDS
    if (n := shape[0] * shape[1] - len(a)) > 0:
        r = np.random.RandomState(20_240_502)
        more = r.randint(1, 2**62, (2, n), dtype=np.int64).astype(np.uint64)
        a, b = np.concatenate([a, more[0] * np.uint64(2) + np.uint64(1)]), np.concatenate([b, more[1]])
    return a[: shape[0] * shape[1]], b[: shape[0] * shape[1]]


def slack(least: float) -> float:
    """How far below least an estimate may lie: five standard errors, in thousandths; SLACK from 0.8 on."""
    differ = (1 - least) / 2
    return max(SLACK, math.ceil(1e4 * math.sqrt(differ * (1 - differ) / MINIMA)) / 1e3)


class _Words(dict):
    """Word to hash, as far as seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, words: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of width-word shingles; fewer words make one, none make none."""
    found = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(width, len(h))
    rolled = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        rolled = _mixed(rolled * _MIX + h[i : len(h) - n + 1 + i])
    return np.unique(rolled)


def minima(sets: list[np.ndarray], hashers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(sets, minima) of non-empty sets under each of the hash functions."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    return np.stack([np.minimum.reduceat(flat * a + b, starts) for a, b in zip(*hashers, strict=True)], axis=1)


def packed(low: np.ndarray) -> np.ndarray:
    """(sets, WORDS): a low bit of each minimum, 64 to a word.

    It is taken from the middle of the number, as a minimum's upper bits are mostly 0, and the
    lowest ones of a product hang on few bits.
    """
    x = (low >> np.uint64(32)) & np.uint64(1)
    return np.bitwise_or.reduce(x.reshape(len(x), WORDS, 64) << np.arange(64, dtype=np.uint64), axis=2).view(np.int64)


def banded(low: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands): a key for each band of rows minima, of its number and its minima."""
    key = np.tile(np.arange(low.shape[1] // rows, dtype=np.uint64), (len(low), 1))
    for r in range(rows):
        key = _mixed(key * _MIX + low[:, r::rows])
    return key.view(np.int64)


def similarity(a: Column, b: Column) -> Column:
    """The similarity of two signatures (arrays of WORDS longs), by counting the bits that differ.

    Of minima that differ, half agree in one bit, for which the count is corrected.
    """
    differ = F.lit(0)
    for w in range(WORDS):
        differ = differ + F.bit_count(a[w].bitwiseXOR(b[w]))
    return 1 - differ * (2.0 / MINIMA)


def likely(least: float) -> Column:
    """Whether rows a and b, by their sizes and signatures, can have a similarity of least."""
    return (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-6) & (similarity(F.col("sign_a"), F.col("sign_b")) >= least - slack(least))


def sketches(docs: DataFrame, width: int, shape: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id, n_shingles, the set's 128-bit key, bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for part in slices(batches):
            sets = [shingles(t, width, words) for t in part.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            bands = np.zeros((0, shape[0]), np.int64)
            if full:
                bands = banded(minima(full, band_hashers(shape)), shape[1])
            at_full = np.cumsum([0, *(len(s) > 0 for s in sets)])
            yield pa.RecordBatch.from_arrays([
                part.column(0).cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(at_full * shape[0], pa.int32()), pa.array(bands.ravel(), pa.int64())),
            ], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key binary, bands array<long>")


def full_sets(docs: DataFrame, width: int, shape: tuple[int, int]) -> DataFrame:
    """(id, n, shingles, signature, bands) of docs (id, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in slices(batches):
            sets = [shingles(t, width, words) for t in b.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, sets)])
            signs = packed(minima(sets, _OF_SIGNATURES)).ravel()
            bands = banded(minima(sets, band_hashers(shape)), shape[1]).ravel()
            rows = lambda width, x: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * width, pa.int32()), pa.array(x))  # noqa: B023, E731
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64))), rows(WORDS, signs), rows(shape[0], bands)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], names=["id", "n", "shingles", "signature", "bands"])

    return docs.mapInArrow(run, "id long, n long, shingles array<long>, signature array<long>, bands array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), each once, whose full sets have 100 * intersection >= percent * union."""
    near = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return written(full.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"), "near-links")


def _sided(members: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """Members of buckets, with their signatures, as one side of pairs."""
    own = sets.select("id", F.col("n").alias(f"n_{side}"), F.col("signature").alias(f"sign_{side}"))
    return members.join(own, "id").select("bucket", F.col("id").alias(side), f"n_{side}", f"sign_{side}")


#: Members of a bucket that meet all its pivots in one piece of work.
CHUNK = 512


def _likely_in_buckets(now: DataFrame, pivots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of a pivot and a member of its bucket, in different components, that can be similar.

    now has (bucket, band, id, component, met), met the size of the bucket. A bucket's members are
    cut into chunks, and its pivots go to each of them. A pair comes up in the first band that it
    shares, and in no other.
    """
    cells = sets.select("id", "n", "signature", "bands")
    chunks = F.ceil(F.col("met") / CHUNK).cast("int")
    role = lambda df, r, chunk: df.select("bucket", "band", chunk.alias("chunk"), F.lit(r).alias("role"), "id", "component")
    both = role(now.join(pivots, ["bucket", "id"], "left_semi"), 0, F.explode(F.sequence(F.lit(0), chunks - 1))).unionByName(role(now, 1, F.pmod(F.xxhash64("id"), chunks).cast("int")))

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        col = lambda k: t.column(k).combine_chunks()
        pivot = col("role").to_numpy() == 0
        ids, comps, n = (col(k).to_numpy() for k in ("id", "component", "n"))
        signs, bands = (col(k).flatten().to_numpy().reshape(len(ids), -1) for k in ("signature", "bands"))
        band, out = int(col("band")[0].as_py()), []
        step = max(1, (1 << 19) // (WORDS * max(1, int((~pivot).sum()))))
        at = np.flatnonzero(pivot)
        for i in range(0, len(at), step):
            p, m = at[i : i + step, None], np.flatnonzero(~pivot)[None, :]
            ok = (comps[p] != comps[m]) & (np.minimum(n[p], n[m]) >= least * np.maximum(n[p], n[m]) - 1e-6)
            p, m = (np.broadcast_to(x, ok.shape)[ok] for x in (p, m))
            if band:
                new = ~(bands[p, :band] == bands[m, :band]).any(1)
                p, m = p[new], m[new]
            near = 1 - np.bitwise_count((signs[p] ^ signs[m]).view(np.uint64)).sum(1) * (2.0 / MINIMA) >= least - slack(least)
            out.append((ids[p[near]], ids[m[near]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y:
                    if last is not None and last != tuple(key[x]):
                        yield solve(held)
                        held = []
                    held.append(b.slice(x, y - x))
                    last = tuple(key[x])
        if held:
            yield solve(held)

    dealt = both.join(cells, "id").select("bucket", "band", "chunk", "role", "id", "component", "n", "signature", "bands")
    return dealt.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "role").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are what ASCII white space parts, with A-Z in lower case; a document's set has its
    distinct shingles of width words (all of a shorter text as one; null and wordless texts have
    none and link with nothing). Documents link when 100 * intersection >= percent * union.
    component_id is the least id that links reach, kept is whether it is the row's own. Rows with
    null ids are joined to nothing and stay, with a null component_id. An empty table gives no rows.

    Rows with equal sets are one class. Classes that share a band meet in a bucket: first each
    with the member that meets most others, then every member outside the bucket's largest
    component with all that are in other components. Pairs that their b-bit signatures leave
    possible are confirmed on full sets. Buckets whose members are all connected need no further pairs, and those with
    many unconnected members go on in rounds, until no pair of two components is untried.

    Texts that share an id are linked one by one, and the row's component is that of its text.
    """
    rows, key = row_keys(docs, id_col, nulls_last=True)
    if key == id_col:
        return _linked(docs, width, percent, id_col, text_col)
    ids = rows.select(key, F.col(id_col).cast("long").alias("_id"))
    found = written(_linked(rows.withColumn(key, F.when(F.col(id_col).isNotNull(), F.col(key))), width, percent, key, text_col), "near-rows")
    own, least = (ids.select(F.col(key).alias(k), F.col("_id").alias(f"_{k}")) for k in ("doc_id", "component_id"))
    named = found.join(own, "doc_id").join(least, "component_id").select(F.col("_doc_id").alias("doc_id"), "n_shingles", F.col("_component_id").alias("component_id"))
    alone = found.where("doc_id is null").select("doc_id", "n_shingles", "component_id")
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() of rows whose ids differ where they aren't null."""
    ship(docs.sparkSession)
    shape = band_shape(percent)
    sketch = written(sketches(docs, width, shape, id_col, text_col), "near-sketches")
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = written(usable.groupBy("key").agg(F.min("doc_id").alias("id")), "near-classes")
    reps = usable.join(classes.select("id"), usable["doc_id"] == classes["id"], "left_semi").dropDuplicates(["doc_id"])
    members = reps.select(F.posexplode("bands").alias("band", "bucket"), F.col("doc_id").alias("id"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    members = written(members.join(shared, "bucket"), "near-members")
    ids = written(members.groupBy("id").agg(F.sum("met").alias("met")), "near-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(full_sets(texts.join(ids, "id", "left_semi"), width, shape).dropDuplicates(["id"]), "near-sets")

    # The member that meets most others in its buckets is the likeliest to be what they were copied from.
    centres = members.join(ids.withColumnRenamed("met", "weight"), "id").groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("id"))
    members, least = members.drop("met"), percent / 100
    pairs = _sided(members, sets, "b").join(_sided(centres, sets, "a"), "bucket").where((F.col("a") != F.col("b")) & likely(least))
    links = _confirmed(pairs, sets, percent)
    labels = components(links)
    tried = None
    while True:
        # Members by bucket with their component; buckets of one component are done.
        now = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = now.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all")).where("all > top.m")
        now = written(now.join(largest.select("bucket", F.col("top.component").alias("main"), F.col("all").alias("met")), "bucket"), "near-open")
        rest = now.where("component <> main").select("bucket", "id")
        if tried is not None:
            rest = rest.join(tried, ["bucket", "id"], "left_anti")
        rest = written(rest, "near-rest")
        if rest.isEmpty():
            break
        few = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
        small = rest.join(few.where(F.col("m") <= ALL_AT_ONCE).select("bucket"), "bucket", "left_semi")
        some = rest.join(few.where(F.col("m") > ALL_AT_ONCE).select("bucket"), "bucket", "left_semi").groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(ALL_AT_ONCE)).alias("part")).agg(F.min("id").alias("id")).select("bucket", "id")
        pivots = written(small.unionByName(some), "near-pivots")
        pairs = _likely_in_buckets(now, pivots, sets, least)
        found = _confirmed(pairs, sets, percent)
        tried = pivots if tried is None else written(tried.unionByName(pivots), "near-tried")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    of_class = classes.join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    linked = usable.select("doc_id", "n_shingles", "key").join(of_class, "key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: one with the least id, nulls last. Ids may be null or repeat.

    Null, empty and blank texts are linked with nothing and stay; long ones are read whole. Of equal
    rows of one id any stays. An empty table gives no rows. All columns keep their names and values,
    whatever they are called.
    """
    rows, key = row_keys(docs, id_col, nulls_last=True)
    return chosen(rows, key, _linked(rows, width, percent, key, text_col).where("kept").select("doc_id"), docs.columns)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * common >= 80 * (len(sa.s) + len(sb.s) - common)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN (SELECT id, min(seen) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""
