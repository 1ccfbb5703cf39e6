"""Repeated substrings by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import slices, written

#: Bytes of contexts that become one shard's transforms, and that an owner merges, on average.
AT_ONCE = 4 << 20
#: Bytes of the different contexts of one anchor that are dealt together; beyond, longer grams deal them.
TOGETHER = 512 << 10
#: Bytes of a text that are hashed at a time.
SEGMENT = 1 << 20
_R = np.uint64(0x5851F42D4C957F2D)
_TABLE = np.random.RandomState(7).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of R and of its inverse modulo 2 ** 64, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(_R), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _R)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of data."""
    up, _ = _POWERS.get(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)])


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of data[start:end], whatever stands before."""
    return _mixed((sums[ends] - sums[starts]) * _POWERS.down[starts])


@dataclass(frozen=True)
class Lengths:
    """least: bytes of a repeat; gram: of an anchor; symbol: of a symbol.

    core symbols lie whole in any repeat, and depth symbols hold one that begins with a symbol.
    """

    least: int
    gram: int
    symbol: int
    core: int
    depth: int

    @classmethod
    def of(cls, least: int) -> Lengths:
        symbol = max(1, min(16, least // 4))
        return cls(least, max(1, min(32, least // 2)), symbol, (least - symbol + 1) // symbol, -(-least // symbol))


def owned_ranges(data: np.ndarray, size: Lengths) -> tuple[np.ndarray, ...]:
    """Windows of size.least bytes by their anchor: (start, count, offset, anchor, context).

    The anchor of a window is its gram with the least hash, the first of equals, so that equal
    windows have equal anchors at equal places. count windows from start on have the anchor that is
    offset bytes after start; context is the hash of all their bytes.
    """
    n = len(data) - size.least + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n > SEGMENT:
        parts = [(at, owned_ranges(data[at : at + SEGMENT + size.least - 1], size)) for at in range(0, n, SEGMENT)]
        return tuple(np.concatenate([own[i] + (at if i == 0 else 0) if i < 3 else own[i] for at, own in parts]) for i in range(5))
    sums = _sums(data)
    at = np.arange(len(data) - size.gram + 1)
    grams = _hashes(sums, at, at + size.gram)
    width = size.least - size.gram + 1
    value = np.full(-(-len(grams) // width) * width, np.uint64(2**64 - 1))
    value[: len(grams)] = (grams & ~_LOW) | at.astype(np.uint64)
    blocks = value.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    count = np.diff(np.append(start, n))
    return start, count, anchor[start] - start, grams[anchor[start]], _hashes(sums, start, start + count - 1 + size.least)


def transform(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of a shard's sequences, ended by the codes 0, 1, 2, ...

    The transform has the code before each suffix; a suffix that is a whole sequence has the end of
    the sequence itself.
    """
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        further = np.zeros(n, np.int64)
        further[:-step] = rank[step:] + 1
        key = rank * (n + 1) + further
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            break
        step *= 2
    return order, codes[_before(np.flatnonzero(codes <= codes[-1]))[order]]


def _before(ends: np.ndarray) -> np.ndarray:
    """The place before each place of sequences that end at ends; the first of a sequence has its end before it."""
    back = np.arange(-1, ends[-1])
    back[np.concatenate([[0], ends[:-1] + 1])] = ends
    return back


def interleave(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms: (order, common), the suffixes of all shards in order.

    Suffixes are numbered shard after shard. Begins with the shards one after the other. Each round
    reads the merged transform and moves every entry to its place by one more leading code; entries
    keep their order within their shard, so that no suffix is sorted again. A border between
    neighbours that first shows in round h gives them h - 1 codes in common. After depth rounds,
    common has what a suffix shares with the one before it, depth at most.
    """
    codes = np.concatenate(transforms).astype(np.int64)
    n = len(codes)
    shard = np.repeat(np.arange(len(transforms), dtype=np.int32), [len(t) for t in transforms])
    block, common, place = np.zeros(n, np.int64), np.full(n, depth, np.int64), np.arange(n)
    for h in range(1, depth + 1):
        merged = np.empty(n, np.int64)
        merged[np.argsort(shard, kind="stable")] = codes
        source = merged * n + place
        source.sort()
        source %= n
        first, before = merged[source], block[source]
        border = np.concatenate([[True], (first[1:] != first[:-1]) | (before[1:] != before[:-1])])
        common[border & (common == depth)] = h - 1
        shard, block = shard[source], np.cumsum(border) - 1
    order = np.empty(n, np.int64)
    order[np.argsort(shard, kind="stable")] = place
    return order, common


_SYMBOL = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def _sorted_symbols(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols in the order of their bytes, and the rank of each."""
    order = np.lexsort((symbols["lo"], symbols["hi"]))
    ordered = symbols[order]
    new = np.concatenate([[True], (ordered["hi"][1:] != ordered["hi"][:-1]) | (ordered["lo"][1:] != ordered["lo"][:-1])])
    rank = np.empty(len(symbols), np.int64)
    rank[order] = np.cumsum(new) - 1
    return ordered[new], rank


def _lengths(offset: np.ndarray, count: np.ndarray, size: Lengths) -> np.ndarray:
    """Codes of the sequences of contexts: a head, whole symbols, a tail and an end."""
    return 3 + (count - 1 + size.least - offset % size.symbol) // size.symbol


def shard_transform(bodies: list[bytes], offset: np.ndarray, count: np.ndarray, size: Lengths) -> dict[str, bytes]:
    """The transform of a shard of contexts: their distinct symbols, its suffix array and the transform itself.

    A context is cut into symbols from its anchor on, both ways. What is left before and after them
    is a symbol, too: the head has zeros before it, the tail after it.
    """
    q, lengths = size.symbol, _lengths(offset, count, size)
    ends = np.cumsum(lengths) - 1
    raw = np.zeros((int(ends[-1]) + 1, q), np.uint8)
    flat, first = raw.reshape(-1), offset % q
    for body, at, head in zip(bodies, ((ends - lengths + 1) * q).tolist(), first.tolist(), strict=True):
        flat[at + q - head : at + q - head + len(body)] = np.frombuffer(body, np.uint8)
    wide = np.zeros((len(raw), 16), np.uint8)
    wide[:, 16 - q :] = raw
    inside = np.ones(len(raw), bool)
    inside[ends] = False
    symbols, rank = _sorted_symbols(wide.view(">u8").astype("<u8").view(_SYMBOL).reshape(-1)[inside])
    codes = np.empty(len(raw), np.int64)
    codes[ends], codes[inside] = np.arange(len(ends)), rank + len(ends)
    order, own = transform(codes)
    return {"symbols": symbols.tobytes(), "suffixes": order.astype("<i4").tobytes(), "transform": own.astype("<i4").tobytes()}


def _bytes_in(x: np.ndarray) -> np.ndarray:
    """How many bytes the 128-bit numbers take, without leading zeros."""
    one = lambda v: sum((v >= np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8))
    return np.where(x["hi"] > 0, 8 + one(x["hi"]), one(x["lo"]))


def _tails_in(x: np.ndarray) -> np.ndarray:
    """How many zero bytes the 128-bit numbers end with; 16 for 0."""
    one = lambda v: sum((v & np.uint64((1 << (8 * k)) - 1) == 0).astype(np.int64) for k in range(1, 8)) + (v == 0)
    return np.where(x["lo"] == 0, 8 + one(x["hi"]), one(x["lo"]))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _SYMBOL)
    out["hi"], out["lo"] = a["hi"] ^ b["hi"], a["lo"] ^ b["lo"]
    return out


def repeated_windows(shards: list[dict], size: Lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the transforms of shards: (context, from, to) of the runs of repeated windows.

    shards have offset, count and copies of their contexts beside what shard_transform() gives;
    contexts are numbered shard after shard. A window is `back` bytes before a symbol and the rest
    after it. Suffixes whose common prefix has the rest's length are an interval of the merged
    order; in it, those that have the same bytes before them, by the symbol that the transform has
    there, are one string. It is repeated if their contexts have more than one copy together.
    """
    q = size.symbol
    offset, count, copies = (np.concatenate([s[k] for s in shards]).astype(np.int64) for k in ("offset", "count", "copies"))
    lengths, total = _lengths(offset, count, size), len(offset)
    symbols, ranks = _sorted_symbols(np.concatenate([np.frombuffer(s["symbols"], _SYMBOL) for s in shards]))
    transforms, suffixes, codes, base, context, known = [], [], [], 0, 0, 0
    for s in shards:
        own, order = np.frombuffer(s["transform"], "<i4").astype(np.int64), np.frombuffer(s["suffixes"], "<i4").astype(np.int64)
        k, m = len(s["offset"]), len(s["symbols"]) // _SYMBOL.itemsize
        own = np.where(own < k, own + context, total + ranks[known + np.maximum(own - k, 0)])
        text = np.empty(len(own), np.int64)
        text[_before(np.cumsum(lengths[context : context + k]) - 1)[order]] = own
        transforms.append(own)
        suffixes.append(order + base)
        codes.append(text)
        base, context, known = base + len(own), context + k, known + m
    codes = np.concatenate(codes)
    order, common = interleave(transforms, size.depth)
    # Bytes that neighbours share: whole symbols, and the leading bytes of the next one.
    at, before = np.concatenate(suffixes)[order], np.concatenate(transforms)[order]
    shared = common * q
    part = np.flatnonzero((common >= size.core) & (common < size.depth))
    x, y = (codes[np.minimum(p + common[part], len(codes) - 1)] - total for p in (at[part], at[part - 1]))
    real = (x >= 0) & (y >= 0)
    shared[part[real]] += q - _bytes_in(_differ(symbols[x[real]], symbols[y[real]]))
    least = size.least - q + 1
    near = np.concatenate([shared >= least, [False]])
    starts, of = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(total), lengths)[at]
    use = np.flatnonzero(near[:-1] | near[1:] | (copies[of] > 1))
    at, of, before, shared = at[use], of[use], before[use] - total, shared[use]
    place = (offset % q)[of] + (at - starts[of] - 1) * q
    # Symbols in the order of their last bytes: those that agree in the last bytes are neighbours.
    swapped = np.empty(len(symbols), _SYMBOL)
    swapped["hi"], swapped["lo"] = symbols["lo"].byteswap(), symbols["hi"].byteswap()
    backwards = np.lexsort((swapped["lo"], swapped["hi"]))
    agree = _tails_in(_differ(symbols[backwards[1:]], symbols[backwards[:-1]]))
    begin = np.concatenate([[0], np.cumsum(count + 1)])
    repeated = np.zeros(int(begin[-1]) + 1, bool)
    for back in range(q):
        start = place - back
        ok = np.flatnonzero((start >= 0) & (start < count[of]) & (before >= 0))
        if not len(ok):
            continue
        interval = np.cumsum(shared < size.least - back)[ok]
        kind = np.empty(len(symbols), np.int64)
        kind[backwards] = np.concatenate([[0], np.cumsum(agree < back)])
        key = interval * (len(symbols) + 1) + kind[before[ok]]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        many = np.add.reduceat(copies[of[ok]][by], first) > 1
        found = ok[by][np.repeat(many, np.diff(np.append(first, len(by))))]
        repeated[begin[of[found]] + start[found]] = True
    edge = np.diff(np.concatenate([[False], repeated]).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    which = np.searchsorted(begin, lo, "right") - 1
    return which, lo - begin[which], hi - begin[which]


#: What tells a text from all others: two hashes of its id and itself.
_ROW = ["row", "row_too"]
_KEY = "anchor long, offset int, count int, context long"
_KEYS = ["anchor", "offset", "count", "context"]
_KEY_FIELDS = [("anchor", pa.int64()), ("offset", pa.int32()), ("count", pa.int32()), ("context", pa.int64())]


def occurrences(texts: DataFrame, size: Lengths) -> DataFrame:
    """(row, row_too, anchor, offset, count, context, starts) of texts (row, row_too, text); a text's equal ranges are one row."""
    schema = pa.schema([*((k, pa.int64()) for k in _ROW), *_KEY_FIELDS, ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for row, too, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start, count, offset, anchor, context = owned_ranges(np.frombuffer((text or "").encode(), np.uint8), size)
                if len(start):
                    _, first, which = np.unique(context ^ _mixed(anchor + offset.astype(np.uint64)), return_index=True, return_inverse=True)
                    places = np.split(start[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which))[:-1])
                    out.append((np.full(len(first), row), np.full(len(first), too), anchor[first].view(np.int64), offset[first], count[first], context[first].view(np.int64), places))
            if out:
                flat = [p for x in out for p in x[6]]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([x[i] for x in out])).cast(schema.types[i]) for i in range(6)), lists], schema=schema)

    return texts.mapInArrow(run, f"row long, row_too long, {_KEY}, starts array<int>")


def _asked(texts: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(text, wanted): the texts that have wanted rows, with these rows as a list of structs."""
    by_row = wanted.groupBy(*_ROW).agg(F.collect_list(F.struct(*_KEYS, "start", *columns)).alias("wanted"))
    return texts.join(by_row, _ROW).select("text", "wanted")


def _transforms(texts: DataFrame, wanted: DataFrame, size: Lengths) -> DataFrame:
    """The transforms of shards, one row for each shard and bucket. A shard is what a task meets in AT_ONCE bytes of contexts."""
    schema = pa.schema([("bucket", pa.int64()), *((k, pa.list_(t)) for k, t in _KEY_FIELDS), ("copies", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("symbols", "suffixes", "transform"))])

    def shard(found: dict[int, list]) -> pa.RecordBatch:
        out = []
        for bucket, own in found.items():
            columns = {k: [w[k] for w, _ in own] for k in (*_KEYS, "copies")}
            offset, count = np.array(columns["offset"]), np.array(columns["count"])
            out.append({"bucket": bucket} | columns | shard_transform([body for _, body in own], offset, count, size))
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        held = 0
        for b in slices(batches):
            for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                for w in asked:
                    body = data[w["start"] : w["start"] + w["count"] - 1 + size.least]
                    found.setdefault(w["bucket"], []).append((w, body))
                    held += len(body)
            if held > AT_ONCE:
                yield shard(found)
                found, held = {}, 0
        if found:
            yield shard(found)

    return _asked(texts, wanted, "copies", "bucket").mapInArrow(run, "bucket long, anchor array<long>, offset array<int>, count array<int>, context array<long>, copies array<long>, symbols binary, suffixes binary, transform binary")


def _merged(transforms: DataFrame, size: Lengths) -> DataFrame:
    """The repeated windows of the contexts: the owner of a bucket merges the transforms that the shards have for it."""
    schema = pa.schema([*_KEY_FIELDS, ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])

    def solve(shards: list[dict]) -> pa.RecordBatch:
        which, lo, hi = repeated_windows(shards, size)
        keys = [np.concatenate([s[k] for s in shards]) for k in _KEYS]
        some, first = np.unique(which, return_index=True)
        cuts = pa.array(np.append(first, len(which)), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(k[some], t) for k, (_, t) in zip(keys, _KEY_FIELDS, strict=True)), *(pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (lo, hi))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in slices(batches, 10):
            for row in b.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return transforms.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{_KEY}, lo array<int>, hi array<int>")


def _pieces(texts: DataFrame, wanted: DataFrame, size: Lengths) -> DataFrame:
    """The wanted contexts in pieces of one symbol's windows: (keys of the context, first, copies, group, p_offset, p_count, piece, windows).

    Equal windows have equal groups: that of a piece is a hash of its anchor and of the symbols
    that lie whole in all its windows. windows has two hashes of each window.
    """
    q = size.symbol
    fields = [*((k, pa.int64()) for k in (*_ROW,)), *_KEY_FIELDS, ("copies", pa.int64()), ("start", pa.int32()), ("first", pa.int32()), ("group", pa.int64()), ("p_offset", pa.int32()), ("p_count", pa.int32()), ("piece", pa.int64()), ("windows", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                for w in asked:
                    sums = _sums(data[w["start"] : w["start"] + w["count"] - 1 + size.least])
                    at = np.arange(w["offset"] % q, w["count"] + q - 1, q)  # the symbols at which a window has its first whole one
                    lo, hi = np.maximum(at - q + 1, 0), np.minimum(at + 1, w["count"])
                    at, lo, hi = (x[lo < hi] for x in (at, lo, hi))
                    place = np.uint64(w["anchor"] % (1 << 64)) ^ _mixed((w["offset"] - at).astype(np.uint64))
                    group = _mixed(_hashes(sums, at, at + size.core * q) ^ _mixed(place))
                    piece = _hashes(sums, lo, hi - 1 + size.least)
                    own = np.arange(w["count"])
                    windows = _hashes(sums, own, own + size.least)
                    for i in range(len(at)):
                        a, z = int(lo[i]), int(hi[i])
                        keys = _mixed(windows[a:z] ^ _mixed(np.uint64(group[i]) + (w["offset"] - own[a:z]).astype(np.uint64)))
                        out.append({k: w[k] for k in (*_ROW, *_KEYS, "copies")} | {"start": w["start"] + a, "first": a, "group": int(group[i].view(np.int64)), "p_offset": w["offset"] - a, "p_count": z - a, "piece": int(piece[i].view(np.int64)), "windows": keys.view(np.int64)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _asked(texts, wanted, "copies", *_ROW).mapInArrow(run, f"row long, row_too long, {_KEY}, copies long, start int, first int, group long, p_offset int, p_count int, piece long, windows array<long>")


def _shared(contexts: DataFrame, size: Lengths) -> DataFrame:
    """Those of contexts (keys, copies, ...) whose anchor is met more than once, with the bytes of all of one anchor."""
    body = (F.col("count") - 1 + size.least).cast("long")
    anchors = contexts.groupBy("anchor").agg(F.sum("copies").alias("met"), F.sum(body).alias("bytes")).where("met > 1")
    return contexts.join(anchors.select("anchor", "bytes"), "anchor")


def repeats(texts: DataFrame, found: DataFrame, size: Lengths, together: int) -> DataFrame:
    """(keys of a context, lo, hi): the runs [lo, hi) of its repeated windows. found is what occurrences(texts) gives."""
    first = F.min(F.struct(*_ROW, F.col("starts")[0].alias("start"))).alias("at")
    contexts = found.groupBy(*_KEYS).agg(F.sum(F.size("starts")).cast("long").alias("copies"), first)
    shared = written(_shared(contexts, size).select(*_KEYS, "copies", "at.*", "bytes"), "repeats-shared")
    wanted, large = shared.where(F.col("bytes") <= together), shared.where(F.col("bytes") > together)
    pieces = windows = None
    if not large.isEmpty():
        pieces = written(_pieces(texts, large, size), "repeats-pieces")
        named = pieces.select(*_ROW, "start", "copies", F.col("group").alias("anchor"), F.col("p_offset").alias("offset"), F.col("p_count").alias("count"), F.col("piece").alias("context"), "windows")
        distinct = named.groupBy(*_KEYS).agg(F.sum("copies").alias("copies"), F.min(F.struct(*_ROW, "start", "windows")).alias("at"))
        again = written(_shared(distinct, size).select(*_KEYS, "copies", "at.*", "bytes"), "repeats-again")
        wanted = wanted.unionByName(again.where(F.col("bytes") <= together).drop("windows"))
        windows = again.where(F.col("bytes") > together).select(*_KEYS, "copies", F.posexplode("windows").alias("lo", "window"))
        often = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "window")
        windows = windows.join(often, ["anchor", "window"], "left_semi").groupBy(*_KEYS).agg(F.sort_array(F.collect_list("lo")).alias("lo")).withColumn("hi", F.transform("lo", lambda x: x + 1))
    spark = texts.sparkSession
    total = shared.where(F.col("bytes") <= together).agg(F.sum(F.col("count") - 1 + size.least)).first()[0] or 0
    buckets = max(-(-total // AT_ONCE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = wanted.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).drop("bytes")
    merged = _merged(written(_transforms(texts, dealt, size), "repeats-transforms"), size)
    if pieces is None:
        return merged
    merged = written(merged, "repeats-merged")
    inner = merged.unionByName(windows).select(*(F.col(k).alias(f"_{k}") for k in _KEYS), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    same = [pieces[a] == inner[f"_{k}"] for a, k in zip(("group", "p_offset", "p_count", "piece"), _KEYS, strict=True)]
    moved = [F.transform(f"_{k}", lambda x: x + F.col("first")).alias(k) for k in ("lo", "hi")]
    return merged.unionByName(pieces.join(inner, same).select(*_KEYS, *moved))


def remove_repeats(docs: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (kept_text with with_text).

    Texts are UTF-8 bytes (null: empty). Every byte goes that a string of `least` bytes covers which
    also starts anywhere else, in the same text or another; strings are judged on the input, and
    never cross texts. n_spans counts the removed runs. kept_text replaces what a cut leaves of a
    character. Rows that share id and text count as two texts, and so remove each other; null ids
    are ids as any other. Very long texts are hashed in segments. Other columns are not read.

    Each window of `least` bytes has an anchor, its gram with the least hash. Windows of one anchor
    in a row are a context. Contexts whose anchor is met once have no repeats. Of the others, each
    shard of the texts makes a Burrows-Wheeler transform for each bucket of anchors, and the owner
    of the bucket merges those of all shards. Equal contexts count with their copies.

    The contexts of an anchor go to one owner as long as they have `together` bytes at most. Beyond,
    they are cut into pieces of a few windows, which are dealt by their longest common gram; and
    where that group is still larger, its windows are counted by Spark, one by one. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    size = Lengths.of(least)
    text = F.col(text_col)
    row = [F.xxhash64(F.col(id_col), text).alias("row"), F.xxhash64(F.lit(least), text, F.col(id_col)).alias("row_too")]
    texts = docs.select(*row, text.alias("text")).where(F.octet_length("text") >= least)
    found = written(occurrences(texts, size), "repeats-ranges")
    runs = repeats(texts, found, size, together)
    spans = found.join(runs, _KEYS).groupBy(*_ROW).agg(F.collect_list(F.struct("starts", "lo", "hi")).alias("spans"))
    return _cut(docs.select(*row, F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(spans, _ROW, "left").select("doc_id", "text", "spans"), size, with_text)


def _cut(joined: DataFrame, size: Lengths, with_text: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] * with_text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body, removed, runs = (text or "").encode(), 0, 0
                if spans:
                    edge = np.zeros(len(body) + 1, np.int64)
                    for s in spans:
                        at = np.array(s["starts"])[:, None]
                        np.add.at(edge, (at + np.array(s["lo"])).ravel(), 1)
                        np.add.at(edge, (at + np.array(s["hi"]) - 1 + size.least).ravel(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    body = np.frombuffer(body, np.uint8)[~gone].tobytes()
                out.append((doc, len(body) + removed, removed, runs, hashlib.sha256(body).hexdigest(), *([body.decode("utf-8", "replace")] * with_text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
