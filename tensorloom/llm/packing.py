"""Best-fit packing by a plan over the histogram of lengths."""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import numbered, slices, written

#: Slots that one row of the plan is split into before they are written out.
CHUNK = 10_000


@lru_cache(1)
def _encoder(path: str):
    """The vocabulary's encoder. A .json path names the same merges in its .tiktoken twin, which is faster.

    The twin lacks the added tokens of the JSON, which are found inside a text before any merge.
    """
    import public_tokenizers
    import tiktoken

    twin = path.removesuffix(".json") + ".tiktoken"
    with open(public_tokenizers.path(path), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if odd := [a["content"] for a in added if a["lstrip"] or a["rstrip"] or a["single_word"]]:
        raise ValueError(f"{path}: added tokens that take the text around them aren't supported: {odd}")
    with open(public_tokenizers.path(twin), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(twin, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added})


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than size."""
    first = (n - 1) % size + 1 if n else 0
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, size: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode
        for b in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or "", allowed_special="all"), 0], dtype="<u4")
                out += [(doc, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), size))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_all, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_sequences(counts: Mapping[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over the counts of each length.

    Rows (length, first_rank, bins, each, first_sequence, offset): from first_rank on, `bins`
    sequences from first_sequence take `each` pieces of this length, at offset and after. Bins
    with equal room are runs of sequence numbers, so the plan's size hangs on the number of
    lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan, new = [], 0

    def put(left: int, first: int, bins: int) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(rooms, left)
        room[left].append((first, bins))

    for length in sorted(counts, reverse=True):
        count, rank = counts[length], 0
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                bins = -(-count // (size // length))
                put(size, new, bins)
                new += bins
                at = bisect.bisect_left(rooms, length)
            left = rooms[at]
            first, bins = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
            each = min(left // length, count)
            used = min(bins, count // each)
            plan.append((length, rank, used, each, first, size - left))
            rank, count = rank + used * each, count - used * each
            put(left - each * length, first, used)
            if used < bins:
                put(left, first + used, bins - used)
    return plan


def pack(docs: DataFrame, size: int = 2048, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and then id 0; only those of more than size
    ids are cut. Pieces are numbered within their length over all tasks, and the piece of rank r
    takes the r-th slot that the plan has for its length. The driver sees one count per length
    (size of them at most). Rows with equal ids are packed one by one. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    found = written(pieces(docs, size, vocabulary, id_col, text_col), "pack-pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    plan = spark.createDataFrame(plan_sequences(counts, size), "length long, first_rank long, bins long, each long, first_sequence long, at long")
    slots = plan.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") * F.col("each") - 1, F.lit(CHUNK).cast("long"))))
    slots = slots.repartition(F.col("length"), F.col("first_rank"), F.col("from"))
    slots = slots.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("bins") * F.col("each")) - 1)))
    slots = slots.select("length", (F.col("first_rank") + F.col("i")).alias("rank"), (F.col("first_sequence") + F.floor(F.col("i") / F.col("each"))).alias("sequence_id"), (F.col("at") + F.col("i") % F.col("each") * F.col("length")).alias("offset"))
    cells = max(64, sum(counts.values()) // 60_000)
    ranked = numbered(found, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)), [F.col("doc_id"), F.col("piece")], "rank")
    return ranked.join(slots, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
