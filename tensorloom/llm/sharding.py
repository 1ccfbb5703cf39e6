"""Sharding of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import numbered, written

#: Groups that one task differences, and partial partitions that one task combines.
BLOCK, FAN_IN = 20_000, 200


def difference(partitions: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """For each partial partition, given as k sums in falling order, the final slot of each sum.

    The two partitions with the largest spread are combined, the largest sum of one with the
    smallest of the other, until one is left. k is at most 256.
    """
    heap = [(p[-1] - p[0], n, list(p)) for n, p in enumerate(partitions)]
    heapq.heapify(heap)
    total, made, places = len(heap), [], range(k)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right), strict=True)]
        order = sorted(places, key=sums.__getitem__, reverse=True)
        to = bytearray(k)
        for new, old in enumerate(order):
            to[old] = new
        low = sums[order[-1]]
        new_sums = [sums[i] - low for i in order]
        heapq.heappush(heap, (-new_sums[0], total + len(made), new_sums))
        made.append((a, b, bytes(to)))
    slots = {total + len(made) - 1: bytes(places)}
    for n in range(len(made) - 1, -1, -1):
        a, b, to = made[n]
        own = slots.pop(total + n)
        slots[a] = to.translate(own.ljust(256, b"\0"))
        slots[b] = slots[a][::-1]
    return [list(slots[n]) for n in range(total)]


def _level(parts: DataFrame, k: int) -> DataFrame:
    """parts (up, block, slot, bytes): where differencing within each `up` puts each slot."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        found, sums = [], []
        for block, own in pdf.sort_values(["block", "bytes", "slot"], ascending=[True, False, True], kind="stable").groupby("block", sort=True):
            full = [*own["bytes"], *[0] * (k - len(own))]
            sums.append(full)
            found.append((block, list(own["slot"])))
        rows = [(int(pdf["up"].iloc[0]), block, slot, to[i]) for (block, slots), to in zip(found, difference(sums, k), strict=True) for i, slot in enumerate(slots)]
        return pd.DataFrame(rows, columns=["up", "block", "slot", "to"])

    return parts.groupBy("up").applyInPandas(combine, "up long, block long, slot int, to int")


def shard_groups(groups: DataFrame, shards: int, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """groups (key hex string, bytes long) with the shard of each: key, shard.

    Each block of groups is differenced in a task to one partial partition of `shards` sums; these
    are combined in the same way, fan_in at a time, until one is left.
    """
    if not 0 < shards <= 256:
        raise ValueError("1 to 256 shards")
    n = -(-groups.count() // block) or 1

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        to = difference([[int(x), *[0] * (shards - 1)] for x in pdf["bytes"]], shards)
        return pdf.assign(slot=[x[0] for x in to])[["key", "bytes", "block", "slot"]]

    blocked = groups.select("key", "bytes", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % n).alias("block"))
    dealt = written(blocked.groupBy("block").applyInPandas(first, "key string, bytes long, block long, slot int"), "shard-groups")
    place, parts = dealt.select("key", "block", "slot"), dealt.groupBy("block", "slot").agg(F.sum("bytes").alias("bytes"))
    while n > 1:
        parts = parts.withColumn("up", F.floor(F.col("block") / fan_in))
        to = written(_level(parts, shards), "shard-level")
        place = place.join(to, ["block", "slot"]).select("key", F.col("up").alias("block"), F.col("to").alias("slot"))
        parts = parts.drop("up").join(to, ["block", "slot"]).groupBy(F.col("up").alias("block"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        n = -(-n // fan_in)
    return place.select("key", F.col("slot").alias("shard"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows with equal texts form a group that no shard boundary parts; null is a text of its own,
    of no bytes. size is the text's UTF-8 bytes plus 8; shards get near equal sums of sizes (law
    `bytes`), as far as single groups allow. slot numbers the rows of a shard from 0 without gaps;
    equal ids are numbered in any order. grown_shard is null. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.sha2(F.lit(b"\0null"), 256)).alias("key"),
    )
    rows = written(rows, "shard-rows")
    placed = shard_groups(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards, block, fan_in)
    found = written(rows.join(placed, "key").drop("key"), "shard-placed")
    cells = max(32, found.count() // (shards * 20_000))
    found = numbered(found, ["shard"], F.pmod(F.xxhash64("doc_id"), F.lit(cells)), [F.col("doc_id"), F.col("size")], "slot")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
