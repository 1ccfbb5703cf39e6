"""Exact dedup by an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import chosen, row_keys, written


#: Bytes of the texts that a bucket of the index has at most, as long as it has more than one key.
CAPACITY = 32 << 20
#: Parts that the copies of one text are merged in before they go to their owner.
SALTS = 64
#: A group is hot with more than 1 / (HOT_SHARE * parts) of all rows, so HOT_SHARE * parts groups are hot at most.
HOT_SHARE = 4


def grow_directory(entries: DataFrame, capacity: int, start_bits: int, most_bits: int = 62) -> DataFrame:
    """The directory of the index over entries (key, bytes): (bits, prefix), one row per bucket, written to the shared folder.

    Starts with 2 ** start_bits buckets over the leading bits of key. While a bucket holds more
    than capacity bytes in several keys, the directory doubles: overfull buckets split by one more
    bit, and the others keep their smaller depth.
    """
    bits, done = start_bits, None
    buckets = lambda rows: rows.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys")).withColumn("bits", F.lit(bits))
    full = (F.col("bytes") > capacity) & (F.col("keys") > 1)
    open_ = written(buckets(entries), "dedup-directory")
    while True:
        over = open_.where(full)
        last = bits >= most_bits or over.isEmpty()
        kept = open_ if last else open_.where(~full)
        done = kept if done is None else done.unionByName(kept)
        if last:
            return written(done.select("bits", "prefix"), "dedup-directory")
        bits += 1
        split = entries.join(over.select(F.col("prefix").alias("parent")), F.shiftrightunsigned("key", 64 - bits + 1) == F.col("parent"), "left_semi")
        open_ = written(buckets(split), "dedup-directory")


def in_buckets(df: DataFrame, directory: DataFrame) -> DataFrame:
    """df with the bucket of each key: the directory's entry for the key's leading bits."""
    depths = sorted(r[0] for r in directory.select("bits").distinct().collect())  # one row per depth, 62 at most
    found = None
    for bits in depths or [1]:
        own = directory.where(F.col("bits") == bits).select(F.col("prefix").alias("_p"))
        part = df.join(own, F.shiftrightunsigned("key", 64 - bits) == F.col("_p"), "left_semi")
        part = part.withColumn("bucket", F.concat(F.lit(f"{bits}:"), F.shiftrightunsigned("key", 64 - bits).cast("string")))
        found = part if found is None else found.unionByName(part)
    return found


_CHAINED = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's rows, sorted by key: each key has a chain of the texts that differ by their bytes."""

    def closed(key: int, chain: list) -> list[tuple]:
        return [(key, hashlib.sha256(body).hexdigest(), keep, n) for body, n, keep in chain]

    last, chain = None, []
    for b in batches:
        out: list[tuple] = []
        for key, body, n, keep in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if key != last:
                out += closed(last, chain)
                last, chain = key, []
            for x in chain:
                if x[0] == body:
                    x[1] += n
                    x[2] = keep if x[2] is None else x[2] if keep is None else max(x[2], keep)
                    break
            else:
                chain.append([body, n, keep])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CHAINED.types, strict=True)], schema=_CHAINED) if out else pa.RecordBatch.from_pylist([], schema=_CHAINED)
    yield pa.RecordBatch.from_pylist([dict(zip(_CHAINED.names, x, strict=True)) for x in closed(last, chain)], schema=_CHAINED)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; null counts as empty. Of equal texts the largest id
    stays (keep_id null if all are null: then no row is kept by id, and kept is true for all of
    them, as nothing tells them apart). Rows that share text and id are all kept or all dropped.

    The index has one entry for each 64-bit hash of a text. A directory over the hash's leading
    bits, doubled until no bucket has more than capacity bytes in several keys, deals the entries
    to owner tasks. A key that more than one row has goes to its owner with its texts; copies are
    merged before, in parts, so that a hot text comes as a few rows. The owner compares bytes and
    chains texts that differ. The answers go back to the rows by a join on hash and digest. Hot
    groups, HOT_SHARE for each shuffle partition at most by their definition, are looked up where
    the rows are, before and after, so that no join gathers their rows. hash_bits below 64 makes collisions common, for
    tests. Very long texts are compared whole. An empty table gives no rows; other columns are not
    read.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.shiftleft(F.xxhash64(text), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(text)
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.sha2(text, 256).alias("text_sha256"), (F.octet_length(text) + 64).cast("long").alias("bytes")), "dedup-rows")
    entries = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "dedup-entries")
    shared = entries.where("n > 1")
    sizes = entries.agg(F.sum("n"), F.sum(F.when(F.col("n") > 1, F.col("bytes")))).first()
    count, total, parts = sizes[0] or 0, sizes[1] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = lambda n: F.col(n) > max(1, count // (HOT_SHARE * parts))
    directory = grow_directory(shared, capacity, max(1, (max(parts, -(-total // capacity)) - 1).bit_length()))
    bodies = docs.select(key.alias("key"), text.cast("binary").alias("body"), F.col(id_col).cast("long").alias("id"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    hot_keys = F.broadcast(shared.where(hot("n")).select("key"))
    often = bodies.join(hot_keys, "key", "left_semi")
    seldom = bodies.join(hot_keys, "key", "left_anti").join(shared.where(~hot("n")).select("key").hint("merge"), "key", "left_semi")
    members = often.unionByName(seldom).groupBy("key", "body", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    owned = in_buckets(written(members.drop("salt"), "dedup-members"), directory).repartition("bucket").sortWithinPartitions("key").select("key", "body", "n", "keep")
    index = written(owned.mapInArrow(_chains, "key long, sha string, keep_id long, group_size long").where("key is not null"), "dedup-index")
    single = rows.join(entries.where("n = 1").select("key"), "key", "left_semi").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    near_by = F.broadcast(index.where(hot("group_size")).select("key", F.col("sha").alias("text_sha256"), "keep_id", "group_size"))
    far = index.where(~hot("group_size")).select("key", F.col("sha").alias("text_sha256"), "keep_id", "group_size")
    on = ["key", "text_sha256"]
    copies = rows.join(near_by, on).unionByName(rows.join(near_by.select(*on), on, "left_anti").join(far, on))
    several = copies.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(several)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: of equal texts one row with the largest id stays, also where ids are null or repeat.

    Null texts count as empty; long ones are compared whole. Of equal rows of one id any stays. An
    empty table gives no rows. All columns keep their names and values, whatever they are called.
    """
    rows, key = row_keys(docs, id_col)
    return chosen(rows, key, exact_groups(rows, key, text_col).where("kept").select("doc_id"), docs.columns)


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
