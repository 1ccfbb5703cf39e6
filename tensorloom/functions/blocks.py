"""Fiber trees as numbered arrays, made and read by blocks of neighbouring places: arrays are shuffled packed, not as rows.

A block has the places from B k to B (k + 1) - 1 of a level. A task puts its arrays together; its nodes send their coordinates
to the blocks that their children are in, as ranges. So a node may have more children than a task can hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import runs
from .shipping import ship
from .tables import written

#: Places of a block.
BLOCK = 1 << 16
#: What a packed row has: pointers, indices, values, and ranges of children with the coordinates of their parents.
PTR, IDX, VALUES, RANGES = range(4)
SCHEMA = "block long, level int, kind int, first long, numbers binary"
HEAD = struct.Struct("<BQ")


def press(x: np.ndarray, differences: bool = True) -> bytes:
    """Numbers as bytes: whole ones by their differences, if asked; the first bytes of all numbers, then the second ones."""
    whole, x = x.dtype != float, np.ascontiguousarray(x)
    if not whole and np.all(np.abs(x) < 1 << 53) and np.array_equal(x.astype(np.int64).astype(float).view(np.int64), x.view(np.int64)):
        x, code = x.astype(np.int64), 2 if differences else 3
    else:
        code = 0 if whole else 1
    if code in (0, 2):
        x = np.diff(x, prepend=0)
    if code != 1:
        x = x << 1 ^ x >> 63  # the sign goes last, so that small numbers have empty bytes
    return HEAD.pack(code, len(x)) + pa.Codec("zstd", 1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def release(pressed: bytes) -> np.ndarray:
    code, n = HEAD.unpack_from(pressed)
    body = pa.Codec("zstd").decompress(memoryview(pressed)[HEAD.size :], 8 * n, asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, n).T).view(float if code == 1 else np.int64).ravel()
    if code != 1:
        x = (x >> 1 & (1 << 63) - 1) ^ -(x & 1)
    if code in (0, 2):
        x = np.cumsum(x)
    return x if code < 2 else x.astype(float)


def _press_all(arrays: Sequence[np.ndarray]) -> bytes:
    out = [press(x) for x in arrays]
    return struct.pack(f"<{len(out) + 1}Q", len(out), *map(len, out)) + b"".join(out)


def _release_all(pressed: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<Q", pressed)
    at, out = 8 * (n + 1), []
    for length in struct.unpack_from(f"<{n}Q", pressed, 8):
        out.append(release(memoryview(pressed)[at : at + length]))
        at += length
    return out


def tree_to_coo(arrays: DataFrame, order: int, size: int = BLOCK) -> DataFrame:
    """(i0, ..., v) of a fiber tree's arrays (level, kind, pos, val), see sources/text.py; nodes that lack a number go, with their children."""
    ship(arrays.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            level, kind, pos, val = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            new = np.ones(len(pos), bool)
            new[1:] = (np.diff(level) != 0) | (np.diff(kind) != 0) | (np.diff(pos) != 1) | (pos[1:] % size == 0)
            begins = np.flatnonzero(new)
            rows = []
            for first, end in zip(begins, np.append(begins[1:], len(pos)), strict=True):
                p, k, numbers = int(pos[first]), int(kind[first]), val[first:end]
                rows.append((p // size, int(level[first]), k, p, press(numbers, k != VALUES)))
                if k == PTR and p and p % size == 0:  # the block before has its last end here
                    rows.append((p // size - 1, int(level[first]), k, p, press(numbers[:1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["block", "level", "kind", "first", "numbers"])

    code = F.when(F.col("kind") == "ptr", PTR).when(F.col("kind") == "idx", IDX).otherwise(VALUES)
    # Pointers belong to the nodes that have them, one level up, and values to the last level.
    of = F.when(code == PTR, F.col("level") - 1).when(code == VALUES, order - 1).otherwise(F.col("level"))
    numbers = arrays.select(of.cast("int").alias("level"), code.alias("kind"), F.col("pos").cast("long").alias("pos"), "val").where("level >= 0")
    packed = written(numbers.mapInArrow(pack, SCHEMA), "csf-blocks")

    def level(k: int):
        leaf = k == order - 1

        def told(block: int, pieces: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            base = block * size
            found = {PTR: (np.zeros(size + 1), np.zeros(size + 1, bool)), IDX: (np.zeros(size), np.zeros(size, bool)), VALUES: (np.zeros(size), np.zeros(size, bool))}
            ranges = []
            for kind, first, body in pieces:
                if kind == RANGES:
                    ranges.append(_release_all(body))
                    continue
                x, (own, has) = release(body), found[kind]
                own[first - base : first - base + len(x)] = x
                has[first - base : first - base + len(x)] = True
            idx, has = found[IDX]
            owner, above = np.zeros(size, np.int64), []
            if k:
                owner[:] = -1
                if ranges:
                    start, length, *above = (np.concatenate(x) for x in zip(*ranges, strict=True))
                    at = np.arange(length.sum()) + np.repeat(start - base - np.cumsum(length) + length, length)
                    owner[at] = np.repeat(np.arange(len(start)), length)
            has = has & (owner >= 0)
            if leaf:
                at = np.flatnonzero(has & found[VALUES][1])
                if len(at):
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[owner[at]]) for x in above), pa.array(idx[at].astype(np.int64)), pa.array(found[VALUES][0][at])], names=[*(f"i{m}" for m in range(order)), "v"])
                return
            ptr, there = found[PTR]
            at = np.flatnonzero(has & there[:-1] & there[1:] & (ptr[1:] > ptr[:-1]))
            if not len(at):
                return
            begin, end = ptr[at].astype(np.int64), ptr[at + 1].astype(np.int64)
            times = (end - 1) // size - begin // size + 1
            node = np.repeat(np.arange(len(at)), times)
            child = begin[node] // size + np.arange(len(node)) - np.repeat(np.cumsum(times) - times, times)
            start = np.maximum(begin[node], child * size)
            length = np.minimum(end[node], (child + 1) * size) - start
            coords = [*(x[owner[at]][node] for x in above), idx[at].astype(np.int64)[node]]
            by = np.argsort(child, kind="stable")
            edges = np.flatnonzero(np.diff(child[by], prepend=-1))
            blocks = child[by][edges]
            bodies = [_press_all([x[some] for x in (start, length, *coords)]) for some in np.split(by, edges[1:])]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(n, k + 1), pa.int32()), pa.array(np.full(n, RANGES), pa.int32()), pa.array(blocks * size), pa.array(bodies, pa.binary())], names=["block", "level", "kind", "first", "numbers"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held = None, []
            for b in batches:
                for own, kind, first, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if own != block:
                        if held:
                            yield from told(block, held)
                        block, held = own, []
                    held.append((kind, first, body))
            if held:
                yield from told(block, held)

        return run

    found = None
    for k in range(order):
        pieces = packed.where(F.col("level") == k)
        dealt = (pieces if found is None else pieces.unionByName(found)).repartition("block").sortWithinPartitions("block")
        schema = ", ".join([*(f"i{m} long" for m in range(order)), "v double"]) if k == order - 1 else SCHEMA
        found = dealt.select("block", "kind", "first", "numbers").mapInArrow(level(k), schema)
    return found


def tree_arrays(x: DataFrame, size: int) -> DataFrame:
    """(n, begin, whole, real): the arrays of x's fiber tree, cut every `size` numbers, in whole numbers or (n is 1000) doubles.

    n is 10 + 2 k for the pointers of level k, 11 + 2 k for its indices. x has one row for each coordinate. Rows are numbered once
    (see runs()); a row that is the first of its prefix is a node, so a task has its part of each array in order, and packs it.
    """
    spark, cols = x.sparkSession, [c for c in x.columns if c != "v"]
    ship(spark)
    order = len(cols)
    placed = runs(x, cols, range(1, order + 1), range(1, order + 1)).select(*cols, F.col("v").cast("double").alias("v"), *(f"run{k}" for k in range(1, order + 1)), *(F.col(f"place{k}") == 0 for k in range(1, order + 1)))

    def pieces(n: int, pos: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        begins = np.flatnonzero((np.diff(pos, prepend=-2) != 1) | (pos % size == 0))
        return [(n, int(p.flat[0]) // size * size, int(p.flat[0]), press(own, n != 1000)) for p, own in zip(np.split(pos, begins[1:]), np.split(numbers, begins[1:]), strict=True)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            idx, v, run, new = columns[:order], columns[order], columns[order + 1 : 2 * order + 1], columns[2 * order + 1 :]
            rows = pieces(1000, run[-1], v.astype(float))
            for k in range(order):
                nodes = new[k].astype(bool)
                if nodes.any():
                    rows += pieces(11 + 2 * k, run[k][nodes], idx[k][nodes].astype(np.int64))
                    if k < order - 1:
                        rows += pieces(12 + 2 * k, run[k][nodes], run[k + 1][nodes])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["n", "begin", "first", "numbers"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def line(n: int, begin: int, held: list[np.ndarray]) -> pa.RecordBatch:
            numbers = np.concatenate(held)
            both = [pa.array([None if (n == 1000) != real else numbers], pa.list_(t)) for real, t in ((False, pa.int64()), (True, pa.float64()))]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([begin], pa.int64()), *both], names=["n", "begin", "whole", "real"])

        at, held, lines, total = None, [], [], 0
        for b in batches:
            for n, begin, body in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (n, begin) != at:
                    if held:
                        lines.append(line(*at, held))
                        total += size
                    if total >= BLOCK:
                        yield pa.Table.from_batches(lines).combine_chunks().to_batches()[0]
                        lines, total = [], 0
                    at, held = (n, begin), []
                held.append(release(body))
        if held:
            lines.append(line(*at, held))
        if lines:
            yield pa.Table.from_batches(lines).combine_chunks().to_batches()[0]

    schema = "n int, begin long, first long, numbers binary"
    most = placed.agg(*(F.max(f"run{k}") for k in range(1, order + 1))).first()
    counts = [0 if m is None else m + 1 for m in most]
    ends = [(10, 0, 0), (10, 1, counts[0]), *((12 + 2 * k, counts[k], counts[k + 1]) for k in range(order - 1) if counts[k])]
    closing = spark.createDataFrame([(n, p // size * size, p, press(np.array([number]))) for n, p, number in ends], schema)
    dealt = placed.mapInArrow(cut, schema).unionByName(closing).repartition("n", "begin").sortWithinPartitions("n", "begin", "first")
    return dealt.mapInArrow(put, "n int, begin long, whole array<long>, real array<double>")
