"""Binary factor files as a Spark data source: `spark.read.format("factor")`, `df.write.format("factor")`.

A file has two unsigned 64-bit sizes and row-major float32 or float64 cells. Reading splits a file,
or a folder of parts, into byte ranges of whole rows, so its size is no task's. Writing makes a
folder of parts `part-<first row>.bin`, each with its own header; parts appear under their names when
all tasks have ended. Files are reached through pyarrow's file systems by the path's scheme, which
the executors need to have.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tensorloom.functions.shipping import ship

SCHEMA = "idx long, row array<double>"
#: Bytes of ranges that one task reads, about, how many ranges at most, and rows of a batch.
RANGE, RANGES, BATCH = 64 << 20, 64, 1 << 14
HEADER = struct.Struct("<QQ")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"[a-zA-Z][\w+.-]*:", path) else f"file://{path}")


@dataclass
class Rows:
    """`count` rows of a file from row `skip` on; the file's first row is number `first`."""

    path: str
    offset: int
    first: int
    count: int
    cols: int
    width: int


@dataclass
class Share(InputPartition):
    """What one task reads."""

    ranges: list[Rows]


class FactorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.cols, self.range = options["path"], options.get("cols"), int(options.get("range", RANGE))

    def partitions(self) -> Sequence[InputPartition]:
        fs, at = located(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info]
        if info.type == pafs.FileType.Directory:
            files = [f for f in fs.get_file_info(pafs.FileSelector(at)) if re.fullmatch(r"part-\d+\.bin", f.base_name)]
        out = []
        for f in files:
            named = re.fullmatch(r"part-(\d+)\.bin", f.base_name)
            first, header = int(named[1]) if named else 0, 0
            if self.cols is None:
                with fs.open_input_file(f.path) as src:
                    rows, cols = HEADER.unpack(src.read(HEADER.size))
                header = HEADER.size
                width = (f.size - header) // max(1, rows * cols)
                if rows * cols and width not in (4, 8) or header + rows * cols * width != f.size:
                    raise ValueError(f"{f.path}: {rows} x {cols} cells don't fit {f.size} bytes")
            else:
                cols, width = int(self.cols), 4
                if f.size % (cols * width):
                    raise ValueError(f"{f.path}: {f.size} bytes are no rows of {cols} cells")
                rows = f.size // (cols * width)
            step = max(1, self.range // max(1, cols * width))
            out += [Rows(f.path, header + k * cols * width, first + k, min(step, rows - k), cols, width) for k in range(0, rows, step)]
        # A folder of many small parts is not a task for each of them.
        shares, held = [Share([])], 0
        for r in out:
            own = r.count * r.cols * r.width
            if shares[-1].ranges and (held + own > self.range or len(shares[-1].ranges) == RANGES):
                shares.append(Share([]))
                held = 0
            shares[-1].ranges.append(r)
            held += own
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, _ = located(self.path)
        for part in partition.ranges:
            row = part.cols * part.width
            with fs.open_input_file(part.path) as src:
                for k in range(0, part.count, BATCH):
                    n = min(BATCH, part.count - k)
                    m = np.frombuffer(src.read_at(n * row, part.offset + k * row), "<f4" if part.width == 4 else "<f8").astype(float)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.cols, pa.int32()), pa.array(m))
                    yield pa.RecordBatch.from_arrays([pa.array(part.first + k + np.arange(n)), rows], names=["idx", "row"])


@dataclass
class Parts(WriterCommitMessage):
    made: list[tuple[str, str]]


class FactorWriter(DataSourceArrowWriter):
    """Rows come sorted, blocks of `rows` whole in one task; absent rows of a block are 0."""

    def __init__(self, options):
        self.path, self.rows, self.total, self.cols, self.width = options["path"], int(options["rows"]), int(options["total"]), int(options["cols"]), int(options.get("width", 8))
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        fs, at = located(self.path)
        made: list[tuple[str, str]] = []
        block, held = None, None

        def flush() -> None:
            if held is None:
                return
            name = f"part-{block * self.rows:015d}.bin"
            temporary = posixpath.join(at, "_temporary", f"{self.attempt}-{uuid.uuid4().hex}")
            fs.create_dir(posixpath.dirname(temporary), recursive=True)
            with fs.open_output_stream(temporary) as out:
                out.write(HEADER.pack(*held.shape) + held.tobytes())
            made.append((temporary, posixpath.join(at, name)))

        for b in iterator:
            if not b.num_rows:
                continue
            idx, cells = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for k in np.unique(idx // self.rows).tolist():
                if k != block:
                    flush()
                    block, held = k, np.zeros((min(self.rows, self.total - k * self.rows), self.cols), "<f4" if self.width == 4 else "<f8")
                own = idx // self.rows == k
                held[idx[own] - k * self.rows] = cells[own]
        flush()
        return Parts(made)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, at = located(self.path)
        fs.create_dir(at, recursive=True)
        for message in messages:
            for temporary, name in message.made if message else ():
                fs.move(temporary, name)
        if fs.get_file_info(temporary := posixpath.join(at, "_temporary")).type != pafs.FileType.NotFound:
            fs.delete_dir(temporary)

    def abort(self, messages: list[Parts | None]) -> None:
        fs, _ = located(self.path)
        for message in messages:
            for temporary, _name in message.made if message else ():
                fs.delete_file(temporary)


class FactorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "factor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FactorReader:
        return FactorReader(self.options)

    def writer(self, schema, overwrite: bool) -> FactorWriter:
        return FactorWriter(self.options)


@contextmanager
def registered(spark: SparkSession) -> Iterator[None]:
    """The source's name means something in `spark`, which is this thread's active session meanwhile.

    Spark looks names of sources up in the thread's active session, whatever session a reader or a writer is of.
    """
    ship(spark)
    spark.dataSource.register(FactorSource)
    sessions = getattr(spark._jvm, "org.apache.spark.sql.SparkSession")
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        yield
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


def read_factor(spark: SparkSession, path: str, cols: int | None = None) -> DataFrame:
    """(idx, row) of a factor file or folder of parts. Files without header need cols, and have float32 cells."""
    with registered(spark):
        reader = spark.read.format("factor")
        return (reader if cols is None else reader.option("cols", cols)).load(path)


def write_factor(factor: DataFrame, path: str, width: int = 8, rows: int = 1 << 16) -> None:
    """A factor (x, u0, ...) as a folder of parts of `rows` rows each; absent rows are 0, and parts of absent rows alone are left out."""
    spark, names = factor.sparkSession, factor.columns[1:]
    most = factor.agg(F.max("x")).first()[0]
    table = factor.select(F.col("x").cast("long").alias("idx"), F.array(*(F.col(c).cast("double") for c in names)).alias("row"))
    dealt = table.repartition(F.floor(F.col("idx") / rows)).sortWithinPartitions("idx")
    with registered(spark):
        dealt.write.format("factor").mode("append").options(rows=rows, total=1 + (-1 if most is None else most), cols=len(names), width=width).save(path)


def as_factor(rows: DataFrame, cols: int) -> DataFrame:
    """(idx, row) as a factor (x, u0, ...)."""
    return rows.select(F.col("idx").alias("x"), *(F.col("row")[k].alias(f"u{k}") for k in range(cols)))


def write_model_files(model, path: str) -> None:
    """A Tucker model as files: mode<n>.bin (folders of parts), core.bin (order, sizes, row-major doubles) and summary.txt (name=value)."""
    for n, f in enumerate(model.factors):
        write_factor(f, f"{path}/mode{n}.bin")
    fs, at = located(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/core.bin") as out:
        out.write(struct.pack(f"<{model.core.ndim + 1}Q", model.core.ndim, *model.core.shape) + np.ascontiguousarray(model.core, "<f8").tobytes())
    with fs.open_output_stream(f"{at}/summary.txt") as out:
        out.write("".join(f"{name}={value}\n" for name, value in (("ranks", " ".join(map(str, model.core.shape))), ("fits", " ".join(map(repr, map(float, model.fits)))))).encode())


def read_model_files(spark: SparkSession, path: str):
    """What write_model_files() wrote."""
    from tensorloom.operators.tucker import Tucker

    fs, at = located(path)
    with fs.open_input_file(f"{at}/core.bin") as src:
        body = src.read()
    (order,) = struct.unpack_from("<Q", body)
    shape = struct.unpack_from(f"<{order}Q", body, 8)
    core = np.frombuffer(body, "<f8", offset=8 * (order + 1)).reshape(shape)
    with fs.open_input_file(f"{at}/summary.txt") as src:
        summary = dict(line.split("=", 1) for line in src.read().decode().splitlines())
    factors = [as_factor(read_factor(spark, f"{path}/mode{n}.bin"), shape[n]) for n in range(order)]
    return Tucker(factors, core.copy(), [float(x) for x in summary["fits"].split()])
