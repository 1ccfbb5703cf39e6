"""Factor matrices and models as files of numbers."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship


def read_factors(spark: SparkSession, path: str, cols: int | None = None) -> DataFrame:
    """(file, idx, row) of binary factors: two unsigned 64-bit sizes and then float32 or float64 cells.

    Files are read by the executors, each file whole in one task. Without a header, cols is needed
    and cells are float32. Sizes that don't fit the file raise.
    """
    return parse_factors(spark.read.format("binaryFile").load(path).select("path", F.lit(0).alias("first"), "content"), cols)


def parse_factors(files: DataFrame, cols: int | None = None) -> DataFrame:
    """read_factors() of files (path, first, content), whose rows are numbered from first on."""
    ship(files.sparkSession)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path_, first, body in zip(pdf["path"], pdf["first"], pdf["content"], strict=True):
                if cols is None:
                    n, r = struct.unpack_from("<QQ", body)
                    width = (len(body) - 16) // max(1, n * r)
                    if width not in (4, 8) or 16 + n * r * width != len(body):
                        raise ValueError(f"{path_}: {n} x {r} cells don't fit {len(body)} bytes")
                    m = np.frombuffer(body, "<f4" if width == 4 else "<f8", offset=16).reshape(n, r)
                else:
                    m = np.frombuffer(body, "<f4").reshape(-1, cols)
                yield pd.DataFrame({"file": path_.rsplit("/", 1)[-1], "idx": first + np.arange(len(m)), "row": list(m.astype(float))})

    return files.select("path", "first", "content").mapInPandas(decode, "file string, idx long, row array<double>")


def factor_files(factor: DataFrame, name: str, rows: int = 1 << 16, width: int = 4) -> DataFrame:
    """(path, first, content): a factor of any length as files of `rows` rows each, made on the executors.

    Absent rows are 0; files of absent rows alone are left out.
    """
    ship(factor.sparkSession)
    names, most = factor.columns[1:], factor.agg(F.max("x")).first()[0]

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * rows
        m = np.zeros((min(rows, most + 1 - first), len(names)), "<f4" if width == 4 else "<f8")
        m[pdf["x"].to_numpy(int) - first] = pdf[names].to_numpy(float)
        return pd.DataFrame({"path": [f"{name}-{key[0]}.bin"], "first": [first], "content": [struct.pack("<QQ", *m.shape) + m.tobytes()]})

    return factor.withColumn("part", F.floor(F.col("x") / rows)).groupBy("part").applyInPandas(encode, "path string, first long, content binary")


def write_model(model, path: str) -> None:
    """A Tucker model's tables: factors/mode=n (Parquet), the core (Parquet) and a summary (JSON)."""
    spark = model.factors[0].sparkSession
    for n, f in enumerate(model.factors):
        f.write.mode("overwrite").parquet(f"{path}/factors/mode={n}")
    cells = [(*(int(k) for k in at), float(model.core[at])) for at in np.ndindex(*model.core.shape)]
    names = [*(f"r{k} long" for k in range(model.core.ndim)), "v double"]
    spark.createDataFrame(cells, ", ".join(names)).write.mode("overwrite").parquet(f"{path}/core")
    spark.createDataFrame([(json.dumps({"ranks": list(model.core.shape), "fits": model.fits}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def read_model(spark: SparkSession, path: str):
    """What write_model() wrote."""
    from tensorloom.operators.tucker import Tucker, core_array

    summary = json.loads(spark.read.text(f"{path}/summary").first()["value"])
    factors = [spark.read.parquet(f"{path}/factors/mode={n}") for n in range(len(summary["ranks"]))]
    return Tucker(factors, core_array(spark.read.parquet(f"{path}/core"), summary["ranks"]), summary["fits"])


def show(x: DataFrame, limit: int = 20) -> str:
    """The first entries of a tensor as text."""
    cols = [c for c in x.columns if c != "v"]
    return "\n".join(f"({', '.join(str(r[c]) for c in cols)}) {r['v']:g}" for r in x.orderBy(*cols).limit(limit).collect())


def result_lines(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, value): `R x C matrix` and the rows with two decimals, parted by tabs."""
    from .text import dense_lines

    body = dense_lines(m, cols, 2).select("row", F.regexp_replace("value", " ", "\t").alias("value"))
    return m.sparkSession.createDataFrame([(-1, f"{rows} x {cols} matrix")], "row long, value string").unionByName(body)
