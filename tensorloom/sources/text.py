"""Text formats of tensors and matrices, read and written as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.blocks import tree_arrays, tree_to_coo
from tensorloom.functions.runs import running
from tensorloom.functions.tables import cleaning, ordinals, written
from tensorloom.operators.coo import canonical, delinearise, linearise, modes

#: The folder beside the parts of a text that has its header; Spark's readers pass over it.
HEADER = "_header"
#: White space as regular expressions know it.
BLANKS = " \t\n\x0b\f\r"


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of a file or folder; None if there is none."""
    try:
        return spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _put_header(spark: SparkSession, path: str, lines: Sequence[str]) -> None:
    header = spark.createDataFrame(list(enumerate(lines)), "n int, value string").coalesce(1).sortWithinPartitions("n")
    header.select("value").write.mode("overwrite").text(f"{path}/{HEADER}")


def _tokens(lines: DataFrame) -> DataFrame:
    """Lines with their white-space-separated tokens; blank lines and comments (# or %) go."""
    body = F.btrim("value", F.lit(BLANKS))
    single = F.when(body.rlike(r"[\s&&[^ ]]|  "), F.regexp_replace(body, r"\s+", " ")).otherwise(body)
    # Tokens behind a generator are cut once a line; as a plain expression they would be cut anew in each place that reads one.
    kept = lines.where((body != "") & ~body.startswith("#") & ~body.startswith("%"))
    return kept.select("*", F.explode(F.array(F.split(single, " "))).alias("t"))


def parse_coo(lines: DataFrame, order: int, base: int = 1, strict: bool = False, missing: float | Column | None = None) -> DataFrame:
    """Lines (value) of `i1 ... iN v` as a tensor.

    Lines of other lengths, or with words that aren't numbers, go; with strict they raise. With
    `missing`, lines without a value get that value, or that of a column such as F.rand(). Indices below base raise with strict, too.
    Lines may have their tokens (t) already.
    """
    rows = lines if "t" in lines.columns else _tokens(lines)
    n = F.size("t")
    cols = [F.try_element_at("t", F.lit(k + 1)).try_cast("long") - base for k in range(order)]
    value = F.try_element_at("t", F.lit(order + 1)).try_cast("double")
    if missing is not None:
        value = F.when(n == order, missing if isinstance(missing, Column) else F.lit(float(missing))).otherwise(value)
    parsed = rows.select(*(c.alias(f"i{k}") for k, c in enumerate(cols)), value.alias("v"), n.alias("n"), "value")
    good = (F.col("n") == order + 1) if missing is None else F.col("n").between(order, order + 1)
    for k in range(order):
        good = good & F.col(f"i{k}").isNotNull() & (F.col(f"i{k}") >= 0)
    good = F.coalesce(good & F.col("v").isNotNull(), F.lit(False))
    if strict:
        check = F.when(good, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), "value")).cast("double"))
        return parsed.select(*(f"i{k}" for k in range(order)), check.alias("v"))
    return parsed.where(good).select(*(f"i{k}" for k in range(order)), "v")


def peek(spark: SparkSession, path: str) -> tuple[int, list[int] | None]:
    """(order, dims) of a file: from its header, or from the length of its first line alone."""
    header = _lines(spark, f"{path}/{HEADER}")
    lines = [r["t"] for r in _tokens(spark.read.text(path) if header is None else header).limit(2).collect()]
    if len(lines) > 1 and len(lines[0]) == 1 and len(lines[1]) == int(lines[0][0]):
        return int(lines[0][0]), [int(x) for x in lines[1]]
    return len(lines[0]) - 1, None


def read_tns(spark: SparkSession, path: str, base: int = 1, strict: bool = False, missing: float | Column | None = None) -> tuple[DataFrame, list[int] | None]:
    """(tensor, dims or None) of a `.tns` file or of what write_tns() wrote, with or without the two header lines.

    The header's lines have other numbers of tokens than entries, but for a tensor of order 0.
    """
    order, sizes = peek(spark, path)
    lines = spark.read.text(path)
    if sizes is not None:
        # The header is one line of one token and one of `order` tokens.
        lines = _tokens(lines).where((F.size("t") != 1) & ((F.size("t") != order) | (F.lit(missing is not None) & (F.col("value") != " ".join(map(str, sizes))))))
    return parse_coo(lines, order, base, strict, missing), sizes


def read_directory(spark: SparkSession, path: str, order: int, pattern: str = "*.tns", base: int = 1, named_by: int = -1) -> DataFrame:
    """All headerless files of a folder, with the name of each entry's file; with named_by -2, that of the file's folder.

    Tensors of other orders go.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), named_by))
    rows = _tokens(lines).where(F.size("t") == order + 1)
    return rows.select("file", *((F.col("t")[k].try_cast("long") - base).alias(f"i{k}") for k in range(order)), F.col("t")[order].try_cast("double").alias("v"))


def write_tns(x: DataFrame, path: str, dims: Sequence[int] | None = None, base: int = 1) -> None:
    """x as text, one entry a line, values in full; with dims, a header in a folder `_header` beside the parts."""
    line = F.concat_ws(" ", *((F.col(c) + base).cast("string") for c in modes(x)), F.col("v").cast("string"))
    x.select(line.alias("value")).write.mode("overwrite").text(path)
    if dims is not None:
        _put_header(x.sparkSession, path, [str(len(dims)), " ".join(map(str, dims))])


def parse_mtx(lines: DataFrame, symmetric: bool = False) -> DataFrame:
    """Coordinate lines of MatrixMarket (without the size line) as a matrix (row, col, v), 0-based.

    Symmetric storage is expanded; entries without a value count as 1.
    """
    rows = _tokens(lines).where(F.size("t").between(2, 3))
    m = rows.select((F.col("t")[0].cast("long") - 1).alias("row"), (F.col("t")[1].cast("long") - 1).alias("col"), F.coalesce(F.try_element_at("t", F.lit(3)).try_cast("double"), F.lit(1.0)).alias("v"))
    if not symmetric:
        return m
    # Both cells of an entry come from one reading of its line.
    cells = F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col")))
    return m.select(F.explode(F.slice(cells, F.lit(1), F.when(F.col("row") == F.col("col"), 1).otherwise(2))).alias("p"), "v").select("p.row", "p.col", "v")


def read_mtx(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """(matrix, (rows, cols, nnz)) of a MatrixMarket coordinate file, or of what write_mtx() wrote."""
    lines, header = spark.read.text(path), _lines(spark, f"{path}/{HEADER}")
    head = lines if header is None else header
    top = head.limit(1).first()["value"].lower()
    sizes = _tokens(head).limit(1).first()
    rows, cols, n = (int(v) for v in sizes["t"])
    body = lines.where(F.col("value") != sizes["value"]) if header is None else lines
    return parse_mtx(body, "symmetric" in top), (rows, cols, n)


def write_mtx(m: DataFrame, path: str, rows: int | None = None, cols: int | None = None, symmetric: bool = False, compression: str = "none") -> None:
    """A matrix (row, col, v) as MatrixMarket coordinates, its header in a folder `_header` beside the parts.

    With symmetric, m has the entries on and below the diagonal alone. m is made once: its entries, and the sizes that
    aren't given, are observed as it is written. compression is as Spark's text writer has it.
    """
    seen, spark = Observation(), m.sparkSession
    told = m.observe(seen, F.count(F.lit(1)).alias("n"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    with cleaning(spark):
        told.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "v").alias("value")).write.mode("overwrite").option("compression", compression).text(path)
    found = seen.get
    sizes = [found.get("rows") or 0 if rows is None else rows, found.get("cols") or 0 if cols is None else cols]
    if symmetric and (rows is None or cols is None):
        sizes = [max(sizes)] * 2
    kind = "symmetric" if symmetric else "general"
    _put_header(spark, path, [f"%%MatrixMarket matrix coordinate real {kind}", f"{sizes[0]} {sizes[1]} {found.get('n') or 0}"])


def csf_lines(x: DataFrame, dims: Sequence[int], order: Sequence[int] | None = None, size: int = 1 << 16) -> DataFrame:
    """(n, begin, value): the labelled text of a fiber tree, in the order of n and begin.

    An array is a line `label: numbers`; what passes `size` numbers goes on in lines `label[begin]:`,
    so that no cell holds a level.
    """
    spark = x.sparkSession
    head = [f"# Tensor order: {len(dims)}", "# Mode ordering: " + " ".join(map(str, order or range(len(dims)))), "# Dimensions: " + " ".join(map(str, dims))]
    x, level = canonical(x), F.floor((F.col("n") - 10) / 2)
    kind = x.schema["v"].dataType
    numbers = lambda name, kind: F.array_join(F.transform(name, lambda c: c.cast(kind).cast("string")), " ")
    label = F.when(F.col("n") == 1000, "values").otherwise(F.concat(F.lit("mode_"), level, F.when(F.col("n") % 2 == 0, "_ptr").otherwise("_idx")))
    begun = F.when(F.col("begin") == 0, ": ").otherwise(F.concat(F.lit("["), F.col("begin"), F.lit("]: ")))
    body = tree_arrays(x, size).select("n", "begin", F.concat(label, begun, F.when(F.col("n") == 1000, numbers("real", kind)).otherwise(numbers("whole", "long"))).alias("value"))
    return spark.createDataFrame([(n, 0, line) for n, line in enumerate(head)], "n int, begin long, value string").unionByName(body)


def parse_csf(lines: DataFrame) -> DataFrame:
    """(level, kind, pos, val) of labelled lines: the arrays ptr, idx and (level -1) values, whole or in ranges `label[begin]:`."""
    label = F.trim(F.substring_index("value", ":", 1))
    level = F.coalesce(F.regexp_extract(label, r"mode_(\d+)_", 1).try_cast("int"), F.lit(-1))
    kind = F.when(label.startswith("values"), "values").otherwise(F.regexp_extract(label, r"_(ptr|idx)(?:\[|$)", 1))
    begin = F.coalesce(F.regexp_extract(label, r"\[(\d+)\]$", 1).try_cast("long"), F.lit(0))
    # Labels behind a generator are read once a line, not for each of its numbers.
    labels = F.explode(F.array(F.struct(level.alias("level"), kind.alias("kind"), begin.alias("begin")))).alias("l")
    labelled = lines.where("value NOT LIKE '#%' AND value LIKE '%:%'").select("value", labels)
    rows = labelled.select("l.*", F.posexplode(F.split(F.trim(F.substring_index("value", ":", -1)), r"\s+")).alias("at", "s"))
    numbers = rows.select("level", "kind", (F.col("begin") + F.col("at")).alias("pos"), F.col("s").try_cast("double").alias("val"))
    return numbers.where("val IS NOT NULL")


def parse_positional_csf(lines: DataFrame, order: int = 3) -> DataFrame:
    """parse_csf()'s table of numbered lines (n, value): a pointer and an index line for each level, then the values."""
    rows = lines.where(F.trim("value") != "").select("n", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "s"))
    last = F.col("n") == 2 * order
    level = F.when(last, -1).otherwise(F.floor(F.col("n") / 2)).cast("int")
    kind = F.when(last, "values").when(F.col("n") % 2 == 0, "ptr").otherwise("idx")
    return rows.where(F.col("n") <= 2 * order).select(level.alias("level"), kind.alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("s").cast("double").alias("val"))


def csf_to_coo(arrays: DataFrame, order: int) -> DataFrame:
    """The tensor of parse_csf()'s arrays, from one pass over them (see functions/blocks.py)."""
    return tree_to_coo(arrays, order)


def parse_dense(lines: DataFrame, cols: int | None = None) -> DataFrame:
    """(row, col, v) of dense rows; lines (row, value) are numbered by their reader. With cols, rows of other lengths raise."""
    cells = F.split(F.trim("value"), r"\s+")
    if cols is not None:
        cells = F.when(F.size(cells) == cols, cells).otherwise(F.raise_error(F.concat(F.lit("ragged row: "), "value")).cast("array<string>"))
    cells = lines.select(F.col("row").cast("long").alias("row"), F.posexplode(cells).alias("col", "s"))
    return cells.select("row", F.col("col").cast("long").alias("col"), F.col("s").cast("double").alias("v"))


def read_dense(spark: SparkSession, path: str, cols: int, ones: int | None = None) -> DataFrame:
    """(row, col, v) of a dense text file with cols numbers a line; others raise. Without a file, `ones` rows of ones."""
    lines = _lines(spark, path)
    if lines is None:
        if ones is None:
            raise FileNotFoundError(path)
        return spark.range(ones).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"), F.lit(1.0).alias("v"))
    # Files follow one another by name, and their splits by where they begin; within one, rows come as they stand.
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return parse_dense(ordinals(rows.where(F.trim("value") != ""), ["file", "split", "at"], "row"), cols)


def dense_lines(m: DataFrame, cols: int, decimals: int | None = None) -> DataFrame:
    """(row, value): a dense matrix as text, a line for each row; absent cells are 0."""
    cells = m.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("c"))
    at = lambda k: F.coalesce(F.try_element_at("c", k.cast("long")), F.lit(0.0))
    show = (lambda v: v.cast("string")) if decimals is None else (lambda v: F.format_string(f"%.{decimals}f", v))
    return cells.select("row", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda k: show(at(k))), " ").alias("value"))


def read_dense_tensor(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """(tensor, sizes) of a text file or folder of parts: the order, the sizes, and the row-major values, over any lines.

    Numbers find their places by prefix sums over lines, so neither a line nor the file has to be
    short. Another number of values than the sizes ask for raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    tokens = lines.select(F.split(F.trim("value"), r"\s+").alias("t"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    placed, total = running(tokens.withColumn("n", F.size("t")), ["file", "split", "at"], "n", "before")
    cells = placed.select("before", F.posexplode("t").alias("k", "s")).select((F.col("before") + F.col("k")).alias("pos"), "s")
    first = cells.where("pos = 0").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    order = int(first["s"])
    sizes = [int(r["s"]) for r in sorted(cells.where(F.col("pos").between(1, order)).collect(), key=lambda r: r["pos"])]
    if len(sizes) < order or total - 1 - order != math.prod(sizes):
        raise ValueError(f"{path} has {total - 1 - order} values for the sizes {sizes}")
    return delinearise(cells.where(F.col("pos") > order).select((F.col("pos") - 1 - order).alias("pos"), F.col("s").cast("double").alias("v")), sizes), sizes


def write_dense_tensor(x: DataFrame, sizes: Sequence[int], path: str, per_line: int = 1024) -> None:
    """x with all its cells as text that read_dense_tensor() reads; parts follow one another by name."""
    spark, total = x.sparkSession, math.prod(sizes)
    grid = spark.range(total).select(F.col("id").alias("pos")).join(linearise(x, sizes), "pos", "left").select("pos", F.coalesce("v", F.lit(0.0)).alias("v"))
    lines = grid.groupBy(F.floor(F.col("pos") / per_line).alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"].cast("string")), " ").alias("value"))
    head = spark.createDataFrame([(-1, f"{len(sizes)} " + " ".join(map(str, sizes)))], "line long, value string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head.unionByName(lines).repartitionByRange(parts, "line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def read_observed(spark: SparkSession, path: str, order: int, base: int = 1, seed: int = 0) -> tuple[DataFrame, dict[str, int | list[int]]]:
    """(tensor, what was seen) of a headerless file, in one pass: sizes, entries, entries without value, malformed lines.

    Entries without a value get a number in (0, 1) that hangs on the place of their line. An index
    below base raises. Lines that are no entries are counted and go. The tensor is a written table.
    """
    seen = Observation()
    rows = _tokens(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")))
    drawn = (F.pmod(F.xxhash64(F.regexp_extract("file", "[^/]*$", 0), "split", "at", F.lit(seed)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    cols = [F.try_element_at("t", F.lit(k + 1)).try_cast("long").alias(f"i{k}") for k in range(order)]
    parsed = rows.select(*cols, F.when(F.size("t") == order, drawn).otherwise(F.try_element_at("t", F.lit(order + 1)).try_cast("double")).alias("v"), F.size("t").alias("n"))
    good = F.col("n").between(order, order + 1) & F.col("v").isNotNull()
    for k in range(order):
        good = good & F.col(f"i{k}").isNotNull()
    good = F.coalesce(good, F.lit(False))
    told = [F.count_if(good).alias("entries"), F.count_if(~good).alias("malformed"), F.count_if(good & (F.col("n") == order)).alias("drawn")]
    told += [f(F.when(good, F.col(f"i{k}"))).alias(f"{name}{k}") for k in range(order) for name, f in (("low", F.min), ("high", F.max))]
    x = written(parsed.observe(seen, *told).where(good).select(*((F.col(f"i{k}") - base).alias(f"i{k}") for k in range(order)), "v"), "observed")
    found = seen.get
    if found["entries"] and min(found[f"low{k}"] for k in range(order)) < base:
        raise ValueError(f"indices begin at {base}, but {path} has lower ones")
    dims = [(found[f"high{k}"] or base - 1) - base + 1 for k in range(order)]
    return x, {"dims": dims, "entries": found["entries"], "malformed": found["malformed"], "drawn": found["drawn"]}


def flat_lines(df: DataFrame, key: str, value: str, size: int = 1 << 16) -> DataFrame:
    """(begin, value): a vector in the order of its keys as lines of `size` numbers, and their places."""
    placed = ordinals(df.select(key, value), [key])
    number = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda s: s[value].cast("string")), " ")
    return placed.groupBy((F.floor(F.col("pos") / size) * size).alias("begin")).agg(number.alias("value"))


def with_header(x: DataFrame) -> dict[str, list[int] | int]:
    """The header that a headerless tensor should have: order and sizes, in one pass."""
    row = x.agg(*(F.max(c).alias(c) for c in modes(x))).first()
    return {"order": len(modes(x)), "dims": [int(row[c]) + 1 for c in modes(x)]}
