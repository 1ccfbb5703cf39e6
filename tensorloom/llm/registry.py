"""The corpus queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .clustering import cluster, op11_sql
from .codes import encode, op12_sql
from .exact_dedup import OP6_SQL, exact_groups
from .language import held_out, identify
from .mixing import OP10_SQL, mix
from .near_dedup import OP5_SQL, near_duplicates
from .neighbours import neighbours
from .packing import pack
from .quality import quality
from .search import search
from .sharding import shard
from .substring_dedup import remove_repeats
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document; its source is the host, its language the section of it."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of near equal bytes; equal texts stay together."""
    return shard(table(spark, sf_dir, "documents"), 24)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three quarters of them."""
    return identify(table(spark, sf_dir, "documents")).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 50 = 0"), 10)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, by four-word shingles and similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; the largest id stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from four fifths of the labels."""
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of 400 bytes that occur twice leave of each document."""
    return remove_repeats(table(spark, sf_dir, "documents"), 400)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 in turn, 150 % of all words, at most two epochs."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 16 clusters, after three rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of 16 bytes."""
    return encode(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each embedding whose id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality": op1_quality, "op2_sharding": op2_sharding, "op3_language": op3_language, "op4_search": op4_search, "op5_near_dedup": op5_near_dedup, "op6_exact_dedup": op6_exact_dedup, "op7_toxicity": op7_toxicity, "op8_substring_dedup": op8_substring_dedup, "op9_packing": op9_packing, "op10_mixing": op10_mixing, "op11_clustering": op11_clustering, "op12_codes": op12_codes, "op13_neighbours": op13_neighbours}
SQL: dict[str, str] = {"op5_near_dedup": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op10_mixing": OP10_SQL, "op11_clustering": op11_sql(), "op12_codes": op12_sql()}
