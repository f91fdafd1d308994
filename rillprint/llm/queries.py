"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontam import contaminated
from .frames import write_and_read
from .neardup import group_documents
from .packing import pack_documents
from .pii import surrogate_key, with_surrogates
from .quality import classify
from .secrets import scan_documents
from .sharding import HashTree, shard_documents
from .suffix_dedup import remove_repeats
from .vptree import nearest


def op1_greedy_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), HashTree.of(8))


def op3_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))


def op7_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), counts="n_entities")


def op9_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(read_table(spark, sf_dir, "documents"), similarity=(85, 100))


def op10_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
