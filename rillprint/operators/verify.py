"""Equality of objects by their hashes: pairs, groups, missing and shared content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify_pairs(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """pairs (with a_id, b_id) with match: whether both objects' hashes and lengths agree; null if one is unknown.

    Every object is hashed once, however many pairs it is in.
    """
    a = hashes.select(F.col("object_id").alias("a_id"), F.col("hash").alias("__ah"), F.col("length").alias("__an"))
    b = hashes.select(F.col("object_id").alias("b_id"), F.col("hash").alias("__bh"), F.col("length").alias("__bn"))
    joined = pairs.join(a, "a_id", "left").join(b, "b_id", "left")
    return joined.select(*pairs.columns, ((F.col("__ah") == F.col("__bh")) & (F.col("__an") == F.col("__bn"))).alias("match"))


def duplicate_groups(hashes: DataFrame) -> DataFrame:
    """length, hash, copies and first (smallest object_id) of content that several objects have; a partial aggregate, no pairs."""
    return hashes.groupBy("length", "hash").agg(F.count(F.lit(1)).alias("copies"), F.min("object_id").alias("first")).where("copies > 1")


def with_copies(hashes: DataFrame, others: DataFrame) -> DataFrame:
    """Objects whose content is among the others."""
    return hashes.join(others.select("length", "hash").distinct(), ["length", "hash"], "left_semi")


def without_copies(hashes: DataFrame, others: DataFrame) -> DataFrame:
    """Objects whose content is not among the others."""
    return hashes.join(others.select("length", "hash").distinct(), ["length", "hash"], "left_anti")


def cross_format_matrix(hashes: DataFrame) -> DataFrame:
    """content_id, fmt_a < fmt_b and match, of objects (content_id, format, length, hash) that should hold the same content.

    Both sides of the join read one exchange, so that every object is hashed once.
    """
    hashes = hashes.repartition("content_id")
    a = hashes.select("content_id", F.col("format").alias("fmt_a"), F.col("hash").alias("__a"), F.col("length").alias("__an"))
    b = hashes.select("content_id", F.col("format").alias("fmt_b"), F.col("hash").alias("__b"), F.col("length").alias("__bn"))
    both = a.join(b, "content_id").where("fmt_a < fmt_b")  # as many rows for each content as there are pairs of formats
    return both.select("content_id", "fmt_a", "fmt_b", ((F.col("__a") == F.col("__b")) & (F.col("__an") == F.col("__bn"))).alias("match"))


def shared_chunks(a: DataFrame, b: DataFrame) -> DataFrame:
    """size and hash of the chunks that both have."""
    return a.select("size", "hash").intersect(b.select("size", "hash"))


def dedup_ratio(chunks: DataFrame) -> DataFrame:
    """All and distinct chunks and bytes, and the share of bytes that need not be stored again."""
    distinct = chunks.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"))
    totals = distinct.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("distinct_bytes"))
    return totals.withColumn("saved", F.when(F.col("bytes") > 0, 1 - F.col("distinct_bytes") / F.col("bytes")).otherwise(F.lit(0.0)))
