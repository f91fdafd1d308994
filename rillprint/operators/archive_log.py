"""Incremental archives as a log of operations: add a chunk, or remove the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..spec import DEFAULT_BASE, M61
from .monoid import ordered_concat


def surviving(log: DataFrame) -> DataFrame:
    """Adds (archive_id, seq, op, chunk) that no later remove takes away; a remove from an empty archive is an error.

    An add at depth d is gone once a later depth is below d; depths are running sums, so this is two windows over the log.
    """
    order = Window.partitionBy("archive_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("op") == "add", 1).when(F.col("op") == "remove", -1).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))))
    deep = log.withColumn("__step", step).withColumn("__depth", F.sum("__step").over(so_far))
    checked = deep.withColumn("__depth", F.when(F.col("__depth") < 0, F.raise_error(F.lit("a chunk is removed from an empty archive"))).otherwise(F.col("__depth")))
    later = checked.withColumn("__low", F.min("__depth").over(order.rowsBetween(1, Window.unboundedFollowing)))
    return later.where((F.col("op") == "add") & (F.col("__low").isNull() | (F.col("__low") >= F.col("__depth")))).select(log.columns)


def archive_hashes(log: DataFrame, base: int = DEFAULT_BASE, prime: int = M61) -> DataFrame:
    """archive_id, chunks, length and h of what is left; archives with nothing left have 0, 0 and 0."""
    left = surviving(log)
    n = F.octet_length("chunk").cast("long")
    pieces = left.select("archive_id", "seq", n.alias("length"), E.poly_hash(F.col("chunk"), base, prime).alias("h"))
    whole = ordered_concat(pieces, ["archive_id"], "seq", base=base, prime=prime)
    counts = left.groupBy("archive_id").agg(F.count(F.lit(1)).alias("chunks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    every = log.select("archive_id").distinct()
    return every.join(counts, "archive_id", "left").join(whole, "archive_id", "left").select("archive_id", zero("chunks"), zero("length"), zero("h"))


def archive_digests(log: DataFrame) -> DataFrame:
    """archive_id and the SHA-256 of the remaining chunks one after another."""
    part = F.struct("seq", F.hex("chunk").alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), "")
    return surviving(log).groupBy("archive_id").agg(F.sha2(F.unhex(joined), 256).alias("digest"))
