"""Token tables (object_id, seq, kind, byte, distance, length) as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(tokens: DataFrame) -> DataFrame:
    """Tokens with their place in the output (start) and the bytes they make (size)."""
    size = F.coalesce(F.col("length"), F.lit(1)).cast("long")
    frame = Window.partitionBy("object_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("size", size).withColumn("start", F.sum("size").over(frame) - F.col("size"))


def invalid(tokens: DataFrame) -> DataFrame:
    """Tokens that no stream can have: bytes out of range, lengths or distances below 1, references to before the start."""
    t = positions(tokens)
    literal = (F.col("kind") == "L") & F.coalesce(F.col("byte").between(0, 255), F.lit(False))
    reference = (F.col("kind") == "R") & F.coalesce((F.col("distance") >= 1) & (F.col("length") >= 1) & (F.col("distance") <= F.col("start")), F.lit(False))
    return t.where(~(literal | reference))


def stats(tokens: DataFrame) -> DataFrame:
    """Counts of tokens by kind, of overlapping references, and the decoded size."""
    return tokens.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("total_tokens"),
        F.count_if(F.col("kind") == "L").alias("literals"),
        F.count_if(F.col("kind") == "R").alias("references"),
        F.count_if(F.col("distance") < F.col("length")).alias("overlapping_refs"),
        F.sum(F.coalesce("length", F.lit(1))).cast("long").alias("decoded_size"),
    )


def decode_relational(tokens: DataFrame, checkpoint=lambda df: df, rounds: int = 64) -> DataFrame:
    """object_id, pos and byte of the output, by pointer jumping: a self-join halves all chains of references each round.

    A cross-check of the per-object decoder and a way for one object too large for a task.  ``checkpoint`` cuts lineage.
    """
    each = positions(tokens).select("object_id", "start", "kind", "byte", "distance", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))).alias("k"))
    pos = (F.col("start") + F.col("k")).alias("pos")
    # an overlapping reference points into its first period
    source = F.when(F.col("kind") == "R", F.col("start") - F.col("distance") + F.col("k") % F.col("distance"))
    now = checkpoint(each.select("object_id", pos, source.alias("src"), F.when(F.col("kind") == "L", F.col("byte")).alias("byte")))
    for _ in range(rounds):
        if now.where("byte IS NULL").limit(1).count() == 0:
            return now.select("object_id", "pos", "byte")
        a, b = now.alias("a"), now.alias("b")
        joined = a.join(b, (F.col("a.object_id") == F.col("b.object_id")) & (F.col("a.src") == F.col("b.pos")), "left")
        value = F.coalesce("a.byte", "b.byte")
        now = checkpoint(joined.select("a.object_id", "a.pos", F.when(value.isNull(), F.col("b.src")).alias("src"), value.alias("byte")))
    raise ValueError("references do not end in literals")
