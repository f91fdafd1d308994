"""Ordered concatenation of hashed pieces, as window and aggregate plans.

A piece is (length, hash); pieces of a key follow one another by an order column.  The hash of their concatenation is the sum
of hash * base**(bytes after it): the sum itself is an ordinary aggregate, so pieces of one key are combined where they are.
All functions take HashSpecs with long values and one base; k-tuples are k columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..spec import DEFAULT_BASE, M61

BLOCK = 4096  # orders of a key that are joined in one window


def _after(key: list[str], order: str, length: Column) -> Column:
    """Bytes of the pieces after each."""
    frame = Window.partitionBy(*key).orderBy(order)
    total = F.sum(length).over(Window.partitionBy(*key))
    return (total - F.sum(length).over(frame.rowsBetween(Window.unboundedPreceding, 0))).cast("long")


def starts(df: DataFrame, key: list[str], order: str, length: str = "length", to: str = "start") -> DataFrame:
    """The place of each piece in its key's concatenation."""
    frame = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, (F.sum(length).over(frame) - F.col(length)).cast("long"))


def ordered_concat(df: DataFrame, key: list[str], order: str, length: str = "length", h: str = "h", base: int = DEFAULT_BASE, prime: int = M61, block: int = BLOCK) -> DataFrame:
    """key, length and h of each key's pieces one after another; no pieces give no row, empty ones count for nothing.

    Where the order column is a number, pieces are first joined in blocks of ``block`` orders: a key with most of the pieces is dealt
    over many tasks, and its own window holds a row for each block.
    """
    if dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint") and block:
        blocks = df.withColumn("__block", F.floor(F.col(order) / block))
        df = _concat(blocks, [*key, "__block"], order, length, h, base, prime)
        order, length, h = "__block", "length", "h"
    return _concat(df, key, order, length, h, base, prime)


def _concat(df: DataFrame, key: list[str], order: str, length: str, h: str, base: int, prime: int) -> DataFrame:
    term = E.mod_mul(F.col(h), E.power(base, F.col("__after"), prime), prime)
    terms = df.withColumn("__after", _after(key, order, F.col(length))).select(*key, F.col(length).alias("__n"), term.alias("__t"))
    total = E.mod_reduce(F.sum(F.col("__t").cast("decimal(28,0)")), prime)
    return terms.groupBy(*key).agg(F.sum("__n").alias("length"), total.alias("h"))


def prefix_hashes(df: DataFrame, key: list[str], order: str, length: str = "length", h: str = "h", base: int = DEFAULT_BASE, prime: int = M61, to: str = "prefix_h") -> DataFrame:
    """Each piece with the hash of all up to and with it.

    Terms are taken to the key's end, summed so far and divided by the power of what follows: a multiplication by its inverse.
    """
    inverse = pow(base, -1, prime)
    frame = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    with_after = df.withColumn("__after", _after(key, order, F.col(length)))
    terms = with_after.withColumn("__t", E.mod_mul(F.col(h), E.power(base, F.col("__after"), prime), prime).cast("decimal(28,0)"))
    so_far = terms.withColumn("__s", E.mod_reduce(F.sum("__t").over(frame), prime))
    return so_far.withColumn(to, E.mod_mul(F.col("__s"), E.power(inverse, F.col("__after"), prime), prime)).select(*df.columns, to)


def validate_segments(segments: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose segments (idx, bytes, reps, length) break a rule: reps below 1, empty bytes, a wrong length, idx given twice."""
    bad = (F.col("reps") < 1) | (F.octet_length("bytes") == 0) | (F.col("length") != F.octet_length("bytes") * F.col("reps"))
    counts = segments.groupBy(*key).agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_segments"), (F.count("idx") - F.count_distinct("idx")).alias("repeated_idx"))
    return counts.where("bad_segments > 0 OR repeated_idx > 0")


def hash_segments(segments: DataFrame, key: list[str], base: int = DEFAULT_BASE, prime: int = M61) -> DataFrame:
    """key, length and h of segments (idx, bytes, reps): each repeated reps times, in the order of idx."""
    n = F.octet_length("bytes").cast("long")
    one = segments.select(*key, "idx", (n * F.col("reps")).alias("length"), E.hash_repeat(E.poly_hash(F.col("bytes"), base, prime), n, F.col("reps"), base, prime).alias("h"))
    return ordered_concat(one, key, "idx", base=base, prime=prime)


def segment_bytes(segments: DataFrame, key: list[str]) -> DataFrame:
    """key and content: the segments' bytes, repeated and joined in the order of idx."""
    part = F.struct("idx", F.expr("repeat(hex(bytes), cast(reps as int))").alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), "")
    return segments.groupBy(*key).agg(F.unhex(joined).alias("content"))


def slice_segments(segments: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Segments that make up each range (key, start, length) of its key: a range join and a cut of the first and last ones.

    What lies beyond the end is left out; a repeated segment becomes up to three pieces: the rest of a repeat, whole repeats, the
    beginning of one.
    """
    placed = starts(segments.withColumn("length", F.octet_length("bytes").cast("long") * F.col("reps")), [key], "idx", to="at")
    s = placed.select(F.col(key).alias("__key"), "idx", "bytes", F.octet_length("bytes").cast("long").alias("d"), "length", "at")
    r = ranges.select(key, F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("want"))
    on = (F.col("__key") == F.col(key)) & (F.col("at") < F.col("start") + F.col("want")) & (F.col("at") + F.col("length") > F.col("start"))
    cut = r.join(s, on).withColumn("lo", F.greatest(F.col("start") - F.col("at"), F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("want") - F.col("at"), F.col("length")))
    d = F.col("d")
    first_end = F.least(F.col("hi"), F.ceil(F.col("lo") / d).cast("long") * d)
    last_begin = F.greatest(first_end, F.floor(F.col("hi") / d).cast("long") * d)
    piece = lambda k, lo, n, reps: F.struct(F.lit(k).alias("k"), F.substring(F.col("bytes"), (lo % d + 1).cast("int"), n.cast("int")).alias("bytes"), reps.cast("long").alias("reps"))
    one = F.lit(1)
    pieces = F.array(
        piece(0, F.col("lo"), first_end - F.col("lo"), one),
        piece(1, F.lit(0), d, F.floor((last_begin - first_end) / d)),
        piece(2, F.lit(0), F.col("hi") - last_begin, one),
    )
    flat = cut.select(key, "start", "want", "idx", F.explode(pieces).alias("p")).where("octet_length(p.bytes) > 0 AND p.reps > 0")
    return flat.select(key, "start", F.col("want").alias("length"), (F.col("idx") * 3 + F.col("p.k")).alias("idx"), "p.bytes", "p.reps")


def split_segments(segments: DataFrame, key: str, at: int) -> tuple[DataFrame, DataFrame]:
    """Segments of the bytes before and from a place; a place at or before 0 or beyond the end leaves one side empty."""
    totals = segments.groupBy(key).agg(F.sum(F.octet_length("bytes").cast("long") * F.col("reps")).alias("n"))
    cut = F.least(F.greatest(F.lit(at).cast("long"), F.lit(0)), F.col("n"))
    left = slice_segments(segments, totals.select(key, F.lit(0).alias("start"), cut.alias("length")), key)
    right = slice_segments(segments, totals.select(key, cut.alias("start"), (F.col("n") - cut).alias("length")), key)
    return tuple(x.select(key, "idx", "bytes", "reps") for x in (left, right))
