"""One query for each operator over the driver's tables, and the SQL that must give the same rows.

A compressed object's hash is that of its content, so the SQL of every compressed query is the hash of the text itself.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as E
from .operators import archive_log, monoid, tokens, verify
from .operators.cdc import GEAR, ChunkSpec
from .operators.cdh import METHODS
from .plans import objects as P
from .sources import objects as S
from .spec import M61, M127, HashSpec

Query = Callable[[SparkSession, str], DataFrame]
FORMATS = ("deflate", "gzip", "zip", "lz4_block", "lz4_frame", "zstd")
TWO = HashSpec((131, 257))
CHUNKS = ChunkSpec(256, 1024, 4096)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.text_objects(table(spark, sf_dir, "documents"), "doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as objects conv_id-turn."""
    t = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return S.text_objects(t, "id", "text")


def raw(text: str = "text") -> Column:
    return F.col(text).cast("binary")


# SQL of hashes: over hexadecimal digits, so that a text is walked once


def hex_of(text: str = "text") -> str:
    return f"hex(encode({text}))"


def h_sql(digits: str, base: int = 131) -> str:
    return f"CASE WHEN ({digits}) IS NOT NULL THEN list_reduce(list_prepend(0::HUGEINT, list_transform(regexp_extract_all({digits}, '..'), lambda x: ('0x' || x)::INT::HUGEINT)), lambda a, c: (a * {base} + c + 1) % {M61})::BIGINT END"


DOCUMENT_HASHES = f"SELECT doc_id::VARCHAR AS object_id, octet_length(encode(text))::BIGINT AS length, {h_sql(hex_of())} AS h FROM documents"
TURN_HASHES = f"SELECT conv_id || '-' || turn AS object_id, octet_length(encode(text))::BIGINT AS length, {h_sql(hex_of())} AS h FROM conversations"


def flat(hashes: DataFrame) -> DataFrame:
    """Hashes of one base as a column h."""
    return hashes.select("object_id", "length", F.col("hash")[0].alias("h"))


# scalar hashes


@query(f"SELECT doc_id, {h_sql(hex_of())} AS h FROM documents")
def poly_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.poly_hash(raw()).alias("h"))


@query(f"SELECT doc_id, {h_sql(hex_of(), 257)} AS h FROM documents")
def poly_hash_base257(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.poly_hash(raw(), 257).alias("h"))


@query(DOCUMENT_HASHES)
def poly_hash_batches(spark, sf_dir):
    return flat(P.hash_raw(documents(spark, sf_dir)))


@query(f"SELECT item_id, {h_sql(hex_of())} AS h, {h_sql(hex_of(), 257)} AS h2 FROM benchmark")
def multi_hash_k2(spark, sf_dir):
    h = table(spark, sf_dir, "benchmark").select("item_id", E.multi_hash(raw(), TWO).alias("h"))
    return h.select("item_id", F.col("h")[0].alias("h"), F.col("h")[1].alias("h2"))


@query(f"SELECT conv_id, turn, format('{{:x}}', {h_sql(hex_of())}) AS h FROM conversations")
def hash_hex(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.format_hash(E.poly_hash(raw()), as_hex=True).alias("h"))


_ODD_BYTES = ["", "00", "0000", "000000", "01", "FF", "FFFF", "00FF00FF00", "61"]


@query(f"SELECT digits, {h_sql('digits')} AS h FROM (VALUES {', '.join(f"('{x}')" for x in _ODD_BYTES)}) t(digits)")
def hash_empty_and_nul(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _ODD_BYTES], "digits string").select("digits", E.poly_hash(F.unhex("digits")).alias("h"))


@query(f"SELECT n, list_reduce(list_prepend(1::HUGEINT, list_transform(range(n), lambda i: 131::HUGEINT)), lambda a, x: a * x % {M61})::BIGINT AS p FROM range(400) t(n)")
def power_table(spark, sf_dir):
    return spark.range(400).select(F.col("id").alias("n"), E.power(131, F.col("id")).alias("p"))


@query(f"SELECT n AS q, list_reduce(list_prepend(0::HUGEINT, list_transform(range(n), lambda i: 2248091::HUGEINT)), lambda a, x: (a * x + 1) % {M61})::BIGINT AS phi FROM range(400) t(n)")
def phi_table(spark, sf_dir):
    return spark.range(400).select(F.col("id").alias("q"), E.phi(F.col("id"), 131**3).alias("phi"))


@query(f"SELECT a.conv_id, a.turn, {h_sql('hex(encode(a.text || b.text))')} AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def hash_concat_pairs(spark, sf_dir):
    h = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n"), E.poly_hash(raw()).alias("h"))
    b = h.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("bn"), F.col("h").alias("bh"))
    return h.join(b, ["conv_id", "turn"]).select("conv_id", "turn", E.hash_concat(F.col("h"), F.col("bh"), F.col("bn")).alias("h"))


@query(f"SELECT conv_id, turn, {h_sql('repeat(hex(encode(text)), (turn % 5)::BIGINT)')} AS h FROM conversations")
def hash_repeat(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", E.hash_repeat(E.poly_hash(raw()), F.octet_length("text").cast("long"), F.col("turn") % 5).alias("h"))


@query(f"SELECT item_id, {h_sql('left(repeat(hex(encode(text)), 3), 2 * (2 * octet_length(encode(text)) + octet_length(encode(text)) // 3)::BIGINT)')} AS h FROM benchmark WHERE text <> ''")
def hash_overlap(spark, sf_dir):
    d = F.octet_length("text").cast("long")
    rest = F.floor(d / 3).cast("long")
    first = E.poly_hash(F.substring(raw(), F.lit(1), rest.cast("int")))
    return table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", E.hash_overlap(E.poly_hash(raw()), d, 2 * d + rest, first).alias("h"))


@query(f"SELECT conv_id, turn, {h_sql('substr(hex(encode(text)), 2 * (octet_length(encode(text)) // 4) + 1, 2 * (octet_length(encode(text)) // 2))')} AS h FROM conversations")
def substr_hash(spark, sf_dir):
    d = F.octet_length("text").cast("long")
    a, n = F.floor(d / 4).cast("long"), F.floor(d / 2).cast("long")
    upto = lambda end: E.poly_hash(F.substring(raw(), F.lit(1), end.cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.substring_hash(upto(a), upto(a + n), n).alias("h"))


@query(
    f"SELECT a.conv_id, a.turn, {h_sql('hex(encode(a.text || b.text))')} AS joined, {h_sql('hex(encode(a.text || b.text))', 257)} AS joined2, {h_sql('repeat(hex(encode(a.text)), 3)')} AS thrice, "
    f"{h_sql('repeat(hex(encode(a.text)), 3)', 257)} AS thrice2, 0::BIGINT AS zero FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
)
def multi_operations(spark, sf_dir):
    """Concatenation and repetition of pairs of hashes, and the hash of nothing."""
    h = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n"), E.multi_hash(raw(), TWO).alias("h"))
    b = h.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("bn"), F.col("h").alias("bh"))
    both = h.join(b, ["conv_id", "turn"])
    joined = E.each(E.hash_concat, F.col("h"), F.col("bh"), spec=TWO, len_b=F.col("bn"))
    thrice = E.each(E.hash_repeat, F.col("h"), spec=TWO, length=F.col("n"), q=3)
    return both.select("conv_id", "turn", *[x[i].alias(name + ("2" if i else "")) for name, x in (("joined", joined), ("thrice", thrice)) for i in range(2)], F.lit(TWO.zero[1]).cast("long").alias("zero"))


@query()
def poly_hash_m127(spark, sf_dir):
    return P.hash_raw(documents(spark, sf_dir), HashSpec((131, 257), M127))


# ordered concatenation


def turn_pieces(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("length"), E.poly_hash(raw()).alias("h"))


@query(f"SELECT conv_id, sum(octet_length(encode(text)))::BIGINT AS length, {h_sql("string_agg(hex(encode(text)), '' ORDER BY turn)")} AS h FROM conversations GROUP BY conv_id")
def concat_turns(spark, sf_dir):
    return monoid.ordered_concat(turn_pieces(spark, sf_dir), ["conv_id"], "turn")


@query(f"SELECT conv_id, turn, {h_sql('upto')} AS prefix_h FROM (SELECT conv_id, turn, string_agg(hex(encode(text)), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations)")
def prefix_hash_turns(spark, sf_dir):
    return monoid.prefix_hashes(turn_pieces(spark, sf_dir), ["conv_id"], "turn").select("conv_id", "turn", "prefix_h")


def segments(spark, sf_dir) -> DataFrame:
    """Turns as segments, each repeated 1 to 3 times."""
    return table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", F.col("turn").alias("idx"), raw().alias("bytes"), (F.col("turn") % 3 + 1).alias("reps"))


_SEGMENT_HEX = "SELECT conv_id, string_agg(repeat(hex(encode(text)), (turn % 3 + 1)::BIGINT), '' ORDER BY turn) AS digits FROM conversations WHERE text <> '' GROUP BY conv_id"


@query(f"SELECT conv_id, (length(digits) // 2)::BIGINT AS length, {h_sql('digits')} AS h FROM ({_SEGMENT_HEX})")
def rope_hash(spark, sf_dir):
    return monoid.hash_segments(segments(spark, sf_dir), ["conv_id"])


@query(f"SELECT conv_id, lower(digits) AS content FROM ({_SEGMENT_HEX})")
def rope_bytes(spark, sf_dir):
    return monoid.segment_bytes(segments(spark, sf_dir), ["conv_id"]).select("conv_id", F.lower(F.hex("content")).alias("content"))


@query(f"SELECT conv_id, {h_sql('substr(digits, 101, 600)')} AS h FROM ({_SEGMENT_HEX})")
def rope_substring_hash(spark, sf_dir):
    s = segments(spark, sf_dir)
    ranges = s.select("conv_id").distinct().select("conv_id", F.lit(50).alias("start"), F.lit(300).alias("length"))
    found = monoid.hash_segments(monoid.slice_segments(s, ranges, "conv_id"), ["conv_id"])
    return ranges.select("conv_id").join(found, "conv_id", "left").select("conv_id", F.coalesce("h", F.lit(0)).cast("long").alias("h"))


@query(f"SELECT conv_id, {h_sql('left(digits, 200)')} AS h_left, {h_sql('substr(digits, 201)')} AS h_right FROM ({_SEGMENT_HEX})")
def rope_split(spark, sf_dir):
    s = segments(spark, sf_dir)
    left, right = (monoid.hash_segments(x, ["conv_id"]).select("conv_id", F.col("h").alias(f"h_{side}")) for side, x in zip(("left", "right"), monoid.split_segments(s, "conv_id", 100)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return left.join(right, "conv_id", "full").select("conv_id", zero("h_left"), zero("h_right"))


_FAULTS = "SELECT conv_id, turn - CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END AS idx, coalesce(turn % 4 = 0 OR text = '' OR turn % 7 = 3, true) AS bad FROM conversations"


@query(f"SELECT conv_id, count(*) FILTER (bad) AS bad_segments, count(idx) - count(DISTINCT idx) AS repeated_idx FROM ({_FAULTS}) GROUP BY conv_id HAVING count(*) FILTER (bad) > 0 OR count(idx) > count(DISTINCT idx)")
def rope_validate(spark, sf_dir):
    """Planted faults: no repeats at every fourth turn, a wrong length at some, an idx given twice at every fifth."""
    s = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - (F.col("turn") % 5 == 4).cast("int")).alias("idx"), "turn", raw().alias("bytes"), (F.col("turn") % 4).alias("reps"))
    s = s.withColumn("length", F.octet_length("bytes") * F.col("reps") + (F.col("turn") % 7 == 3).cast("int")).drop("turn")
    return monoid.validate_segments(s, ["conv_id"])


# equality of content


@query(f"SELECT octet_length(encode(text))::BIGINT AS length, {h_sql(hex_of())} AS h, count(*) AS copies, min(doc_id::VARCHAR) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    found = verify.duplicate_groups(P.hash_raw(documents(spark, sf_dir), TWO).where("hash IS NOT NULL"))
    return found.select("length", F.col("hash")[0].alias("h"), "copies", "first")


@query("SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.text = b.text AS match FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1")
def verify_pairs(spark, sf_dir):
    d = documents(spark, sf_dir)
    pairs = d.select(F.col("object_id").alias("a_id"), (F.col("object_id").cast("long") + 1).cast("string").alias("b_id"))
    found = verify.verify_pairs(pairs, P.hash_raw(d, TWO))
    known = d.select(F.col("object_id").alias("b_id"), F.lit(True).alias("known"))
    return found.join(known, "b_id", "left").select(F.col("a_id").cast("long"), F.when(F.col("known"), F.col("b_id").cast("long")).alias("b_id"), "match")


def _two_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    of = lambda some: P.hash_raw(S.text_objects(d.where(some), "doc_id", "text"), TWO).where("hash IS NOT NULL")
    return of("lang = 'en'"), of("source = 'src0'")


@query("SELECT doc_id::VARCHAR AS object_id FROM documents WHERE lang = 'en' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0' AND text IS NOT NULL)")
def missing_copies_anti(spark, sf_dir):
    return verify.without_copies(*_two_sides(spark, sf_dir)).select("object_id")


@query("SELECT doc_id::VARCHAR AS object_id FROM documents WHERE lang = 'en' AND text IN (SELECT text FROM documents WHERE source = 'src0')")
def semi_copies(spark, sf_dir):
    return verify.with_copies(*_two_sides(spark, sf_dir)).select("object_id")


def in_formats(objects: DataFrame, formats: Iterable[str], run: Callable[[DataFrame], DataFrame] = lambda forms: forms) -> DataFrame:
    """The objects encoded in each format, or what run makes of each, with the format; run's first step shares the worker that encodes."""
    parts = [run(objects if fmt == "raw" else S.encode_objects(objects, fmt)).withColumn("format", F.lit(fmt)) for fmt in formats]
    return functools.reduce(DataFrame.unionByName, parts)


@query(
    "WITH f(fmt) AS (VALUES ('raw'), ('deflate'), ('gzip'), ('zip'), ('lz4_block'), ('lz4_frame'), ('zstd')) "
    "SELECT item_id::VARCHAR AS content_id, a.fmt AS fmt_a, b.fmt AS fmt_b, true AS match FROM benchmark, f a, f b WHERE a.fmt < b.fmt AND text IS NOT NULL"
)
def cross_format_matrix(spark, sf_dir):
    items = S.text_objects(table(spark, sf_dir, "benchmark"), "item_id", "text")
    h = in_formats(items, ("raw", *FORMATS), lambda forms: P.hash_objects(forms, TWO))
    return verify.cross_format_matrix(h.withColumnRenamed("object_id", "content_id"))


# compressed objects


def _cdh_query(fmt: str, method: str) -> Query:
    def run(spark, sf_dir):
        objects = turns(spark, sf_dir)
        if fmt != "raw":  # the turns stand in few row groups, and reading streams is the work of Python
            objects = S.encode_objects(objects.repartition(spark.sparkContext.defaultParallelism, "object_id"), fmt)
        return flat(P.hash_objects(objects, method=method))

    return run


for _fmt in ("raw", *FORMATS):
    for _method in METHODS:
        query(TURN_HASHES, f"cdh_{_fmt}_{_method}")(_cdh_query(_fmt, _method))


def _cdh_multi_query(fmt: str) -> Query:
    def run(spark, sf_dir):
        h = P.hash_objects(S.encode_objects(turns(spark, sf_dir), fmt), TWO)
        return h.select("object_id", "length", F.col("hash")[0].alias("h"), F.col("hash")[1].alias("h2"))

    return run


for _fmt in FORMATS:
    query(TURN_HASHES.replace(" FROM", f", {h_sql(hex_of(), 257)} AS h2 FROM"), f"cdh_multi_{_fmt}")(_cdh_multi_query(_fmt))


def _multi_sliding(fmt: str) -> Query:
    def run(spark, sf_dir):
        h = P.hash_objects(S.encode_objects(turns(spark, sf_dir), fmt), TWO, method="sliding")
        return h.select("object_id", "length", F.col("hash")[0].alias("h"), F.col("hash")[1].alias("h2"))

    return run


for _fmt in FORMATS:
    query(TURN_HASHES.replace(" FROM", f", {h_sql(hex_of(), 257)} AS h2 FROM"), f"cdh_multi_sliding_{_fmt}")(_multi_sliding(_fmt))


@query(DOCUMENT_HASHES)
def cdh_documents_stored(spark, sf_dir):
    """Stored blocks alone."""
    return flat(P.hash_objects(S.encode_objects(documents(spark, sf_dir), "deflate", 0)))


@query(DOCUMENT_HASHES.replace(" FROM", f", {h_sql(hex_of(), 257)} AS h2 FROM"))
def hash_by_chunks(spark, sf_dir):
    h = P.hash_chunked(documents(spark, sf_dir), TWO, CHUNKS)
    return h.select("object_id", "length", F.col("hash")[0].alias("h"), F.col("hash")[1].alias("h2"))


@query("SELECT conv_id || '-' || turn || '!content' AS object_id, octet_length(encode(text))::BIGINT AS length, " + h_sql(hex_of()) + " AS h FROM conversations")
def zip64_entry_hashes(spark, sf_dir):
    """Archives whose sizes and places stand in ZIP64 records."""
    return flat(P.hash_objects(S.entry_objects(S.zip64_archives(turns(spark, sf_dir)))))


@query("SELECT conv_id || '-' || turn AS object_id, a.fmt AS fmt_a, b.fmt AS fmt_b, NOT ((a.fmt = 'zstd' OR b.fmt = 'zstd') AND turn % 3 = 0) AS match FROM conversations, (VALUES ('raw'), ('gzip'), ('zstd')) a(fmt), (VALUES ('raw'), ('gzip'), ('zstd')) b(fmt) WHERE a.fmt < b.fmt")
def cross_format_mismatch(spark, sf_dir):
    """The Zstandard form of every third turn holds other content."""
    t = turns(spark, sf_dir)
    wrong = t.withColumn("content", F.when(F.split("object_id", "-")[1].cast("int") % 3 == 0, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")))
    hashes = lambda forms: P.hash_objects(forms, TWO)
    h = in_formats(t, ("raw", "gzip"), hashes).unionByName(in_formats(wrong, ("zstd",), hashes))
    found = verify.cross_format_matrix(h.withColumnRenamed("object_id", "content_id"))
    return found.withColumnRenamed("content_id", "object_id")


@query(DOCUMENT_HASHES)
def cdh_documents_zstd(spark, sf_dir):
    return flat(P.hash_objects(S.encode_objects(documents(spark, sf_dir), "zstd")))


@query(f"SELECT page_id::VARCHAR AS object_id, octet_length(encode(html))::BIGINT AS length, {h_sql(hex_of('html'))} AS h FROM pages")
def cdh_pages_gzip(spark, sf_dir):
    return flat(P.hash_objects(S.encode_objects(S.text_objects(table(spark, sf_dir, "pages"), "page_id", "html"), "gzip")))


@query(DOCUMENT_HASHES)
def decode_then_hash(spark, sf_dir):
    return flat(P.hash_decoded(S.encode_objects(documents(spark, sf_dir), "deflate")))


@query("SELECT conv_id || '-' || turn AS object_id, f.fmt AS format, text FROM conversations, (VALUES ('deflate'), ('gzip'), ('zip'), ('lz4_block'), ('lz4_frame'), ('zstd')) f(fmt)")
def decode_roundtrip(spark, sf_dir):
    return in_formats(turns(spark, sf_dir), FORMATS, P.decode_objects).select("object_id", "format", F.col("content").cast("string").alias("text"))


@query("SELECT doc_id::VARCHAR AS object_id, octet_length(encode(text))::BIGINT AS decoded_size FROM documents")
def decoded_size(spark, sf_dir):
    return P.token_stats(S.encode_objects(documents(spark, sf_dir), "lz4_frame")).select("object_id", "decoded_size")


@query("SELECT conv_id || '-' || turn AS object_id, f.fmt AS format, f.fmt AS found FROM conversations, (VALUES ('gzip'), ('lz4_frame'), ('zstd'), ('raw')) f(fmt)")
def detect_format(spark, sf_dir):
    objects = in_formats(turns(spark, sf_dir), ("raw", "gzip", "lz4_frame", "zstd"))
    return objects.select("object_id", "format", E.resolve_format(F.col("content"), F.lit("auto")).alias("found"))


@query("SELECT conv_id || '-' || turn AS object_id, 'content' AS filename, 8::INT AS compression_method, octet_length(encode(text))::BIGINT AS uncompressed_size, 0::BIGINT AS local_header_offset FROM conversations")
def zip_entries(spark, sf_dir):
    return S.list_entries(S.encode_objects(turns(spark, sf_dir), "zip")).select("object_id", "filename", "compression_method", "uncompressed_size", "local_header_offset")


@query(TURN_HASHES.replace("turn AS object_id", "turn || '!content' AS object_id"))
def zip_entry_hashes(spark, sf_dir):
    return flat(P.hash_objects(S.entry_objects(S.encode_objects(turns(spark, sf_dir), "zip"))))


# token tables


@query("SELECT item_id::VARCHAR AS object_id, octet_length(encode(text))::BIGINT AS total_tokens, octet_length(encode(text))::BIGINT AS literals, 0::BIGINT AS \"references\", 0::BIGINT AS overlapping_refs, octet_length(encode(text))::BIGINT AS decoded_size FROM benchmark WHERE text <> ''")
def token_stats_raw(spark, sf_dir):
    return tokens.stats(P.extract_tokens(S.text_objects(table(spark, sf_dir, "benchmark"), "item_id", "text")))


@query("SELECT item_id::VARCHAR AS object_id, i - 1 AS pos, ('0x' || d[i])::SMALLINT AS byte FROM (SELECT item_id, regexp_extract_all(hex(encode(text)), '..') AS d FROM benchmark), unnest(range(1, len(d) + 1)) t(i)")
def pointer_jump_decode(spark, sf_dir):
    parsed = P.encode_lz77(S.text_objects(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return tokens.decode_relational(parsed, lambda df: df.cache())


@query(f"SELECT item_id::VARCHAR AS object_id, octet_length(encode(text))::BIGINT AS length, {h_sql(hex_of())} AS h FROM benchmark WHERE text <> ''")
def lz77_encode_decode(spark, sf_dir):
    """Greedy parse, tokens, and the hash of what they decode to by pieces: bytes in the order of their place."""
    parsed = P.encode_lz77(S.text_objects(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    placed = tokens.decode_relational(parsed, lambda df: df.cache())
    one = placed.select("object_id", "pos", F.lit(1).cast("long").alias("length"), (F.col("byte") + 1).cast("long").alias("h"))
    return monoid.ordered_concat(one, ["object_id"], "pos")


def made_tokens(spark, sf_dir) -> DataFrame:
    """Four tokens for each document, good and bad ones: a literal, a reference, a reference back by one, a literal."""
    i = F.col("doc_id")
    token = lambda seq, kind, byte, distance, length: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), byte.cast("short").alias("byte"), distance.cast("long").alias("distance"), length.cast("long").alias("length"))
    none = F.lit(None)
    four = F.array(
        token(0, "L", i % 300, none, none),
        token(1, "R", none, i % 4, i % 3),
        token(2, "R", none, F.lit(1), i % 5 + 1),
        token(3, "L", F.when(i % 7 > 0, i % 256), none, none),
    )
    return table(spark, sf_dir, "documents").select(i.cast("string").alias("object_id"), F.explode(four).alias("t")).select("object_id", "t.*")


@query(
    "SELECT doc_id::VARCHAR AS object_id, s.seq::BIGINT AS seq FROM documents, (VALUES (0), (1), (2), (3)) s(seq) "
    "WHERE CASE s.seq WHEN 0 THEN doc_id % 300 > 255 WHEN 1 THEN doc_id % 4 <> 1 OR doc_id % 3 = 0 WHEN 3 THEN doc_id % 7 = 0 ELSE false END"
)
def invalid_tokens(spark, sf_dir):
    return tokens.invalid(made_tokens(spark, sf_dir)).select("object_id", "seq")


@query(
    'SELECT doc_id::VARCHAR AS object_id, 4::BIGINT AS total_tokens, 2::BIGINT AS literals, 2::BIGINT AS "references", '
    "((doc_id % 4 < doc_id % 3)::BIGINT + (1 < doc_id % 5 + 1)::BIGINT) AS overlapping_refs, (2 + doc_id % 3 + doc_id % 5 + 1)::BIGINT AS decoded_size FROM documents"
)
def token_stats_relational(spark, sf_dir):
    return tokens.stats(made_tokens(spark, sf_dir))


@query(
    'SELECT doc_id::VARCHAR AS object_id, n AS total_tokens, n AS literals, CASE WHEN n IS NOT NULL THEN 0::BIGINT END AS "references", '
    "CASE WHEN n IS NOT NULL THEN 0::BIGINT END AS overlapping_refs, n AS decoded_size FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents)"
)
def token_stats_stored(spark, sf_dir):
    """Stored blocks have a literal for each byte."""
    return P.token_stats(S.encode_objects(documents(spark, sf_dir), "deflate", 0))


def runs(spark, sf_dir) -> DataFrame:
    """A letter and 1 + 258 * k times another, for each document: two literals and k references back by one of the longest length."""
    k = (F.col("doc_id") % 40 + 1).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("object_id"), F.concat(F.lit("b"), F.repeat(F.lit("a"), 258 * k + 1)).cast("binary").alias("content"), F.lit("raw").alias("format"))


@query('SELECT doc_id::VARCHAR AS object_id, 2 + k AS total_tokens, 2::BIGINT AS literals, k AS "references", k AS overlapping_refs, 2 + 258 * k AS decoded_size FROM (SELECT doc_id, (doc_id % 40 + 1)::BIGINT AS k FROM documents)')
def token_stats_runs(spark, sf_dir):
    return P.token_stats(S.encode_objects(runs(spark, sf_dir), "deflate"))


@query(
    "SELECT doc_id::VARCHAR AS object_id, seq, CASE WHEN seq < 2 THEN 'L' ELSE 'R' END AS kind, CASE WHEN seq < 2 THEN (98 - seq)::SMALLINT END AS byte, CASE WHEN seq > 1 THEN 1::BIGINT END AS distance, "
    "CASE WHEN seq > 1 THEN 258::BIGINT END AS length, CASE WHEN seq < 2 THEN chr((98 - seq)::INT) END AS char FROM documents, range(4) t(seq) WHERE seq <= doc_id % 40 + 2"
)
def inspect_runs(spark, sf_dir):
    return P.inspect(S.encode_objects(runs(spark, sf_dir), "gzip"), 4)


@query(
    "SELECT conv_id || '-' || turn AS object_id, i - 1 AS seq, 'L' AS kind, b::SMALLINT AS byte, NULL::BIGINT AS distance, NULL::BIGINT AS length, CASE WHEN b BETWEEN 32 AND 126 THEN chr(b) END AS char "
    "FROM (SELECT conv_id, turn, i, ('0x' || d[i])::INT AS b FROM (SELECT conv_id, turn, regexp_extract_all(hex(encode(text)), '..') AS d FROM conversations), range(1, 6) t(i) WHERE i <= len(d))"
)
def inspect_stored(spark, sf_dir):
    return P.inspect(S.encode_objects(turns(spark, sf_dir), "deflate", 0), 5)


@query("SELECT conv_id || '-' || turn AS object_id, n + 23 AS file_size, 'gzip' AS format, n AS decoded_size, round_even(n::DOUBLE / (n + 23), 2) AS compression_ratio FROM (SELECT conv_id, turn, octet_length(encode(text))::BIGINT AS n FROM conversations)")
def info_stored(spark, sf_dir):
    """A stored gzip file has 23 bytes more than its content: header, one block's head, checksum and size."""
    return P.info(S.encode_objects(turns(spark, sf_dir), "gzip", 0)).select("object_id", "file_size", "format", "decoded_size", "compression_ratio")


@query()
def token_stats(spark, sf_dir):
    return P.token_stats(S.encode_objects(documents(spark, sf_dir), "deflate"))


@query()
def inspect_limit(spark, sf_dir):
    return P.inspect(S.encode_objects(turns(spark, sf_dir), "zstd"), 5)


@query()
def compression_ratio(spark, sf_dir):
    return in_formats(turns(spark, sf_dir), ("raw", *FORMATS), P.info)


# chunks

_HARD, _EASY = CHUNKS.bits + 1, CHUNKS.bits - 1
_GEAR = [int(g) & ((1 << _HARD) - 1) for g in GEAR.tolist()]
_CUTS = f"""
WITH RECURSIVE hexed AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text))::BIGINT AS n FROM documents WHERE text IS NOT NULL),
gear AS (SELECT doc_id, list_transform(regexp_extract_all(x, '..'), lambda b: {_GEAR}[('0x' || b)::INT + 1]) AS g FROM hexed),
places AS (SELECT doc_id, unnest(g)::BIGINT AS g, generate_subscripts(g, 1)::BIGINT AS pos FROM gear),
prints AS (SELECT doc_id, pos, ({" + ".join(f"coalesce(lag(g, {j}) OVER w, 0) * {1 << j}" for j in range(_HARD))}) AS f FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
lists AS (SELECT doc_id, coalesce(list(pos ORDER BY pos) FILTER (f % {1 << _HARD} = 0), []) AS hard, list(pos ORDER BY pos) AS easy FROM prints WHERE f % {1 << _EASY} = 0 GROUP BY doc_id),
docs AS (SELECT doc_id, n, coalesce(hard, []) AS hard, coalesce(easy, []) AS easy FROM hexed LEFT JOIN lists USING (doc_id)),
cuts(doc_id, idx, st, en) AS (
  SELECT doc_id, -1, 0::BIGINT, 0::BIGINT FROM docs
  UNION ALL
  SELECT c.doc_id, c.idx + 1, c.en, CASE WHEN least(c.en + {CHUNKS.max_size}, n) - c.en <= {CHUNKS.min_size} THEN least(c.en + {CHUNKS.max_size}, n) ELSE coalesce(
    list_filter(hard, lambda p: p >= c.en + {CHUNKS.min_size} AND p < c.en + {CHUNKS.avg_size} AND p <= n)[1],
    list_filter(easy, lambda p: p >= c.en + {CHUNKS.avg_size} AND p <= least(c.en + {CHUNKS.max_size}, n))[1],
    least(c.en + {CHUNKS.max_size}, n)) END
  FROM cuts c JOIN docs USING (doc_id) WHERE c.en < n),
chunks AS (SELECT doc_id, idx, st, en - st AS size, substr(x, 2 * st + 1, 2 * (en - st)) AS digits FROM cuts JOIN hexed USING (doc_id) WHERE idx >= 0)
"""


def chunk_table(spark, sf_dir) -> DataFrame:
    return P.chunk_objects(documents(spark, sf_dir), CHUNKS)


@query(_CUTS + 'SELECT doc_id::VARCHAR AS object_id, idx::INT AS idx, st AS "offset", size FROM chunks')
def cdc_chunks(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("object_id", "idx", "offset", "size")


@query(_CUTS + f"SELECT doc_id::VARCHAR AS object_id, idx::INT AS idx, {h_sql('digits')} AS h FROM chunks")
def cdc_chunk_hashes(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("object_id", "idx", F.col("hash")[0].alias("h"))


@query(DOCUMENT_HASHES + " WHERE text <> ''")
def cdc_compose(spark, sf_dir):
    pieces = chunk_table(spark, sf_dir).select("object_id", "idx", F.col("size").alias("length"), F.col("hash")[0].alias("h"))
    return monoid.ordered_concat(pieces, ["object_id"], "idx")


@query(_CUTS + "SELECT count(*) AS chunks, count(DISTINCT digits) AS distinct_chunks, sum(size)::BIGINT AS bytes, (SELECT sum(size)::BIGINT FROM (SELECT DISTINCT digits, size FROM chunks)) AS distinct_bytes FROM chunks")
def cdc_dedup_ratio(spark, sf_dir):
    return verify.dedup_ratio(chunk_table(spark, sf_dir)).select("chunks", "distinct_chunks", F.col("bytes").cast("long"), F.col("distinct_bytes").cast("long"))


@query(_CUTS + f", shared AS (SELECT digits, size FROM chunks JOIN documents USING (doc_id) WHERE source = 'src0' INTERSECT SELECT digits, size FROM chunks JOIN documents USING (doc_id) WHERE source <> 'src0') SELECT size, {h_sql('digits')} AS h FROM shared")
def cdc_shared_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = (P.chunk_objects(S.text_objects(d.where(some), "doc_id", "text"), CHUNKS) for some in ("source = 'src0'", "source <> 'src0'"))
    return verify.shared_chunks(a, b).select("size", F.col("hash")[0].alias("h"))


@query(_CUTS + "SELECT doc_id::VARCHAR AS object_id, count(*) AS num_chunks, sum(size)::BIGINT AS total_bytes, round(sum(size)::DOUBLE / count(*), 1) AS avg_size FROM chunks GROUP BY doc_id")
def cdc_chunk_stats(spark, sf_dir):
    return P.chunk_stats(chunk_table(spark, sf_dir))


# integrity and incremental archives


def turn_log(spark, sf_dir) -> DataFrame:
    """An archive for each conversation: turns are added in order, and every third is removed at once."""
    t = table(spark, sf_dir, "conversations")
    adds = t.select(F.col("conv_id").alias("archive_id"), (F.col("turn") * 2).alias("seq"), F.lit("add").alias("op"), raw().alias("chunk"))
    removes = t.where("turn % 3 = 2").select(F.col("conv_id").alias("archive_id"), (F.col("turn") * 2 + 1).alias("seq"), F.lit("remove").alias("op"), F.lit(None).cast("binary").alias("chunk"))
    return adds.unionByName(removes)


_LEFT = "SELECT conv_id, count(*) FILTER (turn % 3 <> 2) AS chunks, coalesce(string_agg(hex(encode(text)), '' ORDER BY turn) FILTER (turn % 3 <> 2), '') AS digits FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id AS archive_id, chunks, (length(digits) // 2)::BIGINT AS length, {h_sql('digits')} AS h FROM ({_LEFT})")
def incremental_log(spark, sf_dir):
    return archive_log.archive_hashes(turn_log(spark, sf_dir))


@query(f"SELECT conv_id AS archive_id, sha256(unhex(digits)) AS digest FROM ({_LEFT}) WHERE chunks > 0")
def incremental_digest(spark, sf_dir):
    return archive_log.archive_digests(turn_log(spark, sf_dir))


_INTEGRITY = f"SELECT conv_id || '-' || turn AS object_id, {h_sql(hex_of())} AS h, {h_sql(hex_of(), 257)} AS h2, 'MODE' AS mode, DIGEST AS digest FROM conversations"


def _integrity(spark, sf_dir, **how) -> DataFrame:
    out = P.integrity(S.encode_objects(turns(spark, sf_dir), "gzip"), TWO, **how)
    return out.select("object_id", F.col("cdh")[0].alias("h"), F.col("cdh")[1].alias("h2"), "mode", F.lower(F.hex("digest")).alias("digest"))


@query(_INTEGRITY.replace("MODE", "fast").replace("DIGEST", "NULL::VARCHAR"))
def integrity_fast(spark, sf_dir):
    return _integrity(spark, sf_dir)


@query(_INTEGRITY.replace("MODE", "full").replace("DIGEST", "sha256(text)"))
def integrity_sha256(spark, sf_dir):
    return _integrity(spark, sf_dir, full=True)


@query()
def integrity_blake3(spark, sf_dir):
    return _integrity(spark, sf_dir, full=True, digest="blake3")
