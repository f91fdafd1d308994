"""Whole queries over tables of objects (object_id, content, format): hashes, tokens, statistics, chunks.

Per-object work is one Arrow function over rows, without a shuffle; the token table is only made where it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.batches import SLICE_BYTES, map_objects, slices
from ..functions.blake3 import blake3
from ..functions.exprs import compression_ratio, printable
from ..operators.cdc import ChunkSpec, cut_points
from ..operators.cdh import METHODS, WINDOWS, cdh
from ..operators.lz77 import decode, encode
from ..operators.monoid import ordered_concat
from ..sources.formats import extract
from ..spec import HashSpec


SLICE = 8192  # rows that an object's tokens or chunks are sent in, so that they are never all held at once


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class _Rows:
    """An Arrow function that turns each (object_id, content, format) into rows; null contents give none, or a row of nulls.

    Rows are sent SLICE at a time, and after each SLICE_BYTES read or made.  With ``formats`` an object's format is the second column.
    """

    def __init__(self, f: Callable, schema: pa.Schema, nulls: bool = True, formats: bool = False):
        self.f, self.schema, self.nulls, self.formats = f, schema, nulls, formats
        self.heavy = [k for k, field in enumerate(schema) if pa.types.is_binary(field.type)]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows, size = [], 0
            for o, c, fmt in zip(*(batch[k].to_pylist() for k in ("object_id", "content", "format"))):
                head = (o, fmt) if self.formats else (o,)
                made = self.f(c, fmt) if c is not None else [[None] * (len(self.schema) - len(head))] if self.nulls else ()
                for r in made:
                    rows.append((*head, *r))
                    for k in self.heavy:
                        size += len(rows[-1][k] or b"")
                    if len(rows) == SLICE or size >= SLICE_BYTES:
                        yield _columns(rows, self.schema)
                        rows, size = [], 0
            yield _columns(rows, self.schema)


def _apply(objects: DataFrame, f: Callable, fields: list[tuple[str, pa.DataType]], ddl: str, nulls: bool = True) -> DataFrame:
    return map_objects(objects, ("content", "format"), _Rows(f, pa.schema([("object_id", pa.string()), *fields]), nulls), "object_id string, " + ddl)


def _hash_type(spec: HashSpec) -> tuple[pa.DataType, str]:
    return (pa.list_(pa.int64()), "array<bigint>") if spec.is_long else (pa.list_(pa.binary()), "array<binary>")


def hash_objects(objects: DataFrame, spec: HashSpec = HashSpec(), method: str = "rope") -> DataFrame:
    """object_id, length (decoded) and hash (one for each base) of each object; equal for equal content in any format."""
    if method not in METHODS:
        raise ValueError(f"{method} is none of {', '.join(METHODS)}")

    def one(content: bytes, fmt: str):
        if fmt == "raw":  # nothing to read: the bytes are hashed as they are
            h, n = [K.hash_bytes(content, b, spec.prime) for b in spec.bases], len(content)
        else:
            ops = extract(content, fmt)
            h = cdh(ops, spec, method, *WINDOWS[fmt])
            n = sum(len(op) if isinstance(op, bytes) else op[1] for op in ops)
        yield n, [K.column_value(x, spec) for x in h]

    kind, ddl = _hash_type(spec)
    return _apply(objects, one, [("length", pa.int64()), ("hash", kind)], f"length long, hash {ddl}")


def hash_decoded(objects: DataFrame, spec: HashSpec = HashSpec()) -> DataFrame:
    """The same by decoding first: what compressed-domain hashes are measured and checked against."""

    def one(content: bytes, fmt: str):
        data = decode(extract(content, fmt))
        yield len(data), [K.column_value(K.hash_bytes(data, b, spec.prime), spec) for b in spec.bases]

    kind, ddl = _hash_type(spec)
    return _apply(objects, one, [("length", pa.int64()), ("hash", kind)], f"length long, hash {ddl}")


class _HashBatch:
    def __init__(self, spec: HashSpec):
        self.spec = spec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            data = batch["content"].to_pylist()
            per_base = [K.hash_many([c or b"" for c in data], b, self.spec.prime) for b in self.spec.bases]
            hashes = [None if c is None else [K.column_value(h, self.spec) for h in hs] for c, hs in zip(data, zip(*per_base))]
            lengths = [None if c is None else len(c) for c in data]
            yield pa.RecordBatch.from_arrays([batch["object_id"], pa.array(lengths, pa.int64()), pa.array(hashes, _hash_type(self.spec)[0])], ["object_id", "length", "hash"])


def hash_raw(objects: DataFrame, spec: HashSpec = HashSpec()) -> DataFrame:
    """object_id, length and hash of raw contents, a batch of rows at a time."""
    return map_objects(objects, ("content",), _HashBatch(spec), f"object_id string, length long, hash {_hash_type(spec)[1]}")


def decode_objects(objects: DataFrame) -> DataFrame:
    """object_id and decoded content."""
    return _apply(objects, lambda c, fmt: [(decode(extract(c, fmt)),)], [("content", pa.binary())], "content binary")


def extract_tokens(objects: DataFrame) -> DataFrame:
    """object_id, seq, kind ('L' or 'R'), byte, distance, length: a row for each literal byte and reference."""

    def one(content: bytes, fmt: str):
        seq = 0
        for op in extract(content, fmt):
            for c in op if isinstance(op, bytes) else (None,):
                yield (seq, "R", None, *op) if c is None else (seq, "L", c, None, None)
                seq += 1

    fields = [("seq", pa.int64()), ("kind", pa.string()), ("byte", pa.int16()), ("distance", pa.int64()), ("length", pa.int64())]
    return _apply(objects, one, fields, "seq long, kind string, byte short, distance long, length long", nulls=False)


def encode_lz77(objects: DataFrame, min_match: int = 3, max_match: int = 258, window: int = 32768) -> DataFrame:
    """The token table of a greedy LZ77 parse of raw contents."""

    def one(content: bytes, _: str):
        seq = 0
        for op in encode(content, min_match, max_match, window):
            for c in op if isinstance(op, bytes) else (None,):
                yield (seq, "R", None, *op) if c is None else (seq, "L", c, None, None)
                seq += 1

    fields = [("seq", pa.int64()), ("kind", pa.string()), ("byte", pa.int16()), ("distance", pa.int64()), ("length", pa.int64())]
    return _apply(objects, one, fields, "seq long, kind string, byte short, distance long, length long", nulls=False)


def inspect(objects: DataFrame, limit: int = 0) -> DataFrame:
    """The first ``limit`` tokens of each object (0: all), with printable characters; raw objects have none to show."""
    tokens = extract_tokens(objects.where(F.col("format") != "raw"))
    shown = tokens.withColumn("char", printable(F.col("byte").cast("int")))
    return shown.where(F.col("seq") < limit) if limit else shown


STATS = ("total_tokens", "literals", "references", "overlapping_refs", "decoded_size")


def _stats(content: bytes, fmt: str) -> tuple[int, ...]:
    ops = extract(content, fmt)
    refs = [op for op in ops if not isinstance(op, bytes)]
    literals = sum(len(op) for op in ops if isinstance(op, bytes))
    return literals + len(refs), literals, len(refs), sum(d < n for d, n in refs), literals + sum(n for _, n in refs)


def token_stats(objects: DataFrame) -> DataFrame:
    """object_id, total_tokens, literals, references, overlapping_refs and decoded_size, without a token table."""
    return _apply(objects, lambda c, fmt: [_stats(c, fmt)], [(n, pa.int64()) for n in STATS], ", ".join(f"{n} long" for n in STATS))


def info(objects: DataFrame) -> DataFrame:
    """Sizes, ratio and token counts of each object, a row for each row; raw objects have a size only.

    Contents are read once, and rows are not told apart by object_id, which forms of one content may share.
    """

    def one(content: bytes, fmt: str):
        yield len(content), *(_stats(content, fmt) if fmt != "raw" else [None] * len(STATS))

    names = ("file_size", *STATS)
    schema = pa.schema([("object_id", pa.string()), ("format", pa.string()), *[(n, pa.int64()) for n in names]])
    found = map_objects(objects, ("content", "format"), _Rows(one, schema, formats=True), "object_id string, format string, " + ", ".join(f"{n} long" for n in names))
    ratio = F.when(F.col("format") != "raw", compression_ratio(F.col("decoded_size"), F.col("file_size"))).alias("compression_ratio")
    return found.select("object_id", "file_size", "format", "decoded_size", ratio, "total_tokens", "literals", "references", "overlapping_refs")


def chunk_objects(objects: DataFrame, sizes: ChunkSpec = ChunkSpec(), spec: HashSpec = HashSpec(), content: bool = False) -> DataFrame:
    """object_id, idx, offset, size and hash of the chunks of raw contents (and their content)."""

    def one(data: bytes, _: str):
        cuts = cut_points(data, sizes)
        parts = [data[a:b] for a, b in zip([0, *cuts], cuts)]
        hashes = zip(*[K.hash_many(parts, b, spec.prime) for b in spec.bases])
        for i, (p, h, end) in enumerate(zip(parts, hashes, cuts)):
            yield (i, end - len(p), len(p), [K.column_value(x, spec) for x in h], *((p,) if content else ()))

    kind, ddl = _hash_type(spec)
    fields = [("idx", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("hash", kind), *([("content", pa.binary())] if content else [])]
    return _apply(objects, one, fields, f"idx int, offset long, size long, hash {ddl}" + (", content binary" if content else ""), nulls=False)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """object_id, num_chunks, total_bytes and avg_size (to one place) of chunk rows."""
    sums = chunks.groupBy("object_id").agg(F.count(F.lit(1)).alias("num_chunks"), F.sum("size").alias("total_bytes"))
    return sums.withColumn("avg_size", F.round(F.col("total_bytes") / F.col("num_chunks"), 1))


def hash_chunked(objects: DataFrame, spec: HashSpec = HashSpec(), sizes: ChunkSpec = ChunkSpec()) -> DataFrame:
    """object_id, length and hash of objects by way of the chunks of their content: a sum over the chunks' hashes for each base.

    Compressed objects are decoded first.  Empty contents have the hash 0, null ones none.
    """
    if not spec.is_long:
        raise ValueError("chunks are joined under primes up to 2**61 - 1")
    packed = objects.where(F.col("format") != "raw")
    plain = objects.where(F.col("format") == "raw").select(F.col("object_id").cast("string"), "content", "format")
    contents = plain.unionByName(decode_objects(packed).withColumn("format", F.lit("raw")))
    chunks = chunk_objects(contents, sizes, spec)
    out = contents.select("object_id", F.octet_length("content").cast("long").alias("length"))
    for i, base in enumerate(spec.bases):
        own = chunks.select("object_id", "idx", F.col("size").alias("length"), F.col("hash")[i].alias("h"))
        joined = ordered_concat(own, ["object_id"], "idx", base=base, prime=spec.prime)
        out = out.join(joined.select("object_id", F.col("h").alias(f"h{i}")), "object_id", "left")
    hashes = F.array(*[F.coalesce(f"h{i}", F.lit(0).cast("long")) for i in range(spec.k)])
    return out.select("object_id", "length", F.when(F.col("length").isNotNull(), hashes).alias("hash"))


def integrity(objects: DataFrame, spec: HashSpec = HashSpec((131, 257)), full: bool = False, digest: str = "sha256") -> DataFrame:
    """object_id, cdh (hashes), digest and mode: fast is the hashes alone, full has a digest (sha256 or blake3) of the decoded bytes too."""
    if digest not in ("sha256", "blake3"):
        raise ValueError(f"{digest} is not a digest")

    def one(content: bytes, fmt: str):
        import hashlib

        ops = extract(content, fmt)
        h = [K.column_value(x, spec) for x in cdh(ops, spec)]
        data = decode(ops) if full else None
        yield h, None if data is None else hashlib.sha256(data).digest() if digest == "sha256" else blake3(data), "full" if full else "fast"

    kind, ddl = _hash_type(spec)
    return _apply(objects, one, [("cdh", kind), ("digest", pa.binary()), ("mode", pa.string())], f"cdh {ddl}, digest binary, mode string")


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: extract_tokens(content, format), zip_entries(content), cdc_chunks(content, min, avg, max)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="seq bigint, kind string, byte smallint, distance bigint, length bigint")
    class ExtractTokens:
        def eval(self, content, fmt):
            seq = 0
            for op in extract(bytes(content), fmt) if content is not None else ():
                for c in op if isinstance(op, bytes) else (None,):
                    yield (seq, "R", None, *op) if c is None else (seq, "L", c, None, None)
                    seq += 1

    @udtf(returnType="filename string, compression_method int, compressed_size bigint, uncompressed_size bigint, crc32 bigint, local_header_offset bigint, data_offset bigint")
    class ZipEntries:
        def eval(self, content):
            from ..sources.archives import zip_entries

            for e in zip_entries(bytes(content)) if content is not None else ():
                yield e.filename, e.compression_method, e.compressed_size, e.uncompressed_size, e.crc32, e.local_header_offset, e.data_offset

    @udtf(returnType="idx int, offset bigint, size bigint")
    class CdcChunks:
        def eval(self, content, least, average, most):
            start = 0
            for i, end in enumerate(cut_points(bytes(content), ChunkSpec(least, average, most)) if content is not None else ()):
                yield i, start, end - start
                start = end

    spark.udtf.register("extract_tokens", ExtractTokens)
    spark.udtf.register("zip_entries", ZipEntries)
    spark.udtf.register("cdc_chunks", CdcChunks)
