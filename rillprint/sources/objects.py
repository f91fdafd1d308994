"""Tables of objects: files, archives, text columns, and their encoded forms."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import map_objects, slices
from ..functions.exprs import resolve_format
from .archives import zip_entries, zip_entry_ops

OBJECTS = "object_id string, content binary, format string"
ENTRIES = "object_id string, filename string, compression_method int, compressed_size long, uncompressed_size long, crc32 long, local_header_offset long, data_offset long"


def read_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """object_id (the path), content and length of all files under a path; a missing path is an error, and Spark leaves out files without bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.col("path").alias("object_id"), "content", "length")


def text_objects(df: DataFrame, object_id: str, text: str) -> DataFrame:
    """object_id, content (UTF-8) and format of a text column."""
    return df.select(F.col(object_id).cast("string").alias("object_id"), F.col(text).cast("binary").alias("content"), F.lit("raw").alias("format"))


def with_format(objects: DataFrame, asked: Column | None = None) -> DataFrame:
    """Objects with the format asked for, or that of their magic bytes, or raw."""
    return objects.withColumn("format", resolve_format(F.col("content"), F.lit(None).cast("string") if asked is None else asked))


def _zip(data: bytes, stored: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("content"), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def encode(data: bytes, fmt: str, level: int | None = None) -> bytes:
    """An object's content in a format."""
    if fmt == "raw":
        return data
    if fmt == "deflate":
        packer = zlib.compressobj(6 if level is None else level, wbits=-15)
        return packer.compress(data) + packer.flush()
    if fmt == "gzip":
        return gzip.compress(data, 6 if level is None else level, mtime=0)
    if fmt == "zip":
        return _zip(data, stored=level == 0)
    if fmt == "lz4_block":
        return pa.compress(data, codec="lz4_raw", asbytes=True) if data else b""
    if fmt == "lz4_frame":
        return pa.compress(data, codec="lz4", asbytes=True)
    if fmt == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3 if level is None else level).compress(data)
    raise ValueError(f"{fmt} is not a format")


def _zip64_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    full, limit = 0xFFFFFFFF, zipfile.ZIP64_LIMIT
    for batch in (part for whole in batches for part in slices(whole)):
        zipfile.ZIP64_LIMIT = -1
        try:  # not across the yield: other steps run in the same worker
            content = [None if c is None else _zip(c) for c in batch["content"].to_pylist()]
        finally:
            zipfile.ZIP64_LIMIT = limit
        assert all(c is None or full.to_bytes(4, "little") in c for c in content)
        yield pa.RecordBatch.from_arrays([batch["object_id"], pa.array(content, pa.binary()), pa.array(["zip"] * len(content))], ["object_id", "content", "format"])


def zip64_archives(objects: DataFrame) -> DataFrame:
    """ZIP archives of the objects' content whose directories have ZIP64 fields and ends, as archives beyond 4 GB do; for checks."""
    return map_objects(objects, ("content",), _zip64_archives, OBJECTS)


class _Encode:
    def __init__(self, fmt: str, level: int | None):
        self.fmt, self.level = fmt, level

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            content = [None if c is None else encode(c, self.fmt, self.level) for c in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["object_id"], pa.array(content, pa.binary()), pa.array([self.fmt] * len(content))], ["object_id", "content", "format"])


def encode_objects(objects: DataFrame, fmt: str, level: int | None = None) -> DataFrame:
    """object_id, content and format of the objects' content in a format; null stays null."""
    return map_objects(objects, ("content",), _Encode(fmt, level), OBJECTS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        rows = [(o, e.filename, e.compression_method, e.compressed_size, e.uncompressed_size, e.crc32, e.local_header_offset, e.data_offset) for o, c in zip(batch["object_id"].to_pylist(), batch["content"].to_pylist()) if c is not None for e in zip_entries(c)]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        names = ["object_id", "filename", "compression_method", "compressed_size", "uncompressed_size", "crc32", "local_header_offset", "data_offset"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def list_entries(archives: DataFrame) -> DataFrame:
    """ENTRIES of each ZIP archive."""
    return map_objects(archives, ("content",), _entries, ENTRIES)


def _entry_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        rows = []
        for o, c in zip(batch["object_id"].to_pylist(), batch["content"].to_pylist()):
            for e in zip_entries(c) if c is not None else ():
                zip_entry_ops(c, e)  # refuses what cannot be read
                rows.append((f"{o}!{e.filename}", c[e.data_offset : e.data_offset + e.compressed_size] if e.uncompressed_size else b"", "deflate" if e.compression_method == 8 and e.uncompressed_size else "raw"))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["object_id", "content", "format"])


def entry_objects(archives: DataFrame) -> DataFrame:
    """Every entry of the archives as an object of its own (archive!name), still compressed."""
    return map_objects(archives, ("content",), _entry_objects, OBJECTS)
