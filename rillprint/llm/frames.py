"""Token files: independent zstandard frames, a document directory and a trailing seek table.

A file is a run of zstandard frames, each holding the ids of whole documents (a document larger than
a frame has frames of its own), then the directory (document ids and id counts) in a skippable
frame, then the seek table of the public zstandard seekable format: for each frame its compressed
size, its decompressed size and the low 32 bits of the XXH64 of its content.  Any zstandard tool can
decompress a file; a reader here fetches the tail, then only the frames of the documents it is asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, vocabulary, written
from .tokens import encoder

# Fixed values of the public zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

DIRECTORY_MAGIC = 0x184D2A50  # the first of the magic numbers of skippable frames
FRAME_BYTES = 256 << 10
FILE_BYTES = 64 << 20  # of ids before compression; a file ends after the document that reaches it
END_ID = 0


class FrameWriter:
    """Writes documents to an open binary file; finish() writes directory and seek table."""

    def __init__(self, file, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.file, self.width, self.frame_bytes = file, width, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries, self.ids, self.counts, self.waiting, self.size, self.total = [], [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, f"<u{self.width}").tobytes()
        if self.size and self.size + len(raw) > self.frame_bytes:
            self.flush()
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(raw)
        self.size += len(raw)
        self.total += len(raw)

    def flush(self) -> None:
        data = b"".join(self.waiting)
        self.waiting, self.size = [], 0
        for at in range(0, len(data), max(self.frame_bytes, 1)) if data else ():
            part = data[at : at + self.frame_bytes]
            packed = self.zip.compress(part)
            self.file.write(packed)
            self.entries.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))

    def finish(self) -> None:
        self.flush()
        nulls = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        body = struct.pack("<BQ", self.width, len(ids)) + zlib.compress(ids.tobytes() + np.array(self.counts, "<u8").tobytes() + nulls.tobytes())
        head = struct.pack("<II", DIRECTORY_MAGIC, len(body))
        self.file.write(head + body)
        self.entries.append((len(head) + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Random access by document over an open file (seek, read); a damaged frame raises ValueError."""

    def __init__(self, file):
        self.file, self.opened = file, 0
        end = file.seek(0, 2) if not hasattr(file, "size") else file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        table = self._at(end - 9 - 12 * n, 12 * n)
        self.entries = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        self.frames = np.concatenate([[0], np.cumsum([e[1] for e in self.entries], dtype=np.int64)])
        body = self._at(int(self.starts[-2]) + 8, self.entries[-1][0] - 8)
        self.width, docs = struct.unpack_from("<BQ", body)
        raw = zlib.decompress(body[9:])
        ids, self.counts = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        nulls = np.frombuffer(raw, np.uint8, docs, 16 * docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls)]
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)]) * self.width
        self.unzip = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        packed, size, check = self.entries[i]
        self.opened += 1
        try:
            data = self.unzip.decompress(self._at(int(self.starts[i]), packed), max_output_size=size)
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {i} is damaged") from e
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def read(self, positions: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the documents at these places in the file, all by default; each frame they need is opened once in a row."""
        last, data = -1, b""
        for k in range(len(self.doc_ids)) if positions is None else positions:
            start, stop = int(self.offsets[k]), int(self.offsets[k + 1])
            parts, i = [], int(np.searchsorted(self.frames, start, "right")) - 1
            while start < stop:
                if i != last:
                    last, data = i, self.frame(i)
                base = int(self.frames[i])
                take = data[start - base : stop - base]
                parts.append(take)
                start += len(take)
                i += 1
            yield self.doc_ids[k], np.frombuffer(b"".join(parts), f"<u{self.width}")


FILES = "path string, task int, file int, docs long, ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WriteFiles:
    """Sorted (doc_id, text) batches of a task to token files; a row for each file."""

    def __init__(self, path: str, folder: str, file_bytes: int):
        self.path, self.folder, self.file_bytes = path, folder, file_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, names = TaskContext.get(), ["path", "task", "file", "docs", "ids"]
        coder, end, n, out, writer = encoder(self.path), None, 0, None, None
        fs, folder = pa.fs.FileSystem.from_uri(self.folder)
        end = np.array([END_ID], coder.type)

        def done() -> pa.RecordBatch:
            writer.finish()
            out.close()
            row = [self.folder + "/" + name, task.partitionId(), n, len(writer.ids), writer.total // writer.width]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(part["doc_id"].to_pylist(), coder.encode(part["text"].to_pylist())):
                    if writer is None:
                        # an attempt writes files of its own, so a second copy of a task harms nothing
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:05d}.zst"
                        fs.create_dir(folder, recursive=True)
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        writer = FrameWriter(out, coder.type.itemsize)
                    writer.add(doc, np.concatenate([ids, end]))
                    if writer.total >= self.file_bytes:
                        yield done()
                        writer, n = None, n + 1
        if writer is not None:
            yield done()


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Token files of all (doc_id, text) in ascending doc_id order, nulls first, a null text as empty.

    Returns FILES, ordered by (task, file).  Equal ids are ordered by their text's hash.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(dealt.mapInArrow(WriteFiles(tokenizer or vocabulary(), folder, file_bytes), FILES), "token-files")


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
            fs, name = pa.fs.FileSystem.from_uri(path)
            rows = []
            with fs.open_input_file(name) as f:
                for doc, ids in FrameReader(f).read():
                    rows.append((doc, base, len(ids), zlib.crc32(ids.astype("<u4"))))
                    base += len(ids)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(files: DataFrame) -> DataFrame:
    """DOCS of every document in the files; start counts the ids of all documents before it."""
    order = Window.orderBy("task", "file")  # a row for each file of up to FILE_BYTES
    begin = files.select("path", (F.sum("ids").over(order) - F.col("ids")).alias("start"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright, else so few bytes of paths go to one task
    return begin.repartition(n, "path").mapInArrow(read_rows, DOCS)


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token files of (doc_id, text) in the shared folder, and DOCS as read back from them."""
    return read_files(write_files(docs, new_path(docs.sparkSession, "tokens"), tokenizer))
