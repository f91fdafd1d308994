"""Sequence packing by best-two-fit.

Document sizes are small integers, so the packing itself works on the histogram of piece lengths, at
most ``capacity`` numbers however large the corpus.  A bin is filled greedily with the largest
unpacked piece that fits; then its smallest piece is given back for the two unpacked pieces that
fill the widened gap best.  The same bin recurs while its pieces last, so one pattern is laid down
as often as the counts allow.  The plan (a few rows per pattern) is joined to the pieces by their number
within their length; nothing but lengths ever leaves the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbers, small_batches, vocabulary, with_tasks
from .tokens import encoder

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "s_length long, s_from long, s_to long, s_each long, s_sequence long, s_offset long"


def best_pair(free: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
    """Two lengths with the largest sum in (least, most], from counts of unpacked pieces."""
    for total in range(most, least, -1):
        half = total // 2
        if half < 1:
            return None
        low = np.arange(1, half + 1)
        high = total - low
        ok = (high < len(free)) & (free[low] > 0) & (free[np.minimum(high, len(free) - 1)] > 0)
        if total % 2 == 0 and free[half] < 2:
            ok[half - 1] = False
        hit = np.flatnonzero(ok)
        if len(hit):
            return int(total - low[hit[0]]), int(low[hit[0]])
    return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces}) and how many bins have each; every piece is in just one bin."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1 to {capacity}")
        free[length] = n
    bins = []
    while (there := np.flatnonzero(free)).size:
        gap, pattern = capacity, {}
        while there.size and (fit := there[there <= gap]).size:
            length = int(fit[-1])
            n = min(gap // length, int(free[length]))
            pattern[length] = n
            gap -= n * length
            there = fit[:-1]
        if gap:
            small = min(pattern)
            left = free.copy()
            for length, n in pattern.items():
                left[length] -= n
            if pair := best_pair(left, small, small + gap):
                pattern[small] -= 1
                for length in pair:
                    pattern[length] = pattern.get(length, 0) + 1
                pattern = {length: n for length, n in pattern.items() if n}
        times = min(int(free[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            free[length] -= n * times
        bins.append((dict(sorted(pattern.items(), reverse=True)), times))
    return bins


def slots(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """Rows of SLOTS: pieces number s_from to s_to of a length, s_each to a sequence from s_sequence on."""
    out, given, sequence = [], {}, 0
    for pattern, times in bins:
        offset = 0
        for length, n in pattern.items():
            first = given.get(length, 0)
            given[length] = first + n * times
            out.append((length, first, first + n * times, n, sequence, offset))
            offset += n * length
        sequence += times
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


class Pieces:
    """Token pieces of (doc_id, text) batches."""

    def __init__(self, path: str, capacity: int):
        self.path, self.capacity = path, capacity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(self.path).encode, np.array([END_ID], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist())):
                    raw = np.concatenate([ids.astype("<u4"), end])
                    rows += [(doc, i, start, n, zlib.crc32(raw[start : start + n])) for i, (start, n) in enumerate(cut(len(raw), self.capacity))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every row: ids with END_ID appended, cut where longer than ``capacity``. A null text is empty."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(Pieces(tokenizer or vocabulary(), capacity), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (any columns, with length long in 1 to capacity) with sequence_id and offset (long).

    Equal rows are different pieces.  An empty table gives no rows.  Sequences are numbered from 0.
    """
    kept = with_tasks(pieces, "pieces")
    counts = {r[0]: r[1] for r in kept.groupBy("length").count().collect()}  # at most `capacity` rows
    ranked = numbers(kept, ["length"], "__rank")
    table = kept.sparkSession.createDataFrame(slots(plan_bins(counts, capacity)), SLOTS)
    c = F.col
    at = (c("length") == c("s_length")) & (c("__rank") >= c("s_from")) & (c("__rank") < c("s_to"))
    # the plan's rows are bounded by the capacity (a few for each pattern, a pattern or two for each length)
    joined = ranked.join(F.broadcast(table), at)
    k = c("__rank") - c("s_from")
    sequence = (c("s_sequence") + F.floor(k / c("s_each"))).cast("long").alias("sequence_id")
    offset = (c("s_offset") + k % c("s_each") * c("length")).cast("long").alias("offset")
    return joined.select(*pieces.columns, sequence, offset)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all rows of (doc_id, text).

    A null or empty text is one piece of END_ID alone; a null doc_id stays null; repeated rows are packed each; an empty table gives
    no rows; other columns are ignored.  Which of equally long pieces shares a sequence with which others is not defined.
    """
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
