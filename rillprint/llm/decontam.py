"""Benchmark decontamination by greedy string tiling.

Benchmark items are broadcast in blocks of at most BLOCK_BYTES of text.  A document's windows of MIN_MATCH tokens are
looked up among the items' (the shared-token seeds); an item whose seeds could cover enough of it is
tiled against the document: the longest common runs of tokens that are not yet marked are found by running
Karp-Rabin hashing, marked, and searched again at shorter lengths.  Since tiles may lie in any order, the
share of the item that they cover (coverage) also finds passages whose parts were moved around.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MIN_MATCH = 4  # tokens of the shortest tile
COVERAGE = 0.5  # share of an item's tokens that makes a document contaminated
BLOCK_BYTES = 32 << 20
WORDS_KEPT = 200_000
FOUND = "doc_id long, item_id long, item_tokens int, covered int, coverage double, tiles int, longest int"

_SPACES = bytes.maketrans(bytes(i for i in range(128) if not chr(i).isalnum()), b" " * sum(not chr(i).isalnum() for i in range(128)))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class TokenHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


def tokens(text: str | None, hashes: TokenHashes) -> np.ndarray:
    """Hashes of the lower-case words, ASCII punctuation taken as white space."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Karp-Rabin hashes of the windows of any length, from one running sum modulo 2**64."""

    def __init__(self, own: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers(len(own), _BASE), dtype=np.uint64)])
        self.back = powers(len(own), _BACK)

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of tiles that do not overlap, longest first.

    Equal lengths go to the smaller place in the text, then in the item.
    """
    in_item, in_text = Rolling(item), Rolling(text)
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles, size = [], min(len(item), len(text))
    while size >= least:
        clear_i = np.flatnonzero(clear(free_i, size))
        clear_t = np.flatnonzero(clear(free_t, size))
        where = defaultdict(list)
        for p, h in zip(clear_i.tolist(), in_item.windows(size)[clear_i].tolist()):
            where[h].append(p)
        hashes = in_text.windows(size)[clear_t]
        hit = np.isin(hashes, np.array(list(where), np.uint64))
        # longer runs were marked at their own size, so runs are just this long or a piece of several
        for t, h in zip(clear_t[hit].tolist(), hashes[hit].tolist()):
            if not free_t[t : t + size].all():
                continue
            for p in where[h]:
                if free_i[p : p + size].all() and np.array_equal(item[p : p + size], text[t : t + size]):
                    free_i[p : p + size] = False
                    free_t[t : t + size] = False
                    tiles.append((p, t, size))
                    break
        size = longest(in_item, in_text, free_i, free_t, least, size - 1)
    return tiles


def clear(free: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of this size is free throughout."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[size:] == taken[: len(taken) - size]


def longest(in_item: Rolling, in_text: Rolling, free_i: np.ndarray, free_t: np.ndarray, least: int, most: int) -> int:
    """The longest size from least to most that free runs of both have in common; 0 if none. Sizes are halved, as runs hold their parts."""
    common = lambda n: np.isin(in_text.windows(n)[clear(free_t, n)], in_item.windows(n)[clear(free_i, n)]).any()
    if most < least or not common(least):
        return 0
    low, high = least, most + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if common(middle) else (low, middle)
    return low


class Items:
    """A block of benchmark items with the index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], least: int = MIN_MATCH):
        hashes = TokenHashes()
        self.least = least
        self.items = [(i, t) for i, t in ((i, tokens(text, hashes)) for i, text in rows) if len(t) >= least]
        seeds = [Rolling(t).windows(least) for _, t in self.items]
        flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order]
        self.place = np.concatenate([*[np.arange(len(s)) for s in seeds], np.zeros(0, int)]).astype(np.int64)[order]
        self.bits = max(16, len(flat).bit_length() + 4)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.seeds * np.uint64(_BASE)) >> np.uint64(64 - self.bits)] = True

    def found(self, text: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, float, int, int]]:
        """(item_id, tokens, covered, coverage, tiles, longest) of the items that the text covers enough of."""
        if len(text) < self.least or not len(self.seeds):
            return
        own = Rolling(text).windows(self.least)
        at = np.flatnonzero(self.maybe[(own * np.uint64(_BASE)) >> np.uint64(64 - self.bits)])
        at = at[self.seeds[np.minimum(np.searchsorted(self.seeds, own[at]), len(self.seeds) - 1)] == own[at]]
        if not len(at):
            return
        # only runs of tokens with a seed can be in a tile; a stop between runs keeps them apart
        near = np.zeros(len(text), bool)
        for k in range(self.least):
            near[at + k] = True
        places = np.flatnonzero(near)
        breaks = np.flatnonzero(np.diff(places) > 1) + 1
        runs = np.insert(text[places], breaks, np.arange(1, len(breaks) + 1, dtype=np.uint64))
        shared = np.unique(own[at])
        first, last = np.searchsorted(self.seeds, shared), np.searchsorted(self.seeds, shared, "right")
        spots = defaultdict(list)
        for a, b in zip(first.tolist(), last.tolist()):
            for k in range(a, b):
                spots[int(self.item[k])].append(int(self.place[k]))
        for i, seeds in sorted(spots.items()):
            item_id, item = self.items[i]
            could = np.zeros(len(item), bool)
            for k in range(self.least):
                could[np.array(seeds) + k] = True
            if could.sum() < coverage * len(item):
                continue
            tiles = tile(item, runs, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                yield item_id, len(item), covered, covered / len(item), len(tiles), max(n for _, _, n in tiles)


class Find:
    """Batches of (doc_id, text) to FOUND."""

    def __init__(self, items: Items, coverage: float):
        self.items, self.coverage = items, coverage

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        names = ["doc_id", "item_id", "item_tokens", "covered", "coverage", "tiles", "longest"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for f in self.items.found(tokens(t, hashes), self.coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class Drop:
    """Batches with a text column, without the rows whose text covers an item."""

    def __init__(self, items: Items, coverage: float):
        self.items, self.coverage = items, coverage

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            keep = [next(self.items.found(tokens(t, hashes), self.coverage), None) is None for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of at most ``block_bytes`` of text each (or of one item), so that a block can be broadcast."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()

    def split(part: DataFrame, level: int) -> Iterator[Items]:
        size, n = part.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
        if n <= 1 or size <= block_bytes:
            if n:
                yield Items([tuple(r) for r in part.orderBy("item_id", "text").collect()])
            return
        ways = 2 + size // block_bytes
        for k in range(ways):
            yield from split(part.where(F.pmod(F.xxhash64("item_id", "text", F.lit(level)), F.lit(ways)) == k), level + 1)

    yield from split(rows, 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """FOUND: a row for each document and benchmark item that it covers to at least ``coverage``; clean documents have none.

    Items of fewer than MIN_MATCH tokens, null ones included, match nothing; null and empty texts cover
    nothing; repeated documents are each reported, equal rows of items (item_id and text) once; empty tables give no rows.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in blocks(benchmark):
        part = rows.mapInArrow(Find(items, coverage), FOUND)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns as they are, that cover no item to ``coverage``."""
    small_batches(docs)
    for items in blocks(benchmark):
        docs = docs.mapInArrow(Drop(items, coverage), docs.schema)
    return docs
