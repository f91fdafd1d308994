"""Removal of repeated passages by suffix arrays, shard by shard.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller doc_id.

1. Texts are written in blocks to the shared folder.
2. Every window is given an anchor: the GRAM bytes in it with the least hash (the leftmost of equals).  Equal windows
   have equal anchors, so only windows whose anchor is found in several documents can repeat.  Shorter grams are also
   shared by chance, and by more documents the more there are.  Blocks say which anchors
   they have, once each, and hear which of them are shared: a very frequent one costs an entry for each block.
   Segments of an anchor that alone would fill a shard are split into their windows, each of which is
   its own anchor, and blocks say and hear of these windows, too: an edge of boilerplate is dealt over all shards,
   and only its windows that several documents have are sent.
3. The stretch of windows that share an anchor is a segment.  Blocks send their distinct segments with shared anchors, each
   with the smallest doc_id that has it, to the shard of the anchor; so all equal windows meet in one shard.
4. A shard's distinct segments (equal hashes are compared byte by byte) are one text, which external induced sorting
   (suffix.py) sorts as a whole, however long it is.  Neighbours with WINDOW bytes in common are copies of one window;
   each learns the smallest doc_id among them.
5. Blocks hear that for their segments, mark what is covered, and hash what is left.

What moves is one compressed row for each block and shard that have to do with one another.  There are MAX_SHARDS at
most, so a block has a bounded number of rows and all of them grow with the input; beyond MAX_SHARDS * SHARD_BYTES of text
the shards grow instead, which the sort is for.  Anchors are dealt by the bytes of all text, segments by the bytes of
those that are shared, so that a sort is as large however much repeats.  Of a shard, 20 bytes for each segment (of 63
bytes on average) stay in memory, and while shared anchors are looked for, 40 for each of its anchors.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, written
from .suffix import GAP, Queue, Store, Stored, Text, descending

WINDOW = 50
GRAM = 24  # three words of 8 bytes
STARTS = WINDOW - GRAM + 1  # places of a gram in a window
BLOCK_BYTES = 8 << 20  # of text; a longer text has a block of its own
HASH_BYTES = 1 << 20  # of text whose strings are hashed together
SHARD_BYTES = 16 << 20  # for each shard on the whole: of text while anchors are looked for, of segments in a sort
STEP = 1 << 16  # windows looked at together, in the processor's cache
MAX_SHARDS = 1 << 16
PIECE_BYTES = 4 * SHARD_BYTES  # of segments that are made distinct at once: all of a shard, unless it is far above the others
SEGMENT_BYTES = WINDOW + STARTS // 2 + 17  # on average, with its anchor, smallest id and size
HOT_SEGMENTS = SHARD_BYTES // (WINDOW + STARTS - 1)  # of an anchor; those of more are dealt by window

BLOCKS = "block long, path string, bytes long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _LAST = 0x9E3779B97F4A7C15, (1 << 63) - 1


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(types) + 1)[1:]
    ends = 8 * (len(types) + 1) + np.cumsum(np.concatenate([[0], sizes]))
    return [np.frombuffer(raw[a:b], t) for a, b, t in zip(ends, ends[1:], types)]


def stretches(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches in which all keys stay the same."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = np.flatnonzero(new)
    return begin, np.append(begin, len(new))[1:]


class WriteBlocks:
    """(doc_id, text) batches to block files; a row for each."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(folder, recursive=True)
        ids, texts, size = [], [], 0

        def done() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            nulls = np.array([i is None for i in ids], np.uint8)
            body = packed(np.array([_LAST if i is None else i for i in ids], "<i8"), nulls, np.array([len(t) for t in texts], "<i8"), np.frombuffer(b"".join(texts), np.uint8))
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(body)
            row = [int(name[:15], 16), f"{self.folder}/{name}", size]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["block", "path", "bytes"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > BLOCK_BYTES:
                    yield done()
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield done()


class Block:
    """A block's texts and its segments: first window, windows, anchor and document of each; those of hot anchors split."""

    def __init__(self, path: str, hot: np.ndarray):
        fs, name = pa.fs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f:
            self.ids, nulls, sizes, self.text = unpacked(f.read(), "<i8", "u1", "<i8", "u1")
        self.nulls, self.ends = nulls.astype(bool), np.cumsum(sizes)
        self.first, self.count, self.anchor, self.doc = segments(self.text, self.ends)
        if self.nulls.any():  # no id is smaller than none, and none is smaller than an id
            keep = ~self.nulls[self.doc]
            self.first, self.count, self.anchor, self.doc = (x[keep] for x in (self.first, self.count, self.anchor, self.doc))
        self.hot, self.whole, self.windows = hot, (self.anchor, self.ids[self.doc]), (self.anchor[:0], self.ids[:0])
        if len(hot) and len(self.anchor):
            self.split(hot[np.minimum(np.searchsorted(hot, self.anchor), len(hot) - 1)] == self.anchor)

    def split(self, some: np.ndarray) -> None:
        """Each window of some segments to a segment of its own, with a hash of the window for its anchor."""
        n = np.where(some, self.count, 1)
        which = np.repeat(np.arange(len(n)), n)
        some, self.doc = some[which], self.doc[which]
        self.first = self.first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        self.count, self.anchor = np.where(some, 1, self.count[which]), self.anchor[which]
        self.anchor[some] = window_hashes(self.text, self.first[some])
        self.windows = self.anchor[some], self.ids[self.doc[some]]


def window_hashes(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows, by other means than string_hashes()."""
    words = np.ndarray(len(text) - 7, "<u8", np.ascontiguousarray(text), strides=(1,))
    h = np.zeros(len(first), np.uint64)
    for k in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        h = (h ^ words[first + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h * np.uint64(_BASE)


def segments(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor (a number for its gram, spread over 64 bits) and document of each stretch with one anchor."""
    windows = len(text) - WINDOW + 1
    raw = text.tobytes() + bytes(24)
    firsts, places, grams, last = [], [], [], -1
    for low in range(0, max(windows, 0), STEP):
        high = min(low + STEP, windows)
        n = high - low + STARTS - 1  # grams in these windows
        words = np.empty(n + GRAM - 8, np.uint64)
        for k in range(8):
            words[k::8] = np.frombuffer(raw, "<u8", len(range(k, len(words), 8)), low + k)
        h = words[:n] * np.uint64(_BASE)
        h += words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += words[16:] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        # the low six bits count the places from the window's start, so that the leftmost of equal grams is least
        h &= ~np.uint64(63)
        width = 1
        while 2 * width <= STARTS:
            h = np.minimum(h[:-width], h[width:] + np.uint64(width))
            width *= 2
        if width < STARTS:
            h = np.minimum(h[: width - STARTS], h[STARTS - width :] + np.uint64(STARTS - width))
        at = np.arange(low, high) + (h & np.uint64(63)).astype(np.int64)
        for end in ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, high + WINDOW)].tolist():
            at[max(end - WINDOW + 1 - low, 0) : max(end - low, 0)] = -1  # windows that reach over a text's end
        new = np.empty(high - low, bool)
        new[0], new[1:], last = at[0] != last or low == 0, at[1:] != at[:-1], at[-1]
        found = np.flatnonzero(new)
        firsts.append(found + low)
        places.append(at[found])
        grams.append(h[found] >> np.uint64(6))
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    first, place = np.concatenate(firsts), np.concatenate(places)
    ok = place >= 0
    count = np.append(first[1:], windows) - first
    first, count, gram = first[ok], count[ok], np.concatenate(grams)[ok]
    return first, count, gram * np.uint64(0xD6E8FEB86659FD93), np.searchsorted(ends, first, "right")


def shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of anchors, so that their order is that of the shards too."""
    return (anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


@functools.lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    powers = np.full(2 * HASH_BYTES + 1, np.uint64(base))
    powers[0] = 1
    return np.multiply.accumulate(powers)


def string_hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of text[start : start + size], short strings in the order of their starts."""
    powers, inverse = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    h = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):  # those that begin in the next HASH_BYTES
        origin = start[low]
        high = int(np.searchsorted(start, origin + HASH_BYTES))
        at, own = start[low:high] - origin, size[low:high]
        some = text[origin : origin + int((at + own).max())]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[some] * powers[: len(some)], dtype=np.uint64)])
        h[low:high] = (sums[at + own] - sums[at]) * inverse[at]
        low = high
    h = (h + size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def distinct(text: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings by key, so that equal ones follow each other by ``least``: their order, and begins and ends of equal ones."""
    h = string_hashes(text, start, size)
    order = np.lexsort((least, h, key))
    h, key, size, start = h[order], key[order], size[order], start[order]
    like = np.flatnonzero((h[1:] == h[:-1]) & (key[1:] == key[:-1]) & (size[1:] == size[:-1])) + 1
    new = np.ones(len(order), bool)
    for some in by_bytes(size[like]):
        own = like[some]
        same = strings(text, start[own], size[own]) == strings(text, start[own - 1], size[own])
        new[own] = ~np.logical_and.reduceat(same, np.cumsum(size[own]) - size[own])
    begin = np.flatnonzero(new)
    return order, begin, np.append(begin, len(order))[1:]


class Anchors:
    """Blocks to (shard, block, blob): the sorted anchors of a shard that a block has, which several of its documents have, and segments of each.

    Where there are hot anchors, these are the windows of their segments alone.
    """

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch["block"].to_pylist(), batch["path"].to_pylist()):
                block = Block(path, self.hot)
                own = anchors(block.windows if len(self.hot) else block.whole, self.shards)
                rows = [(s, number, packed(np.diff(a, prepend=np.uint64(0)), several, n)) for s, a, several, n in own]
                yield batch_of(rows)


def anchors(own: tuple[np.ndarray, np.ndarray], shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    order = np.argsort(own[0])
    a, d = own[0][order], own[1][order]
    begin, stop = stretches(a)
    if not len(begin):
        return
    times = (stop - begin).astype("<u4")
    several = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
    a = a[begin]
    cuts = np.searchsorted(shard_of(a, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        some = slice(cuts[s], cuts[s + 1])
        yield s, a[some], several[some].astype(np.uint8), times[some]


def shared_anchors(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """All blocks' anchors of one shard to a row of bits for each block: which are in several documents.

    The first row also has those of them with over ``most`` segments, the number of these, and that of all with shared anchors.
    """
    parts = [unpacked(b, "<u8", "u1", "<u4") for b in group["blob"]]
    own = [np.cumsum(a, dtype=np.uint64) for a, *_ in parts]
    flat = np.concatenate(own)
    found, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    shared[inverse[np.concatenate([s for _, s, _ in parts]).astype(bool)]] = True
    ends = np.cumsum([0, *map(len, own)])
    bits = shared[inverse]
    rows = [(s, b, np.packbits(bits[i:j]).tobytes(), None, 0, 0) for s, b, i, j in zip(group["shard"], group["block"], ends, ends[1:]) if bits[i:j].any()]
    all_of = np.bincount(inverse, np.concatenate([n for *_, n in parts]), len(found))
    hot = shared & (all_of > most)
    if rows:
        rows[0] = (*rows[0][:3], found[hot].tobytes() if hot.any() else None, int(all_of[hot].sum()), int(all_of[shared].sum()))
    return pd.DataFrame(rows, columns=["shard", "block", "blob", "hot", "hot_segments", "segments"])


def shared_of(own: tuple[np.ndarray, np.ndarray], told: list[dict] | None, shards: int) -> np.ndarray:
    """Those anchors that a block has heard are shared."""
    bits = {t["shard"]: t["blob"] for t in told or ()}
    found = [a[np.unpackbits(np.frombuffer(bits[s], np.uint8), count=len(a)).astype(bool)] for s, a, *_ in anchors(own, shards) if s in bits]
    return np.concatenate([*found, own[0][:0]])


class Distinct:
    """A block's segments with shared anchors by shard, equal ones once; ``told`` is of its anchors and then of split windows."""

    def __init__(self, block: Block, told: list[dict] | None, again: list[dict] | None, first_shards: int, shards: int):
        shared = shared_of(block.whole, told, first_shards)
        shared = np.sort(np.concatenate([shared[~np.isin(shared, block.hot)], shared_of(block.windows, again, shards)]))
        if len(shared):
            good = shared[np.minimum(np.searchsorted(shared, block.anchor), len(shared) - 1)] == block.anchor
        else:
            good = np.zeros(len(block.anchor), bool)
        self.first, self.count, self.anchor, self.ids = block.first[good], block.count[good], block.anchor[good], block.ids[block.doc[good]]
        size = self.count + WINDOW - 1
        # by anchor, thus by shard, then content; equal segments follow each other by document
        self.order, self.begin, self.stop = distinct(block.text, self.first, size, self.anchor, self.ids)
        one = self.order[self.begin]
        self.shard = shard_of(self.anchor[one], shards)
        self.size, self.least, self.key, self.start = size[one], self.ids[one], self.anchor[one], self.first[one]

    def of(self, shard: int) -> slice:
        return slice(*np.searchsorted(self.shard, [shard, shard + 1]).tolist())

    def places(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these segments, all that are equal to it: which of the asked it is, and its place among all."""
        n = (self.stop - self.begin)[segments]
        which = np.repeat(np.arange(len(segments)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, self.order[self.begin[segments][which] + step]


def by_bytes(size: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of strings of about so many bytes together."""
    ends = np.cumsum(size)
    cuts = np.searchsorted(ends, np.arange(most, int(ends[-1]) if len(ends) else 0, most)).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(size)]):
        if b > a:
            yield slice(a, b)


def strings(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all text[start : start + size], one after another."""
    out = [np.zeros(0, text.dtype)]
    for some in by_bytes(size):
        at, own = start[some], size[some]
        out.append(text[np.arange(own.sum()) + np.repeat(at - (np.cumsum(own) - own), own)])
    return np.concatenate(out)


class Send:
    """Blocks with what they heard of their anchors to (shard, block, blob) of segments."""

    def __init__(self, first_shards: int, shards: int, hot: np.ndarray):
        self.first_shards, self.shards, self.hot = first_shards, shards, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, told, again in zip(*(batch[c].to_pylist() for c in ("block", "path", "told", "again"))):
                block = Block(path, self.hot)
                own = Distinct(block, told, again, self.first_shards, self.shards)
                rows = []
                for s in np.unique(own.shard).tolist():
                    some = own.of(s)
                    rows.append((s, number, packed(own.key[some], own.least[some].astype("<i8"), own.size[some].astype("u1"), strings(block.text, own.start[some], own.size[some]))))
                if rows:
                    yield batch_of(rows)


class Shard:
    """The segments of one shard, distinct within a piece of them, to the repeats of each block's."""

    def __init__(self, number: int, folder: str, memory: int | None = None):
        self.number, self.store = number, Store(folder, *([] if memory is None else [memory]))
        self.text, self.valid = Text(self.store, np.uint16), Stored(self.store, np.uint8)
        self.pieces, self.begins, self.least, self.count = [], [], [], 0

    def add(self, told: list[tuple[int, bytes]], whole: bool) -> None:
        """A piece of the shard, or all of it: blobs of (anchor, smallest id, size, bytes) of segments by block."""
        parts = [unpacked(b, "<u8", "<i8", "u1", "u1") for _, b in told]
        n = [len(p[0]) for p in parts]
        blocks = np.array([b for b, _ in told])
        key, least, size, text = (np.concatenate([p[k] for p in parts]) for k in range(4))
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        order, begin, stop = distinct(text, start, size, key, least)
        one = order[begin]  # each distinct segment, with the smallest id that has it
        # an anchor with one segment: its windows are in no other, and there is nothing to sort
        of, upto = stretches(key[one])
        alone = np.repeat(upto - of == 1, upto - of) & whole
        mine = one[~alone]
        own = size[mine]
        for some in by_bytes(own):
            sizes = own[some]
            symbols, good = np.full(int(sizes.sum()) + len(sizes), GAP, np.uint16), np.zeros(int(sizes.sum()) + len(sizes), np.int8)
            first = np.cumsum(sizes + 1) - sizes - 1
            symbols[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = strings(text, start[mine[some]], sizes).astype(np.uint16) + 2
            good[first] = 1
            good[first + sizes - WINDOW + 1] = -1
            self.begins.append(first + self.text.n)
            self.text.append(symbols)
            self.valid.append(np.cumsum(good, dtype=np.int8))
        self.least.append(least[mine])
        kept = (blocks, np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]), order, begin, stop, np.flatnonzero(~alone), np.flatnonzero(alone), size[one[alone]] - WINDOW, least[one[alone]])
        self.pieces.append((self.count, self.count + len(mine), self.store.keep(kept)))
        self.count += len(mine)

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(segment, first window, last window, smallest id) in the order of segments; stretches with one smallest id are one row."""
        begins, least = np.concatenate([*self.begins, np.zeros(0, np.int64)]), np.concatenate(self.least)
        text, valid = self.text.close(), self.valid.close()
        by_place, smallest = Queue(self.store, text.n), Stored(self.store, np.int64)
        cuts = groups = 0
        open_, low = -1, None
        for suffixes, common in descending(text):
            group = cuts + np.cumsum(common < WINDOW)
            cuts = group[-1]
            good = valid[suffixes] == 1  # only whole windows count
            places, group = suffixes[good], group[good]
            if not len(places):
                continue
            begin, stop = stretches(group)
            lows = np.minimum.reduceat(least[np.searchsorted(begins, places, "right") - 1], begin)
            if group[0] == open_:
                lows[0] = min(lows[0], low)
            elif low is not None:
                smallest.append(np.array([low]))
                groups += 1
            by_place.put(places, groups + np.repeat(np.arange(len(begin)), stop - begin))
            smallest.append(lows[:-1])
            groups += len(begin) - 1
            open_, low = group[-1], lows[-1]
        smallest.append(np.array([] if low is None else [low]))
        smallest.close()
        for places, group in by_place.drain():
            segment, low = np.searchsorted(begins, places, "right") - 1, smallest[group]
            new, stop = stretches(segment, low)
            offset = places - begins[segment]
            yield segment[new], offset[new], offset[stop - 1], low[new]

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(shard, block, blob) of all pieces."""
        found, waiting = self.repeats(), None
        for first, stop, kept in self.pieces:
            parts = [] if waiting is None else [waiting]
            while not parts or parts[-1][0][-1] < stop:
                if (more := next(found, None)) is None:
                    break
                parts.append(more)
            all_of = [np.concatenate([p[k] for p in parts]) for k in range(4)] if parts else [np.zeros(0, np.int64)] * 4
            at = int(np.searchsorted(all_of[0], stop))
            waiting = tuple(a[at:] for a in all_of) if at < len(all_of[0]) else None
            yield from self._of_piece(self.store.take(kept), all_of[0][:at] - first, *(a[:at] for a in all_of[1:]))
        self.store.clear()

    def _of_piece(self, kept: tuple, segment: np.ndarray, *others: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        blocks, block, index, order, begin, stop, mine, alone, last, least = kept
        seg = np.concatenate([alone, mine[segment]])
        low, high, smallest = (np.concatenate([a, b]) for a, b in zip((np.zeros(len(alone), np.int64), last, least), others))
        # every segment equal to a distinct one hears the same
        n = stop - begin
        which = np.repeat(np.arange(len(seg)), n[seg])
        step = np.arange(len(which)) - np.repeat(np.cumsum(n[seg]) - n[seg], n[seg])
        seg, low, high, smallest = order[begin[seg][which] + step], low[which], high[which], smallest[which]
        by_block = np.argsort(block[seg], kind="stable")
        cuts = np.searchsorted(block[seg][by_block], np.arange(len(blocks) + 1))
        for b, number in enumerate(blocks.tolist()):
            some = by_block[cuts[b] : cuts[b + 1]]
            if len(some):
                yield self.number, number, packed(index[seg[some]].astype("<i4"), low[some].astype("u1"), high[some].astype("u1"), smallest[some].astype("<i8"))


class SortShards:
    """Rows (shard, block, blob) in the order of shards to the repeats of each block's segments."""

    def __init__(self, folder: str, memory: int | None = None):
        self.folder, self.memory = folder, memory

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, told, size = None, [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            if told:
                shard.add(told, not shard.pieces)
            rows = []
            for row in shard.rows():
                rows.append(row)
                if sum(len(r[2]) for r in rows) > BLOCK_BYTES:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

        for batch in batches:
            for number, block, blob in zip(*(batch[c].to_pylist() for c in ("shard", "block", "blob"))):
                if shard is not None and number != shard.number:
                    yield from ended()
                    shard = None
                if shard is None:
                    shard, told, size = Shard(number, self.folder, self.memory), [], 0
                more = zstandard.frame_content_size(blob)
                if told and size + more > PIECE_BYTES:
                    shard.add(told, False)
                    told, size = [], 0
                told.append((block, blob))
                size += more
        if shard is not None:
            yield from ended()


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))], ["shard", "block", "blob"])


class Finish:
    """Blocks with what they heard of their segments to RESULT, and the texts left where they are asked for."""

    def __init__(self, first_shards: int, shards: int, hot: np.ndarray, texts: bool = False):
        self.first_shards, self.shards, self.hot, self.texts = first_shards, shards, hot, texts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, told, again, heard in zip(*(batch[c].to_pylist() for c in ("path", "told", "again", "heard"))):
                block = Block(path, self.hot)
                change = np.zeros(len(block.text) + 1, np.int32)
                if heard:
                    own = Distinct(block, told, again, self.first_shards, self.shards)
                    starts = np.searchsorted(own.shard, [s["shard"] for s in heard])
                    parts = [unpacked(s["blob"], "<i4", "u1", "u1", "<i8") for s in heard]
                    seg = np.concatenate([p[0] + start for p, start in zip(parts, starts)])
                    low, high, smallest = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
                    which, place = own.places(seg)
                    gone = own.ids[place] > smallest[which]
                    which, place = which[gone], place[gone]
                    np.add.at(change, own.first[place] + low[which], 1)
                    np.add.at(change, own.first[place] + high[which] + WINDOW, -1)
                yield self.rows(block, np.cumsum(change[:-1], dtype=np.int32) > 0)

    def rows(self, block: Block, gone: np.ndarray) -> pa.RecordBatch:
        removed, spans, digest, texts, start = [], [], [], [], 0
        for end in block.ends.tolist():
            own, mark = block.text[start:end], gone[start:end]
            removed.append(int(mark.sum()))
            spans.append(int(mark[:1].sum()) + int((mark[1:] & ~mark[:-1]).sum()))
            left = own[~mark].tobytes() if removed[-1] else own.tobytes()
            digest.append(hashlib.sha256(left).hexdigest())
            if self.texts:
                texts.append(left)
            start = end
        ids = pa.array(block.ids, mask=block.nulls)
        sizes = np.diff(np.concatenate([[0], block.ends]))
        columns = [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if self.texts:
            columns.append(pa.array(texts, pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, texts: bool = False, memory: int | None = None) -> DataFrame:
    """RESULT for every row of (doc_id, text), and with ``texts`` the bytes left (kept).

    A null text is empty; texts under WINDOW bytes lose nothing; rows with the same doc_id are no smaller than
    one another, so only smaller ids count; a null doc_id neither loses bytes nor makes others lose any; other
    columns are ignored; an empty table gives no rows.  ``memory`` limits what a sort keeps out of its files, in bytes.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = written(rows.mapInArrow(WriteBlocks(new_path(spark, "blocks")), BLOCKS), "block-list")
    total, count = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    shards = min(MAX_SHARDS, 1 + total // SHARD_BYTES)
    tasks = max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, count // 4)))
    table = "shard long, block long, blob binary"
    spread = blocks.repartition(tasks, "block")  # said outright, else so few bytes of paths go to one task

    def say(hot: np.ndarray, shards: int) -> DataFrame:
        said = spread.mapInArrow(Anchors(shards, hot), table)
        return written(said.groupBy("shard").applyInPandas(lambda group: shared_anchors(group, HOT_SEGMENTS), table + ", hot binary, hot_segments long, segments long"), "shared-anchors")

    gather = lambda df, name: df.groupBy("block").agg(F.collect_list(F.struct("shard", "blob")).alias(name))  # a row for each shard at most
    first_shards, shared = shards, say(np.zeros(0, np.uint64), shards)
    told = blocks.join(gather(shared, "told"), "block", "left")
    found = shared.where("segments > 0").select("hot", "hot_segments", "segments").collect()  # of each shard one, and 8 bytes for every HOT_SEGMENTS segments at most
    hot = np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in found if r[0]), np.uint64))
    split = sum(r[1] for r in found) * (STARTS // 2)  # a segment has STARTS / 2 windows on average
    shards = min(MAX_SHARDS, 1 + ((sum(r[2] - r[1] for r in found) + split) * SEGMENT_BYTES) // SHARD_BYTES)
    if len(hot):
        told = told.join(gather(say(hot, shards), "again"), "block", "left")
    else:
        told = told.withColumn("again", F.lit(None).cast("array<struct<shard: bigint, blob: binary>>"))
    sent = told.repartition(tasks, "block").mapInArrow(Send(first_shards, shards, hot), table).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    heard = written(sent.mapInArrow(SortShards(new_path(spark, "sorts"), memory), table), "repeats")
    ready = told.join(gather(heard, "heard"), "block", "left").repartition(tasks, "block")
    return ready.mapInArrow(Finish(first_shards, shards, hot, texts), RESULT + (", kept binary" if texts else ""))
