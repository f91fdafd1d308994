"""Suffix order and common prefixes of a text by external induced sorting.

The text's leftmost S-type (LMS) substrings are sorted by one induction and named; the string of names is sorted in
the same way, by recursion, until no name repeats or BASE are left; then a second induction sorts all suffixes.  An induction
reads suffix tuples from a priority queue and puts each one's predecessor back into it, under its own first symbol.  At the
level of the text a tuple also carries the common prefix with the one before it: one more than the least common prefix among
the tuples read since.  Those of neighbouring LMS suffixes are read off the text.

Nothing is held as a whole: queues are sorted runs, and texts, names and places are blocks.  What a sort keeps beyond
its memory goes to files in a folder of its own, which is shared, so a lost executor's task starts over elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.fs

MEMORY_BYTES = 128 << 20
ROWS = 1 << 15  # tuples looked at together
BASE = 1 << 20  # names at the recursion's end
END, GAP = 0, 1  # the end of a text, below all symbols; the gap between strings, which equals nothing
_NONE = np.iinfo(np.int64).max
Arrays = tuple[np.ndarray, ...]


class Store:
    """Arrays of one sort: in memory up to a limit, then in files of a folder of this sort."""

    def __init__(self, folder: str, memory: int = MEMORY_BYTES):
        self.fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.path, self.memory = f"{path}/{uuid.uuid4().hex}", memory
        self.held = self.spilled = self.files = 0

    def keep(self, arrays: Arrays):
        """A handle of the arrays."""
        size = sum(a.nbytes for a in arrays)
        if self.held + size <= self.memory:
            self.held += size
            return arrays
        if not self.files:
            self.fs.create_dir(self.path, recursive=True)
        self.files += 1
        self.spilled += size
        name = f"{self.path}/{self.files}"
        with self.fs.open_output_stream(name, compression=None) as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a).view(np.uint8))
        return name, [(a.dtype, len(a)) for a in arrays]

    def get(self, kept) -> Arrays:
        if not isinstance(kept[0], str):
            return kept
        with self.fs.open_input_file(kept[0]) as f:
            return tuple(np.frombuffer(f.read(kind.itemsize * n), kind) for kind, n in kept[1])

    def take(self, kept) -> Arrays:
        out = self.get(kept)
        if isinstance(kept[0], str):
            self.fs.delete_file(kept[0])
        else:
            self.held -= sum(a.nbytes for a in kept)
        return out

    def clear(self) -> None:
        if self.files:
            self.fs.delete_dir(self.path)


class Stream:
    """Rows of a few arrays, appended in turn and read once, forward or backward."""

    def __init__(self, store: Store):
        self.store, self.parts, self.wait, self.rows, self.waiting = store, [], [], 0, 0
        self.most = min(ROWS, max(256, store.memory // 256))

    def append(self, *arrays: np.ndarray) -> None:
        if not len(arrays[0]):
            return
        self.rows += len(arrays[0])
        self.waiting += len(arrays[0])
        self.wait.append(arrays)
        if self.waiting >= self.most:
            self._flush()

    def _flush(self) -> None:
        if self.wait:
            self.parts.append(self.store.keep(tuple(map(np.concatenate, zip(*self.wait)))))
            self.wait, self.waiting = [], 0

    def forward(self) -> Iterator[Arrays]:
        self._flush()
        self.parts.reverse()
        while self.parts:
            yield self.store.take(self.parts.pop())

    def backward(self) -> Iterator[Arrays]:
        self._flush()
        while self.parts:
            yield tuple(a[::-1] for a in self.store.take(self.parts.pop()))

    def drop(self) -> None:
        for _ in self.forward():
            pass


class Stored:
    """A long array, appended in blocks and then read at any places; beyond a share of the memory through a cache of blocks."""

    def __init__(self, store: Store, kind):
        self.store, self.kind, self.parts, self.wait, self.n, self.top = store, np.dtype(kind), [], [], 0, 0
        self.block = min(1 << 16, max(64, store.memory // 64 // self.kind.itemsize))
        self.flat, self.waiting = None, 0

    def append(self, values: np.ndarray) -> None:
        values = values.astype(self.kind)
        self.n += len(values)
        self.top = max(self.top, int(values.max(initial=0)))
        self.wait.append(values)
        self.waiting += len(values)
        if self.waiting >= self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        all_of = np.concatenate([*self.wait, np.zeros(0, self.kind)])
        cut = len(all_of) if least == 1 else len(all_of) // self.block * self.block
        self.parts += [self.store.keep((all_of[a : a + self.block].copy(),)) for a in range(0, cut, self.block)]
        self.wait, self.waiting = [all_of[cut:]], len(all_of) - cut

    def close(self) -> Stored:
        self._flush(1)
        if self.n * self.kind.itemsize <= self.store.memory // 4:
            self.flat = np.concatenate([*(self.store.take(p)[0] for p in self.parts), np.zeros(0, self.kind)])
            self.store.held += self.flat.nbytes
        else:
            slots = max(4, self.store.memory // 8 // (self.block * self.kind.itemsize))
            self.slots, self.at, self.next = np.zeros((slots, self.block), self.kind), np.full(len(self.parts), -1), 0
            self.holds = np.full(slots, -1)
        return self

    def blocks(self, back: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first, values) of all blocks in order, or from the last one."""
        order = range(-(-self.n // self.block))
        for k in reversed(order) if back else order:
            yield k * self.block, self.store.get(self.parts[k])[0] if self.flat is None else self.flat[k * self.block : (k + 1) * self.block]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return self.flat[at]
        block, place = np.divmod(at, self.block)
        need = np.unique(block)
        if len(need) > len(self.slots):  # some blocks at a time
            out = np.zeros(at.shape, self.kind)
            for low in range(0, len(need), len(self.slots)):
                some = (block >= need[low]) & (block <= need[min(low + len(self.slots), len(need)) - 1])
                out[some] = self[at[some]]
            return out
        for b in need[self.at[need] < 0].tolist():
            while self.holds[self.next] in need:
                self.next = (self.next + 1) % len(self.slots)
            if self.holds[self.next] >= 0:
                self.at[self.holds[self.next]] = -1
            values = self.store.get(self.parts[b])[0]
            self.slots[self.next, : len(values)] = values
            self.at[b], self.holds[self.next] = self.next, b
            self.next = (self.next + 1) % len(self.slots)
        return self.slots[self.at[block], place]

    def drop(self) -> None:
        if self.flat is not None:
            self.store.held -= self.flat.nbytes
        else:
            while self.parts:
                self.store.take(self.parts.pop())
        self.flat = self.slots = None


class Run:
    """Sorted rows, chunk by chunk."""

    def __init__(self, chunks: Iterator[Arrays]):
        self.chunks, self.now, self.at, self.over = chunks, None, 0, False

    def ready(self) -> bool:
        while not self.over and (self.now is None or self.at == len(self.now[0])):
            self.now, self.at = next(self.chunks, None), 0
            self.over = self.now is None
        return not self.over

    def left(self) -> int:
        return len(self.now[0]) - self.at

    def last(self, rows: int) -> int:
        """The key that is read last if so many rows are looked at."""
        return int(self.now[0][min(self.at + rows, len(self.now[0])) - 1])

    def pull(self, upto: int, rows: int, side: str) -> Arrays:
        """Of so many rows, those with keys below upto (side left), or that and below (right)."""
        n = int(np.searchsorted(self.now[0][self.at : self.at + rows], upto, side))
        self.at += n
        return tuple(a[self.at - n : self.at] for a in self.now)


def in_order(arrays: Arrays) -> Arrays:
    order = np.argsort(arrays[0], kind="stable")
    return tuple(a[order] for a in arrays)


class Queue:
    """A priority queue of rows whose first array is the key; equal keys leave in the order they came in.

    Runs are in that order too: what was spilled, then what is in memory, then what has just come.
    """

    def __init__(self, store: Store, most_key: int):
        self.store = store
        self.kind = np.uint16 if most_key < 1 << 16 else np.int32 if most_key < 1 << 31 else np.int64
        self.old: list[Run] = []
        self.young: list[Run] = []
        self.new: list[Arrays] = []
        self.near, self.size = None, 0
        self.most = max(1024, store.memory // 8 // 16)  # rows in memory
        self.rows = min(ROWS if self.kind == np.uint16 else ROWS // 4, self.most)

    def put(self, key: np.ndarray, *others: np.ndarray) -> None:
        rows = (key.astype(self.kind), *others)
        if self.near is not None and len(self.near[0]):
            soon = key < self.near[0][-1]  # others wait behind those of the last key
            if soon.any():
                self.near = in_order(tuple(np.concatenate([a, b[soon]]) for a, b in zip(self.near, rows)))
                rows = tuple(a[~soon] for a in rows)
        if len(rows[0]):
            self.new.append(rows)
            self.size += len(rows[0])
            if self.size > self.most:
                self._settle()

    def add_run(self, chunks: Iterator[Arrays]) -> None:
        self.old.append(Run(chunks))

    def _settle(self) -> None:
        """What has come becomes a run; runs of like sizes become one, and many rows go to the store."""
        if self.new:
            rows = in_order(tuple(map(np.concatenate, zip(*self.new))))
            self.new, self.size = [], 0
            self.young = [r for r in self.young if r.ready()]
            while self.young and self.young[-1].left() <= 2 * len(rows[0]):
                before = self.young.pop()
                rows = in_order(tuple(np.concatenate([a[before.at :], b]) for a, b in zip(before.now, rows)))
            self.young.append(Run(iter([rows])))
            self.young[-1].ready()
        if sum(r.left() for r in self.young) > self.most:
            rows = in_order(tuple(map(np.concatenate, zip(*(tuple(a[r.at :] for a in r.now) for r in self.young)))))
            out = Stream(self.store)
            for a in range(0, len(rows[0]), self.rows):
                out.append(*(x[a : a + self.rows] for x in rows))
            self.old.append(Run(out.forward()))
            self.young = []

    def head(self) -> Arrays | None:
        """The next rows, at least one if there is any."""
        if self.near is None or not len(self.near[0]):
            self._settle()
            self.old = [r for r in self.old if r.ready()]
            self.young = [r for r in self.young if r.ready()]
            runs = [*self.old, *self.young]
            if not runs:
                return None
            each = max(64, self.rows // len(runs))
            upto = min(r.last(each) for r in runs)
            parts = [r.pull(upto, each, "left") for r in runs]
            if not any(len(p[0]) for p in parts):  # all of one key: from the first runs that have it
                left = self.rows
                for r in runs:
                    parts.append(r.pull(upto, left, "right") if r.now[0][r.at] == upto else parts[0])
                    left -= len(parts[-1][0])
                    if left <= 0 or r.at == len(r.now[0]):  # the next chunk may have more of them
                        break
            self.near = in_order(tuple(map(np.concatenate, zip(*parts))))
        return self.near

    def advance(self, rows: int) -> None:
        self.near = tuple(a[rows:] for a in self.near)

    def drain(self) -> Iterator[Arrays]:
        """All rows in order, when no more will come."""
        while (rows := self.head()) is not None:
            self.near = None
            yield rows


class Text(Stored):
    """Symbols of a string; close() adds its end."""

    def close(self) -> Text:
        self.append(np.zeros(1, self.kind))
        super().close()
        if self.flat is not None and self.kind.itemsize < 8:
            padded = np.append(self.flat, np.zeros(3, self.kind))
            self.flat, self.words = padded[: self.n], np.ndarray(self.n, "<u8", padded, strides=(self.kind.itemsize,))
        return self

    words = None  # 64 bits of symbols from every place, where the text is in memory

    def same(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None, gap: int = -1) -> np.ndarray:
        """Symbols that the suffixes at a and b have in common, up to ``most``; gaps equal nothing."""
        out = np.zeros(len(a), np.int64)
        for low in range(0, len(a), ROWS):
            open_ = np.arange(low, min(low + ROWS, len(a)))
            while len(open_) and self.words is not None:
                left = self.words[a[open_] + out[open_]]
                unlike = left ^ self.words[b[open_] + out[open_]]
                if gap >= 0:  # the lowest sign of each that is a gap gets a bit, too
                    left = left ^ np.uint64(gap * 0x0001000100010001)
                    unlike |= (left - np.uint64(0x0001000100010001)) & ~left & np.uint64(0x8000800080008000)
                first = (unlike == 0).astype(np.int64)
                for bits in range(64 - 8 * self.kind.itemsize, 0, -8 * self.kind.itemsize):
                    first += unlike & np.uint64((1 << bits) - 1) == 0
                out[open_] += first
                open_ = open_[(unlike == 0) if most is None else (unlike == 0) & (out[open_] < most[open_])]
            while len(open_):
                step = np.arange(min(max(1 << 18, len(open_)) // len(open_), 8 if len(open_) > 1024 else 1024))
                x, y = ((at[open_] + out[open_])[:, None] + step for at in (a, b))
                left, right = self[np.minimum(x, self.n - 1)], self[np.minimum(y, self.n - 1)]
                bad = (left != right) | (left == gap) | (x >= self.n - 1) | (y >= self.n - 1)
                if most is not None:
                    bad |= out[open_][:, None] + step >= most[open_][:, None]
                first = np.where(bad.any(axis=1), bad.argmax(axis=1), len(step))
                out[open_] += first
                open_ = open_[first == len(step)]
        return out if most is None else np.minimum(out, most)


def lms_places(text: Text) -> Stored:
    """Places of the LMS suffixes in order, that of the end at last."""
    found, store = Stream(text.store), text.store
    after, after_s = None, True
    for begin, s in text.blocks(back=True):
        s = s.astype(np.int64)
        ahead = np.append(s[1:], -1 if after is None else after)
        up, differs = s < ahead, s != ahead
        # equal neighbours take the type of the next symbol that differs; the end is of type S
        upto = np.minimum.accumulate(np.where(differs, np.arange(len(s)), len(s))[::-1])[::-1]
        is_s = np.append(up, after_s)[upto]
        if after is None:
            is_s[-1] = True
        types = np.append(is_s, after_s)
        places = np.flatnonzero(types[1:] & ~types[:-1])[::-1] + begin + 1
        found.append(places)
        after, after_s = s[0], bool(is_s[0])
    out = Stored(store, np.int32 if text.n < 1 << 31 else np.int64)
    for (places,) in found.backward():
        out.append(places)
    return out.close()


def induce(text: Text, seeds: Iterator[tuple[np.ndarray, np.ndarray]], carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes but the end, from the last to the first: (suffix, carried, whether it is LMS).

    seeds are LMS suffixes with what they carry, in order within each first symbol.  With ``carry`` that is the common prefix with the
    one before them, and that of each suffix comes out; else the number of the LMS suffix itself, and the next one's comes out.
    """
    store, most = text.store, 2 * text.top + 3
    queue = Queue(store, most)
    for suffixes, carried in seeds:
        queue.put(2 * text[suffixes].astype(np.int64) + 1, suffixes, carried)
    larger = Stream(store)  # L-type suffixes in order

    def write(even: np.ndarray, suffixes: np.ndarray, carried: np.ndarray, lms: np.ndarray) -> None:
        larger.append(suffixes[even], carried[even])

    for rows in _scan(text, queue, carry, lambda key: key >> 1, lambda symbol: 2 * symbol, lambda before, own, even: ~even | (before >= own)):
        write(*rows)
    queue = Queue(store, most)

    def backward() -> Iterator[Arrays]:
        # read from the last: what a suffix has in common with the one read before it stands with that one
        later = 0
        for suffixes, carried in larger.backward():
            if carry:
                carried, later = np.append(np.array([later], carried.dtype), carried[:-1]), carried[-1]
            yield (2 * (text.top - text[suffixes].astype(np.int64)) + 1).astype(queue.kind), suffixes, carried

    queue.add_run(backward())
    turn = lambda key: text.top - (key >> 1)
    for _, suffixes, carried, lms in _scan(text, queue, carry, turn, lambda symbol: 2 * (text.top - symbol), lambda before, own, even: np.where(even, before <= own, before < own)):
        yield suffixes, carried, lms


def _scan(text: Text, queue: Queue, carry: bool, symbol_of: Callable, key_of: Callable, wanted: Callable) -> Iterator[tuple[np.ndarray, ...]]:
    """Read the queue and put predecessors into it: (of the type looked for, suffixes, carried, LMS) in order.

    A key is even for suffixes of the type looked for and odd for seeds, which come after them.  Of the rows at the head,
    those are read whose keys no predecessor of the rows before them goes below.
    """
    since = np.full(text.top + 1, -1, np.int64) if carry else None  # least common prefix since a symbol was put
    look, last = queue.rows, None
    while (head := queue.head()) is not None:
        key, suffixes, carried = (a[:look] for a in head)
        key = key.astype(np.int64)
        own, even, before = symbol_of(key), key % 2 == 0, suffixes - 1
        symbol = text[np.maximum(before, 0)].astype(np.int64)
        put = (before >= 0) & wanted(symbol, own, even)
        new_key = np.where(put, key_of(symbol), _NONE)
        unsafe = key[1:] > np.minimum.accumulate(new_key)[:-1]
        n = 1 + int(unsafe.argmax()) if unsafe.any() else len(key)
        look = min(max(256, 2 * n), queue.rows)
        key, own, even, suffixes, carried, before, symbol, put, new_key = (a[:n] for a in (key, own, even, suffixes, carried, before, symbol, put, new_key))
        kind = carried.dtype
        if carry:
            carried = carried.astype(np.int64)
            was = np.concatenate([[-1] if last is None else last[:1], key[:-1]])
            # the first seed after suffixes of the same symbol
            seam = np.flatnonzero((key % 2 == 1) & (was == key - 1))
            if len(seam):
                ahead = np.concatenate([[0] if last is None else last[1:], suffixes[:-1]])
                carried[seam] = text.same(ahead[seam], suffixes[seam], gap=GAP)
            last = np.array([key[-1], suffixes[-1]])
        lms = even & (before >= 0) & ~put
        queue.advance(n)
        rows = np.flatnonzero(put)
        if len(rows):
            if carry:
                rows = rows[np.argsort(symbol[rows], kind="stable")]
                child = _common(carried, rows, symbol[rows], since).astype(kind)
            else:
                child = carried[rows]
            queue.put(new_key[rows], before[rows], child)
        elif carry:
            np.minimum(since, carried.min(), out=since)
        yield even, suffixes, carried.astype(kind) if carry else carried, lms


def _common(carried: np.ndarray, order: np.ndarray, symbol: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Common prefixes of new rows, sorted by symbol and made from these places, with the one of their symbol before them."""
    out = np.zeros(len(order), np.int64)
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    stop = np.append(first[1:], len(order))
    lowered = np.minimum(since, carried.min())
    for a, b in zip(first.tolist(), stop.tolist()):
        at, c = order[a:b], symbol[a]
        out[a] = min(since[c], carried[: at[0] + 1].min())
        if b - a > 1:
            out[a + 1 : b] = np.minimum.reduceat(carried[: at[-1] + 1], at[:-1] + 1)
        lowered[c] = carried[at[-1] + 1 :].min() if at[-1] + 1 < len(carried) else _NONE
    since[:] = lowered
    return np.where(symbol == GAP, 0, out + 1)


def names_of(text: Text, lms: Stored) -> tuple[Stream, Text | None]:
    """LMS suffixes by number, from the last to the first substring, and the string of names unless all differ."""
    def seeds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for begin, places in lms.blocks():
            yield places, np.arange(begin, begin + len(places)).astype(lms.kind)

    order, by_place = Stream(text.store), Queue(text.store, lms.n)
    name, last = -1, None
    for suffixes, following, is_lms in induce(text, seeds(), False):
        places, following = suffixes[is_lms], following[is_lms]
        if not len(places):
            continue
        size = lms[following] - places + 1
        ahead, ahead_size = (np.append(v, x[:-1]) for v, x in zip(last or (places[:1], [-1]), (places, size)))
        new = size != ahead_size
        check = np.flatnonzero(~new)
        new[check] = text.same(ahead[check], places[check], size[check]) < size[check]
        names = name + np.cumsum(new)
        name, last = int(names[-1]), (places[-1:], size[-1:])
        order.append(following - 1)
        by_place.put(following - 1, names)
    if name + 1 == order.rows:
        return order, None
    reduced = Text(text.store, np.int32 if name < 1 << 30 else np.int64)
    for _, names in by_place.drain():
        reduced.append(name + 1 - names)
    return order, reduced.close()


def ranks(names: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling: for strings of names that are short at last."""
    step, rank = 1, np.unique(names, return_inverse=True)[1].astype(np.int64)
    while rank.max() + 1 < len(rank):
        after = np.append(rank[step:], np.full(min(step, len(rank)), -1)) + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
        step *= 2
    return rank


def descending(text: Text, carry: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffix, common prefix with the next larger one) of all suffixes, from the last to the first; the end is left out.

    With ``carry`` False there are no common prefixes.  Symbols are from 2 on; GAP stands between strings, and a common prefix ends there.
    """
    if not carry and text.n <= min(BASE, text.store.memory // 64):
        yield np.argsort(ranks(text[np.arange(text.n)]))[:0:-1], np.zeros(text.n - 1, np.int32)
        return
    lms = lms_places(text)
    order, reduced = names_of(text, lms)
    if reduced is not None:
        order.drop()
        order = Stream(text.store)
        for numbers, _ in descending(reduced, False):
            order.append(numbers)
        reduced.drop()

    def seeds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.array([text.n - 1], lms.kind), np.zeros(1, np.int32)
        ahead = None
        for (numbers,) in order.backward():
            places = lms[numbers]
            if carry:
                before = places[:0] if ahead is None else ahead
                common = text.same(np.append(before, places[:-1]), places[1 - len(before) :], gap=GAP)
                yield places, np.append(np.zeros(1 - len(before)), common).astype(np.int32)
                ahead = places[-1:]
            else:
                yield places, np.zeros(len(places), np.int32)

    for suffixes, common, _ in induce(text, seeds(), carry):
        yield suffixes, common
    lms.drop()
