"""Hashes of decoded content straight from LZ77 operations, by three strategies.

``prefix`` keeps the hash of every prefix; ``rope`` keeps only segments, as large as the operations, and never makes the decoded bytes; ``sliding`` keeps
a bounded window of them.  All raise ValueError for a reference to before the start, and all give H(decode(ops)).
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

from ..functions import kernels as K
from ..sources.streams import Op
from ..spec import HashSpec
from .lz77 import check

METHODS = ("prefix", "rope", "sliding")
#: Largest distance and match length of each format; the sliding strategy's window is their sum.
WINDOWS = {"raw": (1, 1), "deflate": (32768, 258), "gzip": (32768, 258), "zip": (32768, 258), "lz4_block": (65535, 65536), "lz4_frame": (65535, 65536), "zstd": (1 << 27, 131074)}


def _prefix(ops: list[Op], base: int, prime: int) -> int:
    """All prefix hashes, 8 bytes each below 2**64.

    After k bytes of a reference the hash is that of the output before it, less that of the output before its source, times
    base**k, plus that of the source's prefix; a turn of the period is added at a time, so that each has its source.
    """
    hashes = array("Q", [0]) if prime < 1 << 64 else [0]
    powers = Powers(base, prime)
    for op in ops:
        h = hashes[-1]
        if isinstance(op, bytes):
            for c in op:
                h = (h * base + c + 1) % prime
                hashes.append(h)
            continue
        distance, length = op
        n = len(hashes) - 1
        check(distance, length, n)
        done = 0
        while done < length:
            turn = min(distance, length - done)
            at = len(hashes) - 1
            shift = hashes[at] - hashes[at - distance]
            hashes.extend([(shift * w + x) % prime for w, x in zip(powers.to(turn), hashes[at - distance + 1 : at - distance + turn + 1])])
            done += turn
    return hashes[-1]


class Powers:
    """Powers of a base; those to KEPT are made once."""

    KEPT = 1024

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.kept = base, prime, [1]

    def to(self, n: int) -> list[int]:
        """base**1 to base**n."""
        kept = self.kept if n < self.KEPT else list(self.kept)
        while len(kept) <= n:
            kept.append(kept[-1] * self.base % self.prime)
        return kept[1 : n + 1]

    def __getitem__(self, n: int) -> int:
        if n >= self.KEPT:
            return pow(self.base, n, self.prime)
        while len(self.kept) <= n:
            self.kept.append(self.kept[-1] * self.base % self.prime)
        return self.kept[n]


class Segments:
    """Output as segments: literal runs as they are, and references to earlier output, with the hash of all before each.

    The hash of the first t bytes of the output is that of the whole segments before t and of a part of one.  A part of a run is
    hashed from the last of its marks, one every STEP bytes.  A part of a reference leads to the prefix that ends in its source,
    which may end in a reference again; at most about KNOWN prefixes found on the way are remembered.
    """

    STEP, RUN, KNOWN = 64, 1 << 16, 1 << 16
    READY = 64  # powers below this are there from the start

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.powers = base, prime, Powers(base, prime)
        self.powers.to(self.READY - 1)
        self.kept, self.ready = self.powers.kept, self.READY
        self.starts, self.parts, self.before = [], [], [0]  # before: hash of all segments before each
        self.length, self.known, self.marks = 0, {}, {}

    def literals(self, data: bytes) -> None:
        for part in pieces(data, self.RUN):
            self.run(part, K.hash_bytes(part, self.base, self.prime))

    def run(self, data: bytes, h: int) -> None:
        """Literals whose hash is known; at least one."""
        self._add(data, len(data), (self.before[-1] * self.powers[len(data)] + h) % self.prime)

    def copy(self, distance: int, length: int) -> None:
        n = self.length
        if not 1 <= distance <= n or length < 1:
            check(distance, length, n)
        if len(self.known) > self.KNOWN:
            self.known.clear()
        start = n - distance
        shift = self.before[-1] - self.prefix(start)
        if length <= distance and length < self.ready:
            whole = self.prefix(start + length) + shift * self.kept[length]
        else:
            end, more = self._source((start, distance, shift), length)
            whole = self.prefix(end) + more
        self.starts.append(n)
        self.parts.append((start, distance, shift))
        self.before.append(whole % self.prime)
        self.length = n + length

    def _add(self, part, length: int, whole: int) -> None:
        self.starts.append(self.length)
        self.parts.append(part)
        self.before.append(whole)
        self.length += length

    def _source(self, part: tuple[int, int, int], n: int) -> tuple[int, int]:
        """A place in the output before a reference, and what the hash of the output to n bytes of it is above the hash to that place.

        The output to n bytes of a reference is the output before it, in place of that before its source, and then the source's
        n bytes; where these overlap the reference itself, the same holds a distance earlier, and so on.
        """
        start, distance, shift = part
        if n <= distance:
            return start + n, shift * self.powers[n]
        q = -(-n // distance)
        first = n - (q - 1) * distance
        return start + first, shift * self.powers[first] * K.phi(q, self.powers[distance], self.prime)

    def substring(self, start: int, length: int) -> int:
        """H of the output from start; 0 for no bytes."""
        return (self.prefix(start + length) - self.prefix(start) * self.powers[length]) % self.prime if length else 0

    def prefix(self, end: int) -> int:
        """H of the first ``end`` bytes."""
        if end == self.length:
            return self.before[-1]
        known, starts, parts, kept, ready = self.known, self.starts, self.parts, self.kept, self.ready
        h = known.get(end)
        if h is not None:
            return h
        way, t = [], end
        while True:
            k = bisect_right(starts, t) - 1
            n, part = t - starts[k], parts[k]
            if not n:
                h = self.before[k]
                break
            if part.__class__ is bytes:
                h = self._in_run(k, part, n)
                break
            way.append(t)
            start, distance, shift = part
            if n <= distance and n < ready:
                way.append(shift * kept[n])
                t = start + n
            else:
                t, more = self._source(part, n)
                way.append(more)
            h = known.get(t)
            if h is not None:
                break
        prime = self.prime
        for i in range(len(way) - 1, 0, -2):
            h = known[way[i - 1]] = (h + way[i]) % prime
        return h

    def _in_run(self, k: int, run: bytes, n: int) -> int:
        h, at, base, prime = self.before[k], 0, self.base, self.prime
        if n > self.STEP:
            at = n - n % self.STEP
            h = self._marks(k)[n // self.STEP]
        for c in run[at:n] if at or n < len(run) else run:
            h = (h * base + c + 1) % prime
        return h

    def _marks(self, k: int) -> list[int]:
        """Hashes of the output to every STEP bytes of a run, made when first asked for."""
        if k not in self.marks:
            out, power = [self.before[k]], self.powers[self.STEP]
            for h in K.hash_many(list(pieces(self.parts[k], self.STEP)), self.base, self.prime):
                out.append((out[-1] * power + h) % self.prime)
            self.marks[k] = out
        return self.marks[k]

    @property
    def hash(self) -> int:
        return self.before[-1]


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    return (data[at : at + size] for at in range(0, len(data), size))


def _hashed_runs(ops: list[Op], base: int, prime: int) -> Iterator[tuple[bytes, int]]:
    """The literal runs of operations, in pieces, with their hashes, about Segments.RUN bytes hashed at a time."""
    some, size = [], 0
    for op in ops:
        if isinstance(op, bytes):
            for part in pieces(op, Segments.RUN):
                some.append(part)
                size += len(part)
                if size >= Segments.RUN:
                    yield from zip(some, K.hash_many(some, base, prime))
                    some, size = [], 0
    yield from zip(some, K.hash_many(some, base, prime))


def _rope(ops: list[Op], base: int, prime: int) -> int:
    rope, runs = Segments(base, prime), _hashed_runs(ops, base, prime)
    for op in ops:
        if isinstance(op, bytes):
            for _ in range(0, len(op), Segments.RUN):
                rope.run(*next(runs))
        else:
            rope.copy(*op)
    return rope.hash


class SlidingState:
    """A window of the last bytes, and length and hashes of all that has left it.

    The window may grow to d_max + m_max bytes; then the oldest go, so that d_max stay.
    """

    def __init__(self, spec: HashSpec = HashSpec(), d_max: int = 32768, m_max: int = 258):
        if d_max < 1 or m_max < 1:
            raise ValueError("d_max and m_max are at least 1")
        self.spec, self.d_max, self.size = spec, d_max, d_max + m_max
        self.gone, self.hashes, self.window = 0, list(spec.zero), bytearray()

    @property
    def length(self) -> int:
        return self.gone + len(self.window)

    def literals(self, data: bytes) -> None:
        for at in range(0, len(data), self.size):
            self.window += data[at : at + self.size]
            self._evict()

    def copy(self, distance: int, length: int) -> None:
        check(distance, length, self.length)
        if distance > len(self.window):
            raise ValueError(f"distance {distance} exceeds window size {len(self.window)}")
        while length:
            # whole turns of the period at a time, so that a long reference needs no more than a window
            n = min(length, max(distance, self.size - self.size % distance))
            period = bytes(self.window[-distance:])
            self.window += (period * (n // distance + 1))[:n]
            length -= n
            if length and n % distance:
                raise AssertionError("a period was cut")
            self._evict()

    def _evict(self) -> None:
        if len(self.window) > self.size:
            old = bytes(self.window[: -self.d_max])
            self.hashes = [K.concat(h, K.hash_bytes(old, b, self.spec.prime), len(old), b, self.spec.prime) for h, b in zip(self.hashes, self.spec.bases)]
            self.gone += len(old)
            del self.window[: -self.d_max]

    def current(self) -> tuple[int, ...]:
        """Hashes of all bytes so far."""
        own = bytes(self.window)
        return tuple(K.concat(h, K.hash_bytes(own, b, self.spec.prime), len(own), b, self.spec.prime) for h, b in zip(self.hashes, self.spec.bases))


def cdh(ops: list[Op], spec: HashSpec = HashSpec(), method: str = "rope", d_max: int = 32768, m_max: int = 258) -> tuple[int, ...]:
    """The spec's hashes of what the operations decode to."""
    if method == "sliding":
        state = SlidingState(spec, d_max, m_max)
        for op in ops:
            state.literals(op) if isinstance(op, bytes) else state.copy(*op)
        return state.current()
    if method not in METHODS:
        raise ValueError(f"{method} is none of {', '.join(METHODS)}")
    one = _prefix if method == "prefix" else _rope
    return tuple(one(ops, b, spec.prime) for b in spec.bases)
