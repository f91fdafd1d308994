"""LZ77 operations read from compressed streams, without decompressing them.

Every reader takes the bytes of one object and returns its operations in order: a ``bytes`` for a run of
literals, a ``(distance, length)`` for a back-reference.  A malformed stream raises StreamError, a ValueError.
"""

from __future__ import annotations

Op = bytes | tuple[int, int]


class StreamError(ValueError):
    pass


class Out:
    """Operations under construction; neighbouring literals become one run."""

    def __init__(self):
        self.ops: list[Op] = []
        self.run = bytearray()

    def literals(self, data: bytes) -> None:
        self.run += data

    def copy(self, distance: int, length: int) -> None:
        if self.run:
            self.ops.append(bytes(self.run))
            self.run.clear()
        self.ops.append((distance, length))

    def done(self) -> list[Op]:
        if self.run:
            self.ops.append(bytes(self.run))
            self.run = bytearray()
        return self.ops


class LowBits:
    """Bits of a byte string, the lowest of each byte first."""

    def __init__(self, data: bytes, start: int = 0):
        self.data, self.at = data, 8 * start  # in bits

    def peek(self, n: int) -> int:
        """The next n (up to 32) bits, zeros after the end."""
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise StreamError("the stream ends too early")

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value

    def bytes_from_here(self, n: int) -> bytes:
        """n whole bytes from the next byte border."""
        first = (self.at + 7) >> 3
        if first + n > len(self.data):
            raise StreamError("the stream ends too early")
        self.at = 8 * (first + n)
        return self.data[first : first + n]


class HighBits:
    """Bits of a byte string from its end backwards; the highest set bit of the last byte marks where they begin."""

    def __init__(self, data: bytes):
        if not data or not data[-1]:
            raise StreamError("a backward stream has no end mark")
        self.data, self.left = data, 8 * len(data) - 9 + data[-1].bit_length()

    def peek(self, n: int) -> int:
        """The next n bits, zeros after the stream's start."""
        low = self.left - n
        if low < 0:
            return (int.from_bytes(self.data[: (self.left + 7) >> 3], "little") & ((1 << max(self.left, 0)) - 1)) << -low if self.left > 0 else 0
        first = low >> 3
        return (int.from_bytes(self.data[first : first + ((n + 14) >> 3)], "little") >> (low & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek(n)
        self.left -= n
        return value
