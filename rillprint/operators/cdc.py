"""Content-defined chunking by gear fingerprints.

The low m bits of a fingerprint depend on the last m bytes alone, so where min_size is at least as large as the harder
mask, the possible cuts of all bytes are found at once, and chunks are picked from those.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

# The seed of the gear table (cuts are the same only with the same table) and the default sizes.
GEAR_SEED = b"uhc-gear-table-"
MIN_SIZE, AVG_SIZE, MAX_SIZE = 2048, 8192, 65536


def gear_table() -> list[int]:
    """256 numbers of 64 bits: the first 8 bytes, lowest first, of SHA-256 of seed and index (2 bytes, highest first)."""
    return [int.from_bytes(hashlib.sha256(GEAR_SEED + i.to_bytes(2, "big")).digest()[:8], "little") for i in range(256)]


GEAR = np.array(gear_table(), np.uint64)


@dataclass(frozen=True)
class ChunkSpec:
    """Sizes of chunks; the average is brought between the least and the greatest."""

    min_size: int = MIN_SIZE
    avg_size: int = AVG_SIZE
    max_size: int = MAX_SIZE

    def __post_init__(self):
        if self.min_size < 1 or self.max_size < self.min_size:
            raise ValueError("chunk sizes need 1 <= min_size <= max_size")
        object.__setattr__(self, "avg_size", min(max(self.avg_size, self.min_size), self.max_size))

    @property
    def bits(self) -> int:
        return self.avg_size.bit_length() - 1

    @property
    def hard(self) -> int:
        """Mask before the average size."""
        return (1 << (self.bits + 1)) - 1

    @property
    def easy(self) -> int:
        """Mask from the average size on."""
        return (1 << max(self.bits - 1, 1)) - 1


def _fingerprints(data: bytes, bits: int) -> np.ndarray:
    """Of the last ``bits`` bytes or more at each place, by doubling the bytes taken in."""
    f, width = GEAR[np.frombuffer(data, np.uint8)], 1
    while width < bits:
        f[width:] = f[width:] + (f[:-width] << np.uint64(width))
        width *= 2
    return f


def cut_points(data: bytes, spec: ChunkSpec = ChunkSpec()) -> list[int]:
    """Ends of the chunks, the last one being len(data); none of no bytes."""
    n, cuts, start = len(data), [], 0
    if n and spec.min_size < spec.bits + 1:
        return _cut_in_turn(data, spec)
    if n > spec.min_size:
        f = _fingerprints(data, spec.bits + 1)
        hard = np.flatnonzero(f & np.uint64(spec.hard) == 0) + 1
        easy = np.flatnonzero(f & np.uint64(spec.easy) == 0) + 1
    while start < n:
        end = min(start + spec.max_size, n)
        cut = end
        if end - start > spec.min_size:
            # the first cut by the harder mask that leaves min_size bytes but fewer than avg_size, else by the easier one
            k = np.searchsorted(hard, start + spec.min_size)
            if k < len(hard) and hard[k] < start + spec.avg_size and hard[k] <= end:
                cut = int(hard[k])
            else:
                k = np.searchsorted(easy, start + spec.avg_size)
                if k < len(easy) and easy[k] <= end:
                    cut = int(easy[k])
        cuts.append(cut)
        start = cut
    return cuts


def _cut_in_turn(data: bytes, spec: ChunkSpec) -> list[int]:
    """The same with a fingerprint that begins anew in each chunk, for chunks shorter than the mask."""
    cuts, start, n, gear = [], 0, len(data), GEAR.tolist()
    while start < n:
        end = min(start + spec.max_size, n)
        cut, f = end, 0
        if end - start > spec.min_size:
            for place in range(start, end):
                f, size = ((f << 1) + gear[data[place]]) & 0xFFFFFFFFFFFFFFFF, place - start + 1
                if size >= spec.min_size and not f & (spec.hard if size < spec.avg_size else spec.easy):
                    cut = place + 1
                    break
        cuts.append(cut)
        start = cut
    return cuts


def chunks(data: bytes, spec: ChunkSpec = ChunkSpec()) -> list[bytes]:
    cuts = cut_points(data, spec)
    return [data[a:b] for a, b in zip([0, *cuts], cuts)]
