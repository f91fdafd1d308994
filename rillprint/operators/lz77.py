"""LZ77 operations: decoding, greedy encoding, checks.

A back-reference to before the start of the output raises ValueError wherever operations are read.
"""

from __future__ import annotations

from ..sources.streams import Op


def decode(ops: list[Op]) -> bytes:
    """The bytes that operations stand for; an overlapping reference repeats its own output."""
    out = bytearray()
    for op in ops:
        if isinstance(op, bytes):
            out += op
            continue
        distance, length = op
        check(distance, length, len(out))
        start = len(out) - distance
        if distance >= length:
            out += out[start : start + length]
        else:
            out += (bytes(out[start:]) * (length // distance + 1))[:length]
    return bytes(out)


def check(distance: int, length: int, decoded: int) -> None:
    if distance < 1 or length < 1:
        raise ValueError("distance and length are at least 1")
    if distance > decoded:
        raise ValueError(f"distance {distance} exceeds decoded length {decoded}")


def encode(data: bytes, min_match: int = 3, max_match: int = 258, window: int = 32768) -> list[Op]:
    """Greedy parse: at each place the longest match, the farthest of equals."""
    out: list[Op] = []
    run, where, at, n = bytearray(), {}, 0, len(data)
    while at < n:
        best, distance = 0, 0
        most = min(max_match, n - at)
        if most >= min_match:
            key = data[at : at + min_match]
            starts = where.get(key, [])
            drop = 0
            for start in starts:
                if start < at - window:
                    drop += 1
                    continue
                if best and data[start + best] != data[at + best]:
                    continue
                k = min_match
                while k < most and data[start + k] == data[at + k]:
                    k += 1
                if k > best:
                    best, distance = k, at - start
                    if k == most:
                        break
            del starts[:drop]
        step = best or 1
        if best:
            if run:
                out.append(bytes(run))
                run.clear()
            out.append((distance, best))
        else:
            run.append(data[at])
        for p in range(at, min(at + step, n - min_match + 1)):
            where.setdefault(data[p : p + min_match], []).append(p)
        at += step
    if run:
        out.append(bytes(run))
    return out


def token_count(ops: list[Op]) -> int:
    return sum(len(op) if isinstance(op, bytes) else 1 for op in ops)
