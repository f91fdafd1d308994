"""Hash arithmetic on bytes and numbers for Arrow functions: numpy for M61, Python numbers for other primes."""

from __future__ import annotations

import functools

import numpy as np

from ..spec import M61, HashSpec

_M, _LOW = np.uint64(M61), np.uint64((1 << 31) - 1)
BLOCK = 1 << 17  # bytes hashed at a time; numpy holds about 60 bytes for each


def phi(q: int, alpha: int, prime: int) -> int:
    """1 + alpha + ... + alpha**(q - 1) modulo the prime, by halving q, without inverses."""
    if q < 0:
        raise ValueError("a repeat count is not negative")
    total, power = 0, 1  # of the bits of q read so far: the sum, and alpha to their number
    for bit in bin(q)[2:]:
        total = total * (1 + power) % prime
        power = power * power % prime
        if bit == "1":
            total = (total * alpha + 1) % prime
            power = power * alpha % prime
    return total


def concat(a: int, b: int, len_b: int, base: int, prime: int) -> int:
    return (a * pow(base, len_b, prime) + b) % prime


def repeat(h: int, length: int, q: int, base: int, prime: int) -> int:
    return h * phi(q, pow(base, length, prime), prime) % prime


def overlap(h: int, d: int, length: int, h_rest: int, base: int, prime: int) -> int:
    """Of the first ``length`` bytes of a period of d bytes with hash h, whose first length % d bytes have h_rest."""
    q, r = divmod(length, d)
    return concat(repeat(h, d, q, base, prime), h_rest, r, base, prime)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod 2**61 - 1 for arrays below that."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    middle = al * bh + ah * bl
    total = ((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + al * bl
    total = (total & _M) + (total >> np.uint64(61))
    return np.where(total >= _M, total - _M, total)


@functools.lru_cache(maxsize=16)
def _powers61(x: int, size: int) -> np.ndarray:
    out, n = np.ones(size, np.uint64), 1
    while n < size:  # the first n powers times x**n are the next n
        more = min(n, size - n)
        out[n : n + more] = mul61(out[:more], np.full(more, np.uint64(pow(x, n, M61))))
        n += more
    return out


def _group(base: int) -> int:
    """Bytes whose polynomial stays below 2**61 without reduction."""
    k = 1
    while k < 8 and 257 * sum(base**i for i in range(k + 1)) < M61:
        k += 1
    return k


def _hash61(parts: list[bytes], base: int) -> list[int]:
    """Hashes of many strings, about BLOCK bytes at a time; a longer string is joined from its pieces."""
    out, some, size = [], [], 0
    for p in parts:
        if some and (size + len(p) > BLOCK or len(some) == BLOCK >> 3):  # a short string takes a group of bytes too
            out += _block61(some, base).tolist()
            some, size = [], 0
        if len(p) > BLOCK:
            h = 0
            for at in range(0, len(p), BLOCK):
                piece = p[at : at + BLOCK]
                h = concat(h, int(_block61([piece], base)[0]), len(piece), base, M61)
            out.append(h)
        else:
            some.append(p)
            size += len(p)
    return out + _block61(some, base).tolist()


def _block61(parts: list[bytes], base: int) -> np.ndarray:
    """Hashes of strings held at once: groups of bytes first, then their powers and a sum for each string."""
    out = np.zeros(len(parts), np.uint64)
    some = [i for i, p in enumerate(parts) if p]
    if not some:
        return out
    g = _group(base)
    # a zero byte would count as 1, so strings are filled up with what counts as nothing, at their start
    counts = np.array([-(-len(parts[i]) // g) for i in some])
    sizes = np.array([len(parts[i]) for i in some])
    values = np.zeros(int(counts.sum()) * g, np.uint64)
    flat = np.frombuffer(b"".join(parts[i] for i in some), np.uint8)
    ends = np.cumsum(counts) * g
    values[np.arange(len(flat)) + np.repeat(ends - np.cumsum(sizes), sizes)] = flat.astype(np.uint64) + np.uint64(1)
    groups = values.reshape(-1, g) @ np.array([base**i for i in range(g - 1, -1, -1)], np.uint64)
    power = _powers61(pow(base, g, M61), 1 << int(counts.max() - 1).bit_length() if counts.max() > 1 else 1)
    left = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(len(groups))
    terms = mul61(groups, power[left])
    starts = np.cumsum(counts) - counts
    high, low = np.add.reduceat(terms >> np.uint64(31), starts), np.add.reduceat(terms & _LOW, starts)
    out[some] = [((int(h) << 31) + int(lo)) % M61 for h, lo in zip(high, low)]
    return out


def hash_many(parts: list[bytes], base: int, prime: int = M61) -> list[int]:
    """H of each string."""
    if prime == M61:
        return _hash61(parts, base)
    out = []
    for p in parts:
        h = 0
        for c in p:
            h = (h * base + c + 1) % prime
        out.append(h)
    return out


def hash_bytes(data: bytes, base: int, prime: int = M61) -> int:
    return hash_many([data], base, prime)[0]


def prefix_hashes(data: bytes, base: int, prime: int = M61) -> list[int]:
    """H of each prefix, the empty one first."""
    out, h = [0], 0
    for c in data:
        h = (h * base + c + 1) % prime
        out.append(h)
    return out


def substring_hash(prefixes: list[int], start: int, length: int, base: int, prime: int = M61) -> int:
    return (prefixes[start + length] - prefixes[start] * pow(base, length, prime)) % prime if length else 0


def as_binary(h: int) -> bytes:
    return h.to_bytes(16, "big")


def column_value(h: int, spec: HashSpec) -> int | bytes:
    return h if spec.is_long else as_binary(h)


def value_of(h: int | bytes) -> int:
    """The number in a hash column's value."""
    return h if isinstance(h, int) else int.from_bytes(h, "big")
