"""BLAKE3 in plain Python, from the published description: a hash of 32 bytes over chunks of 1024 in a binary tree."""

from __future__ import annotations

import struct

# Fixed values of BLAKE3: initial words, message order, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
_MASK = 0xFFFFFFFF
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(chain: tuple, words: tuple, counter: int, size: int, flags: int) -> tuple:
    v = [*chain, *IV[:4], counter & _MASK, counter >> 32, size, flags]
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_COLUMNS):
            for word, (r, s) in ((words[2 * k], (16, 12)), (words[2 * k + 1], (8, 7))):
                v[a] = (v[a] + v[b] + word) & _MASK
                x = v[d] ^ v[a]
                v[d] = (x >> r | x << 32 - r) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                x = v[b] ^ v[c]
                v[b] = (x >> s | x << 32 - s) & _MASK
        if turn < 6:
            words = tuple(words[i] for i in ORDER)
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def _chunk(data: bytes, number: int, flags: int) -> tuple:
    chain, blocks = IV, max(1, -(-len(data) // BLOCK))
    for k in range(blocks):
        block = data[k * BLOCK : (k + 1) * BLOCK]
        own = (CHUNK_START if k == 0 else 0) | (CHUNK_END | flags if k == blocks - 1 else 0)
        chain = _compress(chain, struct.unpack("<16I", block.ljust(BLOCK, b"\0")), number, len(block), own)
    return chain


def blake3(data: bytes) -> bytes:
    """The 32-byte hash."""
    n = max(1, -(-len(data) // CHUNK))
    if n == 1:
        return struct.pack("<8I", *_chunk(data, 0, ROOT))
    waiting: list[tuple] = []
    for k in range(n):
        chain = _chunk(data[k * CHUNK : (k + 1) * CHUNK], k, 0)
        done = k + 1
        while done % 2 == 0 and k < n - 1:  # whole subtrees are closed at once
            chain, done = _compress(IV, waiting.pop() + chain, 0, BLOCK, PARENT), done // 2
        waiting.append(chain)
    chain = waiting.pop()
    while waiting:
        chain = _compress(IV, waiting.pop() + chain, 0, BLOCK, PARENT | (ROOT if not waiting else 0))
    return struct.pack("<8I", *chain)
