"""DEFLATE (RFC 1951) and gzip (RFC 1952) streams to LZ77 operations."""

from __future__ import annotations

import functools
import zlib

from .streams import LowBits, Op, Out, StreamError

# Fixed values of RFC 1951: base and extra bits of length codes 257-285 and distance codes 0-29, order of code lengths.
LENGTH_BASE = [3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258]
LENGTH_BITS = [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 0]
DISTANCE_BASE = [1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145, 8193, 12289, 16385, 24577]
DISTANCE_BITS = [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13]
CODE_LENGTH_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]


# The numbers of 15 bits with their bits in the other order.
TURNED = [0]
for _k in range(15):
    TURNED += [x + (1 << 14 - _k) for x in TURNED]


class Codes:
    """A canonical Huffman code as a table by the next bits, lowest first; an entry is (symbol, bits)."""

    def __init__(self, lengths: list[int]):
        self.bits = max(lengths, default=0)
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.bits)
        symbols: list[list[int]] = [[] for _ in range(self.bits + 1)]
        for symbol, n in enumerate(lengths):
            symbols[n].append(symbol)
        code = 0
        for size in range(1, self.bits + 1):
            for symbol in symbols[size]:
                if code >> size:
                    raise StreamError("a Huffman code has too many words")
                self.table[TURNED[code] >> 15 - size :: 1 << size] = [(symbol, size)] * (1 << self.bits - size)
                code += 1
            code <<= 1

    def take(self, bits: LowBits) -> int:
        found = self.table[bits.peek(self.bits)] if self.bits else None
        if found is None:
            raise StreamError("no Huffman word matches")
        bits.skip(found[1])
        return found[0]


@functools.lru_cache(maxsize=1)
def fixed_codes() -> tuple[Codes, Codes]:
    return Codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), Codes([5] * 32)


def _dynamic_codes(bits: LowBits) -> tuple[Codes, Codes]:
    n_literal, n_distance, n_code = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    sizes = [0] * 19
    for place in CODE_LENGTH_ORDER[:n_code]:
        sizes[place] = bits.take(3)
    codes, lengths = Codes(sizes), []
    table, mask, end = codes.table, (1 << codes.bits) - 1, bits.at
    # at most 320 lengths of 14 bits: the word holds them all, zeros after the stream's end
    word = int.from_bytes(bits.data[end >> 3 : (end >> 3) + 640], "little") >> (end & 7)
    while len(lengths) < n_literal + n_distance:
        found = table[word & mask]
        if found is None:
            raise StreamError("no Huffman word matches")
        symbol, n = found
        word >>= n
        end += n
        if symbol < 16:
            lengths.append(symbol)
            continue
        n = (2, 3, 7)[symbol - 16]
        times = (3, 3, 11)[symbol - 16] + (word & ((1 << n) - 1))
        word >>= n
        end += n
        lengths += [lengths[-1] if symbol == 16 and lengths else 0] * times
    bits.skip(end - bits.at)
    return Codes(lengths[:n_literal]), Codes(lengths[n_literal : n_literal + n_distance])


def _coded_block(bits: LowBits, out: Out, literal: Codes, distance: Codes) -> None:
    """A block's symbols, with the next bits held in a number: a symbol takes at most 48 with its distance."""
    data, ops, run = bits.data, out.ops, out.run
    literals, literal_mask = literal.table, (1 << literal.bits) - 1
    distances, distance_mask = distance.table, (1 << distance.bits) - 1
    size, first, from_bytes = len(data), bits.at >> 3, int.from_bytes
    word = from_bytes(data[first : first + 8], "little") >> (bits.at & 7)
    at, held = first + 8, 64 - (bits.at & 7)
    try:
        while True:
            if held < 48:
                if at - (held >> 3) > size:
                    raise StreamError("the stream ends too early")
                word |= from_bytes(data[at : at + 6], "little") << held
                held += 48
                at += 6
            symbol, n = literals[word & literal_mask]
            word >>= n
            held -= n
            if symbol < 256:
                run.append(symbol)
                continue
            if symbol == 256:
                break
            if symbol > 285:
                raise StreamError(f"length code {symbol} is not defined")
            symbol -= 257
            length = LENGTH_BASE[symbol]
            if n := LENGTH_BITS[symbol]:
                length += word & ((1 << n) - 1)
                word >>= n
                held -= n
            code, n = distances[word & distance_mask]
            word >>= n
            if code > 29:
                raise StreamError(f"distance code {code} is not defined")
            extra = DISTANCE_BITS[code]
            held -= n + extra
            if run:
                ops.append(bytes(run))
                run.clear()
            ops.append((DISTANCE_BASE[code] + (word & ((1 << extra) - 1)), length))
            word >>= extra
    except TypeError as e:  # a gap in a table is None
        raise StreamError("no Huffman word matches") from e
    bits.skip(8 * at - held - bits.at)


def deflate_into(bits: LowBits, out: Out) -> None:
    """One raw stream, to the block marked as the last."""
    last = False
    while not last:
        last, kind = bool(bits.take(1)), bits.take(2)
        if kind == 0:
            n, check = (int.from_bytes(bits.bytes_from_here(2), "little") for _ in range(2))
            if n ^ check != 0xFFFF:
                raise StreamError("a stored block's length check fails")
            out.literals(bits.bytes_from_here(n))
        elif kind == 3:
            raise StreamError("block type 3 is reserved")
        else:
            _coded_block(bits, out, *(fixed_codes() if kind == 1 else _dynamic_codes(bits)))


def deflate_ops(data: bytes) -> list[Op]:
    """Operations of a raw DEFLATE stream; bytes after its last block are ignored."""
    out = Out()
    deflate_into(LowBits(data), out)
    return out.done()


def gzip_header_size(data: bytes, start: int = 0) -> int:
    """Where the compressed data of a gzip member begins."""
    if data[start : start + 2] != b"\x1f\x8b":
        raise StreamError("no gzip magic")
    if len(data) < start + 10:
        raise StreamError("the gzip header ends too early")
    if data[start + 2] != 8:
        raise StreamError(f"gzip method {data[start + 2]} is not DEFLATE")
    flags, at = data[start + 3], start + 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for flag in (8, 16):  # a name, a comment
        if flags & flag:
            end = data.find(b"\0", at)
            if end < 0:
                raise StreamError("the gzip header ends too early")
            at = end + 1
    if flags & 2:
        at += 2
    if at > len(data):
        raise StreamError("the gzip header ends too early")
    return at


def gzip_ops(data: bytes, all_members: bool = False, verify_crc: bool = False) -> list[Op]:
    """Operations of a gzip file's first member, or of all; with verify_crc the trailers are checked."""
    out, start = Out(), 0
    while True:
        begin = gzip_header_size(data, start)
        bits, own = LowBits(data, begin), Out()
        deflate_into(bits, own)
        end = (bits.at + 7) >> 3
        ops = own.done()
        if verify_crc:
            from ..operators.lz77 import decode

            content = decode(ops)
            if data[end : end + 8] != zlib.crc32(content).to_bytes(4, "little") + (len(content) & 0xFFFFFFFF).to_bytes(4, "little"):
                raise StreamError("the gzip trailer does not match the content")
        for op in ops:
            out.literals(op) if isinstance(op, bytes) else out.copy(*op)
        start = end + 8
        if not all_members or start >= len(data):
            return out.done()
