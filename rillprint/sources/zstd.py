"""Zstandard frames (RFC 8878) to LZ77 operations."""

from __future__ import annotations

import functools

from .streams import HighBits, LowBits, Op, Out, StreamError

# Fixed values of RFC 8878: magic numbers, code tables and default distributions.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_MAGIC = 0x184D2A50  # to 0x184D2A5F
LITERAL_BASE = [*range(16), 16, 18, 20, 22, 24, 28, 32, 40, 48, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536]
LITERAL_BITS = [0] * 16 + [1, 1, 1, 1, 2, 2, 3, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
MATCH_BASE = [*range(3, 35), 35, 37, 39, 41, 43, 47, 51, 59, 67, 83, 99, 131, 259, 515, 1027, 2051, 4099, 8195, 16387, 32771, 65539]
MATCH_BITS = [0] * 32 + [1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
LITERAL_DEFAULT = (6, (4, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 2, 1, 1, 1, 1, 1, -1, -1, -1, -1))
MATCH_DEFAULT = (6, (1, 4, 3, 2, 2, 2, 2, 2, 2, *[1] * 37, -1, -1, -1, -1, -1, -1, -1))
OFFSET_DEFAULT = (5, (1, 1, 1, 1, 1, 1, 2, 2, 2, *[1] * 15, -1, -1, -1, -1, -1))
FIRST_OFFSETS = [1, 4, 8]


@functools.lru_cache(maxsize=64)
def fse_table(log: int, counts: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, bits, base) of each state."""
    size = 1 << log
    symbols, high = [0] * size, size - 1
    for symbol, n in enumerate(counts):
        if n == -1:
            symbols[high] = symbol
            high -= 1
    place, step = 0, (size >> 1) + (size >> 3) + 3
    for symbol, n in enumerate(counts):
        for _ in range(max(n, 0)):
            symbols[place] = symbol
            place = (place + step) % size
            while place > high:
                place = (place + step) % size
    if place:
        raise StreamError("a distribution does not fill its table")
    turn, table = [1 if n == -1 else n for n in counts], []
    for symbol in symbols:
        n = turn[symbol]
        turn[symbol] += 1
        bits = log - n.bit_length() + 1
        table.append((symbol, bits, (n << bits) - size))
    return table


def read_distribution(data: bytes, start: int, most_log: int) -> tuple[int, tuple[int, ...], int]:
    """(accuracy log, counts, where it ends)."""
    bits = LowBits(data, start)
    log = bits.take(4) + 5
    if log > most_log:
        raise StreamError("a distribution is too fine")
    left, counts = 1 << log, []
    while left > 0:
        width = (left + 1).bit_length()
        low, spare = (1 << (width - 1)) - 1, (1 << width) - 2 - left
        value = bits.peek(width)
        if value & low < spare:
            value &= low
            bits.skip(width - 1)
        else:
            value -= spare if value > low else 0
            bits.skip(width)
        counts.append(value - 1)
        left -= abs(value - 1)
        if value == 1:
            while True:
                zeros = bits.take(2)
                counts += [0] * zeros
                if zeros < 3:
                    break
    if left < 0 or len(counts) > 256:
        raise StreamError("a distribution is not valid")
    return log, tuple(counts), (bits.at + 7) >> 3


def huffman_table(weights: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """(bits to look at, (symbol, bits) by them) from all weights but the last."""
    total = sum(1 << w >> 1 for w in weights)
    if not total:
        raise StreamError("a Huffman tree has no weights")
    most = total.bit_length()
    rest = (1 << most) - total
    if rest & (rest - 1) or most > 11:
        raise StreamError("a Huffman tree is not complete")
    weights = [*weights, rest.bit_length()]
    table = []
    for w in range(1, most + 1):
        for symbol, own in enumerate(weights):
            if own == w:
                table += [(symbol, most + 1 - w)] * (1 << w >> 1)
    return most, table


def read_huffman(data: bytes, at: int) -> tuple[tuple[int, list[tuple[int, int]]], int]:
    head, at = data[at], at + 1
    if head >= 128:
        n = head - 127
        end = at + (n + 1) // 2
        weights = [w for b in data[at:end] for w in (b >> 4, b & 15)][:n]
        if len(weights) < n:
            raise StreamError("a Huffman tree is cut off")
        return huffman_table(weights), end
    end = at + head
    log, counts, begin = read_distribution(data[:end], at, 6)
    table, bits, weights = fse_table(log, counts), HighBits(data[begin:end]), []
    states = [bits.take(log), bits.take(log)]
    turn = 0
    while True:
        symbol, n, base = table[states[turn]]
        weights.append(symbol)
        if bits.left < n:
            weights.append(table[states[1 - turn]][0])
            break
        states[turn] = base + bits.take(n)
        turn = 1 - turn
        if len(weights) > 255:
            raise StreamError("a Huffman tree has too many weights")
    return huffman_table(weights), end


def huffman_stream(data: bytes, n: int, tree: tuple[int, list[tuple[int, int]]]) -> bytes:
    bits, (most, table), out = HighBits(data), tree, bytearray()
    word, held = 0, 0
    for _ in range(n):
        if held < most:
            word = word << 48 | bits.peek(48)
            bits.left -= 48
            held += 48
        symbol, used = table[word >> held - most]
        out.append(symbol)
        held -= used
        word &= (1 << held) - 1
    if bits.left + held:
        raise StreamError("a literal stream does not end where it should")
    return bytes(out)


class Frame:
    """What blocks of a frame hand on: Huffman tree, tables and last offsets."""

    def __init__(self):
        self.tree, self.tables, self.offsets = None, [None, None, None], list(FIRST_OFFSETS)

    def literals(self, data: bytes) -> tuple[bytes, int]:
        """The literals of a block and where its sequences begin."""
        kind, form = data[0] & 3, data[0] >> 2 & 3
        if kind < 2:
            size, shift = ((1, 3), (2, 4), (1, 3), (3, 4))[form]
            n = int.from_bytes(data[:size], "little") >> shift
            body = data[size : size + (n if kind == 0 else 1)]
            if len(body) < (n if kind == 0 else 1):
                raise StreamError("literals are cut off")
            return (body, size + n) if kind == 0 else (body * n, size + 1)
        size, width = ((3, 10), (3, 10), (4, 14), (5, 18))[form]
        head = int.from_bytes(data[:size], "little") >> 4
        n, packed = head & ((1 << width) - 1), head >> width
        end = size + packed
        if end > len(data):
            raise StreamError("literals are cut off")
        at = size
        if kind == 2:
            self.tree, at = read_huffman(data[:end], at)
        if self.tree is None:
            raise StreamError("no Huffman tree to use again")
        if form == 0:
            return huffman_stream(data[at:end], n, self.tree), end
        sizes = [int.from_bytes(data[at + k : at + k + 2], "little") for k in (0, 2, 4)]
        at, each, parts = at + 6, (n + 3) // 4, []
        for k in range(4):
            stop = at + sizes[k] if k < 3 else end
            parts.append(huffman_stream(data[at:stop], each if k < 3 else n - 3 * each, self.tree))
            at = stop
        return b"".join(parts), end

    def table(self, slot: int, mode: int, data: bytes, at: int, default: tuple, most_log: int) -> int:
        if mode == 0:
            self.tables[slot] = (default[0], fse_table(*default))
        elif mode == 1:
            self.tables[slot] = (0, [(data[at], 0, 0)])
            at += 1
        elif mode == 2:
            log, counts, at = read_distribution(data, at, most_log)
            self.tables[slot] = (log, fse_table(log, counts))
        elif self.tables[slot] is None:
            raise StreamError("no table to use again")
        return at

    def offset(self, value: int, no_literals: bool) -> int:
        """The distance that an offset value stands for; the last three distances move on."""
        last = self.offsets
        if value > 3:
            found, k = value - 3, 2
        else:
            k = value - 1 + no_literals
            found = last[k] if k < 3 else last[0] - 1
        if found < 1:
            raise StreamError("an offset is zero")
        if k:
            self.offsets = [found, last[0], last[1] if k > 1 else last[2]]
        return found

    def block(self, data: bytes, out: Out) -> None:
        if not data:
            raise StreamError("a block is empty")
        literals, at = self.literals(data)
        if at >= len(data):
            raise StreamError("a block has no sequences")
        n = data[at]
        if n == 0:
            out.literals(literals)
            return
        if n < 128:
            at += 1
        elif n < 255:
            n, at = ((n - 128) << 8) + data[at + 1], at + 2
        else:
            n, at = int.from_bytes(data[at + 1 : at + 3], "little") + 0x7F00, at + 3
        modes, at = data[at], at + 1
        at = self.table(0, modes >> 6, data, at, LITERAL_DEFAULT, 9)
        at = self.table(1, modes >> 4 & 3, data, at, OFFSET_DEFAULT, 8)
        at = self.table(2, modes >> 2 & 3, data, at, MATCH_DEFAULT, 9)
        bits = HighBits(data[at:])
        (ll_log, ll), (of_log, of), (ml_log, ml) = self.tables
        a, b, c = bits.take(ll_log), bits.take(of_log), bits.take(ml_log)
        ops, pending = out.ops, out.run
        used, most = 0, len(literals)
        word, held = 0, 0  # the next bits
        for k in range(n):
            literal_code, ll_width, ll_base = ll[a]
            offset_code, of_width, of_base = of[b]
            match_code, ml_width, ml_base = ml[c]
            match_bits, literal_bits = MATCH_BITS[match_code], LITERAL_BITS[literal_code]
            while held < offset_code + match_bits + literal_bits + 27:  # and 9, 9 and 8 for the next states
                word = word << 64 | bits.peek(64)
                bits.left -= 64
                held += 64
            held -= offset_code
            value = (1 << offset_code) + (word >> held)
            word &= (1 << held) - 1
            length = MATCH_BASE[match_code]
            if match_bits:
                held -= match_bits
                length += word >> held
                word &= (1 << held) - 1
            run = LITERAL_BASE[literal_code]
            if literal_bits:
                held -= literal_bits
                run += word >> held
                word &= (1 << held) - 1
            if run:
                if used + run > most:
                    raise StreamError("a sequence wants more literals than there are")
                pending += literals[used : used + run]
                used += run
            if pending:
                ops.append(bytes(pending))
                pending.clear()
            ops.append((self.offset(value, run == 0), length))
            if k < n - 1:
                held -= ll_width
                a = ll_base + (word >> held)
                word &= (1 << held) - 1
                held -= ml_width
                c = ml_base + (word >> held)
                word &= (1 << held) - 1
                held -= of_width
                b = of_base + (word >> held)
                word &= (1 << held) - 1
        if bits.left + held:
            raise StreamError("a block's sequences do not end where they should")
        out.literals(literals[used:])


def _frame_into(data: bytes, at: int, out: Out) -> int:
    """The frame whose magic number ends at ``at``; where it ends."""
    if at >= len(data):
        raise StreamError("the frame header is cut off")
    flags, at = data[at], at + 1
    single = flags >> 5 & 1
    at += not single
    at += (0, 1, 2, 4)[flags & 3]
    at += (single, 2, 4, 8)[flags >> 6]
    frame, last = Frame(), False
    while not last:
        if at + 3 > len(data):
            raise StreamError("a block header is cut off")
        head, at = int.from_bytes(data[at : at + 3], "little"), at + 3
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise StreamError("block type 3 is reserved")
        body = data[at : at + (1 if kind == 1 else size)]
        if len(body) < (1 if kind == 1 else size):
            raise StreamError("a block is cut off")
        if kind == 2:
            try:
                frame.block(body, out)
            except IndexError as e:
                raise StreamError("a block is cut off") from e
        else:
            out.literals(body if kind == 0 else body * size)
        at += len(body)
    return at + 4 * (flags >> 2 & 1)


def zstd_ops(data: bytes, all_frames: bool = False) -> list[Op]:
    """Operations of the first frame, or of all; none where there are fewer than four bytes or a skippable frame comes first."""
    out, at = Out(), 0
    while at + 4 <= len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if not all_frames:
                break
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if magic != FRAME_MAGIC:
            raise StreamError("no Zstandard frame")
        at = _frame_into(data, at + 4, out)
        if not all_frames:
            break
    return out.done()
