"""LZ4 blocks and frames to LZ77 operations."""

from __future__ import annotations

from .streams import Op, Out, StreamError

FRAME_MAGIC = bytes.fromhex("04224d18")  # fixed value of the frame format


def _extended(data: bytes, at: int, n: int) -> tuple[int, int]:
    """A length whose four bits are n, with the bytes that continue it."""
    while n >= 15:
        if at >= len(data):
            raise StreamError("a length goes on past the end")
        n += data[at]
        at += 1
        if data[at - 1] != 255:
            break
    return n, at


def block_into(data: bytes, out: Out) -> None:
    ops, run, size, at = out.ops, out.run, len(data), 0
    while at < size:
        token = data[at]
        n, at = token >> 4, at + 1
        if n == 15:
            n, at = _extended(data, at, n)
        if n:
            if at + n > size:
                raise StreamError("literals go on past the end")
            run += data[at : at + n]
            at += n
        if at == size:
            return
        if at + 2 > size or not (distance := data[at] | data[at + 1] << 8):
            raise StreamError("a match offset is cut off or zero")
        length, at = token & 15, at + 2
        if length == 15:
            length, at = _extended(data, at, length)
        if run:
            ops.append(bytes(run))
            run.clear()
        ops.append((distance, length + 4))


def lz4_block_ops(data: bytes) -> list[Op]:
    """Operations of one block without a size before it; none of no bytes."""
    out = Out()
    block_into(data, out)
    return out.done()


def lz4_frame_ops(data: bytes) -> list[Op]:
    """Operations of the first frame, linked blocks included; checksums are not looked at."""
    if len(data) < 7 or data[:4] != FRAME_MAGIC:
        raise StreamError("no LZ4 frame")
    flags = data[4]
    if flags >> 6 != 1:
        raise StreamError(f"LZ4 frame version {flags >> 6} is not known")
    at, out = 6 + 8 * (flags >> 3 & 1) + 4 * (flags & 1) + 1, Out()
    while True:
        if at + 4 > len(data):
            raise StreamError("the LZ4 frame ends too early")
        size = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if not size:
            return out.done()
        plain, size = size >> 31, size & 0x7FFFFFFF
        if at + size > len(data):
            raise StreamError("an LZ4 block is cut off")
        body = data[at : at + size]
        out.literals(body) if plain else block_into(body, out)
        at += size + 4 * (flags >> 4 & 1)
