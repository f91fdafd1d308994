"""The formats and their readers."""

from __future__ import annotations

from collections.abc import Callable

from .archives import zip_ops
from .deflate import deflate_ops, gzip_ops
from .lz4 import lz4_block_ops, lz4_frame_ops
from .streams import Op
from .zstd import zstd_ops

READERS: dict[str, Callable[[bytes], list[Op]]] = {
    "raw": lambda data: [data] if data else [],
    "deflate": deflate_ops,
    "gzip": gzip_ops,
    "zip": zip_ops,
    "lz4_block": lz4_block_ops,
    "lz4_frame": lz4_frame_ops,
    "zstd": zstd_ops,
}
FORMATS = tuple(READERS)


def extract(data: bytes, fmt: str) -> list[Op]:
    if fmt not in READERS:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
    return READERS[fmt](data)
