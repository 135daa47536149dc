"""Arrays of numbers and lists of byte strings as small byte strings."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import zstandard

LEVEL = 5


def _planes(x: np.ndarray) -> np.ndarray:
    """The lowest bytes of all numbers, then the next ones: high bytes, put together, are mostly zeros."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(_planes(x)).tobytes())


def unpacked(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_ranks(x: np.ndarray) -> bytes:
    """Numbers of which most are small: one byte each, and those from 255 on behind."""
    head = zstandard.ZstdCompressor(level=LEVEL).compress(np.minimum(x, 255).astype(np.uint8).tobytes())
    return len(head).to_bytes(8, "little") + head + packed(x[x >= 255].astype(np.uint32))


def unpacked_ranks(x: bytes) -> np.ndarray:
    n = 8 + int.from_bytes(x[:8], "little")
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[8:n]), np.uint8).astype(np.uint32)
    out[out == 255] = unpacked(x[n:], np.uint32)
    return out


def packed_words(words: list[bytes]) -> bytes:
    sizes = packed(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(words))


def unpacked_words(x: bytes) -> list[bytes]:
    n = 4 + int.from_bytes(x[:4], "little")
    ends = np.cumsum(unpacked(x[4:n], np.uint32), dtype=np.int64).tolist()
    raw = zstandard.ZstdDecompressor().decompress(x[n:])
    return [raw[a:b] for a, b in pairwise([0, *ends])]
