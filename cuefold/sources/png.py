"""PNG bytes of 8-bit RGB images."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(rgb: np.ndarray) -> bytes:
    """A height x width x 3 array of bytes, rows without filter."""
    height, width, _ = rgb.shape
    rows = np.zeros((height, 1 + width * 3), np.uint8)
    rows[:, 1:] = rgb.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """The array of an image that :func:`encode` wrote; a broken one raises ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, b"", None
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("bad checksum")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if size is None:
        raise ValueError("no header")
    width, height = size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * 3)[:, 1:].reshape(height, width, 3)
