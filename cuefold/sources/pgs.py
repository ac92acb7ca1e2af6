"""Bitmap caption streams (PGS): bytes -> display sets with rendered images.

State runs through one stream, so a stream is decoded by one call; streams are
independent.  Rows carry PNG bytes and a hash, never raw pixels.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.sources import png

# Fixed values of the format.
MAGIC, CLOCK = b"PG", 90_000
PALETTE, OBJECT, COMPOSITION, WINDOWS, END = 0x14, 0x15, 0x16, 0x17, 0x80
PADDING, VISIBLE_ALPHA = 24, 8
USABLE_WIDTH, USABLE_HEIGHT = 8, 6
HEAD = struct.Struct(">IIBH")
#: Images a worker remembers, coded; rows and bytes of images in a batch of rows.
REMEMBERED, BATCH_ROWS, BATCH_BYTES = 64, 10_000, 8_000_000


@dataclass
class Part:
    width: int = 0
    height: int = 0
    data: bytearray = field(default_factory=bytearray)
    complete: bool = False


@dataclass
class Composition:
    objects: list[tuple[int, int, int]]
    updates_palette: bool


def segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(clock ticks, type, payload); other bytes are skipped, a cut-off payload ends the stream."""
    at, n = 0, len(data)
    while True:
        at = data.find(MAGIC, at)
        if at < 0 or at + 13 > n:
            return
        pts, _, kind, size = HEAD.unpack_from(data, at + 2)
        end = at + 13 + size
        if end > n:
            return
        yield pts, kind, data[at + 13 : end]
        at = end


def parse_palette(payload: bytes, base: dict[int, tuple] | None) -> dict[int, tuple]:
    """Index to (alpha, r, g, b), colours blended over white; ``base`` is kept where it is given."""
    out = dict(base or {})
    for index, y, cr, cb, alpha in struct.iter_unpack("BBBBB", payload[2 : 2 + (max(0, len(payload) - 2) // 5) * 5]):
        opaque = (y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128))
        blended = [255 + (v - 255) * alpha / 255 for v in opaque]
        out[index] = (alpha, *[min(255, max(0, int(np.floor(v + 0.5)))) for v in blended])
    return out


def parse_composition(payload: bytes) -> Composition | None:
    if len(payload) < 11:
        return None
    at, objects = 11, []
    for _ in range(payload[10]):
        if at + 8 > len(payload):
            break
        ident, _window, flags, x, y = struct.unpack_from(">HBBHH", payload, at)
        objects.append((ident, x, y))
        at += 16 if flags & 0x40 else 8
    return Composition(objects, bool(payload[8] & 0x80))


def add_object(payload: bytes, parts: dict[int, Part]) -> None:
    if len(payload) < 4:
        return
    ident, flags = struct.unpack_from(">H", payload)[0], payload[3]
    if flags & 0x80:
        if len(payload) < 11:
            return
        part = parts[ident] = Part(*struct.unpack_from(">HH", payload, 7))
        part.data += payload[11:]
    elif (part := parts.get(ident)) is not None:
        part.data += payload[4:]
    else:
        return
    part.complete = part.complete or bool(flags & 0x40)


def decode_runs(data: bytes, width: int, height: int) -> np.ndarray:
    """Colour indices of run-length coded pixels; runs go on in the next line."""
    out = np.zeros(width * height, np.uint8)
    # ``x`` may stand at the end of a full line: only the next pixel, not a line end, moves on.
    at, x, y, n = 0, 0, 0, len(data)
    byte = lambda k: data[k] if k < n else 0
    while at < n and y < height:
        color, length = data[at], 1
        at += 1
        if color == 0:
            if at >= n:
                break
            k = data[at]
            at += 1
            if k == 0:
                x, y = 0, y + 1
                continue
            length = k & 0x3F
            if k & 0x40:
                length = (length << 8) + byte(at)
                at += 1
            if k & 0x80:
                color = byte(at)
                at += 1
        start = y * width + x
        stop = min(start + length, len(out))
        out[start:stop] = color
        if length:
            y, x = divmod(stop, width)
            if x == 0:
                x, y = width, y - 1
            if start + length > len(out):
                break
    return out.reshape(height, width)


def render(placed: tuple[tuple, ...], palette: tuple[tuple, ...]) -> tuple[np.ndarray, int, int] | None:
    """(padded image, content width, content height) of objects (x, y, width, height, runs), None if nothing is visible."""
    if not palette:
        return None
    alpha, color, known = np.zeros(256, int), np.full((256, 3), 255, np.uint8), np.zeros(256, bool)
    for k, (a, *rgb) in palette:
        alpha[k], color[k], known[k] = a, rgb, True
    seen = []
    for x, y, width, height, runs in placed:
        pixels = decode_runs(runs, width, height)
        rows, cols = np.nonzero(alpha[pixels] > VISIBLE_ALPHA)
        if len(rows):
            r0, r1, c0, c1 = rows.min(), rows.max() + 1, cols.min(), cols.max() + 1
            seen.append((y + r0, x + c0, pixels[r0:r1, c0:c1]))
    if not seen:
        return None
    top, left = min(p[0] for p in seen), min(p[1] for p in seen)
    height = max(p[0] + p[2].shape[0] for p in seen) - top
    width = max(p[1] + p[2].shape[1] for p in seen) - left
    image = np.full((height + 2 * PADDING, width + 2 * PADDING, 3), 255, np.uint8)
    for y, x, pixels in seen:
        area = image[y - top + PADDING :, x - left + PADDING :][: pixels.shape[0], : pixels.shape[1]]
        drawn = (pixels != 0) & known[pixels]
        area[drawn] = color[pixels[drawn]]
    return image, int(width), int(height)


_composition = lru_cache(1024)(parse_composition)


@lru_cache(256)
def _palette(payload: bytes, base: tuple[tuple, ...]) -> tuple[tuple, ...]:
    return tuple(parse_palette(payload, dict(base)).items())


def _states(data: bytes) -> Iterator[tuple[float, tuple, tuple]]:
    """(seconds, complete objects as placed, palette) of each display set: all that its image depends on."""
    display, palette, parts = None, (), {}
    for pts, kind, payload in segments(data):
        if kind == COMPOSITION:
            display = _composition(payload)
            if display is not None and display.objects:
                parts = {}
        elif kind == PALETTE:
            palette = _palette(payload, palette if display is not None and display.updates_palette else ())
        elif kind == OBJECT:
            add_object(payload, parts)
        elif kind == END:
            placed = []
            for ident, x, y in display.objects if display is not None else ():
                part = parts.get(ident)
                if part is not None and part.complete and part.width and part.height:
                    placed.append((x, y, part.width, part.height, bytes(part.data)))
            yield pts / CLOCK, tuple(placed), palette


def display_sets(data: bytes) -> Iterator[tuple[float, tuple[np.ndarray, int, int] | None]]:
    """(seconds, rendered image or None) of each display set."""
    for pts, placed, palette in _states(data):
        yield pts, render(placed, palette)


def is_usable(shown: tuple[np.ndarray, int, int] | None) -> bool:
    return shown is not None and shown[1] > USABLE_WIDTH and shown[2] > USABLE_HEIGHT


@lru_cache(REMEMBERED)
def _coded(placed: tuple[tuple, ...], palette: tuple[tuple, ...]) -> tuple:
    """The columns of SCHEMA from ``width`` on; a set that comes again is not rendered again."""
    shown = render(placed, palette)
    if shown is None:
        return None, None, None, None, False, None, None
    image, cw, ch = shown
    coded = png.encode(image)
    return image.shape[1], image.shape[0], cw, ch, is_usable(shown), hashlib.sha1(coded).hexdigest(), coded


def _scan(with_png: bool):
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        files, ords, times, found = zip(*rows, strict=True)
        columns = [files, ords, times, *zip(*found, strict=True)]
        if not with_png:
            columns[-1] = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for file, content in zip(b.column("file"), b.column("content"), strict=True):
                name, data = file.as_py(), content.as_py()
                for k, (pts, placed, palette) in enumerate(_states(data) if data is not None else ()):
                    found = _coded(placed, palette)
                    rows.append((name, k, pts, found))
                    held += len(found[-1] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def preview(files: DataFrame, count: int = 3) -> DataFrame:
    """The first ``count`` usable images of each stream: ``file, number, pts, end_pts, width, height, sha1, png``.

    An image ends at the next display set with a later time, usable or not.  Reading stops at the
    display set after the last image, so that one's end is null.  Images that are not usable don't
    count; nothing behind the last one is decoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[list] = []
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                own: list[list] = []
                for pts, shown in display_sets(bytes(content)) if content is not None and count > 0 else []:
                    if own and own[-1][3] is None and pts > own[-1][2]:
                        own[-1][3] = pts
                    if is_usable(shown):
                        coded = png.encode(shown[0])
                        own.append([file, len(own) + 1, pts, None, shown[0].shape[1], shown[0].shape[0], hashlib.sha1(coded).hexdigest(), coded])
                        if len(own) == count:
                            break
                rows += own
            yield pd.DataFrame(rows, columns=["file", "number", "pts", "end_pts", "width", "height", "sha1", "png"])

    schema = "file string, number int, pts double, end_pts double, width int, height int, sha1 string, png binary"
    return files.select("file", "content").mapInPandas(run, schema)


COLUMNS = ["file", "ord", "pts", "width", "height", "content_width", "content_height", "usable", "sha1", "png"]
SCHEMA = "file string, ord int, pts double, width int, height int, content_width int, content_height int, usable boolean, sha1 string, png binary"


def scan(files: DataFrame, with_png: bool = True) -> DataFrame:
    """One row per display set of each stream; ``files`` has ``file, content`` (binary).

    Bytes that are no stream and null contents give no rows.
    """
    return files.select("file", "content").mapInArrow(_scan(with_png), SCHEMA)


def count_sets(files: DataFrame) -> DataFrame:
    """Number of display sets of each stream, without rendering."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [sum(kind == END for _, kind, _ in segments(bytes(c))) if c is not None else 0 for c in pdf["content"]]
            yield pd.DataFrame({"file": pdf["file"], "sets": n})

    return files.select("file", "content").mapInPandas(run, "file string, sets long")


def read(spark, path: str) -> DataFrame:
    """``file, content`` of the ``.sup`` files of a folder."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][uU][pP]").load(path)
        .select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"), "content")
    )


def _segment(pts: float, kind: int, payload: bytes) -> bytes:
    return MAGIC + struct.pack(">IIBH", int(pts * CLOCK + 0.5) & 0xFFFFFFFF, 0, kind, len(payload)) + payload


def encode_runs(pixels: np.ndarray) -> bytes:
    out = bytearray()
    for row in pixels:
        edge = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip([0, *edge], [*edge, len(row)], strict=True):
            n, c = int(b - a), int(row[a])
            while n:
                k = min(n, 0x3FFF)
                n -= k
                if c and k <= 2:
                    out += bytes([c] * k)
                elif k <= 0x3F:
                    out += bytes([0, k | (0x80 if c else 0)]) + (bytes([c]) if c else b"")
                else:
                    out += bytes([0, (k >> 8) | (0xC0 if c else 0x40), k & 0xFF]) + (bytes([c]) if c else b"")
        out += b"\0\0"
    return bytes(out)


def encode_set(pts: float, pixels: np.ndarray | None, palette: list[tuple] = ((1, 235, 128, 128, 255),), x: int = 100, y: int = 800, cropped: bool = False) -> bytes:
    """The bytes of one display set; None clears the screen."""
    head = struct.pack(">HHBHBBB", 1920, 1080, 0x10, 0, 0x80, 0, 0)
    if pixels is None:
        return _segment(pts, COMPOSITION, head + b"\0") + _segment(pts, END, b"")
    place = struct.pack(">HBBHH", 0, 0, 0x40 if cropped else 0, x, y) + (b"\0" * 8 if cropped else b"")
    coded = encode_runs(pixels)
    body = struct.pack(">HBB", 0, 0, 0xC0) + (len(coded) + 4).to_bytes(3, "big") + struct.pack(">HH", pixels.shape[1], pixels.shape[0]) + coded
    colors = b"\0\0" + b"".join(bytes(p) for p in palette)
    return b"".join([_segment(pts, COMPOSITION, head + b"\1" + place), _segment(pts, PALETTE, colors), _segment(pts, OBJECT, body), _segment(pts, END, b"")])
