"""Tiled and stripped TIFF pyramids: headers as a Spark data source, read windows, and a small writer for tests.

8-bit RGB or RGBA, uncompressed, Deflate, LZW or baseline JPEG, one IFD for each level, classic or BigTIFF. Label, macro and thumbnail
images among the levels are told apart and left out. A header is a few kilobytes and a window touches only the tiles it
overlaps, so slides are never read whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slidemill.functions import jpeg
from slidemill.sources.files import opened

#: Sizes and struct codes of field types, and the tags that are read.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "c"), 16: (8, "Q")}
WIDTH, HEIGHT, COMPRESSION, DESCRIPTION, SAMPLES, ROWS, STRIPS, STRIP_SIZES, XRES, UNIT, PREDICTOR, TILE_W, TILE_H, TILES, TILE_SIZES, PHOTOMETRIC, JPEG_TABLES = 256, 257, 259, 270, 277, 278, 273, 279, 282, 296, 317, 322, 323, 324, 325, 262, 347
SCHEMA = "slide_ord int, wsi_id string, wsi_path string, level int, lw long, lh long, ds double, mpp0 double"
FAILURES = "slide_ord int, wsi_path string, error string"
#: Pixel sizes in micrometres as scanners write them into descriptions.
_mpp = re.compile(r"\b(?:mpp|physicalsizex)\s*=\s*\"?([0-9.]+(?:e-?\d+)?)", re.IGNORECASE)


@dataclass
class Level:
    w: int
    h: int
    channels: int
    compression: int
    predictor: int
    bw: int
    bh: int
    offsets: tuple
    sizes: tuple
    mpp: float | None
    tiled: bool = True
    #: Of JPEG blocks: the tables that they share, and if colours are luma and chroma.
    tables: bytes = b""
    ycc: bool = False


def directories(f) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The tags of every IFD of an open classic or BigTIFF file, in order."""
    f.seek(0)
    head = f.read(16)
    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(end + "H", head[2:4])[0] if end and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    word, count_code = ("I", "H") if magic == 42 else ("Q", "Q")
    slot = struct.calcsize("<" + word)
    at, seen = struct.unpack(end + word, head[4:8] if magic == 42 else head[8:16])[0], set()
    while at and at not in seen:
        seen.add(at)
        f.seek(at)
        n = struct.unpack(end + count_code, f.read(struct.calcsize("<" + count_code)))[0]
        entry = 4 + 2 * slot
        raw, tags = f.read(entry * n + slot), {}
        for i in range(n):
            tag, kind, count = struct.unpack(end + "HH" + word, raw[entry * i : entry * i + 4 + slot])
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            data = raw[entry * i + 4 + slot : entry * (i + 1)]
            if size * count > slot:
                f.seek(struct.unpack(end + word, data)[0])
                data = f.read(size * count)
            tags[tag] = struct.unpack(end + code * count, data[: size * count])
        yield end, tags
        at = struct.unpack(end + word, raw[entry * n :])[0]


def _level(tags: dict[int, tuple]) -> Level:
    one = lambda t, d=None: tags[t][0] if t in tags else d
    w, h, tiled, mpp = one(WIDTH), one(HEIGHT), TILES in tags, None
    if said := _mpp.search(b"".join(tags.get(DESCRIPTION, ())).decode("latin-1")):
        mpp = float(said[1])
    elif XRES in tags and one(UNIT, 2) in (2, 3) and tags[XRES][0]:
        mpp = (25400 if one(UNIT, 2) == 2 else 10000) / (tags[XRES][0] / tags[XRES][1])
    return Level(w, h, one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(TILE_W, w) if tiled else w, one(TILE_H) if tiled else min(one(ROWS, h), h), tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES], mpp or None, tiled, b"".join(tags.get(JPEG_TABLES, ())), one(PHOTOMETRIC) == 6)


def levels_of(f) -> list[Level]:
    """The levels of an open file, largest first.

    The largest image is level 0. Of the others those are levels that have its proportions, to two pixels or two per
    cent, its channels and, where it is tiled, tiles: labels, macro pictures and thumbnails go. Of two of one size the
    first stands.
    """
    all_ = [_level(tags) for _, tags in directories(f) if WIDTH in tags and (TILES in tags or STRIPS in tags)]
    if not all_:
        raise ValueError("no image in the TIFF file")
    base = max(all_, key=lambda v: (v.w * v.h, v.tiled))
    out: dict[int, Level] = {}
    for v in all_:
        alike = abs(base.h * v.w / base.w - v.h) <= max(2, 0.02 * v.h) and v.channels == base.channels and (v.tiled or not base.tiled)
        if v is base or alike and v.w < base.w:
            out.setdefault(v.w, v)
    return sorted(out.values(), key=lambda level: -level.w)


@lru_cache(maxsize=64)
def _levels_at(uri: str, size: int) -> list[Level]:
    with opened(uri) as f:
        return levels_of(f)


def levels_at(uri: str, f) -> list[Level]:
    """levels_of(f), parsed once for each worker, file and size."""
    return _levels_at(uri, f.size())


def _lzw(data: bytes) -> bytes:
    out, table, width, bits, held, last = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _block(f, level: Level, i: int, h: int) -> np.ndarray:
    """The block's pixels; a block that can't be decoded is a ValueError that names it."""
    f.seek(level.offsets[i])
    data = f.read(level.sizes[i])
    try:
        if level.compression == 7:
            px = jpeg.decode(data, level.tables, level.ycc)
            if px.shape[0] < h or px.shape[1] < level.bw or px.shape[2] != level.channels:
                raise ValueError(f"an image of {px.shape} stands for a block of {(h, level.bw, level.channels)}")
            return px[:h, : level.bw]
        if level.compression in (8, 32946):
            data = zlib.decompress(data)
        elif level.compression == 5:
            data = _lzw(data)
        elif level.compression != 1:
            raise ValueError(f"compression {level.compression} is not read here")
        out = np.frombuffer(data, np.uint8)[: h * level.bw * level.channels].reshape(h, level.bw, level.channels)
    except Exception as e:  # whatever broken bytes lead to
        raise ValueError(f"block {i} of the level {level.w} x {level.h}: {e}") from e
    return np.cumsum(out, axis=1, dtype=np.uint8) if level.predictor == 2 else out


def read_window(f, level: Level, x: int, y: int, w: int, h: int, channels: int = 3) -> np.ndarray:
    """(h, w, 3) uint8 at the level's own pixels; zeros outside the image. channels 4: with alpha, if the level has it."""
    out = np.zeros((h, w, channels), np.uint8)
    across = -(-level.w // level.bw)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, level.w), min(y + h, level.h)
    for by in range(y0 // level.bh, -(-y1 // level.bh) if y1 > y0 else 0):
        for bx in range(x0 // level.bw, -(-x1 // level.bw) if x1 > x0 else 0):
            rows = level.bh if level.bw != level.w else min(level.bh, level.h - by * level.bh)
            block = _block(f, level, by * across + bx, rows)
            a, b = max(x0, bx * level.bw), min(x1, (bx + 1) * level.bw)
            c, d = max(y0, by * level.bh), min(y1, (by + 1) * level.bh)
            out[c - y : d - y, a - x : b - x] = block[c - by * level.bh : d - by * level.bh, a - bx * level.bw : b - bx * level.bw, :channels]
    return out


def stem(path: str) -> str:
    """File name less its last suffix."""
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]) or path.rsplit("/", 1)[-1]


class Slides(DataSource):
    """spark.dataSource.register(Slides); spark.read.format("slides").option("paths", "\\n".join(paths)).load(): a row for each level.

    slide_ord is the place in the list: a path that stands twice is two slides. A partition for each slide.
    """

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return FAILURES if self.options.get("report") == "failures" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SlidesReader([p for p in self.options.get("paths", "").split("\n") if p], self.options.get("on_error", "fail"), self.options.get("report") == "failures")


class OneSlide(InputPartition):
    def __init__(self, ord_: int, path: str):
        self.ord, self.path = ord_, path


class SlidesReader(DataSourceReader):
    """on_error skip: files that cannot be read give no rows; with failures they give the only ones."""

    def __init__(self, paths: list[str], on_error: str = "fail", failures: bool = False):
        if on_error not in ("fail", "skip"):
            raise ValueError("on_error must be 'fail' or 'skip'")
        self.paths, self.skip, self.failures = paths, on_error == "skip", failures

    def partitions(self) -> list[OneSlide]:
        return [OneSlide(i, p) for i, p in enumerate(self.paths)] or [OneSlide(-1, "")]

    def read(self, partition: OneSlide) -> Iterator[tuple]:
        if partition.ord < 0:
            return
        rows, error = [], None
        try:
            rows = list(header_rows(partition.ord, partition.path, probe=self.skip or self.failures))
        except Exception as e:  # whatever a broken file leads to
            if not (self.skip or self.failures):
                raise
            error = f"{type(e).__name__}: {e}"
        if not self.failures:
            yield from rows
        elif error:
            yield partition.ord, partition.path, error


def header_rows(ord_: int, path: str, probe: bool = False) -> Iterator[tuple]:
    """A row for each level. probe: also see that every block lies within the file and that each level's first one can be decoded."""
    with opened(path) as f:
        all_ = levels_of(f)
        for level in all_ if probe else ():
            if max(a + n for a, n in zip(level.offsets, level.sizes, strict=True)) > f.size():
                raise ValueError("the file ends before its last block")
            read_window(f, level, 0, 0, 1, 1)
    for i, level in enumerate(all_):
        yield ord_, stem(path), path, i, level.w, level.h, float(all_[0].w / level.w), all_[0].mpp


def write_pyramid(path: str, images: list[np.ndarray], tile: int = 256, compression: int = 8, mpp: float | None = None, big: bool = False, description: str | None = None, encode=None, tables: bytes = b"", photometric: int = 2) -> None:
    """A tiled pyramid of (h, w, 3) uint8 images; compression 1 or 8, or another that encode, a function of a block, gives (with the tables that blocks share); big: as BigTIFF. The description stands with the first."""
    word, slot, link = ("Q", 8, 8) if big else ("I", 4, 4)
    body, entries = bytearray(b"II+\0\x08\0\0\0" + b"\0" * 8 if big else b"II*\0\0\0\0\0"), []
    for image in images:
        h, w, c = image.shape
        offsets, sizes = [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                block = np.zeros((tile, tile, c), np.uint8)
                part = image[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                data = encode(block) if encode else zlib.compress(block.tobytes(), 1) if compression == 8 else block.tobytes()
                offsets.append(len(body))
                sizes.append(len(data))
                body += data
        entries.append((h, w, c, offsets, sizes))
    for k, (h, w, c, offsets, sizes) in enumerate(entries):
        def field(tag, kind, code, values, count=None):
            data = values if isinstance(values, bytes) else struct.pack("<" + code * len(values), *values)
            at = data.ljust(slot, b"\0")
            if len(data) > slot:
                at = struct.pack("<" + word, len(body))
                body.extend(data)
            return struct.pack("<HH" + word, tag, kind, count or len(values)) + at

        fields = [field(t, k_, c_, v) for t, k_, c_, v in ((WIDTH, 4, "I", [w]), (HEIGHT, 4, "I", [h]), (258, 3, "H", [8] * c), (COMPRESSION, 3, "H", [compression]), (PHOTOMETRIC, 3, "H", [photometric]))]
        if description and not k:
            fields.append(field(DESCRIPTION, 2, "c", description.encode("latin-1") + b"\0"))
        fields.append(field(SAMPLES, 3, "H", [c]))
        if mpp:
            fields += [field(XRES, 5, "I", [round(10000 / mpp * 1000), 1000], 1), field(UNIT, 3, "H", [3])]
        fields += [field(TILE_W, 3, "H", [tile]), field(TILE_H, 3, "H", [tile]), field(TILES, 16 if big else 4, word, offsets), field(TILE_SIZES, 4, "I", sizes)]
        fields += [field(JPEG_TABLES, 7, "c", tables)] if tables else []
        body += b"\0" * (len(body) % 2)
        body[link : link + slot] = struct.pack("<" + word, len(body))
        body += struct.pack("<Q" if big else "<H", len(fields)) + b"".join(fields)
        link = len(body)
        body += b"\0" * slot
    with open(path, "wb") as f:
        f.write(body)
