"""PNG files from and to uint8 arrays, by zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour types by number of channels.
COLOUR = {1: 0, 3: 2, 4: 6}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray, compress_level: int = 1) -> bytes:
    """(h, w), (h, w, 1), (h, w, 3) or (h, w, 4); other types than uint8 are clipped to 0..255 and truncated."""
    image = np.asarray(image)
    if image.dtype != np.uint8:
        image = np.clip(image, 0, 255).astype(np.uint8)
    image = image[..., None] if image.ndim == 2 else image
    h, w, c = image.shape
    if c not in COLOUR:
        raise ValueError(f"{c} channels; 1, 3 or 4 can be written")
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image).reshape(h, w * c)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, COLOUR[c], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), compress_level)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(h, w, c) uint8 of an 8-bit file that is not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    channels = {v: k for k, v in COLOUR.items()}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only plain 8-bit files are read")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(np.int32), out[y - 1].astype(np.int32) if y else np.zeros(w * channels, np.int32)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up & 255
        else:
            done = np.zeros(w * channels, np.int32)
            for x in range(w * channels):
                a, b, c = done[x - channels] if x >= channels else 0, up[x], up[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[x] = line[x] + guess & 255
            out[y] = done
    return out.reshape(h, w, channels)
