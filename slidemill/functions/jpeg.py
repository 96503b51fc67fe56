"""Baseline JPEG images to pixels: Huffman codes walked block by block, all that follows on whole arrays.

Reads 8-bit baseline and extended sequential Huffman files of one scan with any sampling factors and restart
intervals, and the abbreviated streams of TIFF tiles, whose tables stand in a stream of their own. Progressive,
lossless and arithmetic files are errors, as is anything cut off or out of range.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Markers, and the order in which a block's coefficients are stored.
SOI, EOI, SOS, DQT, DHT, DRI, APP14 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xEE
ALIKE, OTHERS = (0xC0, 0xC1), (0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
#: Zigzag: by diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Rows of the orthonormal cosine transform of eight.
COSINES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


class Tables:
    """Quantisers and codes read so far; they outlast the stream that they come in."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], list[int]] = {}
        self.restart = 0
        self.adobe: int | None = None
        self.frame: tuple | None = None


def _codes(data: bytes) -> tuple[list[int], int]:
    """For every 16 bits that may follow: length << 8 | symbol of the code they begin with, 0 where there is none; and the bytes read."""
    counts = data[:16]
    symbols = data[16 : 16 + sum(counts)]
    if len(symbols) < sum(counts):
        raise ValueError("a table of codes is cut off")
    out, at, code = np.zeros(65536, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            if code >= 1 << length:
                raise ValueError("a table of codes has too many")
            out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
            code += 1
        at += n
        code <<= 1
    return out.tolist(), 16 + len(symbols)


def _read(data: bytes, t: Tables) -> tuple[bytes, bytes] | None:
    """Takes the tables of a stream into t; (the scan's header, what follows it) if there is a scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG stream")
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == EOI:
            return None
        n = struct.unpack(">H", data[at + 2 : at + 4])[0] if at + 4 <= len(data) else 0
        part = data[at + 4 : at + 2 + n]
        if n < 2 or len(part) < n - 2:
            raise ValueError("a segment is cut off")
        at += 2 + n
        if kind == DQT:
            while part:
                wide = part[0] >> 4
                table = np.frombuffer(part[1 : 129 if wide else 65], ">u2" if wide else np.uint8)
                if len(table) < 64:
                    raise ValueError("a quantiser is cut off")
                t.quant[part[0] & 15] = table.astype(np.float32)
                part = part[129 if wide else 65 :]
        elif kind == DHT:
            while part:
                t.codes[part[0] >> 4, part[0] & 15], used = _codes(part[1:])
                part = part[1 + used :]
        elif kind == DRI:
            t.restart = struct.unpack(">H", part[:2])[0]
        elif kind == APP14 and part[:5] == b"Adobe" and len(part) > 11:
            t.adobe = part[11]
        elif kind in ALIKE:
            bits, h, w, n = struct.unpack(">BHHB", part[:6])
            if bits != 8 or not h or not w or len(part) < 6 + 3 * n:
                raise ValueError("only frames of 8 bits and of known size are read here")
            t.frame = h, w, [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(n)]
        elif kind in OTHERS:
            raise ValueError("only baseline JPEG is read here")
        elif kind == SOS:
            return part, data[at:]
    raise ValueError("the stream ends before its scan")


def _walk(data: bytes, plan: list[tuple[int, list[int], list[int]]], n_units: int, last: list[int], out: list[list[int]], at: list[list[int]]) -> None:
    """Decodes n_units times the blocks of the plan (component, DC codes, AC codes) from bits without markers: appends nonzero coefficients to out, their places (64 * block + k) to at. last holds each component's DC, and its count of blocks."""
    end = 8 * len(data)
    raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
    words = (raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]).tolist()
    pos = 0
    for _ in range(n_units):
        for c, dc, ac in plan:
            values, places = out[c], at[c]
            base = 64 * last[2 * c + 1]
            last[2 * c + 1] += 1
            k, codes = 0, dc
            while k < 64:
                if pos > end:
                    raise ValueError("the scan ends too early")
                word = words[pos >> 3] << (pos & 7)
                found = codes[word >> 24 & 0xFFFF]
                if not found:
                    raise ValueError("no such code")
                pos += found >> 8
                size = found & 15
                if k and not size:
                    if found & 0xF0 != 0xF0:
                        break
                    k += 16
                    continue
                k += (found & 0xFF) >> 4 if k else 0
                if k > 63:
                    raise ValueError("a block has too many coefficients")
                value = 0
                if size:
                    value = (words[pos >> 3] << (pos & 7)) >> (40 - size) & (1 << size) - 1
                    pos += size
                    if value < 1 << size - 1:
                        value -= (1 << size) - 1
                if not k:
                    last[2 * c] = value = last[2 * c] + value
                values.append(value)
                places.append(base + k)
                k += 1
                codes = ac
    if pos > end:
        raise ValueError("the scan ends too early")


def _doubled(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along the axis: three quarters of the nearer, one of the further; the ends repeat themselves."""
    x = np.moveaxis(x, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.stack([0.75 * x + 0.25 * before, 0.75 * x + 0.25 * after], 1).reshape(2 * len(x), *x.shape[1:])
    return np.moveaxis(out, 0, axis)


def decode(data: bytes, tables: bytes = b"", ycc: bool | None = None) -> np.ndarray:
    """(h, w, components) uint8. tables: a stream whose tables hold where data brings none. ycc: if three components are luma and chroma; by default unless an Adobe marker says otherwise."""
    t = Tables()
    if tables:
        _read(tables, t)
    scan = _read(data, t)
    if scan is None or t.frame is None:
        raise ValueError("the stream has no image")
    head, body = scan
    h, w, parts = t.frame
    if len(head) < 1 + 2 * len(parts) or head[0] != len(parts):
        raise ValueError("only files of one scan are read here")
    top, left = max(p[2] for p in parts), max(p[1] for p in parts)
    single = len(parts) == 1
    if single:  # blocks of a lone component stand one by one
        parts, top, left = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    down, across = -(-h // (8 * top)), -(-w // (8 * left))
    plan = []
    for i, (_, hs, vs, q) in enumerate(parts):
        codes = head[2 + 2 * i]
        if q not in t.quant or (0, codes >> 4) not in t.codes or (1, codes & 15) not in t.codes:
            raise ValueError("a table is missing")
        plan += [(i, t.codes[0, codes >> 4], t.codes[1, codes & 15])] * (hs * vs)
    stop = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", body)
    pieces = re.split(rb"\xff[\xd0-\xd7]", body[: stop.start()] if stop else body)
    total, step = down * across, t.restart or down * across
    if len(pieces) < -(-total // step):
        raise ValueError("the scan ends too early")
    values, places = [[] for _ in parts], [[] for _ in parts]
    counts = [0] * len(parts)
    for k in range(-(-total // step)):
        last = [x for c in range(len(parts)) for x in (0, counts[c])]
        _walk(pieces[k].replace(b"\xff\x00", b"\xff"), plan, min(step, total - k * step), last, values, places)
        counts = last[1::2]
    planes = []
    for i, (_, hs, vs, q) in enumerate(parts):
        flat = np.zeros(64 * counts[i], np.float32)
        flat[np.asarray(places[i], np.int64)] = values[i]
        flat = flat.reshape(-1, 64) * t.quant[q]
        blocks = np.zeros_like(flat)
        blocks[:, ZIGZAG] = flat
        px = COSINES.T @ blocks.reshape(-1, 8, 8) @ COSINES + 128
        px = px.reshape(down, across, vs, hs, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * vs * 8, across * hs * 8)
        px = np.clip(np.rint(px), 0, 255)[: -(-h * vs // top), : -(-w * hs // left)]
        for axis, ratio in ((0, top // vs), (1, left // hs)):
            px = _doubled(px, axis) if ratio == 2 else np.repeat(px, ratio, axis)
        planes.append(px[:h, :w])
    out = np.stack(planes, -1)
    if len(parts) == 3 and (ycc if ycc is not None else t.adobe != 0):
        y, b, r = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
        out = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
