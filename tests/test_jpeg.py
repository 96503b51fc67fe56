"""The JPEG decoder against images that a plain encoder, written here, quantised: what it must give is known to the level."""

import struct

import numpy as np
import pytest

from slidemill.functions import jpeg
from slidemill.plans import builder
from slidemill.sources import tiff

RNG = np.random.default_rng(5)
DCT = np.array([[(1 / 8**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def zigzag():
    out, r, c = [], 0, 0
    for _ in range(64):
        out.append(8 * r + c)
        if (r + c) % 2 == 0:
            r, c = (r, c + 1) if r == 0 and c < 7 else (r + 1, c) if c == 7 else (r - 1, c + 1)
        else:
            r, c = (r + 1, c) if c == 0 and r < 7 else (r, c + 1) if r == 7 else (r + 1, c - 1)
    return out


Z = zigzag()
# Codes of one length for every symbol: 8 bits but for the last, which has 9, so that no code is all ones.
SYMBOLS = [run << 4 | size for run in range(16) for size in range(11)]
COUNTS = [0] * 7 + [len(SYMBOLS)] + [0] * 8


def segment(kind, data):
    return bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data


def tables(quants):
    out = b"".join(segment(0xDB, bytes([i]) + bytes(int(q[z]) for z in Z)) for i, q in enumerate(quants))
    for kind in (0, 1):
        symbols = list(range(12)) if kind == 0 else SYMBOLS
        counts = [0] * 7 + [len(symbols)] + [0] * 8
        out += segment(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(symbols))
    return out


def bits_of(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def encode(image, sampling=((1, 1), (1, 1), (1, 1)), quality=2, restart=0, apart=False, ycc=True):
    """(bytes, tables or b"", what a decoder must give) of an (h, w, c) image."""
    h, w, n = image.shape
    x = image.astype(float)
    if n == 3 and ycc:
        y = x @ [0.299, 0.587, 0.114]
        x = np.stack([y, 128 + (x[..., 2] - y) / 1.772, 128 + (x[..., 0] - y) / 1.402], -1)
    quants = [np.full(64, quality), np.full(64, quality + 1)]
    sampling = sampling[:n] if n > 1 else ((1, 1),)
    top, left = max(s[1] for s in sampling), max(s[0] for s in sampling)
    down, across = -(-h // (8 * top)), -(-w // (8 * left))
    planes, blocks = [], []
    for i, (hs, vs) in enumerate(sampling):
        p = np.pad(x[..., i], ((0, down * 8 * top - h), (0, across * 8 * left - w)), mode="edge")
        p = p.reshape(down * 8 * vs, top // vs, across * 8 * hs, left // hs).mean(axis=(1, 3))
        b = p.reshape(down * vs, 8, across * hs, 8).swapaxes(1, 2)
        q = np.rint((DCT @ (b - 128) @ DCT.T).reshape(*b.shape[:2], 64) / quants[min(i, 1)]).astype(int)
        blocks.append(q)
        back = DCT.T @ (q * quants[min(i, 1)]).reshape(*b.shape) @ DCT + 128
        planes.append(np.clip(np.rint(back.swapaxes(1, 2).reshape(p.shape)), 0, 255)[: -(-h * vs // top), : -(-w * hs // left)])
    scan, bits, last, unit = b"", "", [0] * n, 0

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for r in range(down):
        for c in range(across):
            if restart and unit and unit % restart == 0:
                scan += flushed(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
                bits, last = "", [0] * n
            unit += 1
            for i, (hs, vs) in enumerate(sampling):
                for v in range(vs):
                    for u in range(hs):
                        k = [int(blocks[i][r * vs + v, c * hs + u][z]) for z in Z]
                        size, tail = bits_of(k[0] - last[i])
                        last[i] = k[0]
                        bits += format(size, "08b") + tail
                        run = 0
                        end = max((j for j in range(1, 64) if k[j]), default=0)
                        for j in range(1, end + 1):
                            if not k[j] and run < 15:
                                run += 1
                                continue
                            size, tail = bits_of(k[j])
                            bits += format(SYMBOLS.index(run << 4 | size), "08b") + tail
                            run = 0
                        bits += format(SYMBOLS.index(0), "08b") if end < 63 else ""
    scan += flushed(bits)
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i + 1, hs << 4 | vs, min(i, 1)]) for i, (hs, vs) in enumerate(sampling))
    shared = tables(quants)
    out = b"\xff\xd8" + (b"" if apart else shared) + segment(0xC0, frame) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    out += segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0") + scan + b"\xff\xd9"
    return out, b"\xff\xd8" + shared + b"\xff\xd9" if apart else b"", expected(planes, sampling, h, w, ycc)


def expected(planes, sampling, h, w, ycc):
    """Chroma by a triangle between the centres of samples, pixel by pixel; then colours."""
    top, left = max(s[1] for s in sampling), max(s[0] for s in sampling)
    full = []
    for p, (hs, vs) in zip(planes, sampling, strict=True):
        ry, rx = top // vs, left // hs

        def taps(n, ratio, size):
            at = (np.arange(n) + 0.5) / ratio - 0.5
            low = np.floor(at).astype(int)
            return np.clip(low, 0, size - 1), np.clip(low + 1, 0, size - 1), at - low

        y0, y1, fy = taps(h, ry, p.shape[0])
        x0, x1, fx = taps(w, rx, p.shape[1])
        rows = p[y0] * (1 - fy)[:, None] + p[y1] * fy[:, None]
        full.append(rows[:, x0] * (1 - fx) + rows[:, x1] * fx)
    out = np.stack(full, -1)
    if len(planes) == 3 and ycc:
        y, b, r = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
        out = np.stack([y + 1.402 * r, y - (0.114 * 1.772 * b + 0.299 * 1.402 * r) / 0.587, y + 1.772 * b], -1)
    return np.clip(np.rint(out), 0, 255)


def picture(h, w, c=3):
    """Smooth shapes with some noise, as scans are."""
    y, x = np.mgrid[:h, :w]
    base = np.stack([128 + 90 * np.sin(x / (7 + 3 * i) + i) * np.cos(y / (9 - 2 * i)) for i in range(c)], -1)
    return np.clip(base + RNG.normal(0, 6, base.shape), 0, 255).astype(np.uint8)


WAYS = [((1, 1), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 2), (1, 1), (1, 1))]


@pytest.mark.parametrize("sampling", WAYS)
@pytest.mark.parametrize("size", [(64, 64), (37, 51), (8, 8), (1, 1)])
def test_samplings(sampling, size):
    data, _, want = encode(picture(*size), sampling)
    got = jpeg.decode(data)
    assert got.shape == want.shape and np.abs(got - want).max() <= 2


@pytest.mark.parametrize("way", [dict(restart=3), dict(apart=True), dict(quality=9, sampling=WAYS[1]), dict(ycc=False), dict(restart=1, sampling=WAYS[1], apart=True)])
def test_ways(way):
    data, shared, want = encode(picture(48, 40), **way)
    assert np.abs(jpeg.decode(data, shared, way.get("ycc", True)) - want).max() <= 2


def test_gray_and_flat():
    data, _, want = encode(picture(20, 30, 1))
    assert np.abs(jpeg.decode(data) - want).max() <= 2
    data, _, want = encode(np.full((16, 16, 3), 200, np.uint8))
    assert np.abs(jpeg.decode(data) - want).max() <= 1


def test_broken_streams():
    data, shared, _ = encode(picture(32, 32), apart=True)
    for bad in (b"", data[:40], data[: len(data) // 2], b"GIF" + data, data.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError):
            jpeg.decode(bad, shared)
    with pytest.raises(ValueError, match="missing"):
        jpeg.decode(data)


@pytest.fixture(scope="module")
def slides(tmp_path_factory):
    """(path, image as it must be read) of a slide of 4:4:4 tiles with tables of their own and one of 4:2:0 tiles that share theirs."""
    out = []
    for k, (sampling, apart) in enumerate(((WAYS[0], False), (WAYS[1], True))):
        at, image, tile = str(tmp_path_factory.mktemp("j") / f"s{k}.tiff"), picture(150, 200), 64
        want = np.zeros((192, 256, 3))
        shared = []

        def block(b, want=want, sampling=sampling, apart=apart, shared=shared, n=[0]):
            data, t, px = encode(b, sampling, apart=apart)
            if n[0] < 12:
                want[64 * (n[0] // 4) : 64 * (n[0] // 4) + 64, 64 * (n[0] % 4) : 64 * (n[0] % 4) + 64] = px
            n[0] += 1
            shared[:] = [t]
            return data

        block(np.zeros((tile, tile, 3), np.uint8), n=[99])
        tiff.write_pyramid(at, [image, image[::2, ::2]], tile=tile, compression=7, mpp=0.5, encode=block, tables=shared[0], photometric=6)
        out.append((at, want[:150, :200]))
    return out


def test_windows_of_jpeg_slides(slides):
    for at, want in slides:
        with open(at, "rb") as f:
            lv = tiff.levels_of(f)
            assert [(v.w, v.h) for v in lv] == [(200, 150), (100, 75)]
            assert np.abs(tiff.read_window(f, lv[0], 30, 40, 150, 90) - want[40:130, 30:180]).max() <= 2


def test_pipeline_over_jpeg_slides(spark, slides, tmp_path):
    p = builder.of_slides(spark, [at for at, _ in slides], 1.0, "downsample").then(builder.extract_patches(50))
    rows = p.frame().collect()
    assert len(rows) == 24
    for r in rows:
        px = np.frombuffer(r.pixels, np.uint8).reshape(50, 50, 3)
        assert np.abs(px - slides[r.slide_ord][1][r.y : r.y + 50, r.x : r.x + 50]).max() <= 2
    bad = str(tmp_path / "bad.tiff")
    with open(slides[0][0], "rb") as f:
        data = bytearray(f.read())
        level = tiff.levels_of(f)[0]
    data[level.offsets[5] + 700 : level.offsets[5] + level.sizes[5]] = b"\xff\xd9" * (level.sizes[5] // 2 - 350) + b"\0" * (level.sizes[5] % 2)
    with open(bad, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match=r"bad\.tiff.*block 5"):
        builder.of_slides(spark, [bad], 1.0, "downsample").then(builder.extract_patches(50)).frame().collect()
