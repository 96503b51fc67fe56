import numpy as np
import pytest

from slidemill.functions import colour, pen, pixels, png


def test_pen_colours():
    solid = np.array([(20, 50, 220), (180, 120, 120), (1, 1, 1)], np.uint8)[:, None, None, :].repeat(4, 1).repeat(4, 2)
    assert pixels.pen_fraction(solid)[0].tolist() == [1.0, 0.0, 0.0]
    rng = np.random.default_rng(0).integers(0, 256, (2000, 3))
    ok = np.ones(len(rng), bool)
    for mode, triples in pen.MODES.items():
        for t in triples:
            ok &= np.array([any((p[c] > t[c]) if pen.ABOVE[mode][c] else (p[c] < t[c]) for c in range(3)) for p in rng])
    want = ~ok & ~(rng.sum(axis=1) < 15)
    assert (pixels.pen_fraction(rng.astype(np.uint8)[:, None, None, :])[1] == want).all()


def brute_otsu(g, nb):
    lo, hi = g.min(), g.max()
    if hi <= lo:
        return lo
    bins = [min(max(int(np.floor((v - lo) / (hi - lo) * nb - 1e-7)), 0), nb - 1) for v in g]
    best, at = -1.0, 0
    for k in range(nb - 1):
        one, two = [b for b in bins if b <= k], [b for b in bins if b >= k + 2]
        m = lambda own: np.mean([(b + 0.5) / nb for b in own]) if own else 0.0
        s = round(len(one) * len(two) * (m(one) - m(two)) ** 2, 9)
        if s > best:
            best, at = s, k
    return lo + (at + 0.5) / nb * (hi - lo)


def test_otsu_against_brute_force():
    p = np.random.default_rng(1).integers(0, 256, (30, 6, 6, 3)).astype(np.uint8)
    p[0] = 7
    got = pixels.otsu(p, 16, np.float64)
    want = [brute_otsu(g.ravel(), 16) for g in pixels.gray(p, np.float64)]
    assert np.allclose(got, want)
    assert pixels.otsu(p, 16).dtype == np.float32


def test_gray_channels():
    assert pixels.gray(np.full((1, 2, 2, 1), 255, np.uint8)).max() == 1
    assert np.allclose(pixels.gray(np.full((1, 2, 2, 4), 300.0)), 1.0, atol=1e-3)


@pytest.mark.parametrize("c", [1, 3, 4])
def test_png_round_trip(c):
    p = np.random.default_rng(2).integers(0, 256, (9, 7, c)).astype(np.uint8)
    assert (png.decode(png.encode(p)) == p).all()
    assert (png.decode(png.encode(p.astype(float) + 0.7)) == np.clip(p + 0.7, 0, 255).astype(np.uint8)).all()
    with pytest.raises(ValueError):
        png.encode(np.zeros((2, 2, 2)))


def test_lab_round_trip():
    p = np.random.default_rng(3).random((3, 16, 16, 3))
    assert np.abs(colour.lab_to_rgb(colour.rgb_to_lab(p)) - p).max() < 1e-3


def test_reinhard_meets_reference():
    p = np.random.default_rng(4).integers(60, 200, (2, 32, 32, 3)).astype(np.uint8)
    lab = colour.rgb_to_lab(colour.reinhard(p, [60, 2, -2], [6, 3, 3]) / 255)
    assert np.allclose(lab.mean(axis=(1, 2)), [60, 2, -2], atol=0.3) and np.allclose(lab.std(axis=(1, 2), ddof=1), [6, 3, 3], atol=0.3)
    modified = colour.rgb_to_lab(colour.reinhard(p, [60, 2, -2], [1, 3, 3], modified=True) / 255)
    assert np.allclose(modified.mean(axis=(1, 2))[:, 1:], [2, -2], atol=0.5)


def test_macenko_finds_the_stain_plane():
    r = np.random.default_rng(42)
    h = np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]])
    h /= np.linalg.norm(h, axis=0)
    od = np.einsum("ij,njk->nik", h, r.gamma(2.0, 0.4, (6, 2, 48 * 48)))
    p = np.clip(255 * np.exp(-od), 0, 255).astype(np.uint8).transpose(0, 2, 1).reshape(6, 48, 48, 3)
    got, top = colour.macenko_fit(p)
    normal = np.cross(h[:, 0], h[:, 1])
    other = np.cross(got[:, 0], got[:, 1])
    angle = np.degrees(np.arccos(min(1, abs(normal @ other) / np.linalg.norm(normal) / np.linalg.norm(other))))
    assert angle < 3 and (top > 0).all()
    assert colour.macenko_apply(p, got, top).shape == p.shape
    with pytest.raises(RuntimeError):
        colour.macenko_fit(np.full((1, 4, 4, 3), 255, np.uint8))


@pytest.mark.parametrize("how", pixels.INTERPOLATIONS)
def test_resize(how):
    flat = np.full((8, 8, 3), 77, np.uint8)
    assert (pixels.resize(flat, 4, 16, how) == 77).all()
    ramp = np.arange(64, dtype=np.uint8).reshape(8, 8, 1).repeat(3, 2)
    assert (pixels.resize(ramp, 8, 8, how) == ramp).all()
    if how == "area":
        assert (pixels.resize(ramp, 4, 4, how)[..., 0] == np.rint(ramp[..., 0].reshape(4, 2, 4, 2).mean(axis=(1, 3)))).all()
    with pytest.raises(ValueError):
        pixels.resize(flat, 4, 4, "best")
