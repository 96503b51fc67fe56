"""The tissue network against plain loops, and pictures with pasted patches pixel by pixel."""

import numpy as np
import pytest

from slidemill.functions import mobilenet, png
from slidemill.plans import builder, pictures
from slidemill.sources import tiff


def weights(seed=0, classes=4):
    rng = np.random.default_rng(seed)
    out = {}
    for k, s in mobilenet.shapes(classes).items():
        fan = np.prod(s[1:]) if len(s) > 1 else 1
        out[k] = (rng.uniform(0.5, 1.5, s) if k.endswith("running_var") else rng.normal(0, 0.1, s) if len(s) == 1 else rng.normal(0, (2 / fan) ** 0.5, s)).astype(np.float32)
        if k.endswith(".1.weight"):
            out[k] = out[k] + 1
    return out


def naive_conv(x, w, stride, groups):
    """(c, h, w) by the definition, a pixel at a time."""
    m, cg, k, _ = w.shape
    c, h, wd = x.shape
    p = np.zeros((c, h + 2 * (k // 2), wd + 2 * (k // 2)))
    p[:, k // 2 : k // 2 + h, k // 2 : k // 2 + wd] = x
    oh, ow = (h + 2 * (k // 2) - k) // stride + 1, (wd + 2 * (k // 2) - k) // stride + 1
    out = np.zeros((m, oh, ow))
    for o in range(m):
        own = range(c) if groups == 1 else [o]
        for i in range(oh):
            for j in range(ow):
                out[o, i, j] = sum((p[a, i * stride : i * stride + k, j * stride : j * stride + k] * w[o, n]).sum() for n, a in enumerate(own))
    return out


def naive(w, image):
    """The network as published, block by block, in double precision: expand, depthwise, squeeze and excite, project, add."""
    relu, hsig = lambda x: np.maximum(x, 0), lambda x: np.clip(x / 6 + 0.5, 0, 1)
    swish = lambda x: x * hsig(x)

    def cbn(x, name, stride=1, groups=1, act=None):
        x = naive_conv(x, w[f"{name}.0.weight"].astype(float), stride, groups)
        g = lambda k: w[f"{name}.1.{k}"].astype(float)[:, None, None]
        x = (x - g("running_mean")) / np.sqrt(g("running_var") + 0.001) * g("weight") + g("bias")
        return act(x) if act else x

    x = np.moveaxis((image / 255 - [0.485, 0.456, 0.406]) / [0.229, 0.224, 0.225], 2, 0)
    x = cbn(x, "features.0", 2, 1, swish)
    settings = [(16, 16, 1, "R", 2), (72, 24, 0, "R", 2), (88, 24, 0, "R", 1), (96, 40, 1, "H", 2), (240, 40, 1, "H", 1), (240, 40, 1, "H", 1), (120, 48, 1, "H", 1), (144, 48, 1, "H", 1), (288, 96, 1, "H", 2), (576, 96, 1, "H", 1), (576, 96, 1, "H", 1)]
    for i, (wide, out, se, act, stride) in enumerate(settings, 1):
        act, y, k = {"R": relu, "H": swish}[act], x, 0
        if wide != x.shape[0]:
            y, k = cbn(y, f"features.{i}.block.0", act=act), 1
        y = cbn(y, f"features.{i}.block.{k}", stride, wide, act)
        if se:
            k += 1
            n = f"features.{i}.block.{k}"
            s = relu(w[f"{n}.fc1.weight"][:, :, 0, 0] @ y.mean(axis=(1, 2)) + w[f"{n}.fc1.bias"])
            y = y * hsig(w[f"{n}.fc2.weight"][:, :, 0, 0] @ s + w[f"{n}.fc2.bias"])[:, None, None]
        y = cbn(y, f"features.{i}.block.{k + 1}")
        x = x + y if stride == 1 and x.shape[0] == out else y
    x = cbn(x, "features.12", act=swish).mean(axis=(1, 2))
    x = swish(w["classifier.0.weight"].astype(float) @ x + w["classifier.0.bias"])
    x = w["classifier.3.weight"].astype(float) @ x + w["classifier.3.bias"]
    return np.exp(x - x.max()) / np.exp(x - x.max()).sum()


def test_against_loops():
    w = weights()
    images = np.random.default_rng(1).integers(0, 256, (2, 33, 20, 3), dtype=np.uint8)
    got = mobilenet.Network(w)(images)
    want = np.stack([naive(w, i) for i in images])
    assert got.shape == (2, 4) and np.abs(got - want).max() < 1e-3 and got.sum(axis=1) == pytest.approx(1, abs=1e-5)
    assert np.allclose(mobilenet.Network(w)(np.concatenate([images, images[..., :1]], axis=3)), got)
    with pytest.raises(ValueError, match="classifier.0.bias"):
        mobilenet.Network({k: v for k, v in w.items() if k != "classifier.0.bias"})


@pytest.fixture(scope="module")
def slide(tmp_path_factory):
    image = np.random.default_rng(2).integers(0, 256, (128, 192, 3), dtype=np.uint8)
    image[:, :64] //= 4
    at = str(tmp_path_factory.mktemp("n") / "s.tiff")
    tiff.write_pyramid(at, [image], tile=64, mpp=0.5)
    return at, image


def test_stage(spark, slide, tmp_path):
    w = weights(7)
    np.savez(tmp_path / "w.npz", **w)
    base = builder.of_slides(spark, [slide[0]], 1.0, "downsample").then(builder.extract_patches(64))
    px = {(r.x, r.y): np.frombuffer(r.pixels, np.uint8).reshape(64, 64, 3) for r in base.frame().collect()}
    probs = {k: mobilenet.Network(w)(v[None])[0] for k, v in px.items()}
    best = {k: int(v.argmax()) for k, v in probs.items()}
    keep = next(iter(best.values()))
    rows = base.then(builder.tissue_classifier(str(tmp_path / "w.npz"), keep)).frame().collect()
    assert {(r.x, r.y) for r in rows} == {k for k, v in best.items() if v == keep} and rows
    assert all(np.abs(np.array(r.probs) - probs[r.x, r.y]).max() < 0.0051 for r in rows)
    with pytest.warns(UserWarning, match="32 pixels"):
        builder.of_slides(spark, [slide[0]], 1.0, "downsample").then(builder.extract_patches(16)).then(builder.tissue_classifier(str(tmp_path / "w.npz"))).frame()


def test_pasted_patches(spark, slide):
    """At full size: pasted pixels, blended outlines, corners moved to the stride's grid, patches beyond the slide left out."""
    at, image = slide
    slides = builder.of_slides(spark, [at], 1.0, "downsample").frame()
    px = np.zeros((3, 32, 32, 3), np.uint8) + np.array([10, 20, 30], np.uint8)[:, None, None, None]
    rows = [(0, 3, 5, px[0].tobytes(), 32, 32, 3), (0, 64, 64, px[1].tobytes(), 32, 32, 3), (0, 170, 0, px[2].tobytes(), 32, 32, 3)]
    patches = spark.createDataFrame(rows, "slide_ord int, x long, y long, pixels binary, ph int, pw int, pc int")
    out = png.decode(pictures.selected_patches(patches, slides, 32, 192, (200, 0, 100), stride=16, paste=True, opacity=0.5).first().png)
    want = image.astype(float).copy()
    for x, y, v in ((0, 0, 10), (64, 64, 20), (160, 0, 30)):
        want[y : y + 32, x : x + 32] = v
        edge = np.zeros((128, 192), bool)
        edge[[y, y + 31], x : x + 32] = edge[y : y + 32, [x, x + 31]] = True
        want[edge] = np.rint(want[edge] * 0.5 + np.array([200, 0, 100]) * 0.5)
    assert (out == want).all()
    beyond = png.decode(pictures.selected_patches(patches, slides, 32, 192, (200, 0, 100), paste=True).first().png)
    assert (beyond[:32, 170:] == image[:32, 170:]).all()
    with pytest.raises(ValueError):
        pictures.selected_patches(patches, slides, 32, stride=0)


def test_alpha_on_white(tmp_path):
    image = np.random.default_rng(4).integers(0, 256, (40, 50, 4), dtype=np.uint8)
    image[:10, :, 3] = 0
    at = str(tmp_path / "a.tiff")
    tiff.write_pyramid(at, [image], tile=16)
    got = pictures.read_thumbnail(at, 50)
    a = image[..., 3:] / 255
    assert np.abs(got - (image[..., :3] * a + 255 * (1 - a))).max() <= 0.51 and (got[:10] == 255).all()


