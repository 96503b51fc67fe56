"""Forward pass of the small mobile network of the third kind (inverted residuals, squeeze and excite, hard swish) over batches of images, from an .npz file of weights.

Names of weights are those that published checkpoints of this network have, so a checkpoint is exported by saving its
arrays. The number of classes is that of the last layer's rows.
"""

from __future__ import annotations

import io

import numpy as np

#: Kernel, channels of the expansion, channels out, squeeze and excite, hard swish, stride of each block.
BLOCKS = (
    (3, 16, 16, True, False, 2), (3, 72, 24, False, False, 2), (3, 88, 24, False, False, 1), (5, 96, 40, True, True, 2), (5, 240, 40, True, True, 1), (5, 240, 40, True, True, 1),
    (5, 120, 48, True, True, 1), (5, 144, 48, True, True, 1), (5, 288, 96, True, True, 2), (5, 576, 96, True, True, 1), (5, 576, 96, True, True, 1),
)
FIRST, LAST, HIDDEN = 16, 576, 1024
#: What images are normalised by, and what is added to variances.
MEAN, STD, EPSILON = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 0.001


def squeezed(n: int) -> int:
    """Channels of the squeeze of n: a quarter, to the next multiple of eight, but not over a tenth less."""
    out = max(8, int(n / 4 + 4) // 8 * 8)
    return out + 8 if out < 0.9 * n / 4 else out


def _layers() -> list[tuple[str, tuple[int, ...], dict]]:
    """Every convolution with its batch normalisation: prefix, shape, and how it is applied."""
    out, n = [("features.0", (FIRST, 3, 3, 3), {"stride": 2, "act": "swish"})], FIRST
    for i, (k, wide, m, se, swish, stride) in enumerate(BLOCKS, 1):
        act, at = "swish" if swish else "relu", 0
        if wide != n:
            out.append((f"features.{i}.block.0", (wide, n, 1, 1), {"act": act}))
            at = 1
        out.append((f"features.{i}.block.{at}", (wide, 1, k, k), {"act": act, "stride": stride}))
        if se:
            out.append((f"features.{i}.block.{at + 1}", (squeezed(wide), wide), {"se": True}))
            at += 1
        out.append((f"features.{i}.block.{at + 1}", (m, wide, 1, 1), {"adds": stride == 1 and n == m, "begins": i}))
        n = m
    return [*out, (f"features.{len(BLOCKS) + 1}", (LAST, n, 1, 1), {"act": "swish"})]


def shapes(classes: int = 4) -> dict[str, tuple[int, ...]]:
    """Names and shapes of all weights."""
    out: dict[str, tuple[int, ...]] = {}
    for prefix, shape, how in _layers():
        if how.get("se"):
            out |= {f"{prefix}.fc1.weight": (*shape, 1, 1), f"{prefix}.fc1.bias": shape[:1], f"{prefix}.fc2.weight": (shape[1], shape[0], 1, 1), f"{prefix}.fc2.bias": shape[1:]}
        else:
            out[f"{prefix}.0.weight"] = shape
            out |= {f"{prefix}.1.{k}": shape[:1] for k in ("weight", "bias", "running_mean", "running_var")}
    return out | {"classifier.0.weight": (HIDDEN, LAST), "classifier.0.bias": (HIDDEN,), "classifier.3.weight": (classes, HIDDEN), "classifier.3.bias": (classes,)}


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x + 3, 0, 6) / 6


def _conv(x: np.ndarray, w: np.ndarray, stride: int = 1) -> np.ndarray:
    """x (n, h, w, c) by kernels (m, c, k, k), or (c, 1, k, k) for each channel by its own; the sides are padded by k // 2 zeros."""
    k, own = w.shape[2], w.shape[1] == 1 and x.shape[3] > 1
    if k == 1:
        return x[:, ::stride, ::stride] @ w[:, :, 0, 0].T
    p = np.pad(x, ((0, 0), (k // 2, k // 2), (k // 2, k // 2), (0, 0)))
    h, wide = (x.shape[1] - 1) // stride + 1, (x.shape[2] - 1) // stride + 1
    out = np.zeros((len(x), h, wide, len(w)), np.float32)
    for i in range(k):
        for j in range(k):
            part = p[:, i : i + stride * (h - 1) + 1 : stride, j : j + stride * (wide - 1) + 1 : stride]
            out += part * w[:, 0, i, j] if own else part @ w[:, :, i, j].T
    return out


class Network:
    """weights by name; a missing one, or one of another shape, is an error."""

    def __init__(self, weights: dict[str, np.ndarray]):
        classes = len(weights["classifier.3.bias"]) if "classifier.3.bias" in weights else 4
        if wrong := sorted(k for k, s in shapes(classes).items() if k not in weights or tuple(weights[k].shape) != s):
            raise ValueError(f"weights lacking or of another shape: {wrong[:5]}")
        self.w = {k: np.asarray(weights[k], np.float32) for k in shapes(classes)}
        self.layers = _layers()

    def _normalised(self, x: np.ndarray, prefix: str) -> np.ndarray:
        scale = self.w[f"{prefix}.weight"] / np.sqrt(self.w[f"{prefix}.running_var"] + EPSILON)
        return x * scale + (self.w[f"{prefix}.bias"] - self.w[f"{prefix}.running_mean"] * scale)

    def features(self, x: np.ndarray) -> np.ndarray:
        """(n, LAST) of normalised images."""
        into = x
        for prefix, _, how in self.layers:
            if how.get("se"):
                s = np.maximum(x.mean(axis=(1, 2)) @ self.w[f"{prefix}.fc1.weight"][:, :, 0, 0].T + self.w[f"{prefix}.fc1.bias"], 0)
                x = x * _gate(s @ self.w[f"{prefix}.fc2.weight"][:, :, 0, 0].T + self.w[f"{prefix}.fc2.bias"])[:, None, None]
                continue
            x = self._normalised(_conv(x, self.w[f"{prefix}.0.weight"], how.get("stride", 1)), f"{prefix}.1")
            x = x * _gate(x) if how.get("act") == "swish" else np.maximum(x, 0) if how.get("act") else x
            if "begins" in how:
                x = x + into if how["adds"] else x
            if "begins" in how or prefix == "features.0":
                into = x
        return x.mean(axis=(1, 2))

    def __call__(self, images: np.ndarray) -> np.ndarray:
        """Class probabilities of (n, h, w, 3 or more) uint8 images; a fourth channel is left out."""
        x = (images[..., :3].astype(np.float32) / 255 - np.array(MEAN, np.float32)) / np.array(STD, np.float32)
        x = self.features(x) @ self.w["classifier.0.weight"].T + self.w["classifier.0.bias"]
        x = (x * _gate(x)) @ self.w["classifier.3.weight"].T + self.w["classifier.3.bias"]
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def load(uri: str) -> Network:
    """The network of an .npz file at a path or URI."""
    from slidemill.sources.files import opened

    with opened(uri) as f, np.load(io.BytesIO(f.read())) as z:
        return Network({k: z[k] for k in z.files})
