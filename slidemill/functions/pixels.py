"""Patch metrics in numpy over batches of patches (n, h, w, c), and resampling. The fast form of slidemill.operators.metrics."""

from __future__ import annotations

import numpy as np

from slidemill.functions import pen
from slidemill.operators.metrics import LUMA


def gray(patches: np.ndarray, precision=np.float32) -> np.ndarray:
    """Luma in 0 to 1; one channel stands for itself, a fourth is ignored; other types than uint8 are clipped to 0..255."""
    p = patches if patches.dtype == np.uint8 else np.clip(patches, 0, 255)
    p = p.astype(precision) / precision(255)
    if p.ndim == 3 or p.shape[-1] == 1:
        return p.reshape(p.shape[:3])
    return p[..., 0] * precision(LUMA[0]) + p[..., 1] * precision(LUMA[1]) + p[..., 2] * precision(LUMA[2])


def gray_stats(patches: np.ndarray, precision=np.float32) -> tuple[np.ndarray, np.ndarray]:
    g = gray(patches, precision).reshape(len(patches), -1)
    return g.min(axis=1), g.max(axis=1)


def otsu(patches: np.ndarray, num_bins: int = 256, precision=np.float32) -> np.ndarray:
    """Threshold of each patch by the shifted between-class variance; first bin of ties; a constant patch's value."""
    g = gray(patches, precision).reshape(len(patches), -1)
    lo, hi = g.min(axis=1, keepdims=True), g.max(axis=1, keepdims=True)
    span = np.maximum(hi - lo, precision(1e-12))
    bins = np.floor(np.clip((g - lo) / span, 0, 1) * precision(num_bins) - precision(1e-7)).astype(np.int64).clip(0, num_bins - 1)
    n = len(g)
    hist = np.bincount((bins + np.arange(n)[:, None] * num_bins).ravel(), minlength=n * num_bins).reshape(n, num_bins).astype(np.float64)
    centre = (np.arange(num_bins) + 0.5) / num_bins
    w1, s1 = np.cumsum(hist, axis=1), np.cumsum(hist * centre, axis=1)
    w2, s2 = w1[:, -1:] - w1, s1[:, -1:] - s1
    m1, m2 = (np.where(w > 0, s / np.maximum(w, 1), 0) for s, w in ((s1, w1), (s2, w2)))
    k = np.argmax(np.round(w1[:, :-1] * w2[:, 1:] * (m1[:, :-1] - m2[:, 1:]) ** 2, 9), axis=1)
    thr = lo[:, 0] + ((k + 0.5) / num_bins).astype(precision) * span[:, 0]
    return np.where(hi[:, 0] <= lo[:, 0], lo[:, 0], thr).astype(precision)


def tissue(patches: np.ndarray, threshold: np.ndarray, darker: bool = True, precision=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Fraction and number of pixels on the tissue's side of the threshold."""
    g = gray(patches, precision).reshape(len(patches), -1)
    mask = g < threshold[:, None] if darker else g >= threshold[:, None]
    return mask.mean(axis=1), mask.sum(axis=1)


def pen_fraction(patches: np.ndarray, diff_thresh: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Fraction and number of pen pixels: not nearly black, and a triple that no channel of the pixel gets past."""
    p = patches if patches.dtype == np.uint8 else np.clip(patches, 0, 255).astype(np.uint8)
    red, green, blue = (np.ascontiguousarray(p[..., c]) for c in range(3))
    ink = np.zeros(red.shape, bool)
    for mode, triples in pen.MODES.items():
        past = [np.greater if above else np.less for above in pen.ABOVE[mode]]
        for r, g, b in triples:
            ink |= ~(past[0](red, r) | past[1](green, g) | past[2](blue, b))
    ink &= p[..., :3].sum(axis=-1, dtype=np.int64) >= 3 * diff_thresh
    ink = ink.reshape(len(p), -1)
    return ink.mean(axis=1), ink.sum(axis=1)


def _kernel(name: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if name == "linear":
        return np.maximum(1 - x, 0)
    if name == "cubic":
        a = -0.75
        return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0))
    return np.where(x < 4, np.sinc(x) * np.sinc(x / 4), 0)


INTERPOLATIONS = ("nearest", "linear", "cubic", "area", "lanczos")


def _taps(n: int, m: int, how: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of m values the few of n that it is made of, and their weights, (m, taps) both; taps beyond an end stand for the end."""
    scale = n / m
    if how == "nearest":
        return np.minimum((np.arange(m) * scale).astype(int), n - 1)[:, None], np.ones((m, 1))
    if how == "area" and scale >= 1:
        low, high = np.arange(m)[:, None] * scale, np.arange(1, m + 1)[:, None] * scale
        at = np.floor(low).astype(int) + np.arange(int(np.ceil(scale)) + 1)[None, :]
        w = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
    else:
        center = (np.arange(m)[:, None] + 0.5) * scale - 0.5
        reach = {"linear": 1, "area": 1, "cubic": 2, "lanczos": 4}[how]
        at = np.floor(center).astype(int) + np.arange(1 - reach, reach + 1)[None, :]
        w = _kernel("linear" if how == "area" else how, center - at)
    return np.clip(at, 0, n - 1), w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, h: int, w: int, how: str = "lanczos") -> np.ndarray:
    """(h0, w0, c) uint8 to (h, w, c); separable filters, rounded half even."""
    if how not in INTERPOLATIONS:
        raise ValueError(f"unknown interpolation {how!r}; one of {INTERPOLATIONS}")
    at, weight = _taps(image.shape[0], h, how)
    out = np.zeros((h, *image.shape[1:]))
    for k in range(at.shape[1]):
        out += weight[:, k, None, None] * image[at[:, k]]
    at, weight = _taps(image.shape[1], w, how)
    rows, out = out, np.zeros((h, w, image.shape[2]))
    for k in range(at.shape[1]):
        out += weight[None, :, k, None] * rows[:, at[:, k]]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
