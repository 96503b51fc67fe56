"""Colour spaces and stain models in numpy: sRGB and CIELAB, Reinhard and Macenko normalisation. Arrays are (n, h, w, 3)."""

from __future__ import annotations

import numpy as np

#: Linear sRGB to XYZ, the D65 white point, and XYZ to linear sRGB.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)
XYZ_TO_RGB = (
    (3.2404813432005266, -1.5371515162713185, -0.4985363261688878),
    (-0.9692549499965682, 1.8759900014898907, 0.0415559265582928),
    (0.0556466391351772, -0.2040413383665112, 1.0573110696453443),
)


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    """rgb in 0 to 1."""
    rgb = np.asarray(rgb, np.float64)
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ np.array(RGB_TO_XYZ).T / np.array(WHITE)
    f = np.where(xyz > 0.008856, np.cbrt(np.maximum(xyz, 0.008856)), 7.787 * xyz + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def lab_to_rgb(lab: np.ndarray) -> np.ndarray:
    """To rgb in 0 to 1, clipped."""
    lab = np.asarray(lab, np.float64)
    y = (lab[..., 0] + 16) / 116
    f = np.stack([lab[..., 1] / 500 + y, y, np.maximum(y - lab[..., 2] / 200, 0)], axis=-1)
    xyz = np.where(f > 0.2068966, f**3, (f - 4 / 29) / 7.787) * np.array(WHITE)
    linear = xyz @ np.array(XYZ_TO_RGB).T
    return np.clip(np.where(linear > 0.0031308, 1.055 * np.maximum(linear, 0.0031308) ** (1 / 2.4) - 0.055, 12.92 * linear), 0, 1)


def reinhard(patches: np.ndarray, mean, std, modified: bool = False) -> np.ndarray:
    """Match each patch's Lab mean and sample deviation to the reference; rounded half even to uint8.

    modified: lightness is stretched about its own mean, by 1 + q where the reference spreads more
    (q > 0, its relative excess) and by 1.05 elsewhere, and only there a and b are moved to the reference's mean.
    """
    mean, std = np.asarray(mean, np.float64), np.asarray(std, np.float64)
    lab = rgb_to_lab(patches.astype(np.float64) / 255)
    mu = lab.mean(axis=(1, 2), keepdims=True)
    sigma = lab.std(axis=(1, 2), ddof=1, keepdims=True)
    if not modified:
        out = (lab - mu) / (sigma + 1e-8) * std + mean
    else:
        q = (std[0] - sigma[..., 0]) / (std[0] + 1e-8)
        out = lab.copy()
        out[..., 0] = (lab[..., 0] - mu[..., 0]) * np.where(q > 0, 1 + q, 1.05) + mu[..., 0]
        moved = lab[..., 1:] - mu[..., 1:] + mean[1:]
        out[..., 1:] = np.where((q > 0)[..., None], lab[..., 1:], moved)
    return np.clip(np.rint(lab_to_rgb(out) * 255), 0, 255).astype(np.uint8)


def optical_density(rgb: np.ndarray, light: float = 255.0) -> np.ndarray:
    return -np.log(np.clip(rgb.astype(np.float64), 1, light) / light)


def macenko_fit(patches: np.ndarray, alpha: float = 1.0, beta: float = 0.15, light: float = 255.0, pixel_limit: int | None = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Two stain vectors (columns of a 3 x 2 matrix) and each one's 99th percentile of saturation."""
    od = optical_density(patches.reshape(-1, 3), light)
    od = od[np.linalg.norm(od, axis=1) >= beta]
    if not len(od):
        raise RuntimeError("no stained pixel to fit on")
    if pixel_limit is not None and len(od) > pixel_limit:
        od = od[np.random.RandomState(0).choice(len(od), pixel_limit, replace=False)]
    plane = np.linalg.svd(od - od.mean(axis=0), full_matrices=False)[2][:2]
    plane *= np.where(plane[:, :1] < 0, -1.0, 1.0)
    on = od @ plane.T
    ends = np.percentile(np.arctan2(on[:, 1], on[:, 0]), [alpha, 100 - alpha])
    stains = np.stack([np.cos(ends), np.sin(ends)], axis=1) @ plane
    if stains[0, 0] < stains[1, 0]:
        stains = stains[::-1]
    h = (stains / np.maximum(np.linalg.norm(stains, axis=1, keepdims=True), 1e-12)).T
    top = np.percentile(np.linalg.lstsq(h, od.T, rcond=None)[0], 99, axis=1)
    return h, np.where(top == 0, 1.0, top)


def macenko_apply(patches: np.ndarray, h: np.ndarray, top: np.ndarray, light: float = 255.0) -> np.ndarray:
    """Saturations are scaled by the fit's and clipped to 0..1; truncated to uint8."""
    c = np.linalg.lstsq(h, optical_density(patches.reshape(-1, 3), light).T, rcond=None)[0]
    c = np.clip(c / np.maximum(top, 1e-6)[:, None], 0, 1)
    return np.clip(light * np.exp(-(h @ c)), 0, 255).astype(np.uint8).T.reshape(patches.shape)
