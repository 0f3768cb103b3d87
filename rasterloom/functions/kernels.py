"""Small numpy kernels used inside tile tasks: separable filters by banded blocks.

The frame's border rule is applied by taking the lines that stand in for missing ones, so tiled and untiled
results agree.  A filter along one axis then goes block by block: a block of lines is the product of one
small band matrix, which depends on the taps alone, with the lines that the block can see.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

TRUNCATE = 4.0


def gaussian_taps(sigma: float, order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and weights of a sampled Gaussian or of its first or second derivative."""
    radius = int(TRUNCATE * sigma + 0.5)
    t = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (t / sigma) ** 2)
    w /= w.sum()
    if order == 1:
        w = w * t / sigma**2
    elif order == 2:
        w = w * (t**2 / sigma**4 - 1 / sigma**2)
    return t, w


def box_taps(size: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(-(size // 2), size - size // 2)
    return t, np.full(size, 1.0 / size)


def border_index(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Frame index that stands in for ``i`` under the border rule."""
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    m = np.mod(i, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def filter_taps(kind: tuple) -> tuple[np.ndarray, np.ndarray]:
    return gaussian_taps(kind[1], kind[2]) if kind[0] == "gauss" else box_taps(kind[1])


@lru_cache(maxsize=64)
def band_block(kind: tuple, size: int) -> np.ndarray:
    """(size x size + taps - 1) matrix of a filter over consecutive lines; under 1 MB for sigmas up to 64."""
    weights = filter_taps(kind)[1]
    m = np.zeros((size, size + len(weights) - 1))
    for i in range(size):
        m[i, i:i + len(weights)] = weights
    return m


def filter_axis(data: np.ndarray, axis: int, core0: int, n_core: int, win0: int, frame: int, kind: tuple, mode: str) -> np.ndarray:
    """Filtered lines ``core0..core0+n_core`` of a stack whose axis begins at frame line ``win0``."""
    offs = filter_taps(kind)[0]
    more = len(offs) - 1
    seen = np.take(data, border_index(core0 + offs[0] + np.arange(n_core + more), frame, mode) - win0, axis)
    size = min(n_core, max(32, len(offs) // 2))
    band, parts = band_block(kind, size), []
    for s in range(0, n_core, size):
        n = min(size, n_core - s)
        m = band[:n, :n + more]
        parts.append(m @ seen[:, s:s + n + more] if axis == 1 else seen[:, :, s:s + n + more] @ m.T)
    return np.concatenate(parts, axis)


class Window:
    """A stack of equal windows with the position of their common core."""

    def __init__(self, data: np.ndarray, core: tuple[int, int, int, int], origin: tuple[int, int], frame: tuple[int, int]):
        self.data, self.core, self.origin, self.frame = data, core, origin, frame

    def centre(self, src: np.ndarray | None = None) -> np.ndarray:
        y, x, h, w = self.core
        oy, ox = self.origin
        return (self.data if src is None else src)[:, y - oy:y - oy + h, x - ox:x - ox + w]

    def filter(self, ky: tuple, kx: tuple, src: np.ndarray | None = None, mode: str = "reflect") -> np.ndarray:
        data = self.data if src is None else src
        y, x, h, w = self.core
        oy, ox = self.origin
        return filter_axis(filter_axis(data, 1, y, h, oy, self.frame[0], ky, mode), 2, x, w, ox, self.frame[1], kx, mode)

    def gauss(self, sigma, order=(0, 0), src=None, mode="reflect"):
        sy, sx = sigma if isinstance(sigma, tuple) else (sigma, sigma)
        return self.filter(("gauss", float(sy), order[0]), ("gauss", float(sx), order[1]), src, mode)

    def box(self, size: int, src=None, mode="nearest"):
        return self.filter(("box", int(size)), ("box", int(size)), src, mode)


def gaussian(win: Window, sigma: float) -> np.ndarray:
    return win.gauss(sigma)


def gradient_magnitude(win: Window, sigma: float) -> np.ndarray:
    return np.hypot(win.gauss(sigma, (1, 0)), win.gauss(sigma, (0, 1)))


def laplacian(win: Window, sigma: float) -> np.ndarray:
    return win.gauss(sigma, (2, 0)) + win.gauss(sigma, (0, 2))


def local_std(win: Window, sigma: float) -> np.ndarray:
    return np.sqrt(np.maximum(win.gauss(sigma, src=win.data**2) - win.gauss(sigma) ** 2, 0.0))


def local_contrast(win: Window, size: int, mean_floor: float = 0.02) -> np.ndarray:
    mean = win.box(size)
    var = np.maximum(win.box(size, src=win.data**2) - mean**2, 0.0)
    return np.sqrt(var) / np.maximum(mean, mean_floor)


def flat_field(win: Window, ref: np.ndarray, sigma_y: float, sigma_x: float, blank_frac: float = 0.05) -> np.ndarray:
    """Divide by a blurred background taken from valid pixels only; blank pixels become 0."""
    ref = ref[:, None, None]
    valid = (win.data >= np.maximum(blank_frac * ref, 1e-6)).astype(float)
    num = win.gauss((sigma_y, sigma_x), src=win.data * valid, mode="nearest")
    den = win.gauss((sigma_y, sigma_x), src=valid, mode="nearest")
    background = num / np.maximum(den, 1e-3)
    out = win.centre() / np.maximum(background, np.maximum(1e-3 * ref, 1e-9))
    return np.where(win.centre(valid) == 0, 0.0, out)


def _hessian(win: Window, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Scale-normalised Hessian eigenvalues, smaller magnitude first."""
    hyy, hxx = win.gauss(sigma, (2, 0)) * sigma**2, win.gauss(sigma, (0, 2)) * sigma**2
    hxy = win.gauss(sigma, (1, 1)) * sigma**2
    mean, disc = (hyy + hxx) / 2, np.sqrt(((hyy - hxx) / 2) ** 2 + hxy**2)
    a, b = mean + disc, mean - disc
    return np.where(np.abs(a) < np.abs(b), a, b), np.where(np.abs(a) < np.abs(b), b, a)


def hessian_energy(win: Window, sigma: float) -> np.ndarray:
    return np.hypot(*_hessian(win, sigma))


def ridge(win: Window, sigmas, energy_max) -> np.ndarray:
    """Dark-ridge strength, greatest over the scales; ``energy_max`` is the frame's largest energy per scale."""
    best = None
    for s, top in zip(sigmas, energy_max):
        small, large = _hessian(win, s)
        blob = np.abs(small) / np.maximum(np.abs(large), 1e-10)
        gamma = np.maximum(top[:, None, None] / 2, 1e-10)
        r = np.exp(-blob**2 / 0.5) * (1 - np.exp(-(small**2 + large**2) / (2 * gamma**2)))
        r = np.where(large > 0, r, 0.0)
        best = r if best is None else np.maximum(best, r)
    return best
