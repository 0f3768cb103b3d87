"""Partial Fourier sums of reflect-padded frames, split over tiles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=8)
def line_terms(size: int, pad: int, bins: tuple[int, ...], start: int, length: int) -> np.ndarray:
    """(bins x length) weights of the frame lines from ``start`` in the given bins, their padded mirror images included."""
    total, turn = size + 2 * pad, 2 * (size - 1)
    at = np.arange(start, start + length)
    if size == 1:
        places = np.arange(total)[:, None]
        seen = np.ones(places.shape, bool)
    else:
        shift = np.arange(-(pad // turn) - 1, total // turn + 2)[:, None] * turn + pad
        places = np.concatenate([shift + at, shift - at])
        seen = (places >= 0) & (places < total)
        seen[len(shift):] &= (at > 0) & (at < size - 1)  # the two end lines are their own mirror images
    out = np.zeros((len(bins), length), complex)
    for place, mine in zip(places, seen):
        if mine.any():
            out += np.where(mine, np.exp(-2j * np.pi * (np.outer(bins, place) % total) / total), 0)
    return out


@lru_cache(maxsize=8)
def inverse_terms(size: int, pad: int, bins: tuple[int, ...], start: int, length: int) -> np.ndarray:
    """(length x bins) inverse waves at the unpadded lines from ``start``, scaled by the padded length."""
    total = size + 2 * pad
    return np.exp(2j * np.pi * (np.outer(np.arange(start, start + length) + pad, bins) % total) / total) / total


def low_pass(lines: np.ndarray, pad: int, cut: float) -> np.ndarray:
    """Lines (size x any) without what a Gaussian of frequency ``cut`` drops, as circles of their reflected padding."""
    size = len(lines)
    turn = np.mod(np.arange(size + 2 * pad) - pad, max(2 * (size - 1), 1))
    padded = lines[np.where(turn < size, turn, 2 * (size - 1) - turn)]
    share = np.exp(-0.5 * (np.fft.rfftfreq(len(padded)) / cut) ** 2)
    return np.fft.irfft(np.fft.rfft(padded, axis=0) * share[:, None], len(padded), axis=0)[pad:pad + size]
