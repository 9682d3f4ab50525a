"""Perceptual hashes of grey images, in numpy."""

from __future__ import annotations

import numpy as np

SIZE, LOW = 32, 8


def dct_matrix(n: int = SIZE) -> np.ndarray:
    """Orthonormal DCT-II."""
    k = np.arange(n)[:, None]
    m = np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


_DCT = dct_matrix()


def dct2d(pixels: np.ndarray) -> np.ndarray:
    return _DCT @ pixels @ _DCT.T


def _weights(n: int, size: int) -> np.ndarray:
    """Triangle filter from ``n`` to ``size`` samples, widened when shrinking."""
    ratio = n / size
    reach = max(1.0, ratio)
    centre = (np.arange(size) + 0.5) * ratio
    w = np.maximum(0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - centre[:, None]) / reach))
    return w / w.sum(1, keepdims=True)


def resize(pixels: np.ndarray, size: int = SIZE) -> np.ndarray:
    out = _weights(pixels.shape[0], size) @ pixels.astype(float) @ _weights(pixels.shape[1], size).T
    return np.clip(np.floor(out + 0.5), 0, 255)


def coefficients(pixels: np.ndarray) -> np.ndarray:
    """The low 8 x 8 block without its first value, and a zero at the end: 64 values."""
    return np.append(dct2d(resize(pixels))[:LOW, :LOW].ravel()[1:], 0.0)


def phash(pixels: np.ndarray) -> int:
    """64 bits as a signed long: bit i where value i is above element 32 of the sorted values."""
    c = coefficients(pixels)
    bits = c > np.sort(c)[32]
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def orientations(pixels: np.ndarray) -> list[np.ndarray]:
    """The image and its quarter turns clockwise."""
    return [np.rot90(pixels, -k) for k in range(4)]
