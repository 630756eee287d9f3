"""Frames as arrays of pixels (height x width x channels, 8 bits): resizing, and a plain file form."""

from __future__ import annotations

import numpy as np


def _weights(n: int, m: int, lobes: int = 3) -> np.ndarray:
    """m x n: how the m pixels of a smaller row weigh the n of a larger one (Lanczos window, widened by the ratio)."""
    ratio = n / m
    x = ((np.arange(n) + 0.5)[None, :] - (np.arange(m) + 0.5)[:, None] * ratio) / ratio
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def fit_size(width: int, height: int, side: int) -> tuple[int, int]:
    """The size at which the longer side is ``side`` at most; the same as ``sampling.fit_within`` says for columns. A side
    of 0 or less leaves the size."""
    longest = max(width, height)
    if side <= 0 or longest <= side:
        return width, height
    return max(1, round(width * (side / longest))), max(1, round(height * (side / longest)))


def fit_within(pixels: np.ndarray, side: int) -> np.ndarray:
    """``pixels``, made smaller where the longer side is above ``side``; the aspect ratio stays."""
    height, width = pixels.shape[:2]
    wide, high = fit_size(width, height, side)
    if (wide, high) == (width, height):
        return pixels
    out = np.tensordot(_weights(height, high), pixels.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(_weights(width, wide), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def to_ppm(pixels: np.ndarray) -> bytes:
    """The portable pixmap form: a line of text and the bytes."""
    return b"P6 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels[..., :3]).tobytes()


def from_ppm(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"\n")
    kind, width, height, most = head.split()
    if kind != b"P6" or most != b"255":
        raise ValueError("not a portable pixmap of 8 bits")
    return np.frombuffer(body, np.uint8).reshape(int(height), int(width), 3)
