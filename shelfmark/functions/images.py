"""Numbers from grey pixels. Pixels are a flat array of a square image, row by
row; decoding files is left to the reader that has a library for it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _grey(pixels) -> np.ndarray | None:
    if pixels is None or len(pixels) == 0:
        return None
    side = int(len(pixels) ** 0.5)
    return np.asarray(pixels, float).reshape(side, side) if side * side == len(pixels) else None


def _cosine(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def phash_of(pixels) -> str | None:
    """16 hex digits: which of the 8 x 8 lowest frequencies lie above their median."""
    g = _grey(pixels)
    if g is None or len(g) < 8:
        return None
    c = _cosine(len(g))
    low = (c @ g @ c.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def sharpness_of(pixels) -> float | None:
    """Variance of the image after an edge filter (each pixel eight times less its neighbours, held within 0 to 255)."""
    g = _grey(pixels)
    if g is None or len(g) < 3:
        return None
    around = sum(np.roll(np.roll(g, dy, 0), dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - g
    edges = np.clip(8 * g - around, 0, 255)
    edges[[0, -1], :], edges[:, [0, -1]] = g[[0, -1], :], g[:, [0, -1]]
    return float(edges.var())


@F.pandas_udf(T.StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    return pd.Series([phash_of(p) for p in pixels], dtype=object)


@F.pandas_udf(T.DoubleType())
def sharpness(pixels: pd.Series) -> pd.Series:
    return pd.Series([sharpness_of(p) for p in pixels], dtype=float)
