"""Blurhash previews: decode to pixels, write as PNG data addresses, and take a primary colour.

The hash is the public compact DCT form: a base-83 text with component counts, a scale, a mean colour and the
remaining components. Decoding sums cosine waves in linear light.
"""

from __future__ import annotations

import base64
import colorsys
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: digits in order.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"
SIZE = 32


def _number(text: str) -> int:
    n = 0
    for ch in text:
        n = n * 83 + DIGITS.index(ch)
    return n


def is_valid(text: str | None) -> bool:
    if not text or len(text) < 6 or any(ch not in DIGITS for ch in text):
        return False
    first = _number(text[0])
    return len(text) == 4 + 2 * (first % 9 + 1) * (first // 9 + 1)


def _linear(srgb: np.ndarray) -> np.ndarray:
    v = srgb / 255.0
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def _srgb(linear: np.ndarray) -> np.ndarray:
    v = np.clip(linear, 0.0, 1.0)
    return np.floor(np.where(v <= 0.0031308, v * 12.92 * 255 + 0.5, (1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5)).astype(np.uint8)


def decode(text: str, width: int = SIZE, height: int = SIZE, punch: float = 1.0) -> np.ndarray:
    """RGBA pixels, height x width x 4."""
    if not is_valid(text):
        raise ValueError("no blurhash")
    across, down = _number(text[0]) % 9 + 1, _number(text[0]) // 9 + 1
    scale = (_number(text[1]) + 1) / 166 * punch
    mean = _number(text[2:6])
    parts = [_linear(np.array([mean >> 16, mean >> 8 & 255, mean & 255], dtype=np.float64))]
    for k in range(1, across * down):
        n = _number(text[4 + 2 * k : 6 + 2 * k])
        q = (np.array([n // 361, n // 19 % 19, n % 19], dtype=np.float64) - 9) / 9
        parts.append(np.sign(q) * q * q * scale)
    waves = np.array(parts).reshape(down, across, 3)
    x = np.cos(np.pi * np.outer(np.arange(width), np.arange(across)) / width)
    y = np.cos(np.pi * np.outer(np.arange(height), np.arange(down)) / height)
    rgb = _srgb(np.einsum("yj,xi,jic->yxc", y, x, waves))
    return np.concatenate([rgb, np.full((height, width, 1), 255, dtype=np.uint8)], axis=2)


def png(pixels: np.ndarray) -> bytes:
    """RGBA pixels as PNG with stored (uncompressed) data and no row filters."""
    height, width, _ = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 0)) + chunk(b"IEND", b"")


def data_url(text: str | None) -> str:
    """Empty for empty input."""
    return "data:image/png;base64," + base64.b64encode(png(decode(text))).decode() if text else ""


def primary_colour(text: str) -> tuple[float, float, float]:
    """Hue (0 to 360), saturation and lightness (0 to 100) of the most frequent colour, in cells of 32 levels a channel.

    The choice of cells is ours; the colour is the mean of the fullest cell, the first in order among equals.
    """
    rgb = decode(text)[:, :, :3].reshape(-1, 3)
    cell = (rgb >> 5).astype(np.int64) @ np.array([64, 8, 1])
    kinds, counts = np.unique(cell, return_counts=True)
    mean = rgb[cell == kinds[np.argmax(counts)]].mean(axis=0) / 255
    h, l, s = colorsys.rgb_to_hls(*mean)  # noqa: E741
    return h * 360, s * 100, l * 100


def data_url_column(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: data_url(t) if pd.notna(t) else None)

    return run(c)


def primary_colour_column(c: Column) -> Column:
    """Struct of h, s and l; null for null and for what is no hash."""

    @F.pandas_udf("h double, s double, l double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([primary_colour(t) if is_valid(t) else (None, None, None) for t in texts], columns=["h", "s", "l"])

    return run(c)
