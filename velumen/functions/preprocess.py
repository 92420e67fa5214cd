"""Preparing inputs for an embedding model: pixels and token ids."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Input sizes by model variant; all others take the first.
SIZE, SMALLER = 256, {"mobileclip_b": 224}
CONTEXT = 77


def to_rgb(pixels: np.ndarray, palette: np.ndarray | None = None) -> np.ndarray:
    """Height x width x 3 bytes from grey, grey with alpha, RGB, RGBA or palette pixels. Alpha is dropped."""
    if palette is not None:
        return palette[pixels.reshape(pixels.shape[:2])][:, :, :3].astype(np.uint8)
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] <= 2 else pixels[:, :, :3]


def _weights(n_in: int, n_out: int) -> np.ndarray:
    """Triangle weights of each output place over the inputs; wider than one input when shrinking, so nothing is skipped."""
    scale = n_in / n_out
    reach = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    w = np.maximum(0.0, 1 - np.abs((np.arange(n_in) + 0.5)[None, :] - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    x = pixels.astype(np.float64)
    out = np.einsum("yh,hwc,xw->yxc", _weights(x.shape[0], height), x, _weights(x.shape[1], width), optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preprocess(pixels: np.ndarray, model: str | None = None) -> np.ndarray:
    """Shorter side to the model's size, the square in the middle, channels first, values 0 to 1."""
    size = SMALLER.get(model or "", SIZE)
    h, w = pixels.shape[:2]
    small = resize(pixels, *((size, max(size, int(size * w / h))) if h <= w else (max(size, int(size * h / w)), size)))
    top, left = (small.shape[0] - size) // 2, (small.shape[1] - size) // 2
    return (small[top : top + size, left : left + size].transpose(2, 0, 1) / 255.0).astype(np.float32)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(texts: list[str], path: str, context: int = CONTEXT, start: int = 49406, end: int = 49407) -> np.ndarray:
    """One row of `context` ids per text: start, the text's ids as far as they fit, end, and zeros."""
    out = np.zeros((len(texts), context), dtype=np.int64)
    for i, e in enumerate(_tokenizer(path).encode_batch(texts, add_special_tokens=False)):
        ids = [start, *e.ids[: context - 2], end]
        out[i, : len(ids)] = ids
    return out
