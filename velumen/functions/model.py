"""An encoder whose model sees the inputs: token ids of texts and pixels of the images at addresses."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from velumen.functions import png, preprocess, vector
from velumen.functions.encoder import Encoder

#: Largest factor by which similarities are scaled to logits.
MOST_SCALE = 100.0


def image_pixels(data: bytes) -> np.ndarray:
    """RGB pixels of an image file."""
    return preprocess.to_rgb(*png.pixels(data))


@lru_cache(maxsize=8)
def _loaded(load: Callable[[], tuple[Callable, Callable]]) -> tuple[Callable, Callable]:
    """The models of a loader, made once a process."""
    return load()


class OnnxModels:
    """Loads two networks from files: pixels (n x 3 x size x size) and ids (n x context) to vectors. Equal paths are one loader."""

    def __init__(self, image_path: str, text_path: str):
        self.paths = image_path, text_path

    def __hash__(self) -> int:
        return hash(self.paths)

    def __eq__(self, other) -> bool:
        return isinstance(other, OnnxModels) and self.paths == other.paths

    def __call__(self) -> tuple[Callable, Callable]:
        import onnxruntime

        def run(path: str) -> Callable[[np.ndarray], np.ndarray]:
            session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
            return lambda x: session.run(None, {name: x})[0]

        return run(self.paths[0]), run(self.paths[1])


class ModelEncoder(Encoder):
    """load gives (image model, text model), once a worker; fetch gives the bytes at an address."""

    def __init__(self, load: Callable[[], tuple[Callable, Callable]], fetch: Callable[[str], bytes], tokenizer: str, *, dim: int = 512, model: str | None = None, decode: Callable[[bytes], np.ndarray] = image_pixels):
        self.load, self.fetch, self.tokenizer, self.dim, self.model, self.decode = load, fetch, tokenizer, dim, model, decode

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return np.asarray(_loaded(self.load)[1](preprocess.token_ids(texts, self.tokenizer)), dtype=np.float64)

    def embed_images(self, addresses: list[str]) -> np.ndarray:
        batch = np.stack([preprocess.preprocess(self.decode(self.fetch(a)), self.model) for a in addresses])
        return np.asarray(_loaded(self.load)[0](batch), dtype=np.float64)


def logits(image: Column, text: Column, log_scale: float) -> Column:
    """Scaled similarity of an image's and a text's vector; the scale is bounded."""
    return F.lit(min(math.exp(log_scale), MOST_SCALE)) * vector.dot(vector.l2_normalize(image), vector.l2_normalize(text))
