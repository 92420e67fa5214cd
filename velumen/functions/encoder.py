"""Embedding encoders: an interface, a deterministic stand-in, and the one-input-many-lines dispatch.

No model is at hand, so semantic quality cannot be had here: the stand-in hashes character trigrams (texts) or the
address (images) into a unit vector, which is stable over runs and machines. A real model implements Encoder.
"""

from __future__ import annotations

import re
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = r"^https?://"
#: Characters at which a text has a new line, and those that are stripped from its ends, as character classes.
NEW_LINE = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
BLANK = r"\t \x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}" + NEW_LINE
#: The same blanks one by one.
BLANKS = "\t \x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


class Encoder(ABC):
    dim: int

    @abstractmethod
    def embed_texts(self, texts: list[str]) -> np.ndarray: ...

    @abstractmethod
    def embed_images(self, addresses: list[str]) -> np.ndarray: ...

    def embed_batch(self, inputs: list[str]) -> list[list[float]]:
        """Unit vectors; inputs that are addresses are embedded as images."""
        image = np.array([bool(re.match(ADDRESS, x)) for x in inputs], dtype=bool)
        out = np.zeros((len(inputs), self.dim))
        for mask, embed in ((image, self.embed_images), (~image, self.embed_texts)):
            if mask.any():
                out[mask] = embed([x for x, m in zip(inputs, mask, strict=True) if m])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()

    def embed(self, text: str) -> list[list[float]]:
        """One vector per line of the stripped input; blank input gives an error, as there is nothing to answer."""
        lines = [line.strip() for line in text.strip().splitlines()]
        if not lines:
            raise ValueError("at least one input line is needed")
        return self.embed_batch(lines)


class HashEncoder(Encoder):
    def __init__(self, dim: int = 512):
        self.dim = dim

    def _hash(self, parts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(parts), self.dim))
        for i, grams in enumerate(parts):
            for g in grams:
                h = zlib.crc32(g.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
            if not out[i].any():
                out[i, 0] = 1
        return out

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return self._hash([[f" {t.lower()} "[k : k + 3] for k in range(len(t))] for t in texts])

    def embed_images(self, addresses: list[str]) -> np.ndarray:
        return self._hash([[f"image:{a}:{k}" for k in range(16)] for a in addresses])


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """The stripped lines of a stripped input; none for blank input."""
    bare = _stripped(text)
    return F.when(F.length(bare) > 0, F.transform(F.split(bare, f"\r\n|[{NEW_LINE}]"), _stripped)).otherwise(F.array().cast("array<string>"))


def dispatch(inputs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line with its position and kind, image for addresses and text else."""
    each = inputs.select(*[c for c in inputs.columns if c != text_col], F.posexplode(lines(F.col(text_col))).alias("line", "input"))
    return each.withColumn("kind", F.when(F.col("input").rlike(ADDRESS), "image").otherwise("text"))


def embed_column(df: DataFrame, encoder: Encoder, text_col: str = "input", out_col: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(encoder.embed_batch(texts.fillna("").tolist()))

    return df.withColumn(out_col, run(F.col(text_col)))
