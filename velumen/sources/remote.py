"""Inputs over HTTP: bytes by address, and embeddings from a service."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from velumen.functions.encoder import Encoder

#: Fixed values of the calls: attempts after the first, and the longest pause between two, in seconds.
RETRIES, PAUSE = 10, 1.0


def call(request: urllib.request.Request, *, retries: int = RETRIES, pause: float = PAUSE, timeout: float | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The answer's body; failures are tried again after growing pauses."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.read()
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == retries:
                raise
            sleep(min(pause, 0.1 * 2**attempt))
    raise AssertionError


def fetched(addresses: DataFrame, *, id_col: str = "id", url_col: str = "url", **options) -> DataFrame:
    """(id, bytes, error) of the content at each address; a failed one tells its error. Tasks fetch side by side."""
    kind = addresses.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, url in zip(batch["id"], batch["url"], strict=True):
                try:
                    rows.append((i, call(urllib.request.Request(url), **options) if url else None, None))
                except Exception as e:
                    rows.append((i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "bytes", "error"])

    return addresses.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url").mapInPandas(run, f"id {kind}, bytes binary, error string")


def files(spark, path: str) -> DataFrame:
    """(path, content) of files in a store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


class RemoteEncoder(Encoder):
    """An embedding service: POST {"inputs": text} answers [{"input": ..., "embedding": [...]}], one per line."""

    def __init__(self, address: str, dim: int = 512, **options):
        self.address, self.dim, self.options = address, dim, options

    def predictions(self, text: str) -> list[dict]:
        body = json.dumps({"inputs": text}).encode()
        request = urllib.request.Request(self.address, data=body, headers={"Content-Type": "application/json"}, method="POST")
        found = json.loads(call(request, **self.options))
        if not isinstance(found, list) or not found:
            raise ValueError("the service answered without embeddings")
        return [{"input": str(x["input"]), "embedding": [float(v) for v in x["embedding"]]} for x in found]

    def _each(self, texts: list[str]) -> np.ndarray:
        return np.array([self.predictions(t)[0]["embedding"] for t in texts])

    embed_texts = embed_images = _each


def database(env: dict[str, str]) -> str:
    """The schema to use: the one named, else by whether this is production."""
    return env.get("DB_SCHEMA") or ("prod" if env.get("NODE_ENV") == "production" else "dev")
