"""A deterministic embedder for tests and offline use, behind the same call as a real one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64


def fnv1a(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def hash_embed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Bags of words hashed into dim slots, to length 1; a text without words is a zero vector."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", t.lower()):
            out[i, fnv1a(w.encode()) % dim] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray] = hash_embed, prefix: str = "") -> DataFrame:
    """key, embedding: Arrow batches go through the model in order; prefix is put before each text, as some models ask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "embedding": list(model([prefix + (t or "") for t in f[text]]))})

    return rows.select(key, F.col(text).alias(text)).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")
