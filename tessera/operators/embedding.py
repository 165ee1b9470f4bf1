"""Batch embedding with a pluggable function; a deterministic hashing embedder serves tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def hashing_embedder(dimensions: int) -> Callable[[list[str]], np.ndarray]:
    """Counts of hashed words as unit vectors."""

    def embed_texts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                out[i, zlib.crc32(w.encode()) % dimensions] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed_texts


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(id, vector): texts of (id, text) pass through the embedder in bounded batches within each task."""

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"], "vector": list(embedder(part["text"].tolist()))})

    return rows.mapInPandas(run, "id long, vector array<float>")
