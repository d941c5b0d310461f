"""Pluggable embedding of texts, in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors of a list of texts, one row each; called in the tasks, so a model is loaded there.
Embedder = Callable[[list[str]], np.ndarray]
#: Texts that are given to the embedder at once.
BATCH = 32


def hashed_words(width: int) -> Embedder:
    """A stand-in for a model: a text's words counted in ``width`` hashed cells, scaled to length 1; no words give zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, text in zip(out, texts):
            for word in re.findall(r"[^\W_]+", text.lower()):
                row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return embed


def http_embedder(url: str, model: str, key: str | None = None, timeout: int = 60) -> Embedder:
    """An embedding model behind ``url`` (…/v1/embeddings): one vector for each text, in the texts' order; anything else is an error."""

    def embed(texts: list[str]) -> np.ndarray:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            rows = sorted(json.load(reply)["data"], key=lambda row: row["index"])
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return np.array([row["embedding"] for row in rows])

    return embed


def embedded(c: Column, embed: Embedder) -> Column:
    """Vectors of a text column; null texts count as empty."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [embed(list(texts.iloc[i : i + BATCH].fillna(""))) for i in range(0, len(texts), BATCH)]
            yield pd.Series([list(v) for part in parts for v in part])

    return vectors(c)
