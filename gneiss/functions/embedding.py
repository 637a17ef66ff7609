"""Embedders as column functions: text to a unit vector of floats."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 256
WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+")

Embedder = Callable[[Column], Column]


def hashed(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed counts of hashed words and letter triples, at length 1; the same everywhere, without a model."""
    import xxhash

    out = np.zeros((len(texts), dimension))
    for row, text in zip(out, texts, strict=True):
        words = [w.lower() for w in WORD.findall(text or "")]
        features = words + [f"{w[i : i + 3]}_" for w in words for i in range(max(0, len(w) - 2))]
        for f in features:
            h = xxhash.xxh64_intdigest(f, 9)
            row[h % dimension] += 1.0 if h >> 63 else -1.0
        size = np.sqrt(row @ row)
        if size:
            row /= size
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def local(texts: pd.Series) -> pd.Series:
    return pd.Series(list(hashed(texts.tolist()).astype(np.float32)))


EMBEDDERS: dict[str, Embedder] = {"local": local}


def embedder(name: str) -> Embedder:
    """The embedder of this name; others register themselves in EMBEDDERS."""
    key = name.strip().lower()
    if key not in EMBEDDERS:
        raise ValueError(f"unsupported embedding: {name}")
    return EMBEDDERS[key]
