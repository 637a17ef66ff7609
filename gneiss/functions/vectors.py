"""Vectors as little-endian 32-bit floats, the form that database stores keep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_bytes(values) -> bytes:
    if values is None or not len(values):
        raise ValueError("an empty vector cannot be stored")
    return np.asarray(values, dtype="<f4").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    if not data or len(data) % 4:
        raise ValueError(f"{len(data or b'')} bytes are no vector of 32-bit floats")
    return np.frombuffer(data, dtype="<f4")


@F.pandas_udf(T.BinaryType())
def encoded(vectors: pd.Series) -> pd.Series:
    return vectors.map(to_bytes)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded(blobs: pd.Series) -> pd.Series:
    return blobs.map(from_bytes)
