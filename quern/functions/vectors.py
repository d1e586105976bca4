"""Vector functions: as columns where a row suffices, as Arrow batches where a matrix product pays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays. The length is an element that is bound once: as a mere expression it would be computed for every component."""
    size = norm(v)
    sizes = F.array(F.when(size == 0, 1.0).otherwise(size))
    return F.transform(sizes, lambda n: F.transform(v, lambda x: (x / n).cast("float")))[0]


def to_bytes(v: Column) -> Column:
    """Little-endian 32-bit floats."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes()), "binary")(v)


def from_bytes(v: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else np.frombuffer(x, "<f4").tolist()), "array<float>")(v)


def hashed_words(text: Column, size: int = 768) -> Column:
    """Unit vectors of hashed words (FNV-1a, 32 bits): an embedding without a model, for tests and offline use."""

    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            out = np.zeros(size)
            for word in (text or "").lower().split():
                h = 2166136261
                for b in word.encode():
                    h = (h ^ b) * 16777619 & 0xFFFFFFFF
                out[h % size] += 1
            length = np.linalg.norm(out)
            return (out / (length or 1)).tolist()

        return texts.map(one)

    return F.pandas_udf(embed, "array<float>")(text)
