"""What the operators on embeddings share: clean vectors in double precision, as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def clean(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and vector (float64 as bytes) of rows with a usable embedding and no null key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                stops = 8 * np.cumsum([len(v) for v in frame["embedding"]])
                raw = np.concatenate(frame["embedding"].tolist()).astype(np.float64).tobytes()
                yield frame[list(keys)].assign(vector=[raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)])

    picked = rows.select(*(F.col(k).cast("bigint").alias(k) for k in keys), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    for key in keys:
        picked = picked.where(F.col(key).isNotNull())
    return picked.mapInPandas(run, ", ".join(f"{k} bigint" for k in keys) + ", vector binary")


def matrix(vectors) -> np.ndarray:
    """Rows of equal length from their bytes."""
    return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)


def units(vectors) -> np.ndarray:
    """Rows of equal length from their bytes, each divided by its norm."""
    x = matrix(vectors)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)
