"""Encoders of texts, waveforms and frames as a protocol with a deterministic stand-in.

No model weights come with this library. An Encoder is any picklable object with `width` and `encode(items)`; it is made once a
worker and called with whole batches. HashEncoder stands in for tests: equal inputs give equal vectors, which mean nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


class Encoder(Protocol):
    width: int

    def encode(self, items: list) -> np.ndarray: ...


class HashEncoder:
    """Vectors from the SHA-256 of an item's repr, in [-1, 1)."""

    def __init__(self, width: int = 16):
        self.width = width

    def encode(self, items: list) -> np.ndarray:
        out = np.empty((len(items), self.width))
        for i, x in enumerate(items):
            x = x.tolist() if isinstance(x, np.ndarray) else x
            raw = b"".join(hashlib.sha256(f"{k}|{x!r}".encode()).digest() for k in range(-(-self.width // 32)))
            out[i] = np.frombuffer(raw, np.uint8)[: self.width] / 128.0 - 1
        return out


_MADE: dict[str, Encoder] = {}


def encoded(df: DataFrame, make: Callable[[], Encoder], column: str, out: str = "embedding", width: int | None = None, skip: Column | None = None, batch: int = 16) -> DataFrame:
    """df with a vector a row; rows where skip holds, or the column is null, get zeros and never reach the encoder."""
    width = width or make().width
    skipped = F.col(column).isNull() if skip is None else F.coalesce(skip, F.lit(False)) | F.col(column).isNull()
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
    key = f"{make!r}|{out}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _MADE:
            _MADE[key] = make()
        encoder = _MADE[key]
        for b in batches:
            items, vectors = b[column].tolist(), []
            for at in range(0, len(items), batch):
                vectors += list(encoder.encode(items[at : at + batch]))
            yield b.assign(**{out: vectors})

    zeros = F.array_repeat(F.lit(0.0), width)
    return df.where(~skipped).mapInPandas(run, schema).unionByName(df.where(skipped).withColumn(out, zeros))
