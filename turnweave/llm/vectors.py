"""Vectors of whole numbers: the rows of a table that can be scaled to them, in Arrow blocks, with exact squared distances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import quoted

#: Components beyond it are no valid ones: 64 squares of differences stay below 2 ** 63.
LARGEST = 1 << 27


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, **more: Column) -> DataFrame:
    """(id, v, *more) of the rows whose vector has dims components, all finite, with v = floor(scale * x).

    Components of which the scaled value is over 2 ** 27 in magnitude count as not finite, as distances to them need not fit a long.
    """
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(F.abs(x) <= LARGEST / scale, F.lit(False)) & ~F.isnan(x))
    own = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("v"), *[c.alias(k) for k, c in more.items()]).where(F.coalesce(fine, F.lit(False)))
    return own.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column whose lists all have dims numbers, as rows of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(-1, dims)


def blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches joined to tables of at most `rows` rows, all full but the last."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        while total + b.num_rows >= rows:
            cut = rows - total
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held, total, b = [], 0, b.slice(cut)
        if b.num_rows:
            held.append(b)
            total += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def narrow(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least type that holds them."""
    return v.astype(np.result_type(np.min_scalar_type(int(v.min(initial=0))), np.min_scalar_type(int(v.max(initial=0)))))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to those of b."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    kind = np.float64 if 4 * a.shape[1] * most * most < 1 << 52 else np.int64  # whole numbers below 2 ** 53 are exact in either
    a, b = a.astype(kind), b.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
