"""Pooling of frames and tokens into one vector a clip.

Each task adds up whole vectors by clip, in NumPy on Arrow batches: number, mean and squared deviations of every dimension and the
first and last vector. One row a task and clip is exchanged, and rows are merged in two steps, first by the task's number modulo
FAN, so a clip that every task holds frames of is never gathered at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64
#: Values that a task holds before it hands on what it has, and the values that a key's state takes as much memory as beside its own,
#: so that many short vectors are bounded like a few long ones.
HELD, STATE = 1 << 20, 512


class _State:
    """n, mean and squared deviations by dimension; the frames' range with the vectors there."""

    __slots__ = ("first", "last", "m2", "mean", "n")

    def __init__(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, first: tuple, last: tuple):
        self.n, self.mean, self.m2, self.first, self.last = n, mean, m2, first, last

    def add(self, o: _State) -> None:
        n = self.n + o.n
        d = o.mean - self.mean
        share = o.n / np.where(n > 0, n, 1)
        self.m2 = self.m2 + o.m2 + d * d * self.n * share
        self.mean = self.mean + d * share
        self.n = n
        self.first = min(self.first, o.first, key=lambda x: x[0])
        self.last = max(self.last, o.last, key=lambda x: x[0])


def _states(keys: pd.DataFrame, frame: np.ndarray, x: np.ndarray, valid: np.ndarray, weight: np.ndarray) -> Iterator[tuple[tuple, _State]]:
    """(key, state) of the rows of a batch, whose vectors all have one length."""
    group = keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((frame, group))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    w = (valid * weight[:, None])[order]
    own = np.where(valid, x, 0.0)[order]
    n = np.add.reduceat(w, starts)
    mean = np.add.reduceat(own * w, starts) / np.where(n > 0, n, 1)
    away = own - np.repeat(mean, ends - starts, 0)
    m2 = np.add.reduceat(w * away * away, starts)
    named = [keys[c].tolist() for c in keys.columns]
    for g, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        i, j = order[a], order[b - 1]
        ends_of = [(frame[k], np.where(valid[k], x[k], np.nan)) for k in (i, j)]
        yield tuple(k[i] for k in named), _State(n[g].copy(), mean[g].copy(), m2[g].copy(), *ends_of)


def _merged(df: DataFrame, keys: Sequence[str], vector: str, frame: str, weight: Column) -> DataFrame:
    """(keys, _s, _first, _last): _s has n, mean and m2 of each dimension, _first and _last the frame and its vector."""
    named = [f"_k{i}" for i in range(len(keys))]
    own = df.where(F.col(vector).isNotNull() & F.col(frame).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(frame).alias("_f"), F.col(vector).cast("array<double>").alias("_x"), weight.cast("double").alias("_w"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[: len(keys)])
    at = own.schema["_f"].dataType.simpleString()
    end = f"struct<f: {at}, v: array<double>>"
    schema = f"{kinds}, _part int, _s array<struct<n: double, mean: double, m2: double>>, _first {end}, _last {end}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % FAN
        held: dict[tuple, _State] = {}
        total, types = 0, None

        def out() -> pa.RecordBatch:
            rows = [[*k, part, [{"n": a, "mean": b, "m2": c} for a, b, c in zip(s.n.tolist(), s.mean.tolist(), s.m2.tolist(), strict=True)], *[{"f": f.item() if hasattr(f, "item") else f, "v": [None if y != y else y for y in v.tolist()]} for f, v in (s.first, s.last)]] for (k, _), s in held.items()]
            ends = pa.struct([("f", types[-1]), ("v", pa.list_(pa.float64()))])
            every = [*types[:-1], pa.int32(), pa.list_(pa.struct([("n", pa.float64()), ("mean", pa.float64()), ("m2", pa.float64())])), ends, ends]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(every)], names=[*named, "_part", "_s", "_first", "_last"])

        for b in batches:
            if not b.num_rows:
                continue
            types = [*[b.column(i).type for i in range(len(named))], b.column(len(named)).type]
            lists, length = b.column(len(named) + 1), np.diff(b.column(len(named) + 1).offsets.to_numpy())
            flat = lists.flatten()
            values, valid = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
            places = np.concatenate([[0], np.cumsum(length)])
            keyed = pd.DataFrame({n: pd.Series(b.column(i).to_pylist(), dtype=object) for i, n in enumerate(named)})
            frames, weights = b.column(len(named)).to_numpy(zero_copy_only=False), b.column(len(named) + 2).fill_null(0.0).to_numpy(zero_copy_only=False)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                take = places[rows][:, None] + np.arange(n)
                for key, state in _states(keyed.iloc[rows].reset_index(drop=True), frames[rows], values[take], valid[take], weights[rows]):
                    if (key, n) in held:
                        held[key, n].add(state)
                    else:
                        held[key, n] = state
                        total += 5 * n + STATE
                        if total > HELD:
                            yield out()
                            held, total = {}, 0
        if held:
            yield out()

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        d = b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * share).alias("m2"))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)

    rows = own.mapInArrow(run, schema)
    for by in ([*named, "_part"], named):
        grouped = rows.groupBy(*by).agg(F.collect_list("_s").alias("_l"), F.min_by("_first", F.col("_first.f")).alias("_first"), F.max_by("_last", F.col("_last.f")).alias("_last"))
        rows = grouped.withColumn("_s", F.aggregate(F.slice("_l", 2, F.size("_l")), F.get("_l", F.lit(0)), lambda s, x: F.zip_with(s, x, merge))).drop("_l")
    return rows.withColumnsRenamed(dict(zip(named, keys, strict=True)))


def pooled(df: DataFrame, keys: Sequence[str], vector: str, frame: str, parts: Sequence[str] = ("mean",)) -> DataFrame:
    """(keys, pooled): the parts of every dimension, one after another.

    Parts: mean; std (of the population); delta (mean first difference, which is (last - first) / (n - 1), 0 for one frame).
    Null vectors and null frames do not count; a null within a vector does not count for its dimension.
    """
    s = F.col("_s")
    each = lambda of: F.transform(s, lambda x: F.when(x["n"] > 0, of(x)))
    last = lambda i: F.get(F.col("_last.v"), i) - F.get(F.col("_first.v"), i)
    made = {
        "mean": each(lambda x: x["mean"]),
        "std": each(lambda x: F.sqrt(x["m2"] / x["n"])),
        "delta": F.transform(s, lambda x, i: F.when(x["n"] > 1, last(i) / (x["n"] - 1)).otherwise(0.0)),
    }
    return _merged(df, keys, vector, frame, F.lit(1.0)).select(*keys, F.concat(*[made[p] for p in parts]).alias("pooled"))


def pooled_or_zeros(clips: DataFrame, df: DataFrame, keys: Sequence[str], vector: str, frame: str, parts: Sequence[str], width: int) -> DataFrame:
    """pooled() for every clip; zeros where it has no frames."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return clips.select(*keys).distinct().join(pooled(df, keys, vector, frame, parts), list(keys), "left").select(*keys, F.coalesce("pooled", zeros).alias("pooled"))


def token_pooled(df: DataFrame, keys: Sequence[str], vector: str, position: str, mask: Column, how: str = "mean") -> DataFrame:
    """(keys, pooled) of tokens: cls (the first), mean (of unmasked ones, over one at least), or cls+mean."""
    made = {"cls": F.col("_first.v"), "mean": F.transform("_s", lambda x: x["mean"] * x["n"] / F.greatest(x["n"], F.lit(1.0)))}
    return _merged(df, keys, vector, position, mask.cast("double")).select(*keys, F.concat(*[made[p] for p in how.split("+")]).alias("pooled"))
