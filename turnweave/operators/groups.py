"""Groups through pandas, one at a time, from partitions that are sorted by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def apply_to_groups(df: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(rows of one key) for every key, its rows in any order; the key is the first column of the schema and added to the result.

    Rows are exchanged by key into the session's shuffle partitions and sorted there, so many small groups cross to pandas in one
    batch, and no more than a batch and a group is held. The number is explicit as adaptive execution goes by bytes, and what is
    done with a group here costs far more than its bytes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in schema.split(", ")]

    def of(group: pd.DataFrame) -> pd.DataFrame:
        got = run(group)
        got.insert(0, names[0], [group[key].iloc[0]] * len(got))
        return got[names]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            k = batch[key]
            new = (k != k.shift()) & ~(k.isna() & k.shift().isna())
            starts = np.flatnonzero(new.to_numpy())
            if held and not _same(held[-1][key].iloc[-1], k.iloc[0]):
                yield of(pd.concat(held, ignore_index=True))
                held = []
            edges = [*starts[starts > 0].tolist(), len(batch)]
            begin, out = 0, []
            for end in edges[:-1]:
                held.append(batch.iloc[begin:end])
                out.append(of(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)))
                held, begin = [], end
            if out:
                yield pd.concat(out)
            held.append(batch.iloc[begin:])
        if held:
            yield of(pd.concat(held, ignore_index=True))

    return df.repartition(n, key).sortWithinPartitions(key).mapInPandas(each, schema)


def _same(a: object, b: object) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))
