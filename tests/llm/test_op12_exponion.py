import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import op12_exponion as op


def brute(rows, dims=64, scale=256, parts=16, entries=64, rounds=2):
    width = dims // parts
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) * scale <= 1 << 27 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[nearest(cut(v, p), p)[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    found = [(i, [nearest(cut(v, p), p) for p in range(parts)], label) for i, v, label in kept]
    by = {}
    for _, f, label in found:
        by[label] = by.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by[label], digest) for i, f, label in found), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("a.b", F.lit(1))
    return sorted((tuple(r) for r in op.compressed(df.repartition(3), **kw).collect()), key=str)


def odd_rows():
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(8)], r.choice([1, 2, None])) for i in range(50, 300)]
    rows += [(1000 + i, rows[0][1], 3) for i in range(150)] + [rows[7]] * 3 + [(rows[7][0], rows[8][1], 4), (None, rows[9][1], None), (None, [0.0] * 8, 5), (-3, [0.0] * 8, 5), (0, [0.0] * 8, 5)]
    return rows + [(1, None, 1), (2, [], 1), (3, [1.0] * 7, 1), (4, [1.0] * 7 + [None], 1), (5, [1.0] * 7 + [math.nan], 1), (6, [1.0] * 7 + [math.inf], 1), (7, [1e30] * 8, 1), (8, [2.0**19] * 8, 1), (9, [-(2.0**19)] * 8, 1)]


@pytest.mark.parametrize("few", [10_000, 0])
def test_matches_brute_force_with_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(op, "FEW_LABELS", few)  # 0: sums by label are not broadcast
    rows = odd_rows()
    assert got(spark, rows, dims=8, parts=4) == brute(rows, dims=8, parts=4)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [i / 3] * 4, None) for i in range(n)]
    assert got(spark, rows, dims=4, parts=2) == brute(rows, dims=4, parts=2)


def test_whole_table_of_given_vectors(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{d}'").fetchall()
    assert sorted((tuple(r) for r in op.compressed(spark.read.parquet(d)).collect()), key=str) == brute(rows)


def test_search_is_exact_from_any_start_and_scans_less_than_all():
    r = np.random.default_rng(4)
    entries = np.concatenate([r.integers(-9, 9, (30, 3)), r.integers(-9, 9, (2, 3)).repeat(3, 0)])  # with equal entries and ties
    parts = r.integers(-9, 9, (3000, 3))
    order, far = op.neighbours(entries)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    for start in (np.zeros(3000, np.int64), r.integers(0, len(entries), 3000), d.argmin(1)):
        best, least = op.search(parts, start, entries, order, far)
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    assert np.mean([np.searchsorted(far[s], 4 * u, side="right") for s, u in zip(d.argmin(1), d.min(1), strict=True)]) < len(entries) / 2
