import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import op11_ball_tree as op


def brute(rows, dims=64, scale=64, k=16, rounds=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) * scale <= 1 << 27 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    z = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(z)), key=lambda c: (far(v, z[c]), c))
    for _ in range(rounds):
        own = [[] for _ in z]
        for _, v in kept:
            own[nearest(v)].append(v)
        z = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, z, strict=True)]
    found = [(i, nearest(v), v) for i, v in kept]
    inertia = [sum(far(v, z[c]) for _, c, v in found if c == k) for k in range(len(z))]
    return sorted(((i, c, far(v, z[c]), inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, c, v in found), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("a.b", F.lit(1))
    return sorted((tuple(r) for r in op.clustered(df.repartition(3), **kw).collect()), key=str)


def test_matches_brute_force_with_odd_rows(spark):
    r = random.Random(1)
    near = lambda c, s: [x + r.gauss(0, s) for x in c]
    centres = [near([0] * 8, 1) for _ in range(5)]
    rows = [(i, near(r.choice(centres), 0.05)) for i in range(300)]
    rows += [(1000 + i, centres[0]) for i in range(150)] + [(7, rows[7][1])] * 3 + [(7, centres[1]), (None, centres[2]), (None, centres[3])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [1.0] * 7 + [None]), (2004, [1.0] * 7 + [math.nan]), (2005, [1.0] * 7 + [-math.inf]), (2006, [1e30] * 8), (2007, [2.0**21] * 8), (2008, [-(2.0**21)] * 8)]
    assert got(spark, rows, dims=8) == brute(rows, dims=8)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    rows = [(i, [i / 3] * 4) for i in range(n)]
    assert got(spark, rows, dims=4) == brute(rows, dims=4)


def test_all_equal_vectors(spark):
    rows = [(i, [0.5, -0.25]) for i in range(100)]
    assert got(spark, rows, dims=2) == brute(rows, dims=2)


def test_whole_table_of_given_vectors(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{d}'").fetchall()
    assert sorted((tuple(r) for r in op.clustered(spark.read.parquet(d)).collect()), key=str) == brute(rows)


def tree_of(v):
    tree = op.build(v)
    return tree, v[tree["order"]]


def test_trees_hold_exact_counts_sums_and_radii():
    v = np.random.default_rng(2).integers(-50, 50, (1000, 6))
    tree, own = tree_of(v)
    assert sorted(tree["order"].tolist()) == list(range(1000))
    for lo, hi, total, radius in zip(tree["lo"], tree["hi"], tree["sum"], tree["radius"], strict=True):
        assert (own[lo:hi].sum(0) == total).all()
        assert ((own[lo:hi] - total // (hi - lo)) ** 2).sum(1).max() == radius


def test_whole_balls_are_assigned_and_every_vector_once():
    r = np.random.default_rng(3)
    centres = r.integers(-10_000, 10_000, (4, 6))
    tree, own = tree_of(centres[r.integers(0, 4, 2000)] + r.integers(-20, 20, (2000, 6)))
    z = np.concatenate([centres, centres[:1]])  # an equal centroid with a larger number gets nothing
    cluster, whole = np.full(2000, -1), 0
    for at, c, is_whole in op.descend(tree, own, z):
        for a, k in zip(at, c, strict=True):
            where = slice(tree["lo"][a], tree["hi"][a]) if is_whole else a
            assert np.all(cluster[where] == -1)
            cluster[where] = k
            whole += len(cluster[where]) if is_whole else 0
    want = ((own[:, None] - z[None]) ** 2).sum(2).argmin(1)
    assert (cluster == want).all()
    assert whole > 1000
