"""Centroid clustering with ball trees: k-means on whole-number vectors in which whole balls of vectors go to a centroid at once.

Every task builds metric trees over blocks of the vectors that it holds, once, and writes them to the shared folder. A node
has the number, the exact sum and a radius of its vectors: the largest exact squared distance from floor(sum / count). An
assignment goes down the trees with the centroids that are still possible: by the triangle inequality a centroid that is further
from a ball's centre than the nearest one is, by more than two radii, is nearest to no vector of the ball. A ball with one
centroid left is assigned whole, by its count and sum; a leaf with more compares its vectors exactly. Bounds are rounded away
from pruning, so results are those of comparing all, ties to the smaller number included.

A round moves, from each task, one row a centroid and component; centroids (k rows) are all that the driver holds.

Defined results: rows whose vector is null, has another number of components or one that is null, not finite or beyond 2 ** 27 when
scaled (distances to it need not fit a long) are dropped; a null id comes after all others when centroids are started, equal
ids by their vectors; repeated rows are rows of their own and may start equal centroids, of which the smaller number gets all; fewer
vectors than k give as many centroids; an empty table gives no rows; a sum of distances that no long holds is null. Extra input
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import materialize, pack, trimming, unpack
from turnweave.llm.vectors import blocks, matrix, narrow, squared, whole_vectors

BLOCK, LEAF = 1 << 14, 32


def build(v: np.ndarray) -> dict[str, np.ndarray]:
    """A tree over the rows of v, cut at the median of the component with the widest range.

    order: rows by leaf; of each node lo and hi, its range in order, its children (-1 in a leaf), sum and squared radius.
    """
    order = np.arange(len(v))
    lo, hi, left, right, sums, radius = [], [], [], [], [], []
    stack = [(0, len(v), -1, False)]
    while stack:
        a, b, parent, is_right = stack.pop()
        node, own = len(lo), v[order[a:b]]
        if parent >= 0:
            (right if is_right else left)[parent] = node
        total = own.sum(0)
        lo.append(a)
        hi.append(b)
        left.append(-1)
        right.append(-1)
        sums.append(total)
        radius.append(int(((own - total // (b - a)) ** 2).sum(1).max()))
        spread = own.max(0) - own.min(0)
        wide = int(spread.argmax())
        if b - a > LEAF and spread[wide]:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide], mid)]
            stack += [(a, a + mid, node, False), (a + mid, b, node, True)]
    return {"order": order, "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left), "right": np.array(right), "sum": np.array(sums), "radius": np.array(radius)}


def descend(tree: dict[str, np.ndarray], v: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Assign all vectors to the rows of z: yields (whole nodes, their centroids, True) and (positions, their centroids, False).

    v: the vectors in the tree's order; positions are places in it.
    """
    nodes, able = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    while len(nodes):
        count = tree["hi"][nodes] - tree["lo"][nodes]
        far = squared(tree["sum"][nodes] // count[:, None], z)
        flat = tree["radius"][nodes] == 0  # all vectors are the centre, as floor(sum / count) of equal ones is they themselves
        d, r = np.sqrt(far.astype(np.float64)), np.sqrt(tree["radius"][nodes].astype(np.float64))
        nearest = np.where(able, far, np.iinfo(np.int64).max).argmin(1)
        bound = d[np.arange(len(nodes)), nearest] + 2 * r
        able &= d <= (bound * (1 + 1e-12) + 1e-9)[:, None]
        able[flat] = False
        able[flat, nearest[flat]] = True
        whole = able.sum(1) == 1
        yield nodes[whole], nearest[whole], True
        leaf = ~whole & (tree["left"][nodes] < 0)
        if leaf.any():
            at = np.concatenate([np.arange(a, b) for a, b in zip(tree["lo"][nodes[leaf]].tolist(), tree["hi"][nodes[leaf]].tolist(), strict=True)])
            yield at, np.where(np.repeat(able[leaf], count[leaf], 0), squared(v[at], z), np.iinfo(np.int64).max).argmin(1), False
        inner = ~whole & ~leaf
        nodes, able = np.concatenate([tree["left"][nodes[inner]], tree["right"][nodes[inner]]]), np.concatenate([able[inner], able[inner]])


def trees(vectors: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """(tree): packed trees over the (id, v) rows that each task has, at most block in one, with their vectors and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, block):
            v = matrix(t.column("v").combine_chunks(), dims)
            tree = build(v)
            ids = t.column("id").combine_chunks()
            own = tree | {"v": narrow(v[tree["order"]]), "id": ids.fill_null(0).to_numpy()[tree["order"]], "no_id": ids.is_null().to_numpy(zero_copy_only=False)[tree["order"]]}
            del own["order"]
            yield pa.RecordBatch.from_arrays([pa.array([pack(own)], pa.binary())], names=["tree"])

    return vectors.select("id", "v").mapInArrow(trimming(run), "tree binary")


def _sums(forest: DataFrame, z: np.ndarray) -> DataFrame:
    """(cluster, place, total): sums by component of each centroid's vectors, their number at place -1."""
    k, dims = z.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for blob in b.column(0):
                tree = unpack(blob.as_py())
                v = tree["v"].astype(np.int64)
                for at, cluster, whole in descend(tree, v, z):
                    n = tree["hi"][at] - tree["lo"][at] if whole else np.ones(len(at), np.int64)
                    np.add.at(total, cluster, tree["sum"][at] if whole else v[at])
                    np.add.at(seen, cluster, n)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dims, dtype=np.int32), len(used))), pa.array(np.concatenate([seen[used, None], total[used]], 1).ravel())], names=["cluster", "place", "total"])

    parts = forest.mapInArrow(trimming(run), "cluster int, place int, total long")
    return parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def fit(vectors: DataFrame, forest: DataFrame, dims: int, k: int, rounds: int, seed: str) -> np.ndarray:
    """Centroids after the rounds; each but an empty one becomes floor(sum / count) of its vectors."""
    first = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k).collect()
    z = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(z) else 0):
        z = z.copy()
        got: dict[int, dict[int, int]] = {}
        for r in _sums(forest, z).collect():  # at most k * (dims + 1) rows
            got.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
        for c, own in got.items():
            z[c] = [own[i] // own[-1] for i in range(dims)]
    return z


def assigned(forest: DataFrame, z: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                tree = unpack(blob.as_py())
                v = tree["v"].astype(np.int64)
                cluster = np.empty(len(v), np.int32)
                for at, own, whole in descend(tree, v, z):
                    if whole:
                        for lo, hi, c in zip(tree["lo"][at].tolist(), tree["hi"][at].tolist(), own.tolist(), strict=True):
                            cluster[lo:hi] = c
                    else:
                        cluster[at] = own
                yield pa.RecordBatch.from_arrays([pa.array(tree["id"], pa.int64(), mask=tree["no_id"]), pa.array(cluster), pa.array(((v - z[cluster]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    return forest.mapInArrow(trimming(run), "id long, cluster int, distance long")


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1:") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Centroids start as the k vectors with the smallest sha256 of seed and id.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col, dims, scale)
    forest = materialize(trees(vectors, dims), "balls")
    z = fit(vectors, forest, dims, k, rounds, seed)
    found = materialize(assigned(forest, z), "clusters")
    own = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # at most k rows
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(d), fits(sum(own.values())), hashlib.sha256(",".join(map(str, z[c].tolist())).encode()).hexdigest()) for c, d in sorted(own.items())]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
