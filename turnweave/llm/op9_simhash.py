"""SimHash near-duplicates: fingerprints linked at a small Hamming distance through vantage-point trees.

Fingerprints are first reduced to the distinct ones. Two 64-bit fingerprints that differ in at most three bits differ in at
most one bit of their left or of their right half, so two vantage-point forests, one over each half, with a search radius of
one find every pair; a full 64-bit comparison follows. The top levels of a tree have fixed vantage points and deal the
fingerprints to shards: each is a point of one shard and a query of every shard that the triangle bound cannot rule out
(those whose boundary it overlaps). Inside a shard the tree goes on with local vantage points and medians. A shard gives a
spanning forest of the links it found, never all pairs of a dense group. Components come from alternating star contraction
over those links, each round written to the shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; repeated
rows each get a row; a null id gets a row and takes no part in the smallest id; an empty table gives no rows. Extra input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import materialize, quoted, reducers, slices, trimmed, trimming

RADIUS = 3
HALF_RADIUS = 1
#: Points that a shard should hold; the number of shards follows the number of fingerprints.
SHARD_POINTS = 32_768
LEAF = 192
PAIRS_AT_ONCE = 1 << 22


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> bytes:
    """Eight bytes, highest bit first, of a UTF-8 text."""
    from xxhash import xxh64_digest

    own = text.lower().split()  # of bytes: A-Z only, and words end at 20 and 09-0D
    if not own:
        return bytes(8)
    if len(own) <= words:
        hashes = xxh64_digest(b" ".join(own), seed)
    else:
        joined = b" ".join(own)
        size = np.fromiter(map(len, own), np.int64, len(own))
        start = np.zeros(len(own) + 1, np.int64)
        np.cumsum(size + 1, out=start[1:])
        n = len(own) - words + 1
        hashes = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), (start[words:] - 1).tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 15):  # bounded memory for very long texts
        ones += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int32)
    return np.packbits(ones * 2 > len(rows)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as the signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            fps = b"".join(fingerprint((t or "").encode(), words, seed) for t in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["id", "fp"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).mapInArrow(trimming(run), "id long, fp long")


def vantage_points(n: int) -> list[int]:
    """Fixed 32-bit points, far from each other in all bits (a multiplicative sequence)."""
    return [int((0x9E3779B97F4A7C15 * (2 * i + 1)) >> 16 & 0xFFFFFFFF) for i in range(n)]


class Forest:
    """Linked sets of 0..n-1 by smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def close_pairs(fp: np.ndarray, half: np.ndarray, points: np.ndarray, queries: np.ndarray, forest: Forest, radius: int = RADIUS) -> None:
    """Link every query to every point within the radius, by a vantage-point tree over the points.

    fp: unsigned 64-bit; half: the 32 bits this tree measures; points and queries: positions in fp.
    """
    stack = [(points, queries, False)]
    while stack:
        p, q, whole = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) <= LEAF or len(p) * len(q) <= 1 << 16:
            step = max(1, PAIRS_AT_ONCE // len(p))
            for at in range(0, len(q), step):
                own = q[at : at + step]
                i, j = np.nonzero(np.bitwise_count(fp[own][:, None] ^ fp[p][None, :]) <= radius)
                forest.link(own[i], p[j])
            continue
        key, r = (fp, radius) if whole else (half, HALF_RADIUS)
        v = key[p[len(p) // 2]]
        dp, dq = np.bitwise_count(key[p] ^ v), np.bitwise_count(key[q] ^ v)
        mu = int(np.median(dp))
        near = dp <= mu
        if near.all():
            mu -= 1
            near = dp <= mu
        if not near.any():  # all as far from the vantage point
            if not whole:
                stack.append((p, q, True))  # one half is shared by all: go on with the whole fingerprint
                continue
            for at in range(0, len(p), LEAF):
                stack.append((p[at : at + LEAF], q, True))
            continue
        dq = dq.astype(np.int16)
        stack += [(p[near], q[dq - r <= mu], whole), (p[~near], q[dq + r > mu], whole)]


def links(nodes: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(u, v): links, a spanning forest of each shard's, between the distinct fingerprints of nodes(fp)."""
    spark = nodes.sparkSession
    n = nodes.count()
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / shard_points))))
    points = vantage_points(levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for side in (0, 1):
                half = (fp >> np.uint64(32) if side else fp & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                at, cell, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
                for level, v in enumerate(points):
                    d, mu = np.bitwise_count(half[at] ^ np.uint32(v)).astype(np.int16), 16 - level % 2
                    inside, outside = d - HALF_RADIUS <= mu, d + HALF_RADIUS > mu
                    at, cell, home = (
                        np.concatenate([at[inside], at[outside]]),
                        np.concatenate([cell[inside] * 2, cell[outside] * 2 + 1]),
                        np.concatenate([(home & (d <= mu))[inside], (home & (d > mu))[outside]]),
                    )
                yield pa.RecordBatch.from_arrays([pa.array(cell * 2 + side), pa.array(fp[at].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def search(t: pa.Table) -> pa.Table:
        side = t.column("shard")[0].as_py() % 2
        fp = t.column("fp").to_numpy().view(np.uint64)
        home = t.column("home").to_numpy()
        half = (fp >> np.uint64(32) if side else fp & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        forest = Forest(len(fp))
        close_pairs(fp, half, np.flatnonzero(home), np.arange(len(fp)), forest)
        linked = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pa.table({"u": fp[linked].view(np.int64), "v": fp[forest.root[linked]].view(np.int64)})

    dealt = nodes.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    count = reducers(spark, 0)
    return dealt.repartition(max(count, min(2 << levels, 4096)), "shard").groupBy("shard").applyInArrow(trimmed(search), "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of edges(u, v) with the smallest node reachable, by alternating large and small stars.

    Each round is written to the shared folder; only two numbers a round come to the driver.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: (id_col, fingerprint, component_id)."""
    fps = materialize(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes))
    # A root is the smallest fingerprint of its component; the smallest id of the component comes from an aggregate over it.
    placed = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    least = placed.where("root != fp").select("root", "first").union(placed.where("root = fp").select("root", "first")).groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies for a stage: Jaccard similarity of sets of five-word shingles.

COPY_WORDS = 5
#: Similar is JACCARD[0] / JACCARD[1] and more.
JACCARD = (4, 5)
#: Bits by which the 128-bit fingerprints of similar sets may differ; at 0.8 they differ in 19 on average, with a deviation of 4.
COPY_RADIUS = 38
#: Documents whose shingles are counted for the order of shingles, and how many of the most common are told apart.
ORDER_DOCS, COMMON, COMMON_LEAST = 20_000, 200_000, 8
#: Shingles of a set by which it meets others, at most.
PREFIX = 16
#: Documents of one shingle up to which pairs are compared by offset instead of a tree.
FEW = 48
#: Bits of the sketches that tell sets that can't be similar: in lists of shingles, and of pairs.
LIST_BITS, PAIR_BITS = 128, 4096


def shingle_set(text: bytes, words: int = COPY_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_digest

    own = text.lower().split()
    if len(own) <= words:
        hashes = xxh64_digest(b" ".join(own), 42) if own else b""
    else:
        joined = b" ".join(own)
        start = np.zeros(len(own) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1, out=start[1:])
        n = len(own) - words + 1
        hashes = b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(start[:n].tolist(), (start[words:] - 1).tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def set_fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes in two words, the second of the hashes mixed anew."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(own), 1 << 14):
        h = own[at : at + (1 << 14)]
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ones += np.unpackbits(np.stack([h, mixed ^ (mixed >> np.uint64(32))], 1).view(np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int32)
    return np.packbits(ones * 2 > len(own)).view(np.uint64)


def parities(own: np.ndarray, bits: int) -> np.ndarray:
    """A sketch of a set of hashes: whether each of so many places has an odd number of them.

    Each hash that one of two sets has alone changes one bit, so they have at least as many such hashes as bits that differ.
    """
    return np.packbits((np.bincount(((own >> np.uint64(9)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def _possible(apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with sketches so far apart can be similar; of both sizes together, similar ones differ in a ninth at most."""
    both = JACCARD[0] + JACCARD[1]
    return both * apart.astype(np.int64) <= (JACCARD[1] - JACCARD[0]) * (a + b)


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, that some of the documents of texts(node, text) often share, and their ranks, rare ones first.

    They only order shingles, so that lists are short; any order finds every similar pair.
    """
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            own = [shingle_set(t.encode()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["h"])

    some = texts.where(F.pmod("node", F.lit(max(1, n // ORDER_DOCS))) == 0).dropDuplicates(["node"]).select("text")
    counted = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_LEAST)
    t = counted.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h = t.column("h").to_numpy().view(np.uint64)
    rank = np.arange(len(h), 0, -1)
    by = np.argsort(h)
    return h[by], rank[by]


def _ordered(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """A set's hashes in the global order, uncommon ones by hash and then common ones by rank, and the number of uncommon ones."""
    h, rank = common
    if not len(h) or not len(own):
        return own, len(own)
    at = np.minimum(np.searchsorted(h, own), len(h) - 1)
    rank = np.where(h[at] == own, rank[at], 0)
    return own[np.lexsort((own, rank))], int((rank == 0).sum())


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], most: int | None = PREFIX) -> np.ndarray:
    """The first shingles of a set in the global order, by which it meets others.

    Similar sets share one of the first fifth and one more, and with most=None all of these are given, so that no similar pair is
    missed. Else a set with three times as many uncommon shingles as that gives `most` of them: a similar set has half of the two
    sets' uncommon ones at least, so that both miss each other with a chance of 0.5 ** most at most (0.2 ** most without common ones).
    """
    if not len(own):
        return np.zeros(1, np.uint64)  # texts without words meet in one list
    m = len(own) - -(-JACCARD[0] * len(own) // JACCARD[1]) + 1
    own, free = _ordered(own, common)
    return own[: min(m, most)] if most is not None and (free >= 3 * m or not len(common[0])) else own[:m]


def neighbours(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of the pairs of neighbours among the first 2 / 5 (and two more) of a set's shingles in the global order, by which it
    meets others.

    Similar sets share one: of sets x and y, that whose first shingles end earlier, say x, has one pair more than can be lost. A
    shingle that x has alone ends two pairs and one that y has alone falls into one, and for sets with Jaccard 4 / 5 and more, a of
    the first kind and b of the second are 5 a + 4 b <= len(x), so that 2 a + b <= 2 / 5 len(x). Sets that share a few shingles by
    chance hardly ever share neighbours.
    """
    if len(own) < 2:
        return own if len(own) else np.zeros(1, np.uint64)  # texts without words meet in one list
    lost = 2 * (JACCARD[1] - JACCARD[0]) * len(own) // JACCARD[1]
    first = _ordered(own, common)[0][: lost + 2]
    return first[:-1] * np.uint64(0x9E3779B97F4A7C15) + first[1:]


def shared_rows(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (h, node), given in their order, of lists with two nodes and more, each once; one row is held between batches."""
    h, node, listed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for more_h, more_node in batches:
        if not len(more_h):
            continue
        held = listed
        h, node = np.concatenate([h, more_h]), np.concatenate([node, more_node])
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node = h[new], node[new]
        same = h[1:] == h[:-1]
        listed = np.r_[same, False] | np.r_[False, same]
        listed[: len(held)] |= held
        yield h[:-1][listed[:-1]], node[:-1][listed[:-1]]
        h, node, listed = h[-1:], node[-1:], listed[-1:]
    yield h[listed], node[listed]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def _sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes that sets of enough similarity can have."""
    return (JACCARD[1] * a >= JACCARD[0] * b) & (JACCARD[1] * b >= JACCARD[0] * a)


def near_sets(fp: np.ndarray, size: np.ndarray, forest: Forest) -> None:
    """Link all of a list that are within COPY_RADIUS and of fitting sizes, by a vantage-point tree."""
    everything = np.arange(len(fp))
    stack = [(everything, everything)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        d = _apart(fp[p], fp[p[len(p) // 2]])
        mu = int(np.median(d))
        near = d <= mu
        if len(p) <= LEAF or near.all():
            step = max(1, (PAIRS_AT_ONCE >> 2) // len(p))
            for at in range(0, len(q), step):
                own = q[at : at + step]
                i, j = np.nonzero((_apart(fp[own][:, None], fp[p][None, :]) <= COPY_RADIUS) & _sized(size[own][:, None], size[p][None, :]))
                forest.link(own[i], p[j])
            continue
        dq = _apart(fp[q], fp[p[len(p) // 2]])
        stack += [(p[near], q[dq - COPY_RADIUS <= mu]), (p[~near], q[dq + COPY_RADIUS > mu])]


def list_links(h: np.ndarray, node: np.ndarray, fp: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(u, v, near): links, a spanning forest of a long list's, between nodes with near fingerprints, and then, not near, all pairs that
    these leave apart in a list and that can be similar by size and sketch; rows sorted by shingle and node."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node, fp, size, sketch = h[new], node[new], fp[new], size[new], sketch[new]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(h)])
    u, v, weak_u, weak_v, held = [], [], [], [], 0
    at = np.flatnonzero(np.repeat((length > 1) & (length <= FEW), length))
    for k in range(1, FEW):
        at = at[at + k < len(h)]
        at = at[h[at] == h[at + k]]
        if not len(at):
            break
        fits, by = _sized(size[at], size[at + k]), _apart(fp[at], fp[at + k]) <= COPY_RADIUS
        near = at[by & fits]
        u.append(node[near])
        v.append(node[near + k])
        rest = at[~by & fits & _possible(_apart(sketch[at], sketch[at + k]), size[at], size[at + k])]
        weak_u.append(node[rest])
        weak_v.append(node[rest + k])
    for s, n in zip(start[length > FEW].tolist(), length[length > FEW].tolist(), strict=True):
        forest = Forest(n)
        near_sets(fp[s : s + n], size[s : s + n], forest)
        linked = np.flatnonzero(forest.root != np.arange(n))
        u.append(node[s : s + n][linked])
        v.append(node[s : s + n][forest.root[linked]])
        by = np.argsort(size[s : s + n], kind="stable")  # fitting sizes are neighbours
        own, marks, root, nodes = size[s : s + n][by], sketch[s : s + n][by], forest.root[by], node[s : s + n][by]
        ends = np.searchsorted(own, own * JACCARD[1] // JACCARD[0], side="right")
        step = max(1, (PAIRS_AT_ONCE >> 4) // n)
        for a in range(0, n, step):
            b = min(a + step, n)
            end = int(ends[b - 1])
            i, j = np.nonzero((root[a:b, None] != root[None, a:end]) & _possible(_apart(marks[a:b, None], marks[None, a:end]), own[a:b, None], own[None, a:end]))
            ahead = i < j
            weak_u.append(nodes[a + i[ahead]])
            weak_v.append(nodes[a + j[ahead]])
            held += len(weak_u[-1])
            if held > PAIRS_AT_ONCE >> 2:
                yield *_pairs(weak_u, weak_v), False
                weak_u, weak_v, held = [], [], 0
    yield *_pairs(u, v), True
    yield *_pairs(weak_u, weak_v), False


def _pairs(u: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
    """Different pairs, the larger number first."""
    empty = np.zeros(0, np.int64)
    a, b = np.concatenate([empty, *u]), np.concatenate([empty, *v])
    return np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)


def similar_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest position that similar sets link each set to, by exact Jaccard similarity."""
    a, b = JACCARD
    size = np.array(list(map(len, sets)), np.int64)
    words, token = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    ends = np.cumsum(size)
    root = np.arange(len(sets))
    held = np.zeros(len(words) + 1, bool)
    left = np.arange(len(sets))  # not reached yet
    flat, begins = token, ends - size
    while len(left):
        first, queue = left[0], [left[0]]
        keep = np.ones(len(left), bool)
        keep[0] = False
        while True:
            if not keep.all():
                flat = flat[np.repeat(keep, size[left])]
                left = left[keep]
                begins = np.cumsum(size[left]) - size[left]
            if not queue or not len(left):
                break
            x = queue.pop()
            own = token[ends[x] - size[x] : ends[x]]
            held[own] = True
            total = np.r_[0, np.cumsum(held[flat])]
            both = total[begins + size[left]] - total[begins]
            held[own] = False
            near = b * both >= a * (size[left] + size[x] - both)
            root[left[near]] = first
            queue += left[near].tolist()
            keep = ~near
    return root


def _set_of(text: str) -> np.ndarray:
    return shingle_set(text.encode())


def similar_pairs(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose texts, of own(node, text), are similar: by long sketches first, then exactly."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = [_set_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([parities(s, PAIR_BITS).tobytes() for s in sets], pa.binary())], ["node", "size", "bits"])

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(b.num_rows, PAIR_BITS // 64) for c in (b.column(2), b.column(4))]
            yield b.select([0, 1]).filter(pa.array(_possible(_apart(*bits), b.column(3).to_numpy(), b.column(5).to_numpy())))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "a", 1 << 20):
            same = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = _set_of(x), _set_of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(JACCARD[1] * both >= JACCARD[0] * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(same, pa.bool_()))

    nodes = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node")
    marks = materialize(own.join(nodes, "node", "left_semi").mapInArrow(trimming(sketched), "node long, size long, bits binary"), "sketches")
    side = lambda t, key, **names: t.withColumnsRenamed({"node": key} | names)
    sized = pairs.join(side(marks, "u", size="a", bits="x"), "u").join(side(marks, "v", size="b", bits="y"), "v")
    left = materialize(sized.select("u", "v", "x", "a", "y", "b").mapInArrow(trimming(sifted), "u long, v long"), "rest")
    texts = left.join(side(own, "u", text="a"), "u").join(side(own, "v", text="b"), "v")
    return materialize(texts.select("u", "v", "a", "b").mapInArrow(trimming(exact), "u long, v long"), "similar")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """(id, group): the rows of docs; rows of one group are linked by texts whose shingle sets have Jaccard 0.8 or more.

    Texts meet by pairs of neighbouring shingles (see neighbours), so no similar pair is missed. With most, they meet by so many
    shingles at most (see prefix), and a similar pair may be missed with a chance of at most 0.5 ** most.

    Only the rows of lists with two texts and more go on, with their texts' fingerprints and sketches. Candidates are in one list
    and have near fingerprints, searched by a vantage-point tree where a list is long. Each candidate component is then compared
    exactly. Pairs of a list whose fingerprints are not near are compared exactly too, unless their sizes or sketches tell that
    they can't be similar. A group is the hash of one of its texts.
    """
    spark = docs.sparkSession
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    common = common_shingles(texts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            own = [_set_of(t) for t in b.column(1).to_pylist()]
            first = [neighbours(s, common) if most is None else prefix(s, common, most) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), list(map(len, first))))], ["h", "node"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, node in shared_rows((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node)], ["h", "node"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            own = [_set_of(t) for t in b.column(1).to_pylist()]
            marks = np.stack([np.concatenate([set_fingerprint(s), parities(s, LIST_BITS)]) for s in own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(marks[:, i].copy()) for i in range(4)], pa.array(list(map(len, own)), pa.int32())], ["node", "fp", "more", "odd", "odds", "size"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for u, v, near in list_links(rows[0], rows[1], np.stack(rows[2:4], 1).view(np.uint64), rows[6].astype(np.int64), np.stack(rows[4:6], 1).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), near))], ["u", "v", "near"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy() for c in b.columns]
            kept = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
            cut = int(np.searchsorted(kept[0], kept[0][-1]))  # the last list may go on
            if cut:
                yield from found([x[:cut] for x in kept])
                kept = [x[cut:] for x in kept]
        if kept:
            yield from found(kept)

    def verify(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_numpy()
        root = similar_sets([_set_of(x) for x in t.column("text").to_pylist()])
        return pa.table({"node": nodes, "group": nodes[root]})

    in_lists = lambda rows: rows.repartition(reducers(spark, 0), "h").sortWithinPartitions("h", "node")
    lists = materialize(in_lists(texts.mapInArrow(trimming(probe), "h long, node long")).mapInArrow(trimming(sift), "h long, node long"), "lists")
    own = materialize(texts.join(lists.select("node").distinct(), "node").groupBy("node").agg(F.first("text").alias("text")), "texts")
    marks = materialize(own.mapInArrow(trimming(mark), "node long, fp long, more long, odd long, odds long, size int"), "marks")
    marked = lists.join(marks, "node").select("h", "node", "fp", "more", "odd", "odds", "size")
    pairs = materialize(in_lists(marked).mapInArrow(trimming(search), "u long, v long, near boolean").distinct(), "pairs")
    stars = components(pairs.where("near").select("u", "v"))
    candidates = stars.union(stars.select("root", "root")).distinct()
    groups = materialize(own.join(candidates, "node").groupBy("root").applyInArrow(trimmed(verify), "node long, group long"), "groups")
    also = similar_pairs(pairs.where("not near").select("u", "v"), own)
    if not also.isEmpty():
        roots = components(groups.select(F.col("node").alias("u"), F.col("group").alias("v")).union(also))
        groups = roots.union(roots.select("root", "root")).distinct().select("node", F.col("root").alias("group"))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(text).alias("node"))
    return rows.join(groups, "node", "left").select("id", F.coalesce("group", "node").alias("group"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """docs with one document of each group of near copies (see near_copies): that with its smallest id.

    Rows that repeat one id count as one document and stay or go together; rows without an id stay.
    """
    rows = materialize(near_copies(docs, id_col, text_col, most), "copies")
    least = rows.groupBy("group").agg(F.min("id").alias("least"))
    gone = rows.where("id IS NOT NULL").join(least, "group").groupBy("id").agg(F.bool_or(F.col("id") == F.col("least")).alias("stays")).where("not stays").select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")
