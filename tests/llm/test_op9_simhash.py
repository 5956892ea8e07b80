import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnweave.llm import op9_simhash as op


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("a.b", F.lit(1))
    return sorted((tuple(r) for r in op.near_duplicates(df, **kw).collect()), key=str)


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([2, 5, 40, 120]))]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            for k in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"x{k}"
                rows.append((10_000 + 10 * i + k, "\n".join(words)))
    return rows


def test_matches_brute_force_with_edge_rows(spark):
    rows = corpus(150) + [(7, None), (8, ""), (9, " \t\n"), (None, "lone words here and there"), (5, "one"), (5, "one"), (4, "Zwei"), (3, "zwei"), (2, "ÀÉ à"), (1, "word " * 60_000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_sharded_forest_finds_every_close_pair(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64)
    flips = [base]
    for k in (1, 2, 3, 4):
        x = base.copy()
        for _ in range(k):
            x ^= np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64)
        flips.append(x)
    same_half = (np.uint64(5) << np.uint64(32)) | r.integers(0, 1 << 20, 600).astype(np.uint64)
    fp = np.unique(np.concatenate([*flips, same_half]))
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = {x.node: x.root for x in op.components(op.links(nodes, shard_points=100)).collect()}
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    root = op.Forest(len(fp))
    root.link(i, j)
    signed = fp.view(np.int64).tolist()
    want, have = {}, {}
    for k, s in enumerate(signed):
        want.setdefault(int(root.root[k]), set()).add(s)
        have.setdefault(found.get(s, s), set()).add(s)
    assert {frozenset(x) for x in want.values()} == {frozenset(x) for x in have.values()}


def test_keep_first_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(3, text), (2, text), (None, text), (9, "quite another text of a few words")], "doc_id long, text string")
    assert sorted((r.doc_id for r in op.keep_first(df).collect()), key=str) == [2, 9, None]


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "a b c d " * 50])
def test_fingerprint(text):
    assert int.from_bytes(op.fingerprint(text.encode()), "big") == brute_fingerprint(text)


def jaccard_groups(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = op.Forest(len(rows))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root.link(np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))
    return root.root


def edited(seed=5):
    r = random.Random(seed)
    common = "this line stands in very many of the texts that we have here".split()
    rows = []
    for i in range(150):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([1, 4, 8, 9, 40, 120, 400]))] + (common if i % 2 else [])
        rows.append((i, " ".join(words)))
        for k in range(r.randrange(4) if i % 3 else 0):
            own = list(words)
            for _ in range(max(1, len(own) // r.choice([25, 40, 55, 80]))):
                own[r.randrange(len(own))] = f"x{r.randrange(99)}"
            rows.append((1000 + 10 * i + k, "\n".join(own)))
    base = [f"g{i}" for i in range(200)]
    for k in range(120):  # a large group of near copies
        own = list(base)
        for _ in range(r.randrange(5)):
            own[r.randrange(len(own))] = f"y{k}"
        rows.append((5000 + k, " ".join(own)))
    return rows + [(6000, None), (6001, ""), (6002, " \t"), (6003, "One two"), (6004, "one  TWO"), (6005, "É"), (6006, "é"), (6007, rows[0][1])]


@pytest.mark.parametrize("least, few, most", [(op.COMMON_LEAST, op.FEW, op.PREFIX), (10**9, 2, op.PREFIX), (op.COMMON_LEAST, op.FEW, None), (10**9, op.FEW, None)])
def test_keep_first_matches_brute_force_jaccard(spark, monkeypatch, least, few, most):
    monkeypatch.setattr(op, "COMMON_LEAST", least)
    monkeypatch.setattr(op, "FEW", few)
    rows = edited()
    root = jaccard_groups(rows)
    least_of = {}
    for (d, _), g in zip(rows, root.tolist(), strict=True):
        least_of[g] = min(least_of.get(g, d), d)
    want = sorted(least_of.values())
    assert sorted(r.doc_id for r in op.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most=most).collect()) == want


@pytest.mark.parametrize("few, radius", [(op.FEW, -1), (2, -1), (2, 12)])
def test_keep_first_finds_similar_texts_whose_fingerprints_are_not_near(spark, monkeypatch, few, radius):
    """With no or few near fingerprints the exact way finds all groups."""
    monkeypatch.setattr(op, "FEW", few)
    monkeypatch.setattr(op, "COPY_RADIUS", radius)
    rows = edited()
    least_of = {}
    for (d, _), g in zip(rows, jaccard_groups(rows).tolist(), strict=True):
        least_of[g] = min(least_of.get(g, d), d)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in op.keep_first(df).collect()) == sorted(least_of.values())


def test_sketches_exclude_no_similar_sets():
    r = np.random.default_rng(4)
    for n in (1, 9, 60, 700, 5000):
        a = r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        for cut in (0, n // 9, n // 5):
            b = np.concatenate([a[cut:], r.integers(0, 1 << 63, cut * (cut <= n // 9), dtype=np.int64).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            assert 5 * both >= 4 * (len(a) + len(b) - both)
            for bits in (op.LIST_BITS, op.PAIR_BITS):
                assert op._possible(op._apart(op.parities(a, bits), op.parities(b, bits)), np.int64(len(a)), np.int64(len(b)))


def test_similar_sets_are_exact():
    r = random.Random(8)
    sets = [np.unique(np.array(r.sample(range(12), r.randrange(13)), np.uint64)) for _ in range(300)]
    own = [set(s.tolist()) for s in sets]
    forest = op.Forest(len(sets))
    i, j = zip(*[(i, j) for i in range(300) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])], strict=True)
    forest.link(np.array(i), np.array(j))
    assert op.similar_sets(sets).tolist() == forest.root.tolist()


def test_similar_pairs_of_given_documents_share_prefixes_and_lie_inside_the_radius():
    """All pairs of different texts of the table with Jaccard 0.8 or more, found by their rarest shingles, with both settings of a prefix."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("SELECT DISTINCT text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()]
    sets = [op.shingle_set(t.encode()) for t in texts]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    words, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    lists: dict[int, list[int]] = {}
    edges = np.concatenate([[0], np.cumsum(list(map(len, sets)))])
    for d, s in enumerate(sets):  # similar sets share one of the rarest fifth and one more: an exact search
        own = which[edges[d] : edges[d + 1]]
        m = len(s) - -(-4 * len(s) // 5) + 1
        for w in own[np.lexsort((own, count[own]))[:m]].tolist():
            lists.setdefault(w, []).append(d)
    pairs = {(a, b) for own in lists.values() for i, b in enumerate(own) for a in own[:i] if 4 * len(sets[a]) <= 5 * len(sets[b]) and 4 * len(sets[b]) <= 5 * len(sets[a])}
    similar = [(a, b) for a, b in pairs if 5 * (both := len(np.intersect1d(sets[a], sets[b], assume_unique=True))) >= 4 * (len(sets[a]) + len(sets[b]) - both)]
    assert len(similar) > 40
    seen = np.isin(words, flat[np.isin(owner, np.arange(0, len(sets), max(1, len(sets) // op.ORDER_DOCS)))])
    often = np.flatnonzero(seen & (count >= op.COMMON_LEAST))
    by = often[np.argsort(-count[often], kind="stable")][: op.COMMON]
    common = (words[np.sort(by)], np.arange(len(by), 0, -1)[np.argsort(by)])
    fp = {d: op.set_fingerprint(sets[d]) for p in similar for d in p}
    assert max(int(op._apart(fp[a], fp[b])) for a, b in similar) <= op.COPY_RADIUS
    for most in (op.PREFIX, None):
        assert all(len(np.intersect1d(op.prefix(sets[a], common, most), op.prefix(sets[b], common, most))) for a, b in similar)
    print(f"{len(similar)} similar pairs, at most {max(int(op._apart(fp[a], fp[b])) for a, b in similar)} bits apart")


def test_chance_shingles_make_no_pairs(spark, monkeypatch):
    """Texts that share two shingles each with all others, by a phrase of six words, meet in no list."""
    seen, real = {}, op.materialize

    def kept_too(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(op, "materialize", kept_too)
    rows = [(i, " ".join([f"t{i}w{k}" for k in range(200)] + "all of these have one phrase".split() + [f"t{i}v{k}" for k in range(200)])) for i in range(150)]
    rows += [(1000, rows[0][1].replace("t0w7 ", "other ")), (1001, rows[0][1].upper())]
    kept = sorted(r.doc_id for r in op.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == list(range(150))
    assert seen["pairs"].count() <= 10


def test_similar_sets_share_neighbours():
    """At the limit of similarity, with the hashes that only one of both has wherever they do most harm; odd batches of rows."""
    r = np.random.default_rng(6)
    for n in [*range(2, 60), 500, 3000]:
        own = np.unique(r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        for alone in range(0, n // 5 + 1, max(1, n // 25)):
            others = (n - 5 * alone) // 4  # of the second set alone
            for at in (np.arange(alone) * 2, np.arange(alone) * 2 + 1, r.permutation(n)[:alone]):
                rest = np.delete(own, at)
                added = rest[2 * alone :][:others] + np.uint64(1) if len(rest) > 2 * alone else rest[:0]
                other = np.unique(np.concatenate([rest, added]))
                both = len(np.intersect1d(own, other))
                assert 5 * both >= 4 * (len(own) + len(other) - both)
                for known in (own[:0], own[::3], own[1 : len(own) // 2]):
                    common = (known, r.permutation(len(known)) + 1)
                    assert len(np.intersect1d(op.neighbours(own, common), op.neighbours(other, common)))
    rows = sorted((int(a), int(b)) for a, b in r.integers(0, 40, (60, 2)))
    want = sorted({x for x in rows if len({b for a, b in rows if a == x[0]}) > 1})
    for step in (1, 2, 7, 60):
        cut = [rows[i : i + step] for i in range(0, len(rows), step)]
        got = op.shared_rows((np.array([a for a, _ in c]), np.array([b for _, b in c])) for c in cut)
        assert [x for h, node in got for x in zip(h.tolist(), node.tolist(), strict=True)] == want
