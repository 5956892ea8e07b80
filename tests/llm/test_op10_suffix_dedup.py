import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import op10_suffix_dedup as op


def brute(rows, span):
    """In input order for equal ids; null ids last."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - span + 1):
            w = raw[i : i + span]
            if w in seen:
                gone[i : i + span] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, rows, parts=3, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("n_bytes", F.lit("clash")).withColumn("a.b", F.lit(1))
    return [tuple(r) for r in op.suffix_digest(df, **kw).collect()]


def order(rows):
    return sorted(rows, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = ["".join(r.choices("abé \n", k=r.randrange(5, 80))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else "".join(r.choices("abcd é", k=r.randrange(60))) for _ in range(r.randrange(8))]
        rows.append((i * 7 % n, "".join(parts)))
    return rows


@pytest.mark.parametrize("kw", [{}, {"shard_strings": 5}, {"many": 2}])
def test_matches_brute_force_on_short_spans(spark, kw):
    rows = [*corpus(1), (1000, None), (1001, ""), (1002, "a" * 500), (1003, "a" * 300), (1004, "ab" * 200), (None, "cd" * 60)]
    assert order(got(spark, rows, span=12, kgram=5, **kw)) == order(brute(rows, 12))


def test_matches_brute_force_at_the_real_span(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("etaoin", k=r.randrange(2, 8)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = [(i, " ".join([word() for _ in range(r.randrange(40))] + r.choices(passage, k=r.randrange(3)) + [word() for _ in range(r.randrange(40))])) for i in range(80)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + "!"), (102, " ".join(word() for _ in range(30_000)) + passage[0])]
    assert order(got(spark, rows)) == order(brute(rows, op.SPAN))
    assert order(got(spark, rows, many=2)) == order(brute(rows, op.SPAN))


def test_repeated_ids_and_empty_table(spark):
    rows = [(5, "xyz" * 60), (5, "xyz" * 60), (2, "xyz" * 50)]
    assert order(got(spark, rows, parts=1)) == order(brute(rows, op.SPAN))
    assert got(spark, []) == []


def test_long_documents_are_cut_into_pieces(monkeypatch, spark):
    monkeypatch.setattr(op, "PIECE_WINDOWS", 50)
    monkeypatch.setattr(op, "BLOCK_BYTES", 200)
    raw = np.frombuffer("".join(random.Random(1).choices("ab", k=2000)).encode(), np.uint8)
    a = op.anchors(raw, np.array([0, 3, 900, 900, 2000]), 12, 5)
    covered = np.concatenate([np.arange(f, e + 1) for f, e in zip(a["first"], a["last"], strict=True)])
    assert sorted(covered.tolist()) == [*range(3, 900 - 11), *range(900, 2000 - 11)]


@pytest.mark.parametrize("files", [False, True])
def test_every_column_is_sorted_with_its_common_prefixes(files, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "LAID_STRINGS", 7)
    r = random.Random(9)
    strings = ["".join(r.choices("ab\x00c", k=r.randrange(1, 20))).encode() for _ in range(80)]
    size = np.array([len(s) for s in strings])
    mid = np.array([r.randrange(n) for n in size])
    left = mid.max() - mid
    columns = set()
    for column, order, lcp in op.positional_order(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, mid, str(tmp_path) if files else None):
        assert sorted(order.tolist()) == [i for i in range(80) if left[i] <= column < left[i] + size[i]]
        suffixes = [strings[i][column - left[i] :] for i in order.tolist()]
        assert suffixes == sorted(suffixes)
        for i in range(1, len(suffixes)):
            a, b = suffixes[i - 1], suffixes[i]
            assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        columns.add(column)
    assert columns == set(range(int((left + size).max())))


def test_texts_keep_the_other_columns(spark):
    df = spark.createDataFrame([(1, "ab" * 80 + "end", "x", 1.5), (2, None, None, None), (3, "é" * 120, "id", 2.0)], "doc_id long, text string, id string, `a.b` double").select("id", "text", "doc_id", "`a.b`")
    got = op.suffix_texts(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [("x", "abend", 1, 1.5), (None, None, 2, None), ("id", "é", 3, 2.0)]


def test_very_long_texts_at_real_piece_sizes(spark):
    """A text of several pieces and blocks, with repeats across their edges and of itself."""
    r = random.Random(9)
    long = "".join(r.choices("etaoinshr dlu", k=3 * op.PIECE_WINDOWS + 777))
    edge = op.PIECE_WINDOWS
    rows = [(1, long), (2, "x" + long[edge - 300 : edge + 250] + "y" + long[2 * edge - 60 : 2 * edge + 60]), (3, long[:150] + long[-150:]), (4, "z" * (edge + 500)), (5, "z" * 150), (6, long[edge // 2 : edge // 2 + 99])]
    assert order(got(spark, rows)) == order(brute(rows, op.SPAN))
