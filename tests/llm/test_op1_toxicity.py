import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import op1_toxicity as op


def net(seed=3):
    n = op.Net.fresh({"bad": 0, "good": 1}, seed)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    return n


def test_gradients_match_differences():
    n, r = net(), np.random.default_rng(0)
    words = ["", "bad", "good", "other", "words", "é"]
    at, label, weight = r.integers(0, len(words), (op.WINDOW, 5)), np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 1, 3])

    def loss():
        x = n.word_inputs(words)[0].astype(np.float64)
        logit = n.logits(x, at)[0]
        return float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())

    _, g = n.step(words, at, label, weight)
    for name, p in n.p.items():
        spots = np.argwhere(np.abs(g[name]) > 1e-5)
        for spot in map(tuple, spots[:: max(1, len(spots) // 4)][:4]):
            keep = p[spot]
            p[spot] = keep + 1e-3
            up = loss()
            p[spot] = keep - 1e-3
            down = loss()
            p[spot] = keep
            assert (up - down) / 2e-3 == pytest.approx(g[name][spot], rel=0.03, abs=2e-5), name


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 47, 48, 49, 100, 1000])
def test_windows_cover_the_whole_text_and_overlap(n):
    starts = op.window_starts(n)
    covered = {i for s in starts for i in range(s, min(n, s + op.WINDOW))}
    assert covered == set(range(n)) and len(set(starts)) == len(starts)
    assert all(0 < b - a <= op.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_scorer_is_the_largest_logit_of_plain_windows(monkeypatch):
    n = op.Net.fresh({"bad": 0, "good": 1}, 3)
    r = random.Random(1)
    texts = [None, "", "bad", " ".join(r.choices(["bad", "good", "x", "ünï", "averyveryverylongword", "é"], k=333)), "Good " * 40]
    want = []
    for t in texts:
        words = op.words_of(t)
        own = [[*words[s : s + op.WINDOW], *[""] * max(0, op.WINDOW - len(words))] for s in op.window_starts(len(words))]
        want.append(max(float(n.logits(n.word_inputs(w)[0], np.arange(op.WINDOW)[:, None])[0][0]) for w in own))
    model = op.Model(n, 2.0, 0.5)
    got = op.Scorer(model).score(texts)
    assert got == pytest.approx(1 / (1 + np.exp(-(2 * np.array(want) + 0.5))), rel=1e-4)
    monkeypatch.setattr(op, "TABLE_WORDS", 3)
    small = op.Scorer(model)
    assert np.concatenate([small.score([t]) for t in texts]) == pytest.approx(got, rel=1e-4)


def test_long_words_lose_nothing():
    text = "x" * 100 + "TAIL, é9_b f*ck @ss ... it's\u00a0(so)"
    words = op.words_of(text)
    assert "".join(words) == "".join(text.lower().split())
    assert {"f", "*", "ck", "@", "ss", "_"} <= set(words) and max(map(len, words)) <= op.PIECE


def test_one_kind_of_labels():
    assert op.Scorer(op.train(["a", "b"], [0, 0])).score(["a", None]).tolist() == [0.0, 0.0]
    assert op.Scorer(op.train([], [])).score([]).tolist() == []
    assert op.Scorer(op.train(["a"], [1])).score([""]).tolist() == [1.0]


def test_rows_and_held_out_flag(spark):
    rows = [(i, "bad thing here" if i % 2 else "good thing here") for i in range(60)] + [(100, None), (101, ""), (None, "bad"), (5, "bad again"), (102, "good " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    got = op.scored(docs, op.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = sum(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert right >= 58
    assert op.scored(docs.limit(0), op.Model(None)).collect() == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = op.fit(docs, labels)
    own = docs.join(labels, "doc_id").where(op.held_out("doc_id")).select("doc_id", "text", "toxic")
    got = op.scored(own, model).join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    found = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    false = sum(r.predicted for r in got if not r.toxic) / sum(1 - r.toxic for r in got)
    assert right > 0.96 and found > 0.9 and false < 0.03, (right, found, false)


def test_ties_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    even = op.Model(None, constant=0.5)  # every score is a tie
    assert [(r.score, r.predicted) for r in op.scored(docs, even).collect()] == [(0.5, 1)] * 3
    assert op.without_toxic(docs, even).count() == 0
    rows = [(i, ("bad" if i % 2 else "good") + f" words {i}") for i in range(40)]
    twice = spark.createDataFrame([*rows, (3, "zzz"), (3, "zzz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (2, 0)], "doc_id long, toxic int")
    one, other = (op.Scorer(op.fit(d, labels)).score(["bad words", "good words"]) for d in (twice, twice.repartition(3)))
    assert one.tolist() == other.tolist()  # the order of rows changes nothing


def test_held_out_recall_on_the_smaller_table(spark):
    """Few rows (some 70, of which some 6 are toxic), so the bounds are wide."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = op.scored(docs.join(labels, "doc_id").where(op.held_out("doc_id")).select("doc_id", "text"), op.fit(docs, labels)).join(labels, "doc_id").select("predicted", "toxic").collect()
    right, found = sum(r.predicted == r.toxic for r in got) / len(got), sum(r.predicted for r in got if r.toxic)
    print(f"{right:.3f} of {len(got)} right, {found} of {sum(r.toxic for r in got)} toxic ones found, {sum(r.predicted for r in got if not r.toxic)} clean ones called toxic")
    assert right > 0.9 and 3 * found >= sum(r.toxic for r in got)
