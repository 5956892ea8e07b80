import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import op13_string_kernel as op


def plain_strings(text):
    """Strings of one to four symbols, by name and not by hash."""
    s = " "
    for c in (text or "").lower() + " ":
        c = c if c.isalpha() else " "
        s += c if c != " " or s[-1] != " " else ""
    return {s[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1)} - {" "} if s.strip() else set()


def sample(seed=1, n=60):
    r = random.Random(seed)
    make = lambda ws: " ".join(r.choice(ws) for _ in range(r.choice([1, 3, 30, 200])))
    kinds = {"xa": ["bana", "nado", "Dona", "élan"], "xb": ["krtek", "strk", "prst"], "xc": ["она", "ночь", "дом"]}
    return [(i, make(kinds[k]), k) for i, k in enumerate(list(kinds) * n)]


@pytest.mark.parametrize("text", ["a", "Ab, ab 12 ab", "É straße", "ДОМ-дом", "x" * 50, "  lone  ", "日本語 テキスト", "ab\ud800cd"])
def test_as_many_strings_as_there_are_different_ones(text):
    assert len(op.Strings()(text)) == len(plain_strings(text))


def test_no_letters():
    assert [len(op.Strings()(t)) for t in (None, "", " \n", "12 % 34", "…")] == [0] * 5


def test_long_texts_in_pieces_give_the_strings_of_the_whole(monkeypatch):
    text = " ".join(t for _, t, _ in sample())
    want = np.sort(op.Strings()(text))
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(op, "PIECE", piece)
        assert (np.sort(op.Strings()(text)) == want).all()


def test_kernel_is_that_of_string_sets():
    rows = sample()
    model = op.train([t for _, t, _ in rows], [k for _, _, k in rows], 6)
    own = [plain_strings(t) for _, t, _ in rows]
    first = [i for i in range(6)]  # two of each language, in turn
    got = model.kernel([op.Strings()(t) for _, t, _ in rows])
    want = np.array([[len(a & own[j]) / np.sqrt(len(a) * len(own[j])) for j in first] for a in own])
    assert got == pytest.approx(want, abs=1e-5)


def test_weights_are_the_ridge_regression_of_the_landmarks_features():
    rows = sample(2, 20)
    model = op.train([t for _, t, _ in rows], [k for _, _, k in rows], 9, ridge=0.01)
    k = model.kernel([op.Strings()(t) for _, t, _ in rows]).astype(float)
    own = k[:9]
    target = np.array([[1.0 if lang == name else -1.0 for name in model.langs] for _, _, lang in rows])
    w = model.weights.astype(float)  # solves (k'k + ridge n own) w = k' target
    assert (k.T @ k + 0.01 * len(rows) * own) @ w == pytest.approx(k.T @ target, abs=0.05)


def test_rows_flags_and_odd_texts(spark):
    rows = sample() + [(500, None, "xa"), (501, "", "xa"), (502, "1 2 3 %", "xb"), (None, "bana dona", None), (None, "krtek", "xb"), (5, "bana", "xb"), (5, "bana", "xb"), (503, "nado " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("a.b", F.lit(1)).repartition(3)
    got = op.identified(docs, op.fit(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (500, 501, 502):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is not None and r.doc_id != 5:
            assert r.lang_pred == ("xa", "xb", "xc")[r.doc_id % 3 if r.doc_id < 500 else 0]
    assert op.identified(docs.limit(0), op.Model([])).collect() == []


def test_one_language_none_and_bounds(spark):
    docs = spark.createDataFrame([(1, "abc", "xa"), (2, "12", "xa"), (3, "def", None)], "doc_id long, text string, lang string")
    none = lambda _: F.lit(False)
    assert sorted(tuple(r)[2:] for r in op.identified(docs, op.fit(docs, exclude=none)).collect()) == [("und", 0.0), ("xa", 1.0), ("xa", 1.0)]
    assert {r.lang_pred for r in op.identified(docs, op.fit(docs.where("lang IS NULL"), exclude=none)).collect()} == {"und"}
    assert {r.lang_pred for r in op.identified(docs, op.fit(docs, exclude=none, max_bytes=0)).collect()} == {"und"}


def test_labels_of_held_out_documents_change_nothing(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(op.held_out("doc_id"), "zz").otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    rows = lambda d: sorted(tuple(r) for r in op.identified(docs, op.fit(d)).collect())
    assert rows(docs) == rows(other)


@pytest.mark.parametrize(("sf", "right"), [("0.01", 0.98), ("0.1", 0.995)])
def test_held_out_accuracy(spark, sf, right):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    own = docs.where(op.held_out("doc_id"))
    got = op.identified(own, op.fit(docs)).join(own.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert got > right
