import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.oracle import same
from turnweave.llm import op3_decontam as op
from turnweave.llm import queries


def words_of(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def windows(t, n):
    w = words_of(t)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    of: dict = {}
    for d, t in docs:
        of.setdefault(d, set()).update(*[windows(t, n) for n in range(1, 6)])
    out = set()
    for d, own in of.items():
        for i, x in items:
            s = windows(x, min(5, len(words_of(x)))) if words_of(x) else set()
            if d is not None and i is not None and s and round(len(s & own) / len(s), 9) >= 0.8:
                out.add((d, i, len(s), len(s & own)))
    return out


@pytest.fixture
def cases():
    r = random.Random(6)
    word = lambda: f"w{r.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 6, 12, 40])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "?!"), (None, "a b c d e f"), (33, items[5][1])]
    docs = []
    for k in range(200):
        words = [word() for _ in range(r.randrange(80))]
        if k % 2:
            own = (r.choice(items)[1] or "").split()
            for _ in range(r.randrange(3)):
                if own:
                    own[r.randrange(len(own))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((k, r.choice([" ", "\n", ", "]).join(words).title()))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, "x " * 40_000 + items[6][1]), (503, items[7][1]), (503, items[7][1])]
    return docs, items


@pytest.mark.parametrize("limit", [op.BROADCAST_SHINGLES, 0])
def test_matches_brute_force(spark, cases, monkeypatch, limit):
    monkeypatch.setattr(op, "BROADCAST_SHINGLES", limit)
    docs, items = cases
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("hash", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit("clash"))
    assert {(r.doc, r.item, r.n_shingles, r.n_held) for r in op.held_items(d, i).collect()} == brute(docs, items)


def test_removal_and_empty_tables(spark):
    schema = "doc_id long, text string"
    d = spark.createDataFrame([(1, "one two three four five six seven"), (2, "clean words stay here for good"), (None, "x")], schema)
    i = spark.createDataFrame([(9, "Two three, four five six seven")], "item_id long, text string")
    assert sorted((r.doc_id for r in op.without_items(d, i).collect()), key=str) == [2, None]
    assert op.held_items(spark.createDataFrame([], schema), i).count() == 0
    assert op.without_items(d, i.limit(0)).count() == 3


def test_plan_is_native(spark, cases):
    docs, items = cases
    plan = op.held_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "short_items_derived"])
def test_query_matches_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")


def test_rows_of_one_id_count_together(spark):
    words = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(words[:17])), (1, " ".join(words[13:])), (2, " ".join(words[:17])), (1, None)]
    items = [(0, " ".join(words))]
    got = op.held_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc, r.item, r.n_shingles, r.n_held) for r in got} == brute(docs, items) == {(1, 0, 26, 26)}


@pytest.mark.parametrize("most", [op.MOST_STARTS, 0])
def test_documents_are_hashed_only_where_items_may_begin(spark, monkeypatch, most):
    """Items of one to six words, the least of which decide where documents are hashed; too many beginnings give the plain way."""
    monkeypatch.setattr(op, "MOST_STARTS", most)
    calls, real = [], op.windows_at
    monkeypatch.setattr(op, "windows_at", lambda *a: calls.append(a) or real(*a))
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(9)}" for _ in range(n))) for i, n in enumerate([2, 2, 3, 4, 5, 6, 6])]
    docs = [(d, " ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(120)))) for d in range(60)] + [(99, None), (98, "w1"), (97, items[5][1]), (96, items[0][1])]
    for own in (items, [*items, (50, "w3")]):
        got = op.held_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(own, "item_id long, text string")).collect()
        assert {tuple(x)[:4] for x in got} == {x[:4] for x in brute(docs, own)}
    assert bool(calls) == bool(most)


def test_windows_at_starts_only(spark):
    df = spark.createDataFrame([("a b c a b",), ("b a",), ("a",), ("",)], "t string").select(op.words_of(F.col("t")).alias("w"))
    start = [df.select(F.xxhash64(F.lit("a"), F.lit("b"))).first()[0]]
    assert [x[0] for x in df.select(op.windows_at(F.col("w"), [2, 3], start)).collect()] == [["a b", "a b c", "a b"], [], [], []]
