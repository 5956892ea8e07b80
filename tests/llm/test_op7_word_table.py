import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnweave.llm import op7_word_table as op

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t", "It's WE'LL", "ΑΣ ΟΔΟΣ Σ", "<|startoftext|>Hi<|endoftext|> x<|endoftext|>y", "a\u00a0b\u2003c", "e\u0301 \u0301x", "İstanbul ǅ", "12345 3.14", "🙂🙃", "a\x1cb \x85 z", "word " * 30_000, "Ж" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def brute(tokenizer, rows):
    out = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digest_matches_the_library(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_BYTES", 2000)
    r = random.Random(3)
    bits = ["The", "a's", "\n", " ", "é", "9", "!?", "\u0301", "Σ", "\u00a0", "ß"]
    rows = list(enumerate(ODD)) + [(100 + i, "".join(r.choices(bits, k=r.randrange(30)))) for i in range(300)] + [(None, "null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("chunk", F.lit("clash")).withColumn("a.b", F.lit(1))
    assert sorted((tuple(x) for x in op.bpe_digest(df, PATH).collect()), key=str) == brute(tokenizer, rows)


def test_round_trip_columns(spark, tokenizer):
    rows = [(1, "hello there World"), (2, None), (3, "")]
    ids = op.bpe_ids(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = {r.id: (r.ids, r.decoded) for r in op.decoded(ids, PATH).collect()}
    for d, t in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (want, tokenizer.decode(want, skip_special_tokens=False))


def test_pieces_decode_with_a_decoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = t.encode("Some text, and é<|endoftext|> more", add_special_tokens=False).ids
    assert op.Pieces(path).decode(np.array(ids)).decode() == t.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert op.bpe_digest(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_codes_of_places():
    place = np.array([0, 1, 0, 2, 3, 3, 3, 4], np.uint32)
    order, code = op._coded(place, np.bincount(place))
    back = op._placed(op._unplaned(op._planes(code)), len(order))
    assert order[back].tolist() == place.tolist()
    assert order.tolist() == [3, 0, 1, 2, 4]


def test_one_exchange_serves_both_uses(spark):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id long, text string")
    plan = op.bpe_digest(df, PATH)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_rows_that_come_in_another_order_when_read_again(spark, tokenizer, monkeypatch, tmp_path):
    """A source whose rows are shuffled anew on every reading, as an exchange's can be after an executor is lost."""
    monkeypatch.setattr(op, "CHUNK_BYTES", 500)
    rows = [(i, f"word{i % 7} and some other word{i}") for i in range(200)]

    def shuffled(batches):
        for b in batches:
            yield b.take(op.np.random.default_rng().permutation(b.num_rows))

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).mapInArrow(shuffled, "doc_id long, text string")
    for _ in range(2):
        assert sorted((tuple(x) for x in op.bpe_digest(df, PATH).collect()), key=str) == brute(tokenizer, rows)
    df.write.parquet(f"{tmp_path}/docs")
    files = spark.read.parquet(f"{tmp_path}/docs").where("doc_id >= 0").select("text", "doc_id")
    assert op._settled(files, "doc_id", "text") is files and op._settled(df, "doc_id", "text") is not df


def test_words_are_those_that_the_library_sees_apart(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "  ", " a  b ", "a\tb\nc\x0bd\x0ce\rf", "a\x1cb\x85c\u00a0d\u2003e", "x" * 5000])]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.w for r in df.select("i", F.array_remove(F.split(F.coalesce("t", F.lit("")), r"[\x20\x09-\x0D]+"), "").alias("w")).collect()}
    assert got == {i: [w.decode() for w in (t or "").encode().split()] for i, t in rows}
