import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnweave.llm import op2_token_files as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def brute(tokenizer, rows):
    start, out = 0, []
    tie = lambda t: int.from_bytes(xxhash.xxh64_digest((t or "").encode(), 42), "big", signed=True)
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["", None, " ", "  a  b ", "a\n b", "a \nb", "it's  we'll\u00a0x", "x <|endoftext|> y", "12 345 6 7", "\u3000wide space", "tab\t tab", "a\x1c b", "é à ñ\u2028 z", "end ", " start", "🙂 🙂🙂 ok", "word " * 40_000]


def test_encode_matches_the_library(tokenizer):
    table = op.PieceTable.of(PATH)
    rng = random.Random(5)
    bits = ["a", "\nthe", ".\nIt", "end.", "x,", "l'l", "'", "½", "\t\n", "the", " ", "  ", "\n", "\t", "'s", "9", "é", "…", "\u00a0", "\u2003", "\x85", "<|endoftext|>", "\x1f", "!?"]
    for text in [t or "" for t in ODD] + ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(3000)]:
        assert table.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_texts_together_are_texts_alone(tokenizer):
    rng = random.Random(6)
    bits = ["a", "\nthe", ".\nIt", "end.", "x,", " ", "  ", "\n", "\t", "9", "é", "\u00a0", "<|endoftext|>", "\0", "\x1f", "word", " word", " of", " it."]
    texts = [*ODD, *("".join(rng.choices(bits, k=rng.randrange(0, 30))) for _ in range(2000))]
    table = op.PieceTable(PATH)
    for at in range(0, len(texts), 300):
        own = texts[at : at + 300]
        size, ids = table.encode_all(op.pa.array(own))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in own]
    assert [x.tolist() for x in table.encode_all(op.pa.array([], op.pa.string()))] == [[], []]


def test_plan_cuts_by_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < op.text_size(docs, "text") < 10_000_000
    assert op.text_size(spark.createDataFrame([("é",), (None,)], "text string"), "text") == 2


def test_table_drops_pieces_at_its_limit(tokenizer, monkeypatch):
    monkeypatch.setattr(op, "TABLE_PIECES", 20)
    table = op.PieceTable(PATH)
    for k in range(30):
        text = "a " + " ".join([*(f"w{k}x{i}" for i in range(15)), "often", "seen", "often"])
        assert table.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(table.index) <= 20 + 18
    assert {"often", "seen"} <= table.index.keys()


def test_round_trip(spark, tokenizer):
    rng = random.Random(2)
    rows = [(rng.randrange(10**12), " ".join(rng.choices(["alpha", "beta", "gamma\n", "δ"], k=rng.randrange(60)))) for _ in range(300)]
    rows += list(enumerate(ODD)) + [(None, "nameless"), (None, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("start", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = sorted((tuple(r) for r in op.token_digest(df, PATH).collect()), key=lambda r: r[1])
    assert got == brute(tokenizer, rows)


def test_empty_table(spark):
    assert op.token_digest(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
