"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated strings go, documents that
hold a benchmark item go, and what is left is encoded and decoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of docs, whatever they are called (dots, and names that the operators use, included).

In every stage: an empty table gives no rows; a null text counts as an empty one and stays null; very long texts are read whole;
repeated rows and rows without an id are rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import op1_toxicity, op3_decontam, op7_word_table, op9_simhash, op10_suffix_dedup
from turnweave.llm.common import materialize, quoted


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labelled ones of these, calls toxic.

    Labels of unknown ids, and null labels, are not used; a score of exactly 0.5 is toxic; without both kinds of labels every score
    is the share of toxic ones among them.
    """
    return op1_toxicity.without_toxic(docs, op1_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by Jaccard 0.8 or more of five-word shingles; fingerprints find the candidates.

    Rows that repeat one id stay or go together; rows without an id stay; texts without words are copies of each other, and so
    are equal texts of fewer than five words.
    """
    return op9_simhash.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes or more that stand earlier in the corpus; n_chars follows.

    Earlier is by smaller id, then by place; rows without an id are latest, those that repeat an id are in order of input. Bytes
    of a character of which a part goes are dropped, so texts stay valid.
    """
    return op10_suffix_dedup.suffix_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Rows that repeat one id go together where any of them holds one; rows without an id stay; without items all stay.
    """
    return op3_decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*map(quoted, docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row: ids of its text and the text that they decode to; empty for a null text."""
    return op7_word_table.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: No SQL: a network, fingerprints by XXH64, and BPE; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
