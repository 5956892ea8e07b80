"""Batches of whole dialogues, padded to the longest of each, and token ids cut to a length.

A batch is one row of nested arrays, bounded by its size and its longest dialogue. Dialogues are numbered in ranges of
(length, id), so dialogues of a batch are about as long and little is padded, and no task numbers all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.operators.ranks import numbered

# Fixed value: characters beyond which a word counts as unknown.
LONGEST_WORD = 100


def padded_batches(df: DataFrame, size: int, vectors: Sequence[str], labels: Sequence[str] = ("label",), speaker: str | None = "speaker_index", n_speakers: int = 2, by_length: bool = True, dialogue: str = "dialogue_id", utterance: str = "utterance_id") -> DataFrame:
    """(batch, longest, dialogue, length, mask, speaker, labels, vectors): a row for every `size` dialogues, the last one with fewer.

    All but the first two are arrays over the batch's dialogues; mask (1 for utterances, 0 beyond), speaker (index, n_speakers
    beyond), labels (0 beyond) and vectors (zeros beyond) have an entry for each place up to the longest dialogue. Utterances
    count in order of their ids. Without by_length dialogues go into batches in order of their ids. A null label counts as 0
    and a null vector as zeros of its column's width.
    """
    fields = [*([speaker] if speaker else []), *labels, *vectors]
    widths = df.agg(*[F.coalesce(F.max(F.size(v)), F.lit(0)).alias(v) for v in vectors]) if vectors else None  # one row
    whole = df.groupBy(dialogue).agg(F.array_sort(F.collect_list(F.struct(utterance, *fields))).alias("_u")).withColumn("length", F.size("_u"))
    ranked = numbered(whole, ["length", dialogue] if by_length else [dialogue], "_n")
    placed = ranked.withColumn("batch", F.floor(F.col("_n") / size)).withColumn("_place", F.col("_n") % size)
    gathered = placed.groupBy("batch").agg(F.max("length").alias("longest"), F.array_sort(F.collect_list(F.struct("_place", dialogue, "length", "_u"))).alias("_d"))
    if widths is not None:
        gathered = gathered.crossJoin(F.broadcast(widths.select(F.struct(*vectors).alias("_w"))))

    def each(value, fill: Column) -> Column:
        """value(utterance) of all places of all dialogues."""
        padded = lambda d: F.concat(F.transform(d["_u"], lambda u: F.coalesce(value(u), fill)), F.array_repeat(fill, F.col("longest") - d["length"]))
        return F.transform("_d", padded)

    zeros = lambda v: F.array_repeat(F.lit(0.0), F.col("_w")[v])
    out = [F.transform("_d", lambda d: d[dialogue]).alias(dialogue), F.transform("_d", lambda d: d["length"]).alias("length"), each(lambda u: F.lit(1), F.lit(0)).alias("mask")]
    out += [each(lambda u: u[speaker].cast("int"), F.lit(n_speakers)).alias(speaker)] if speaker else []
    out += [each(lambda u, c=c: u[c].cast("int"), F.lit(0)).alias(c) for c in labels]
    out += [each(lambda u, v=v: u[v].cast("array<double>"), zeros(v)).alias(v) for v in vectors]
    return gathered.select("batch", "longest", *out)


def words_of(text: Column) -> Column:
    """Runs of letters and digits, and other signs one by one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))


def word_pieces(words: DataFrame, vocabulary: DataFrame, word: str = "word", inner: str = "##") -> DataFrame:
    """(word, ids): each different word's pieces by longest match from its front, null where some rest begins with no piece.

    vocabulary(piece, id) has pieces inside of words with the prefix `inner`. All strings of a word meet the vocabulary in
    one join, of which the longest at each place is kept; a fold then walks from piece to piece.
    """
    longest = F.length(word)
    own = words.select(word).where(F.col(word).isNotNull()).distinct()
    at = own.where(longest.between(1, LONGEST_WORD)).select(word, F.explode(F.sequence(F.lit(1), longest)).alias("_at"))
    strings = at.select(word, "_at", F.explode(F.sequence(F.lit(1), F.length(word) - F.col("_at") + 1)).alias("_n"))
    named = strings.withColumn("piece", F.concat(F.when(F.col("_at") > 1, inner).otherwise(""), F.substring(word, F.col("_at"), F.col("_n"))))
    best = named.join(vocabulary.select("piece", "id"), "piece").groupBy(word, "_at").agg(F.max(F.struct("_n", "id")).alias("_p"))
    steps = best.groupBy(word).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_p"))).alias("_s"))
    empty = F.array().cast("array<long>")
    start = F.struct(F.lit(1).alias("next"), empty.alias("ids"))

    def walk(state: Column, i: Column) -> Column:
        step = F.try_element_at("_s", i)
        on = F.struct((i + step["_n"]).alias("next"), F.concat(state["ids"], F.array(step["id"].cast("long"))).alias("ids"))
        return F.when(state["next"] != i, state).when(step.isNull(), F.struct(F.lit(-1).alias("next"), empty.alias("ids"))).otherwise(on)

    walked = steps.withColumn("_w", F.aggregate(F.sequence(F.lit(1), longest), start, walk))
    found = walked.select(word, F.when(F.col("_w.next") > 0, F.col("_w.ids")).alias("ids"))
    return own.join(found, word, "left")


def token_ids(df: DataFrame, keys: Sequence[str], text: str, vocabulary: DataFrame, unknown: int, start: int, end: int, max_tokens: int = 128, inner: str = "##") -> DataFrame:
    """(keys, ids, n_tokens, truncated): a text's pieces between start and end, max_tokens in all at most; keys name a row.

    A word with a rest that begins with no piece is `unknown`, as are words of over LONGEST_WORD characters. As each word
    has a piece at least, words after the first max_tokens - 2 are cut off before they are looked up. A null text has no words.
    """
    room = max_tokens - 2
    texts = df.select(*keys, words_of(F.col(text)).alias("_w")).withColumn("_cut", F.size("_w") > room).withColumn("_w", F.slice("_w", 1, room))
    placed = texts.select(*keys, F.posexplode("_w").alias("_at", "word"))
    pieces = word_pieces(placed, vocabulary, "word", inner)
    met = placed.join(pieces, "word").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("ids", F.array(F.lit(unknown).cast("long"))).alias("ids")))).alias("_p"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    all_ids = F.coalesce(F.flatten(F.transform("_p", lambda p: p["ids"])), F.array().cast("array<long>"))
    both = texts.alias("l").join(met.alias("r"), same, "left").select(*[F.col(f"l.{k}") for k in keys], "_cut", all_ids.alias("_ids"))
    ids = F.concat(F.array(F.lit(start).cast("long")), F.slice("_ids", 1, room), F.array(F.lit(end).cast("long")))
    return both.select(*keys, ids.alias("ids"), (F.least(F.size("_ids"), F.lit(room)) + 2).alias("n_tokens"), (F.col("_cut") | (F.size("_ids") > room)).alias("truncated"))
