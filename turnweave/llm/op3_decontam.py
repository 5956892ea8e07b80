"""Benchmark decontamination: items found inside documents by size-partitioned MinHash containment, then verified exactly.

Everything is DataFrame expressions. Words are runs of letters and digits of the lower-cased text; an item's shingles are its runs
of N words, or, where it has fewer, all its words as one; a text without words has none and matches nothing. A document is looked
through in windows of all these lengths that the items have, and holds an item where at least THRESHOLD of the item's distinct
shingles are among its windows.

An item's sketch is its shingles with the least hashes (bottom-m MinHash). m depends on the item's size: items are parted by
their number n of distinct shingles, and m = n - ceil(THRESHOLD * n) + 1 is the least number for which a document that holds
THRESHOLD of n shingles must hold one of any m of them. Probing the sketches with every shingle of every document therefore
loses no pair, while only a fifth of an item is indexed. Candidates are counted against the whole item, on strings. Where items
have shingles of several lengths, a document is hashed at all of them only where it begins, at the least length, like some item's.

Documents are never exchanged for the search. The sketches are broadcast while they are under BROADCAST_SHINGLES, which is
checked; beyond it the probes are exchanged by shingle hash, which Spark splits where it is skewed.

Defined results: null texts hold nothing; rows of one document id count together, by the union of their shingles; items with equal
texts are items of their own; an item of fewer than five words is found wherever its words stand next to each other in order; a
containment of exactly the threshold counts; null ids are left out of pairs; empty tables give no pairs. Very long texts are read
whole, as one row's arrays. Extra columns, also of clashing names, are ignored by held_items() and kept by without_items().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import materialize, quoted

WORDS = 5
THRESHOLD = 0.8
#: Sketch entries up to which they are broadcast: 16 bytes each, 16 MB in all.
BROADCAST_SHINGLES = 1_000_000
#: Beginnings of the items' shingles up to which documents are hashed at these alone.
MOST_STARTS = 10_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def windows(words: Column, lengths: list[int], hashed: bool = False) -> Column:
    """Runs of so many words, joined by spaces or as hashes; words is evaluated once.

    Hashes come without their strings: each word's hash seeds the next.
    """

    def of(w: Column, n: int) -> Column:
        at = (lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])) if hashed else (lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), at)).otherwise(F.array().cast("array<long>" if hashed else "array<string>"))

    return F.transform(F.array(words), lambda w: F.concat(*[of(w, n) for n in lengths]))[0]


def windows_at(words: Column, lengths: list[int], starts: list[int], hashed: bool = False) -> Column:
    """Those of windows(), with lengths ascending, that begin with a run of the least length whose hash is among starts."""
    run = lambda w, i, n: F.xxhash64(*[F.get(w, i + k) for k in range(n)])

    def of(w: Column) -> Column:
        places = F.when(F.size(w) >= lengths[0], F.sequence(F.lit(0), F.size(w) - lengths[0])).otherwise(F.array().cast("array<int>"))
        begun = F.filter(places, lambda i: run(w, i, lengths[0]).isin(starts))
        at = run if hashed else (lambda w, i, n: F.array_join(F.slice(w, i + 1, n), " "))
        return F.flatten(F.transform(begun, lambda i: F.array(*[F.when(i + n <= F.size(w), at(w, i, n)) for n in lengths])))

    return F.array_compact(F.transform(F.array(words), of)[0])


def shingles_of_item(words: Column, n: int, hashed: bool = False) -> Column:
    """An item's runs of n words, or of all it has where they are fewer."""
    out = windows(words, [n], hashed)
    for k in range(1, n):
        out = F.when(F.size(words) == k, windows(words, [k], hashed)).otherwise(out)
    return out


def sketches(items: DataFrame, item_id: str = "item_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item, size, hash): the bottom-m hashes of every item, m by the item's size partition."""
    hashed = items.where(quoted(item_id).isNotNull()).select(quoted(item_id).alias("item"), F.array_distinct(shingles_of_item(words_of(quoted(text_col)), n, True)).alias("h"))
    size = F.size("h")
    m = size - F.ceil(F.round(size * F.lit(threshold), 9)).cast("int") + 1
    return hashed.where(size > 0).select("item", size.alias("size"), F.explode(F.slice(F.sort_array("h"), 1, m)).alias("hash"))


def held_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", item_text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, item, n_shingles, n_held, containment): every pair whose containment is at least the threshold."""
    index = materialize(sketches(items, item_id, item_text, n, threshold), "sketches").select("item", "hash").distinct()
    small = index.count() <= BROADCAST_SHINGLES
    words = F.size(words_of(quoted(item_text)))
    lengths = sorted(r[0] for r in items.where(quoted(item_id).isNotNull() & (words > 0)).select(F.least(words, F.lit(n)).alias("k")).distinct().collect())  # n numbers at most
    if not lengths:
        lengths = [n]
    named = docs.where(quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("doc"), words_of(quoted(text_col)).alias("w"))
    of = windows
    if len(lengths) > 1:  # most windows begin like no item's, which one hash for all lengths tells
        begun = items.where(quoted(item_id).isNotNull()).select(F.explode(windows(words_of(quoted(item_text)), lengths[:1], True)).alias("h")).distinct()
        starts = [r[0] for r in begun.limit(MOST_STARTS + 1).collect()]
        if len(starts) <= MOST_STARTS:
            of = lambda words, lengths, hashed=False: windows_at(words, lengths, starts, hashed)
    probes = named.select("doc", F.explode(F.array_distinct(of(F.col("w"), lengths, True))).alias("hash"))
    pairs = materialize(probes.join(F.broadcast(index) if small else index, "hash").select("doc", "item").distinct(), "candidates")

    wanted = pairs.join(items.where(quoted(item_id).isNotNull()).select(quoted(item_id).alias("item"), F.array_distinct(shingles_of_item(words_of(quoted(item_text)), n)).alias("of_item")).distinct(), "item")
    texts = docs.where(quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("doc"), quoted(text_col).alias("t"))
    found = texts.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", of(words_of(F.col("t")), lengths).alias("of_doc")).join(wanted, "doc")
    held = found.select("doc", "item", F.size("of_item").alias("n_shingles"), F.explode(F.array_intersect("of_item", "of_doc")).alias("s"))
    best = held.groupBy("doc", "item").agg(F.max("n_shingles").alias("n_shingles"), F.count_distinct("s").alias("n_held"))
    ratio = F.col("n_held") / F.col("n_shingles")
    return best.where(F.round(ratio, 9) >= threshold).select("doc", "item", F.col("n_shingles").cast("long"), F.col("n_held").cast("long"), F.round(ratio, 6).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """docs without those that hold an item; rows without an id stay."""
    return docs.join(held_items(docs, items, doc_id, **names).select(F.col("doc").alias(doc_id)).distinct(), doc_id, "left_anti")
