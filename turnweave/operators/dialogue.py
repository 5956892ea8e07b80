"""Dialogue order, context, splits and identifiers.

Windows run within a dialogue, whose turns are few by nature; numbers over all dialogues come from ranges and prefix sums (see
ranks.py), so nothing here orders a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.ranks import numbered


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or a KeyError that names what it lacks; checked while the plan is made."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def ranked_utterances(df: DataFrame, dialogue: Sequence[str], start: str = "start", line: str = "line_no") -> DataFrame:
    """utterance_id: place in the dialogue by start time, missing times last, ties in file order."""
    order = Window.partitionBy(*dialogue).orderBy(F.col(start).asc_nulls_last(), line)
    return df.withColumn("utterance_id", F.row_number().over(order) - 1)


def numbered_dialogues(df: DataFrame, order: Sequence[str], name: str = "dialogue_id") -> DataFrame:
    """name: running number of distinct order values; numbers come from the distinct values, which are then joined back."""
    return df.join(numbered(df.select(*order).distinct(), order, name), list(order))


def context_text(df: DataFrame, dialogue: str = "dialogue_id", utterance: str = "utterance_id", speaker: str = "speaker", text: str = "utterance", sentiment: str | None = None, k: int = 2, sep: str = " [SEP] ", prefix: str = "", with_speaker: bool = True) -> DataFrame:
    """context: the k utterances before and the current one as `speaker: text`, joined by sep, the sentiment on the current only.

    k = 0 gives the bare text, as documented. A null text is '', a null or empty speaker or sentiment is left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    if k == 0:
        return df.withColumn("context", F.concat(F.lit(prefix), body))
    said = F.when(F.coalesce(F.col(speaker), F.lit("")) != "", F.concat(F.col(speaker), F.lit(": "), body)).otherwise(body) if with_speaker else body
    own = said if sentiment is None else F.concat(said, F.when(F.coalesce(F.col(sentiment), F.lit("")) != "", F.concat(F.lit(" ["), F.col(sentiment), F.lit("]"))).otherwise(""))
    order = Window.partitionBy(dialogue).orderBy(utterance)
    before = F.collect_list(said).over(order.rowsBetween(-k, -1))
    return df.withColumn("context", F.concat(F.lit(prefix), F.array_join(F.concat(before, F.array(own)), sep)))


def shift_severity(df: DataFrame, dialogue: str = "dialogue_id", utterance: str = "utterance_id", va: str = "va") -> DataFrame:
    """severity: distance from the utterance before in valence and arousal over the square's diagonal; 0 for the first."""
    order = Window.partitionBy(dialogue).orderBy(utterance)
    before = F.lag(va).over(order)
    far = F.sqrt(F.pow(F.col(va)[0] - before[0], 2) + F.pow(F.col(va)[1] - before[1], 2)) / 2.828
    return df.withColumn("severity", F.coalesce(far, F.lit(0.0)))


def split_of(df: DataFrame, in_training: Column) -> DataFrame:
    return df.withColumn("split", F.when(in_training, "train").otherwise("test"))


def remapped_ids(ids: DataFrame, split: str = "split", dialogue: str = "dialogue_id", order: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """(split, dialogue, new_id): the first split keeps its ids, each later one goes on after the largest so far.

    ids holds the (split, dialogue) pairs in use, repeated or not. A missing split takes no room.
    """
    known = numbered(ids.select(split, dialogue).distinct(), [dialogue], "_place", [split])
    place = F.col("_place")
    stats = known.groupBy(split).agg(F.max(dialogue).alias("top"), F.count("*").alias("n"))
    wide = stats.agg(*[F.max(F.when(F.col(split) == s, F.col(c))).alias(f"{c}_{s}") for s in order for c in ("top", "n")])  # one row
    offset, base = F.lit(0).cast("long"), None
    for s in order:
        if base is None:
            offset = F.coalesce(F.col(f"top_{s}").cast("long") + 1, F.lit(0).cast("long"))
            base = F.when(F.col(split) == s, F.col(dialogue).cast("long"))
        else:
            base = base.when(F.col(split) == s, offset + place)
            offset = offset + F.coalesce(F.col(f"n_{s}"), F.lit(0))
    return known.crossJoin(F.broadcast(wide)).select(split, dialogue, base.alias("new_id"))


def sharded(df: DataFrame, shard: int, shards: int, dialogue: str = "dialogue_id") -> DataFrame:
    """Rows of every shards-th distinct dialogue id, in ascending order, from the shard-th on."""
    ids = numbered(df.select(dialogue).distinct(), [dialogue], "_n")
    return df.join(ids.where(F.col("_n") % shards == shard).select(dialogue), dialogue, "left_semi")


def id_overlap(df: DataFrame, split: str = "split", dialogue: str = "dialogue_id", pairs: Sequence[tuple[str, str]] = (("train", "dev"), ("train", "test"), ("dev", "test"))) -> DataFrame:
    """(pair, n): dialogue ids that both splits of each pair have."""
    has = df.groupBy(dialogue).agg(F.collect_set(split).alias("s"))
    counts = has.agg(*[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("n")) for a, b in pairs])).alias("x")).select("x.*")


def id_ranges(df: DataFrame, split: str = "split", dialogue: str = "dialogue_id") -> DataFrame:
    return df.groupBy(split).agg(F.min(dialogue).alias("first"), F.max(dialogue).alias("last"), F.count_distinct(dialogue).alias("n"))


def limited_per_split(df: DataFrame, n: int, order: Sequence[str], split: str = "split") -> DataFrame:
    """The first n rows of every split by order; all for 0. Each task keeps its own first n before rows are exchanged."""
    if n == 0:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(split).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def validation_split(ids: DataFrame, share: float, dialogue: str = "dialogue_id", seed: int = 0) -> DataFrame:
    """part: 'valid' for the first floor(share * n) ids in an order shuffled by seed, 'train' for the rest."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(dialogue).cast("string")))
    known = numbered(ids.select(dialogue).distinct().withColumn("_key", key), ["_key", dialogue], "_i")
    n = F.broadcast(known.agg(F.count("*").alias("_n")))
    return known.crossJoin(n).select(dialogue, F.when(F.col("_i") < F.floor(F.col("_n") * F.lit(share)), "valid").otherwise("train").alias("part"))


def with_new_ids(df: DataFrame, ids: DataFrame, keys: Sequence[str], new: str = "new_id") -> DataFrame:
    """df joined with its ids(keys, new); a row whose keys are not there is an error."""
    error = F.raise_error(F.concat_ws(" ", F.lit("no id for"), *[F.col(k).cast("string") for k in keys]))
    joined = df.join(ids.select(*keys, new), list(keys), "left")
    return joined.withColumn(new, F.coalesce(F.col(new), error.cast(ids.schema[new].dataType)))


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, n), without nulls."""
    return df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))


def speaker_vector(speaker: Column) -> Column:
    """[1, 0] for M, [0, 1] for anyone else."""
    return F.when(speaker == "M", F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))


def speaker_index(vector: Column) -> Column:
    """The first place of the largest entry of a speaker vector."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def dialogue_lengths(df: DataFrame, dialogue: str = "dialogue_id", utterance: str = "utterance_id") -> DataFrame:
    """(dialogue, length): one more than the last utterance's place."""
    return df.groupBy(dialogue).agg((F.max(utterance) + 1).alias("length"))


def dialogue_dataset(keys: DataFrame, parts: dict[str, DataFrame], split: str | None = None, dialogue: str = "dialogue_id", utterance: str = "utterance_id") -> DataFrame:
    """The utterances of the dialogues of keys(dialogue, split) with one column of every part(dialogue, utterance, name).

    Parts have to agree: an utterance that some part has and another lacks is an error. All joins are on one pair of keys, so
    the parts are exchanged once each and co-located.
    """
    own = keys if split is None else keys.where(F.col("split") == split)
    out = None
    for name, part in parts.items():
        part = part.select(dialogue, utterance, name, F.lit(True).alias(f"_has_{name}"))
        out = part if out is None else out.join(part, [dialogue, utterance], "full")
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in parts]))
    error = F.raise_error(F.concat(F.lit("no "), F.array_join(lacking, ", "), F.lit(" of "), F.concat_ws("/", F.col(dialogue).cast("string"), F.col(utterance).cast("string"))))
    whole = out.join(own.select(dialogue).distinct(), dialogue, "left_semi")
    return whole.select(dialogue, F.when(F.size(lacking) == 0, F.col(utterance)).otherwise(error.cast("long")).alias(utterance), *parts)


def missing_policy(df: DataFrame, features: DataFrame, keys: Sequence[str], vector: str, width: int, policy: str = "zeros") -> DataFrame:
    """Left join of vectors; a missing one is zeros of the width, or an error."""
    if policy not in ("zeros", "error"):
        raise ValueError("policy is zeros or error")
    fill = F.array_repeat(F.lit(0.0), width) if policy == "zeros" else F.raise_error(F.lit("a vector is missing")).cast("array<double>")
    joined = df.join(features, list(keys), "left")
    return joined.withColumn("missing", F.col(vector).isNull()).withColumn(vector, F.coalesce(F.col(vector), fill))


def va_lookup(df: DataFrame, classes: DataFrame, label: str = "label", own: str = "va_own") -> DataFrame:
    """va: the utterance's own annotation, else its class's, else the middle. classes(label, va) has a row a class."""
    return df.join(F.broadcast(classes), label, "left").withColumn("va", F.coalesce(F.col(own), F.col("va"), F.array(F.lit(0.5), F.lit(0.5))))
