"""Classification metrics from counts by (label, prediction): one aggregation over the rows, the rest over a few classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """(keys, label, pred, n): the weighted confusion counts."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.sum(w).alias("n"))


def per_class(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, class, support, precision, recall, f1) of every class that is a label or a prediction; nothing over nothing is 0."""
    sides = counts.select(*keys, F.explode(F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0.0).alias("chosen"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0.0).alias("hit")), F.struct(F.col("pred").alias("class"), F.lit(0.0).alias("support"), F.col("n").alias("chosen"), F.lit(0.0).alias("hit")))).alias("x")).select(*keys, "x.*")
    s = sides.groupBy(*keys, "class").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", over(F.col("hit"), F.col("chosen"))).withColumn("recall", over(F.col("hit"), F.col("support")))
    return s.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*keys, "class", "support", "precision", "recall", "f1")


def _mean(value: str, weight: Column | None = None) -> Column:
    return F.avg(value) if weight is None else F.when(F.sum(weight) > 0, F.sum(F.col(value) * weight) / F.sum(weight)).otherwise(0.0)


def summary(counts: DataFrame, keys: Sequence[str] = (), scale: float = 100.0, places: int = 2) -> DataFrame:
    """(keys, n, accuracy, weighted_f1), scaled and rounded."""
    f1 = per_class(counts, keys).groupBy(*keys).agg(_mean("f1", F.col("support")).alias("weighted_f1"))
    acc = counts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("accuracy"))
    joined = acc.join(f1, list(keys)) if keys else acc.crossJoin(F.broadcast(f1))
    return joined.select(*keys, "n", *[F.round(F.col(c) * scale, places).alias(c) for c in ("accuracy", "weighted_f1")])


def confusion(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label, pred, n, share): share of the label's row."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "label")))


def report(counts: DataFrame) -> DataFrame:
    """(row, precision, recall, f1, support): classes, accuracy (in all three columns), macro and weighted means."""
    c = per_class(counts)
    each = c.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    macro = c.agg(*[F.avg(x).alias(x) for x in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro").alias("row"), "*")
    weighted = c.agg(*[_mean(x, F.col("support")).alias(x) for x in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("weighted").alias("row"), "*")
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0.0)) / F.sum("n")
    accuracy = counts.agg(hit.alias("a"), F.sum("n").alias("support")).select(F.lit("accuracy").alias("row"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    return each.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def shift_or_stable(df: DataFrame, dialogue: str = "dialogue_id", utterance: str = "utterance_id", label: str = "label") -> DataFrame:
    """kind: 'shift' where the label differs from that of the turn before, 'stable' where not, 'first' for the first turn.

    The reference's own definition is not there to read; this one is ours.
    """
    before = F.lag(label).over(Window.partitionBy(dialogue).orderBy(utterance))
    return df.withColumn("kind", F.when(before.isNull(), "first").when(before != F.col(label), "shift").otherwise("stable"))


def shift_buckets(severity: Column, moderate: float = 0.15, large: float = 0.35) -> Column:
    """Our cut points of a severity."""
    return F.when(severity < moderate, "stable").when(severity < large, "moderate").otherwise("large")


def early_stop(epochs: DataFrame, patience: int, epoch: str = "epoch", score: str = "f1") -> DataFrame:
    """One row (best_epoch, best, stopped_at): the first epoch of the best score before stopping.

    It stops at the first epoch that is the patience-th in a row without a better score; stopped_at is null when none is.
    """
    order = Window.orderBy(epoch)  # one row an epoch
    best = F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    better = F.when(best.isNull() | (F.col(score) > best), F.col(epoch))
    e = epochs.select(epoch, score, F.row_number().over(order).alias("i"), better.alias("new")).withColumn("at", F.max(F.when(F.col("new").isNotNull(), F.col("i"))).over(order))
    stop = e.agg(F.min(F.when(F.col("i") - F.col("at") >= patience, F.col(epoch))).alias("stopped_at"))
    until = e.crossJoin(F.broadcast(stop)).where(F.col("stopped_at").isNull() | (F.col(epoch) <= F.col("stopped_at")))
    return until.where("new IS NOT NULL").agg(F.max(F.struct("i", epoch, score)).alias("x"), F.max("stopped_at").alias("stopped_at")).select(F.col(f"x.{epoch}").alias("best_epoch"), F.col(f"x.{score}").alias("best"), "stopped_at")


def timing(steps: DataFrame, seconds: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, seconds, n, ms_each) of steps with the seconds that each took."""
    total = F.sum(seconds)
    return steps.groupBy(*keys).agg(total.alias("seconds"), F.count("*").alias("n"), (1000 * total / F.greatest(F.count("*"), F.lit(1))).alias("ms_each"))
