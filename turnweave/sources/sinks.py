"""Writers of embeddings, id maps and metric documents. They return nothing and overwrite nothing unless told to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_embeddings(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = "split", keys: tuple[str, ...] = ("dialogue_id", "utterance_id")) -> None:
    """Parquet, sorted by key within files, so that a dialogue's row groups can be skipped by statistics."""
    by = [partition_by] if partition_by and partition_by in df.columns else []
    out = df.sortWithinPartitions(*by, *keys).write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_id_map(ids: DataFrame, path: str, mode: str = "errorifexists") -> None:
    ids.write.mode(mode).parquet(path)


def metrics_document(summary: DataFrame, per_class: DataFrame, key: str = "combo", **meta: str) -> DataFrame:
    """One row (meta..., combos: map from key to metrics) from a few rows of metrics."""
    classes = per_class.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("class", "f1", F.col("recall").alias("accuracy"), "support"))).alias("classes"))
    joined = summary.join(classes, key)
    combos = joined.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct("n", "accuracy", "weighted_f1", "classes")))).alias("combos"))
    return combos.select(*[F.lit(v).alias(k) for k, v in meta.items()], "combos")


def write_metrics(document: DataFrame, path: str, mode: str = "errorifexists") -> None:
    document.coalesce(1).write.mode(mode).json(path)


def write_best(epochs: DataFrame, weights: DataFrame, path: str, epoch: str = "epoch", score: str = "f1", mode: str = "overwrite") -> None:
    """The weights(epoch, name, value) of the epoch with the best score, the first of equal ones; nulls and NaN are no scores."""
    scored = epochs.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    best = scored.agg(F.max_by(epoch, F.struct(F.col(score), -F.col(epoch))).alias(epoch))  # one row
    weights.join(F.broadcast(best), epoch, "left_semi").write.mode(mode).parquet(path)


def append_metrics(df: DataFrame, path: str, at: int, keys: Sequence[str] = ("run", "step")) -> None:
    """Adds df(keys, metrics...) to a log as rows (keys, metric, value, at), at being the writer's clock or count; nulls are left out."""
    names = [c for c in df.columns if c not in keys]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")
    df.select(*keys, rows).select(*keys, "m.*", F.lit(at).cast("long").alias("at")).where("value IS NOT NULL").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str, keys: Sequence[str] = ("run", "step")) -> DataFrame:
    """(keys, metric, value) of a log, the latest of each."""
    return spark.read.parquet(path).groupBy(*keys, "metric").agg(F.max_by("value", "at").alias("value"))
