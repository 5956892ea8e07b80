"""Masked losses over rows that exist (a row stands for an unmasked position)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.arrays import total
from turnweave.operators.groups import apply_to_groups

#: Anchors whose similarities are held at once.
BLOCK = 512


def nll(log_p: Column, label: Column, weight: Column | None = None) -> Column:
    """Aggregate: -sum w log p[label] / sum w."""
    w = F.lit(1.0) if weight is None else weight
    return F.sum(-w * F.get(log_p, label)) / F.sum(w)


def kl(log_p: Column, target: Column, classes: int, padded: int = 0, eps: float = 1e-8) -> Column:
    """Aggregate: sum of KL(target || p) over max(rows, 1); target is clamped at eps and renormalised.

    A padded position's target becomes uniform and its log p zero, so each of `padded` positions adds -log(classes).
    """
    clamped = F.transform(target, lambda t: F.greatest(t, F.lit(eps)))
    scale = F.greatest(total(clamped), F.lit(eps))
    one = total(F.zip_with(clamped, log_p, lambda t, q: (t / scale) * (F.log(t / scale) - q)))
    return (F.coalesce(F.sum(one), F.lit(0.0)) - padded * math.log(classes)) / F.greatest(F.count("*"), F.lit(1))


def total_loss(parts: dict[str, Column], gammas: dict[str, float]) -> Column:
    """Weighted sum of named losses."""
    out = F.lit(0.0)
    for name, value in parts.items():
        out = out + F.lit(float(gammas.get(name, 1.0))) * value
    return out


def epoch_loss(batches: DataFrame, loss: str = "loss", n: str = "n_valid") -> DataFrame:
    return batches.agg(F.round(F.sum(F.col(loss) * F.col(n)) / F.sum(n), 4).alias("loss"))


def supervised_contrastive(df: DataFrame, batch: str, label: str, views: Sequence[str], temperature: float = 0.07) -> DataFrame:
    """(batch, loss): rows' views of one label attract, within a batch.

    A batch's similarities are products of blocks of its vectors, BLOCK anchors at a time, so no pair is a row and memory is
    linear in the batch. A batch with under two rows has loss 0, and so has one without two views of a label.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = len(group)
        loss = 0.0
        if n > 1:
            h = np.concatenate([np.stack(group[f"v{i}"].to_numpy()).astype(float) for i in range(len(views))])
            h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
            y = np.tile(group["y"].to_numpy(), len(views))
            total, anchors = 0.0, 0
            for at in range(0, len(h), BLOCK):
                s = h[at : at + BLOCK] @ h.T / temperature - 1 / temperature  # at most 0, up to rounding
                own = np.arange(len(s))
                s[own, own + at] = -np.inf
                same = y[at : at + BLOCK, None] == y[None, :]
                same[own, own + at] = False
                count = same.sum(1)
                z = np.log(np.exp(s).sum(1))
                t = np.where(same, s, 0).sum(1)
                some = count > 0
                total += float((z[some] - t[some] / count[some]).sum())
                anchors += int(some.sum())
            loss = total / anchors if anchors else 0.0
        return pd.DataFrame({"loss": [loss]})

    kind = df.schema[batch].dataType.simpleString()
    own = df.select(F.col(batch).alias("b"), F.col(label).alias("y"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(views)])
    return apply_to_groups(own, "b", run, f"b {kind}, loss double").withColumnRenamed("b", batch)
