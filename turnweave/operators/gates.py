"""Learned weightings of modalities and projections of vectors, utterance by utterance, as column expressions.

Layers run in NumPy on Arrow batches of many utterances, each sequence of them in one pass; softmax and mixes stay in expressions.
Weights are those of operators.model: arrays (outputs, inputs) by name, with name.b for a bias and name.g for a norm's scale.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.arrays import dot, let
from turnweave.operators.model import Weights, calibrated, gelu, layer_norm, linear

MODALITIES = ("t", "a", "v")


def layers(x: Column, w: Weights, *steps: str, logits: Column | None = None) -> Column:
    """x through layers, all of them in one pass over a batch: "relu", "gelu", "norm", or the name of a norm or linear layer.

    Calibrated probabilities of logits, where given, are appended to x. Null for a null vector, an error for one of another length.
    """
    used = {k: v.astype(float) for k, v in w.items() if k.rpartition(".")[0] in steps or k in steps}

    def through(y: np.ndarray) -> np.ndarray:
        for step in steps:
            if step == "relu":
                y = np.maximum(y, 0)
            elif step == "gelu":
                y = gelu(y)
            elif step == "norm":
                y = layer_norm(y)
            elif f"{step}.g" in used:
                y = layer_norm(y, used, step)
            else:
                y = linear(y, used, step)
        return y

    stacked, alone = lambda c: np.stack(c.to_list()).astype(float), logits is None

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        there = x.notna() & y.notna()
        rows = []
        if there.any():
            own = stacked(x[there])
            rows = through(own if alone else np.concatenate([own, calibrated(stacked(y[there]))], 1))
        found = iter(rows)
        return pd.Series([next(found) if t else None for t in there], dtype=object)

    return run(x, x if alone else logits)


def over_modalities(scores: Sequence[Column]) -> list[Column]:
    """Softmax over equally long arrays, entry by entry: one array each."""
    most = scores[0]
    for s in scores[1:]:
        most = F.zip_with(most, s, lambda a, b: F.greatest(a, b))
    shares = [F.zip_with(s, most, lambda a, m: F.exp(a - m)) for s in scores]
    whole = shares[0]
    for s in shares[1:]:
        whole = F.zip_with(whole, s, lambda a, b: a + b)
    return [F.zip_with(s, whole, lambda a, b: a / b) for s in shares]


def summed(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def reliability_scores(z: Sequence[Column], logits: Sequence[Column], w: Weights) -> list[Column]:
    """What each modality's gate makes of its representation and calibrated probabilities."""
    return [layers(x, w, f"rel.{m}1", "relu", f"rel.{m}2", logits=y) for m, x, y in zip(MODALITIES, z, logits, strict=True)]


def _together(scores: Sequence[Column], values: Sequence[Column], body: Callable[[Column, Column], Column]) -> Column:
    """The sum over modalities of body(weight, value), with scores computed once and outside of lambdas, where Spark calls no Python."""
    n = range(len(scores))

    def of(x: Column) -> Column:
        weights = over_modalities([x[f"s{i}"] for i in n])
        return summed([body(weights[i], x[f"v{i}"]) for i in n])

    return let(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(scores)], *[v.alias(f"v{i}") for i, v in enumerate(values)]), of)


def class_reliability(scores: Sequence[Column], logits: Sequence[Column]) -> Column:
    """Logits mixed with a weight for each class and modality."""
    return _together(scores, logits, lambda weight, y: F.zip_with(weight, y, lambda a, b: a * b))


def scalar_reliability(scores: Sequence[Column], z: Sequence[Column]) -> Column:
    """Representations mixed with a weight for each modality."""
    return _together(scores, z, lambda weight, x: F.transform(x, lambda v: v * F.get(weight, F.lit(0))))


def visual_halves(appearance: Column, geometry: Column, w: Weights) -> tuple[Column, Column]:
    """Both parts of a visual vector, projected to one width and normed."""
    return layers(appearance, w, "vis.app", "norm"), layers(geometry, w, "vis.norm", "vis.geo1", "gelu", "vis.geo2", "norm")


def visual_gate(look: Column, shape: Column, w: Weights | None = None) -> Column:
    """Their mix: half and half, or as a gate over both weighs them."""
    if w is None:
        return F.zip_with(look, shape, lambda a, b: 0.5 * a + 0.5 * b)
    score = layers(F.concat(look, shape), w, "vis.gate1", "relu", "vis.gate2")
    first = 1 / (1 + F.exp(F.get(score, F.lit(1)) - F.get(score, F.lit(0))))  # softmax over two; let, as Spark calls no Python inside of a lambda
    return let(F.struct(look.alias("a"), shape.alias("b"), first.alias("s")), lambda x: F.zip_with(x["a"], x["b"], lambda a, b: x["s"] * a + (1 - x["s"]) * b))


def landmark_projection(x: Column, w: Weights) -> Column:
    return layers(x, w, "lm.norm1", "lm.fc1", "gelu", "lm.norm2", "lm.fc2", "gelu")


def disentangled(h: Column, w: Weights, modality: str) -> Column:
    """struct<shared, specific, expanded, orthogonality>: the last is the square of the first two's product."""
    shared, specific = layers(h, w, f"dis.{modality}.shared"), layers(h, w, f"dis.{modality}.specific")
    return F.struct(shared.alias("shared"), specific.alias("specific"), layers(shared, w, f"dis.{modality}.expand").alias("expanded"), F.pow(dot(shared, specific), F.lit(2)).alias("orthogonality"))
