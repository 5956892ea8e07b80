"""Forward passes of the dialogue model and its gates, in numpy, one dialogue a group.

Attention runs over a dialogue's utterances, which are few; vectors travel by Arrow. Weights are a dict of arrays (out, in) that
the caller brings; seeded_weights makes some for tests, which say nothing about a trained model. Rows that exist are unmasked, so
no padding is needed. Evaluation only: dropout is the identity and the supervised contrastive loss is its own operator.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.arrays import log_softmax, scaled
from turnweave.functions.arrays import softmax as column_softmax
from turnweave.operators.groups import apply_to_groups

FUSIONS = ("softmax", "entropy", "class_reliability", "scalar_reliability", "transformer_reliability")
PAIRS = ("tt", "at", "vt", "aa", "ta", "va", "vv", "tv", "av")  # from the first modality to the second


@dataclass(frozen=True)
class ModelConfig:
    text: int = 1024
    audio: int = 1024
    visual: int = 768
    hidden: int = 1024
    heads: int = 8
    classes: int = 7
    speakers: int = 9
    gate_hidden: int = 128
    gate_dim: int = 64
    gate_heads: int = 2
    fusion: str = "softmax"
    speaker_embeddings: bool = True
    identity_gates: bool = True
    disentangle: bool = False
    appearance: int = 768
    intra_visual: str = ""  # "", "fixed" or "learned": how appearance and geometry are joined
    landmark_projector: bool = False
    dropout_site: str = "input"

    def __post_init__(self) -> None:
        if self.fusion not in FUSIONS or self.dropout_site not in ("input", "representation") or self.intra_visual not in ("", "fixed", "learned"):
            raise ValueError("unknown fusion, dropout site or visual gate")
        if self.hidden % self.heads or (self.disentangle and self.hidden % 2):
            raise ValueError("hidden must divide by heads, and by 2 to be disentangled")
        if self.intra_visual and self.visual <= self.appearance:
            raise ValueError("there is no geometry after the appearance part")


Weights = dict[str, np.ndarray]


def seeded_weights(c: ModelConfig, seed: int = 0) -> Weights:
    """Weights of the right shapes."""
    r = np.random.default_rng(seed)
    w: Weights = {}

    def linear(name: str, inputs: int, outputs: int, bias: bool = True) -> None:
        w[name] = r.standard_normal((outputs, inputs)) / math.sqrt(inputs)
        if bias:
            w[f"{name}.b"] = r.standard_normal(outputs) * 0.01

    def norm(name: str, n: int) -> None:
        w[f"{name}.g"], w[f"{name}.b"] = np.ones(n), np.zeros(n)

    h = c.hidden
    w["speakers"] = r.standard_normal((c.speakers + 1, h)) * 0.1
    w["speakers"][-1] = 0
    linear("in.t", c.text, h, False)
    linear("in.a", c.audio, h, False)
    if c.intra_visual:
        geometry = c.visual - c.appearance
        linear("vis.app", c.appearance, h, False)
        norm("vis.norm", geometry)
        linear("vis.geo1", geometry, h)
        linear("vis.geo2", h, h)
        if c.intra_visual == "learned":
            linear("vis.gate1", 2 * h, 64)
            linear("vis.gate2", 64, 2)
    elif c.landmark_projector:
        norm("lm.norm1", c.visual)
        linear("lm.fc1", c.visual, h)
        norm("lm.norm2", h)
        linear("lm.fc2", h, h)
    else:
        linear("in.v", c.visual, h, False)
    for pair in PAIRS:
        norm(f"{pair}.norm", h)
        for part in ("q", "k", "v", "o", "ff1", "ff2"):
            linear(f"{pair}.{part}", h, h)
        norm(f"{pair}.ffnorm", h)
        if not c.identity_gates:
            linear(f"{pair}.gate", h, h, False)
    for m in "tav":
        linear(f"reduce.{m}", 3 * h, h)
        linear(f"head.{m}", h, c.classes)
        if c.disentangle:
            linear(f"dis.{m}.shared", h, h // 2, False)
            linear(f"dis.{m}.specific", h, h // 2, False)
            linear(f"dis.{m}.expand", h // 2, h, False)
        if c.fusion in ("class_reliability", "scalar_reliability"):
            linear(f"rel.{m}1", h + c.classes, c.gate_hidden)
            linear(f"rel.{m}2", c.gate_hidden, c.classes if c.fusion == "class_reliability" else 1)
    linear("head.all", h, c.classes)
    if c.fusion == "softmax":
        linear("fuse", h, h, False)
    if c.fusion == "transformer_reliability":
        g = c.gate_dim
        linear("tr.in", h + c.classes, g)
        for n in ("tr.innorm", "tr.norm1", "tr.norm2"):
            norm(n, g)
        for part in ("q", "k", "v", "o"):
            linear(f"tr.{part}", g, g)
        linear("tr.ff1", g, 2 * g)
        linear("tr.ff2", 2 * g, g)
        linear("tr.score", g, 1, False)
    return w


# Pieces


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    y = x @ w[name].T
    return y + w[f"{name}.b"] if f"{name}.b" in w else y


def layer_norm(x: np.ndarray, w: Weights | None = None, name: str = "", eps: float = 1e-5) -> np.ndarray:
    y = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)
    return y * w[f"{name}.g"] + w[f"{name}.b"] if w is not None else y


def gelu_tanh(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def positions(length: int, width: int) -> np.ndarray:
    """Sines at even places and cosines at odd ones."""
    angle = np.arange(length)[:, None] * np.exp(np.arange(0, width, 2) * -(math.log(10_000.0) / width))
    out = np.zeros((length, width))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle)[:, : width // 2]
    return out


def attention(keys: np.ndarray, queries: np.ndarray, w: Weights, name: str, heads: int, hidden: np.ndarray | None = None) -> np.ndarray:
    """Multi-head attention; the last two axes are positions and width; hidden marks positions that nothing attends to."""
    parts = lambda x: np.moveaxis(x.reshape(*x.shape[:-1], heads, -1), -2, -3)
    q, k, v = parts(linear(queries, w, f"{name}q")), parts(linear(keys, w, f"{name}k")), parts(linear(keys, w, f"{name}v"))
    scores = q @ np.swapaxes(k, -1, -2) / math.sqrt(q.shape[-1])
    if hidden is not None:
        scores = np.where(hidden, -1e10, scores)
    out = np.moveaxis(softmax(scores) @ v, -3, -2)
    return linear(out.reshape(*out.shape[:-2], -1), w, f"{name}o")


def encode(a: np.ndarray, b: np.ndarray, speaker: np.ndarray, w: Weights, pair: str, heads: int) -> np.ndarray:
    """One encoder layer in which b attends to a (itself, where they are one modality)."""
    place = positions(len(b), b.shape[1]) + speaker
    a, b = a + place, b + place
    x = attention(layer_norm(a, w, f"{pair}.norm", 1e-6), layer_norm(b, w, f"{pair}.norm", 1e-6), w, f"{pair}.", heads) + b
    return x + linear(gelu_tanh(linear(layer_norm(x, w, f"{pair}.ffnorm", 1e-6), w, f"{pair}.ff1")), w, f"{pair}.ff2")


def visual_input(v: np.ndarray, w: Weights, c: ModelConfig) -> np.ndarray:
    if c.intra_visual:
        look, shape = linear(v[:, : c.appearance], w, "vis.app"), layer_norm(v[:, c.appearance :], w, "vis.norm")
        shape = linear(gelu(linear(shape, w, "vis.geo1")), w, "vis.geo2")
        look, shape = layer_norm(look), layer_norm(shape)
        if c.intra_visual == "fixed":
            return 0.5 * look + 0.5 * shape
        gate = softmax(linear(np.maximum(0, linear(np.concatenate([look, shape], 1), w, "vis.gate1")), w, "vis.gate2"))
        return gate[:, :1] * look + gate[:, 1:] * shape
    if c.landmark_projector:
        x = layer_norm(gelu(linear(layer_norm(v, w, "lm.norm1"), w, "lm.fc1")), w, "lm.norm2")
        return gelu(linear(x, w, "lm.fc2"))
    return linear(v, w, "in.v")


def calibrated(logits: np.ndarray) -> np.ndarray:
    return softmax(logits / np.maximum(np.linalg.norm(logits, axis=-1, keepdims=True), 1e-12))


def reliability(z: dict[str, np.ndarray], logits: dict[str, np.ndarray], w: Weights) -> np.ndarray:
    """(3, utterances, classes or 1): weights of the modalities from their gates."""
    raw = [linear(np.maximum(0, linear(np.concatenate([z[m], calibrated(logits[m])], 1), w, f"rel.{m}1")), w, f"rel.{m}2") for m in "tav"]
    return softmax(np.stack(raw), 0)


def transformer_reliability(z: dict[str, np.ndarray], logits: dict[str, np.ndarray], w: Weights, c: ModelConfig, dropped: frozenset[str]) -> np.ndarray:
    """(3, utterances, 1) from attention between three modality tokens; all count as there when all are dropped."""
    x = np.stack([np.concatenate([z[m], calibrated(logits[m])], 1) for m in "tav"], 1)
    x = layer_norm(linear(x, w, "tr.in"), w, "tr.innorm")
    gone = np.array([m in dropped for m in "tav"])
    gone = np.zeros(3, bool) if gone.all() else gone
    y = layer_norm(x, w, "tr.norm1")
    x = x + attention(y, y, w, "tr.", c.gate_heads, gone if gone.any() else None)
    x = x + linear(np.maximum(0, linear(layer_norm(x, w, "tr.norm2"), w, "tr.ff1")), w, "tr.ff2")
    score = np.where(gone, -1e4, linear(x, w, "tr.score")[..., 0])
    return softmax(score).T[..., None]


def run_dialogue(text: np.ndarray, audio: np.ndarray, visual: np.ndarray, speaker: np.ndarray, w: Weights, c: ModelConfig, dropped: Sequence[str] = ()) -> dict[str, np.ndarray]:
    """Logits of one dialogue: fused ("all") and by modality ("t", "a", "v"), and each modality's representation ("h.t", ...)."""
    gone = frozenset(m.lower() for m in dropped)
    raw = {"t": text, "a": audio, "v": visual}
    if c.dropout_site == "input":
        raw = {m: np.zeros_like(x) if m in gone else x for m, x in raw.items()}
    x = {"t": linear(raw["t"], w, "in.t"), "a": linear(raw["a"], w, "in.a"), "v": visual_input(raw["v"], w, c)}
    who = w["speakers"][np.clip(speaker, 0, c.speakers)] if c.speaker_embeddings else np.zeros((len(text), c.hidden))
    h = {}
    for m, sources in (("t", "tav"), ("a", "atv"), ("v", "vta")):
        parts = []
        for s in sources:
            own = encode(x[s], x[m], who, w, s + m, c.heads)
            gate = own if c.identity_gates else linear(own, w, f"{s}{m}.gate")
            parts.append(own / (1 + np.exp(-gate)))
        h[m] = linear(np.concatenate(parts, 1), w, f"reduce.{m}")
        if c.dropout_site == "representation" and m in gone:
            h[m] = np.zeros_like(h[m])
    logits = {m: linear(np.maximum(0, h[m]), w, f"head.{m}") for m in "tav"}
    out = {f"h.{m}": h[m] for m in "tav"}
    z = h
    if c.disentangle:
        shared = {m: linear(h[m], w, f"dis.{m}.shared") for m in "tav"}
        specific = {m: linear(h[m], w, f"dis.{m}.specific") for m in "tav"}
        z = {m: linear(shared[m], w, f"dis.{m}.expand") for m in "tav"}
        out |= {f"h.{m}": shared[m] for m in "tav"}
        out["orthogonality"] = sum((shared[m] * specific[m]).sum(1) ** 2 for m in "tav")
    stack = np.stack([z[m] for m in "tav"])
    if c.fusion == "class_reliability":
        fused = (reliability(z, logits, w) * np.stack([logits[m] for m in "tav"])).sum(0)
    else:
        if c.fusion == "softmax":
            weight = softmax(linear(stack, w, "fuse"), 0)
        elif c.fusion == "entropy":
            p = softmax(np.stack([logits[m] for m in "tav"]))
            weight = softmax((p * np.log(np.maximum(p, 1e-9))).sum(-1, keepdims=True), 0)
        elif c.fusion == "scalar_reliability":
            weight = reliability(z, logits, w)
        else:
            weight = transformer_reliability(z, logits, w, c, gone)
        fused = linear((weight * stack).sum(0), w, "head.all")
    return out | logits | {"all": fused}


def forward(df: DataFrame, weights: Weights, c: ModelConfig, text: str, audio: str, visual: str, dropped: Sequence[str] = (), combos: dict[str, Sequence[str]] | None = None, dialogue: str = "dialogue_id", utterance: str = "utterance_id", speaker: str = "speaker_index") -> DataFrame:
    """(dialogue, utterance, combo, logits, logits_t, logits_a, logits_v, orthogonality).

    combos: what is dropped by combination; all of them are run on a dialogue while it is there, and each gives its rows.
    orthogonality is the utterance's part of that loss, null without a disentangler. See outputs() for what else the model gives.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)  # of a size that the configuration fixes
    runs = combos or {"": dropped}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("u", kind="stable")
        rows = lambda name: np.stack([np.asarray(x, float) for x in g[name]])
        x, parts = (rows("t"), rows("a"), rows("v")), []
        for combo, gone in runs.items():
            out = run_dialogue(*x, g["s"].to_numpy(), shared.value, c, gone)
            parts.append(pd.DataFrame({"u": g["u"].to_numpy(), "combo": combo, "logits": list(out["all"]), **{f"logits_{m}": list(out[m]) for m in "tav"}, "orthogonality": out.get("orthogonality")}))
        return pd.concat(parts, ignore_index=True).astype({"orthogonality": "float64"})

    own = df.select(F.col(dialogue).cast("long").alias("d"), F.col(utterance).cast("long").alias("u"), F.col(speaker).cast("long").alias("s"), F.col(text).alias("t"), F.col(audio).alias("a"), F.col(visual).alias("v"))
    got = apply_to_groups(own, "d", run, "d long, u long, combo string, logits array<double>, logits_t array<double>, logits_a array<double>, logits_v array<double>, orthogonality double")
    return got.withColumnsRenamed({"d": dialogue, "u": utterance})


def outputs(df: DataFrame, temperature: float = 1.0, logits: str = "logits") -> DataFrame:
    """df with what the model returns of its logits: log-probabilities by modality and fused, fused probabilities, and all of
    these again at a temperature, for distillation: log_p_t, log_p_a, log_p_v, log_p, p, kl_log_p_t, kl_log_p_a, kl_log_p_v, kl_p."""
    hot = 1.0 / float(temperature)
    names = {"t": f"{logits}_t", "a": f"{logits}_a", "v": f"{logits}_v"}
    made = {f"log_p_{m}": log_softmax(F.col(n)) for m, n in names.items()}
    made |= {"log_p": log_softmax(F.col(logits)), "p": column_softmax(F.col(logits))}
    made |= {f"kl_log_p_{m}": log_softmax(scaled(F.col(n), hot)) for m, n in names.items()}
    return df.withColumns(made | {"kl_p": column_softmax(F.col(logits), temperature)})


def parameter_counts(weights: Weights) -> dict[str, int]:
    """Numbers of parameters by part, the first piece of their names, and in all."""
    out: dict[str, int] = {}
    for name, w in weights.items():
        part = name.split(".", 1)[0]
        out[part] = out.get(part, 0) + w.size
    return out | {"all": sum(w.size for w in weights.values())}


def parameters_by_part(weights: DataFrame) -> DataFrame:
    """(part, n) of a table weights(name, value) with arrays of numbers: counts by the first piece of their names, and in all."""
    part = F.substring_index("name", ".", 1)
    counts = weights.groupBy(part.alias("part")).agg(F.sum(F.size("value")).cast("long").alias("n"))
    return counts.unionByName(counts.agg(F.lit("all").alias("part"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))


def positioned(vector: Column, place: Column, speaker: Column) -> Column:
    """A vector plus the sines (even places of it) and cosines (odd ones) of its place in the dialogue, plus its speaker's vector."""
    rate = lambda k: F.exp((k - k % 2) * F.lit(-math.log(10_000.0)) / F.size(vector))
    wave = lambda k: F.when(k % 2 == 0, F.sin(place * rate(k))).otherwise(F.cos(place * rate(k)))
    return F.zip_with(F.transform(vector, lambda x, k: x + wave(k)), speaker, lambda x, s: x + s)


def visual_parts(vector: Column, appearance: int, width: int) -> Column:
    """struct<appearance, geometry> of a visual vector; one of another width is an error."""
    error = F.raise_error(F.concat(F.lit(f"a visual vector is not of width {width} but "), F.size(vector).cast("string"))).cast("array<double>")
    right = F.when(F.size(vector) == width, vector).otherwise(error)
    return F.struct(F.slice(right, 1, appearance).alias("appearance"), F.slice(right, appearance + 1, width - appearance).alias("geometry"))
