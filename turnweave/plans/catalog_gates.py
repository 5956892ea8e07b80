"""Queries over learned gates and projections, with weights by a formula that their SQL repeats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.operators import gates as G
from turnweave.plans import fixtures as fx
from turnweave.plans.catalog import KEYS, query, r6
from turnweave.plans.fixtures import F_SQL, softmax_sql

# Layers by number (k): entry (o, i) of a layer is sin(1.7 o + 0.9 i + k) over the root of its inputs; biases are cos(o + k) / 10.
LAYERS = {"rel.t1": (1, 21, 8), "rel.a1": (2, 21, 8), "rel.v1": (3, 21, 8), "rel.t2": (4, 8, 7), "rel.a2": (5, 8, 7), "rel.v2": (6, 8, 7), "vis.geo1": (7, 6, 8), "vis.geo2": (8, 8, 8), "vis.gate1": (9, 16, 5), "vis.gate2": (10, 5, 2), "lm.fc1": (11, 14, 8), "lm.fc2": (12, 8, 8)}
PLAIN = {"vis.app": (13, 8, 8), "dis.t.shared": (14, 14, 7), "dis.t.specific": (15, 14, 7), "dis.t.expand": (16, 7, 14)}
NORMS = {"vis.norm": 6, "lm.norm1": 14, "lm.norm2": 8}


def weights(scalar: bool = False) -> dict[str, np.ndarray]:
    w = {}
    for name, (k, inputs, outputs) in (LAYERS | PLAIN).items():
        outputs = 1 if scalar and name in ("rel.t2", "rel.a2", "rel.v2") else outputs
        o, i = np.arange(outputs)[:, None], np.arange(inputs)[None, :]
        w[name] = np.sin(1.7 * o + 0.9 * i + k) / np.sqrt(inputs)
        if name in LAYERS:
            w[f"{name}.b"] = np.cos(np.arange(outputs) + k) / 10
    for name, n in NORMS.items():
        w[f"{name}.g"], w[f"{name}.b"] = 1 + np.arange(n) / 10, np.arange(n) / 20
    return w


def _dense(x: str, k: int, outputs: int, bias: bool = True) -> str:
    return f"list_transform(range(0, {outputs}), lambda o: list_sum(list_transform(range(0, len({x})), lambda i: {x}[i + 1] * sin(1.7::DOUBLE * o + 0.9::DOUBLE * i + {k}) / sqrt(len({x})))) + {f'cos(o + {k}) / 10' if bias else '0'})"


def _relu(x: str) -> str:
    return f"list_transform({x}, lambda r: greatest(r, 0))"


# The error function by its series, which for the arguments here has converged after 60 terms.
_GELU = "list_transform({x}, lambda g: 0.5::DOUBLE * g * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * pow(g / sqrt(2.0::DOUBLE), 2 * n + 1) / (gamma(n + 1.0::DOUBLE) * (2 * n + 1))))))"


def _normed(x: str, scaled: bool = False) -> str:
    y = f"list_transform({x}, lambda y: (y - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5))"
    return f"list_transform(range(0, len({x})), lambda s: ({y})[s + 1] * (1 + s / 10.0::DOUBLE) + s / 20.0::DOUBLE)" if scaled else y


_UNIT = "list_transform({x}, lambda u: u / greatest(sqrt(list_sum(list_transform({x}, lambda v: v * v))), 1e-12))"


def _scores(outputs: int) -> str:
    """s: each modality's scores, a step of the gate a table."""
    parts = list(zip("tav", ("rt", "ra", "rv"), ("lt", "la", "lv"), (1, 2, 3), strict=True))
    unit = ", ".join(f"{_UNIT.format(x=y)} AS {m}u" for m, _, y, _ in parts)
    joined = ", ".join(f"list_concat({z}, {softmax_sql(f'{m}u')}) AS {m}0" for m, z, _, _ in parts)
    inner = ", ".join(f"{_dense(f'{m}0', k, 8)} AS {m}1" for m, _, _, k in parts)
    positive = ", ".join(f"{_relu(f'{m}1')} AS {m}2" for m, _, _, _ in parts)
    outer = ", ".join(f"{_dense(f'{m}2', k + 3, outputs)} AS {m}" for m, _, _, k in parts)
    return f"{F_SQL}, q0 AS (SELECT *, {unit} FROM f), q1 AS (SELECT *, {joined} FROM q0), q2 AS (SELECT *, {inner} FROM q1), q3 AS (SELECT *, {positive} FROM q2), s AS (SELECT *, {outer} FROM q3)"


def _rows(array: str, source: str) -> str:
    return f"SELECT dialogue_id, utterance_id, CAST(i AS INTEGER) AS class, round(a[i + 1], 6) AS value FROM (SELECT dialogue_id, utterance_id, {array} AS a, unnest(range(0, len({array}))) AS i FROM {source})"


def _by_entry(df: DataFrame, value: str) -> DataFrame:
    return df.select(*KEYS, F.posexplode(value).alias("class", "value")).withColumn("value", r6("value"))


_SHARE = "exp({m}[{i}]) / (exp(t[{i}]) + exp(a[{i}]) + exp(v[{i}]))"


@query(f"WITH {_scores(7)}, x AS (SELECT dialogue_id, utterance_id, list_transform(range(1, 8), lambda c: {' + '.join(_SHARE.format(m=m, i='c') + f' * {y}[c]' for m, y in (('t', 'lt'), ('a', 'la'), ('v', 'lv')))}) AS a FROM s) {_rows('a', 'x')}")
def class_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, logits = fx.features(spark, sf_dir), [F.col(c) for c in ("lt", "la", "lv")]
    scores = G.reliability_scores([F.col(c) for c in ("rt", "ra", "rv")], logits, weights())
    named = f.select(*KEYS, "lt", "la", "lv", *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    return _by_entry(named.withColumn("x", G.class_reliability([F.col(f"s{i}") for i in range(3)], logits)), "x")


@query(f"WITH {_scores(1)}, x AS (SELECT dialogue_id, utterance_id, list_transform(range(1, 15), lambda c: {' + '.join(_SHARE.format(m=m, i='1') + f' * {z}[c]' for m, z in (('t', 'rt'), ('a', 'ra'), ('v', 'rv')))}) AS a FROM s) {_rows('a', 'x')}")
def scalar_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, z = fx.features(spark, sf_dir), [F.col(c) for c in ("rt", "ra", "rv")]
    scores = G.reliability_scores(z, [F.col(c) for c in ("lt", "la", "lv")], weights(scalar=True))
    named = f.select(*KEYS, "rt", "ra", "rv", *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    return _by_entry(named.withColumn("x", G.scalar_reliability([F.col(f"s{i}") for i in range(3)], z)), "x")


_HALVES = f"""{F_SQL}, v0 AS (SELECT *, rv[1:8] AS app, rv[9:14] AS geo FROM f), v1 AS (SELECT *, {_dense("app", 13, 8, False)} AS l0, {_normed("geo", True)} AS g0 FROM v0),
v2 AS (SELECT *, {_dense("g0", 7, 8)} AS g1 FROM v1), v3 AS (SELECT *, {_GELU.format(x="g1")} AS g2 FROM v2), v4 AS (SELECT *, {_dense("g2", 8, 8)} AS g3 FROM v3), v5 AS (SELECT *, {_normed("l0")} AS look, {_normed("g3")} AS shape FROM v4)"""


@query(
    f"""WITH {_HALVES}, v6 AS (SELECT *, list_concat(look, shape) AS b0 FROM v5), v7 AS (SELECT *, {_dense("b0", 9, 5)} AS b1 FROM v6), v8 AS (SELECT *, {_relu("b1")} AS b2 FROM v7), v9 AS (SELECT *, {_dense("b2", 10, 2)} AS b3 FROM v8),
x AS (SELECT dialogue_id, utterance_id, list_transform(range(1, 17), lambda c: CASE WHEN c <= 8 THEN 0.5 * look[c] + 0.5 * shape[c] ELSE (exp(b3[1]) * look[c - 8] + exp(b3[2]) * shape[c - 8]) / (exp(b3[1]) + exp(b3[2])) END) AS a FROM v9) {_rows("a", "x")}"""
)
def visual_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearance and geometry joined half and half (entries 0 to 7) and by a gate (8 to 15)."""
    w = weights()
    look, shape = G.visual_halves(F.slice("rv", 1, 8), F.slice("rv", 9, 6), w)
    f = fx.features(spark, sf_dir).select(*KEYS, look.alias("look"), shape.alias("shape"))
    both = F.concat(G.visual_gate(F.col("look"), F.col("shape")), G.visual_gate(F.col("look"), F.col("shape"), w))
    return _by_entry(f.withColumn("x", both), "x")


@query(
    f"""WITH {F_SQL}, p1 AS (SELECT *, {_normed("rv", True)} AS p FROM f), p2 AS (SELECT dialogue_id, utterance_id, {_dense("p", 11, 8)} AS q FROM p1), p3 AS (SELECT *, {_GELU.format(x="q")} AS r FROM p2), p4 AS (SELECT *, {_normed("r", True)} AS s FROM p3),
p5 AS (SELECT *, {_dense("s", 12, 8)} AS t FROM p4), x AS (SELECT *, {_GELU.format(x="t")} AS a FROM p5) {_rows("a", "x")}"""
)
def landmark_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_entry(fx.features(spark, sf_dir).withColumn("x", G.landmark_projection(F.col("rv"), weights())), "x")


@query(
    f"""WITH {F_SQL}, d1 AS (SELECT dialogue_id, utterance_id, {_dense("rt", 14, 7, False)} AS sh, {_dense("rt", 15, 7, False)} AS sp FROM f), d2 AS (SELECT *, {_dense("sh", 16, 14, False)} AS ex, pow(list_sum(list_transform(range(1, 8), lambda c: sh[c] * sp[c])), 2) AS o FROM d1),
x AS (SELECT dialogue_id, utterance_id, list_concat(sh, list_concat(sp, list_concat(ex, [o]))) AS a FROM d2) {_rows("a", "x")}"""
)
def disentangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared (entries 0 to 6), specific (7 to 13) and expanded parts (14 to 27), and the loss between the first two (28)."""
    f = fx.features(spark, sf_dir).withColumn("d", G.disentangled(F.col("rt"), weights(), "t"))
    return _by_entry(f.withColumn("x", F.concat("d.shared", "d.specific", "d.expanded", F.array("d.orthogonality"))), "x")
