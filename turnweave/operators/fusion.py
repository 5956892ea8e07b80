"""Fusion of modalities, modality dropping, and the valence-arousal transition prior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.arrays import entropy, let, literal, log_softmax, mix, scaled, softmax, total
from turnweave.functions.signal import uniform

# Valence and arousal by class.
SIX_CLASS_VA = {0: (0.80, 0.60), 1: (0.20, 0.30), 2: (0.50, 0.50), 3: (0.20, 0.80), 4: (0.75, 0.80), 5: (0.25, 0.55)}
SEVEN_CLASS_VA = {0: (0.00, 0.00), 1: (0.40, 0.67), 2: (-0.64, 0.60), 3: (-0.63, -0.27), 4: (0.76, 0.48), 5: (-0.60, 0.35), 6: (-0.43, 0.67)}
# The modality subsets that are evaluated.
COMBOS = {"T": "T", "A": "A", "V": "V", "T+A": "TA", "T+V": "TV", "A+V": "AV", "T+A+V": "TAV"}


def class_table(spark, va: dict[int, tuple[float, float]] = SEVEN_CLASS_VA) -> DataFrame:
    """(label, va): a row a class."""
    return spark.createDataFrame([(k, list(v)) for k, v in va.items()], "label int, va array<double>")


def combo_table(spark) -> DataFrame:
    """(combo, active, dropped): seven rows."""
    rows = spark.createDataFrame([(k, list(v)) for k, v in COMBOS.items()], "combo string, active array<string>")
    return rows.withColumn("dropped", F.array_except(F.array(*[F.lit(m) for m in "TAV"]), "active"))


def entropy_weights(logits: Sequence[Column]) -> Column:
    """Softmax over modalities of minus their entropies."""
    return softmax(F.array(*[-entropy(softmax(x)) for x in logits]))


def entropy_fusion(logits: Sequence[Column], values: Sequence[Column] | None = None) -> Column:
    """values (default: the logits) weighted by how certain each modality is."""
    return let(entropy_weights(logits), lambda w: mix(values or logits, w))


def gated_by_dimension(values: Sequence[Column], scores: Sequence[Column]) -> Column:
    """Per dimension, a softmax over modalities of scores weighs values; scores are values under a shared linear map."""

    n = len(values)

    def one(v: Column) -> Column:
        weights = softmax(F.array(*[v[f"s{i}"] for i in range(n)]))
        return total(F.zip_with(weights, F.array(*[v[f"v{i}"] for i in range(n)]), lambda a, b: a * b))

    return F.transform(F.arrays_zip(*[s.alias(f"s{i}") for i, s in enumerate(scores)], *[v.alias(f"v{i}") for i, v in enumerate(values)]), one)


def class_weighted(logits: Sequence[Column], reliability: Sequence[Column]) -> Column:
    """Per class, a softmax over modalities of reliabilities weighs logits."""
    return gated_by_dimension(logits, reliability)


def self_gated(values: Column) -> Column:
    """sigmoid(x) * x, the gate with an identity map."""
    return F.transform(values, lambda x: x / (1 + F.exp(-x)))


def kept_or_zero(value: Column, active: Column, modality: str) -> Column:
    """The array, or as many zeros where the modality is not active."""
    return F.when(F.array_contains(active, modality), value).otherwise(F.transform(value, lambda x: F.lit(0.0)))


def dropped_modalities(key: Column, rate: float, modalities: Sequence[str] = ("T", "A", "V")) -> Column:
    """Modalities dropped for a batch named by key: each by chance, one kept where all would go."""
    drop = F.array(*[F.when(uniform(F.concat_ws("|", key, F.lit(m))) < rate, F.lit(m)) for m in modalities])
    gone = F.filter(drop, lambda m: m.isNotNull())
    spared = F.get(F.array(*[F.lit(m) for m in modalities]), F.floor(uniform(F.concat(key, F.lit("|keep"))) * len(modalities)).cast("int"))
    return F.when(F.size(gone) == len(modalities), F.array_remove(gone, spared)).otherwise(gone)


def _expected(p: Column, axis: int, va: dict[int, tuple[float, float]]) -> Column:
    return total(F.zip_with(p, literal([va[c][axis] for c in sorted(va)]), lambda x, y: x * y))


def circumplex_prior(df: DataFrame, logits: str, va: dict[int, tuple[float, float]] = SEVEN_CLASS_VA, alpha: float = 0.5, tau: float = 0.5, dialogue: str = "dialogue_id", utterance: str = "utterance_id") -> DataFrame:
    """prior: a log prior for classes near where the dialogue just was, times how far it moved; corrected: logits + alpha * prior.

    The previous distribution is that of the uncorrected logits, so the rule is one lag over a dialogue's turns; before the
    first turn it is uniform.
    """
    n = len(va)
    order = Window.partitionBy(dialogue).orderBy(utterance)
    p = df.withColumn("_p", softmax(F.col(logits)))
    p = p.withColumn("_q", F.coalesce(F.lag("_p").over(order), literal([1.0 / n] * n)))
    here = F.array(*[_expected(F.col("_p"), k, va) for k in (0, 1)])
    there = F.array(*[_expected(F.col("_q"), k, va) for k in (0, 1)])

    def of(e: Column) -> Column:
        far = F.array(*[F.sqrt(F.pow(F.lit(va[c][0]) - e["there"][0], 2) + F.pow(F.lit(va[c][1]) - e["there"][1], 2)) / F.lit(-float(tau)) for c in sorted(va)])
        moved = F.sqrt(F.pow(e["here"][0] - e["there"][0], 2) + F.pow(e["here"][1] - e["there"][1], 2))
        return scaled(log_softmax(far), moved)

    out = p.withColumn("prior", let(F.struct(here.alias("here"), there.alias("there")), of))
    added = F.zip_with(F.col(logits), F.col("prior"), lambda x, y: x + F.lit(float(alpha)) * y) if alpha > 0 else F.col(logits)
    return out.withColumn("corrected", added).drop("_p", "_q")
