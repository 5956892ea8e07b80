"""Array expressions: softmax and its kin, norms, weighted mixes. All take and return Columns and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def scaled(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    """exp(x / T) over its sum, shifted by the maximum."""

    def of(v: Column) -> Column:
        return let(F.transform(v, lambda x: F.exp((x - F.array_max(v)) / F.lit(float(temperature)))), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(a, of)


def log_softmax(a: Column) -> Column:
    def of(v: Column) -> Column:
        return let(F.array_max(v) + F.log(total(F.transform(v, lambda x: F.exp(x - F.array_max(v))))), lambda z: F.transform(v, lambda x: x - z))

    return let(a, of)


def l2_normalised(a: Column, eps: float = 1e-12) -> Column:
    """a over its norm, which is eps at least."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n)))


def calibrated(logits: Column) -> Column:
    """Probabilities of L2-normalised logits."""
    return softmax(l2_normalised(logits))


def entropy(p: Column, floor: float = 1e-9) -> Column:
    """-sum p log max(p, floor)."""
    return -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(floor)))))


def argmax(a: Column) -> Column:
    """Position, from 0, of the largest value; the first on ties."""
    return let(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def mix(parts: Sequence[Column], weights: Column) -> Column:
    """Weighted sum of equally long arrays; weights is an array with one value a part."""
    out = scaled(parts[0], F.get(weights, F.lit(0)))
    for i, part in enumerate(parts[1:], 1):
        out = F.zip_with(out, scaled(part, F.get(weights, F.lit(i))), lambda x, y: x + y)
    return out


def rounded(a: Column, places: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, places))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
