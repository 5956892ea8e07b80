"""Boxes, landmarks and histograms as expressions. A box is a struct<x1, y1, x2, y2: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.arrays import let, total

EPS = 1e-9


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, with EPS under the line."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return wide * high / (area(a) + area(b) - wide * high + EPS)


def centre(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def with_margin(b: Column, margin: float, width: int | Column, height: int | Column) -> Column:
    """A box grown by a share of its sides (of one pixel at least), outwards to whole pixels, inside the frame."""
    mx, my = margin * F.greatest(F.lit(1.0), b["x2"] - b["x1"]), margin * F.greatest(F.lit(1.0), b["y2"] - b["y1"])
    return _pixels(F.greatest(F.lit(0), F.floor(b["x1"] - mx)), F.greatest(F.lit(0), F.floor(b["y1"] - my)), F.least(F.lit(width), F.ceil(b["x2"] + mx)), F.least(F.lit(height), F.ceil(b["y2"] + my)))


def with_margin_truncated(b: Column, margin: float, width: int | Column, height: int | Column) -> Column:
    """The variant of the action-unit and occlusion paths: no least side, truncation towards zero."""
    mx, my = margin * (b["x2"] - b["x1"]), margin * (b["y2"] - b["y1"])
    cut = lambda c: c.cast("long")
    return _pixels(F.greatest(F.lit(0), cut(b["x1"] - mx)), F.greatest(F.lit(0), cut(b["y1"] - my)), F.least(F.lit(width), cut(b["x2"] + mx)), F.least(F.lit(height), cut(b["y2"] + my)))


def _pixels(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("long").alias("x1"), y1.cast("long").alias("y1"), x2.cast("long").alias("x2"), y2.cast("long").alias("y2"))


def occluded_rows(b: Column, share: float) -> Column:
    """The half-open range of rows that a lower-face occlusion zeroes: one row at least."""
    n = F.greatest(F.lit(1), ((b["y2"] - b["y1"]) * share).cast("long"))
    return F.struct((b["y2"] - n).cast("long").alias("first"), b["y2"].cast("long").alias("end"))


def normalised_landmarks(points: Column, origin: int = 30, left: int = 36, right: int = 45, eps: float = 1e-6) -> Column:
    """Points (array of [x, y]) with the origin point at zero and the distance between two points as unit."""
    at = lambda i, k: F.element_at(F.element_at(points, i + 1), k + 1)
    unit = F.sqrt(F.pow(at(left, 0) - at(right, 0), 2) + F.pow(at(left, 1) - at(right, 1), 2)) + eps
    return let(F.struct(at(origin, 0).alias("x"), at(origin, 1).alias("y"), unit.alias("u")), lambda o: F.transform(points, lambda p: F.array((p[0] - o["x"]) / o["u"], (p[1] - o["y"]) / o["u"])))


def chi_square(a: Column, b: Column) -> Column:
    """Distance of two histograms."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + EPS)))
