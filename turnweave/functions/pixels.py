"""Pixels of grey frames, per-frame measurements, and the rules on missing measurements.

A frame is a binary of width * height bytes, row by row. What reads every pixel runs in NumPy on Arrow batches, a frame at a time;
geometry stays in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.arrays import dot, let, norm


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Weights at whole distances up to three sigma and half a step, at least one a side, adding up to one."""
    reach = max(1, int(round(sigma * 6 + 1)) // 2)
    t = np.arange(-reach, reach + 1)
    w = np.exp(-(t**2) / (2 * sigma * sigma))
    return w / w.sum()


def blurred(frame: np.ndarray, sigma: float) -> np.ndarray:
    """A frame (rows, columns, ...) blurred in both directions; beyond its edges it is mirrored without the edge itself."""
    w = gaussian_kernel(sigma)
    out = frame.astype(float)
    for axis in (0, 1):
        n, reach = out.shape[axis], len(w) // 2
        if n == 1:
            continue
        at = np.arange(-reach, n + reach) % (2 * n - 2)
        at = np.where(at < n, at, 2 * n - 2 - at)
        padded = np.take(out, at, axis)
        out = sum(x * np.take(padded, np.arange(i, i + n), axis) for i, x in enumerate(w))
    return np.clip(np.rint(out), 0, 255).astype(frame.dtype) if frame.dtype.kind in "ui" else out


def occluded(frame: np.ndarray, x1: int, y1: int, x2: int, y2: int, share: float) -> np.ndarray:
    """A copy with the lower share of a box, one row at least, set to zero."""
    out = frame.copy()
    out[y2 - max(1, int((y2 - y1) * share)) : y2, x1:x2] = 0
    return out


def resized(frame: np.ndarray, size: int) -> np.ndarray:
    """A frame as (size, size), each pixel mixed of the four around its centre's place; edges go on beyond themselves."""
    parts = []
    for n in frame.shape:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
        parts.append((low, np.minimum(low + 1, n - 1), at - low))
    (y, y_next, fy), (x, x_next, fx) = parts
    rows = lambda r: frame[r][:, x] * (1 - fx) + frame[r][:, x_next] * fx
    return np.rint(rows(y) * (1 - fy)[:, None] + rows(y_next) * fy[:, None]).astype(np.uint8)


def _by_frame(run: Callable[..., bytes | None], kind: str, *columns: Column) -> Column:
    """run(frame as an array, rest) of each row's (pixels, width, rest); null where any is."""

    @F.pandas_udf(kind)
    def each(pixels: pd.Series, width: pd.Series, rest: pd.DataFrame) -> pd.Series:
        rows = zip(pixels, width, *(rest[c] for c in rest.columns), strict=True)
        return pd.Series([None if any(x is None or x != x for x in r if not isinstance(x, bytes)) else run(np.frombuffer(r[0], np.uint8).reshape(-1, int(r[1])), *r[2:]) for r in rows], dtype=object)

    pixels, width, *rest = columns
    return each(pixels, width, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("c")]))


def blurred_pixels(pixels: Column, width: Column, sigma: float) -> Column:
    """A whole frame blurred."""
    return _by_frame(lambda f, _: blurred(f, sigma).tobytes(), "binary", pixels, width)


def occluded_pixels(pixels: Column, width: Column, box: Column, share: float) -> Column:
    """A frame with the lower share of a box of whole pixels set to zero."""
    return _by_frame(lambda f, *b: occluded(f, *map(int, b), share).tobytes(), "binary", pixels, width, *[box[k] for k in ("x1", "y1", "x2", "y2")])


def cropped_pixels(pixels: Column, width: Column, box: Column) -> Column:
    """The part of a frame inside a box of whole pixels, (x2 - x1) wide; empty where the box is."""
    return _by_frame(lambda f, x1, y1, x2, y2: f[int(y1) : max(0, int(y2)), int(x1) : max(0, int(x2))].tobytes(), "binary", pixels, width, *[box[k] for k in ("x1", "y1", "x2", "y2")])


def hidden_pixels(pixels: Column, width: Column, box: Column, share: float) -> Column:
    """cropped_pixels() of occluded_pixels(), in one pass over the frame."""

    def run(f: np.ndarray, *b: float) -> bytes:
        x1, y1, x2, y2 = map(int, b)
        return occluded(f, x1, y1, x2, y2, share)[y1 : max(0, y2), x1 : max(0, x2)].tobytes()

    return _by_frame(run, "binary", pixels, width, *[box[k] for k in ("x1", "y1", "x2", "y2")])


def resized_pixels(pixels: Column, width: Column, size: int) -> Column:
    """A frame as size by size pixels; null if it has none."""
    has = F.when(F.length(pixels) > 0, pixels)
    return _by_frame(lambda f, _: resized(f, size).tobytes(), "binary", has, F.when(width > 0, width))


def face_pixels(pixels: Column, width: Column, box: Column, size: int = 112) -> Column:
    """What a track gives a scorer for a frame: the part inside a box, or the whole frame where that is empty, as size by size pixels."""
    empty = (box["x2"] <= box["x1"]) | (box["y2"] <= box["y1"])
    part = F.when(empty, pixels).otherwise(cropped_pixels(pixels, width, box))
    return resized_pixels(part, F.when(empty, width).otherwise((box["x2"] - box["x1"]).cast("int")), size)


# Parts of a face model's parameters, and the sine beyond which a rotation's yaw counts as a quarter turn.
CAMERA, EXPRESSION, POLE = (1, 12), (53, 10), 0.998


def pose_angles(camera: Column) -> Column:
    """[yaw, pitch, roll] in degrees of a camera matrix, an array of its 3 by 4 numbers by rows.

    The first three columns are a rotation times a scale. The first two rows without their lengths are the rotation's, and
    their cross product is the third, whose first number is the sine of the yaw. At a yaw of a quarter turn the roll is 0.
    """
    row = lambda i: F.slice(camera, 4 * i + 1, 3)
    unit = lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n))

    def angles(a: Column, b: Column) -> Column:
        third = F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        half = F.lit(math.pi / 2)

        def of(c: Column) -> Column:
            free = let(F.asin(c[0]), lambda yaw: let(F.cos(yaw), lambda s: F.array(yaw, F.atan2(c[1] / s, c[2] / s), F.atan2(b[0] / s, a[0] / s))))
            up, down = F.array(half, F.atan2(-a[1], -a[2]), F.lit(0.0)), F.array(-half, F.atan2(a[1], a[2]), F.lit(0.0))
            return F.transform(F.when(c[0] > POLE, up).when(c[0] < -POLE, down).otherwise(free), lambda x: F.degrees(x))

        return let(third, of)

    return let(unit(row(0)), lambda a: let(unit(row(1)), lambda b: angles(a, b)))


def expression_vector(parameters: Column) -> Column:
    """Thirteen values of a face model's 62 parameters: ten of expression, then the pose's angles; null without parameters."""
    return F.when(F.size(parameters) >= sum(EXPRESSION) - 1, F.concat(F.slice(parameters, *EXPRESSION), pose_angles(F.slice(parameters, *CAMERA))))


def total_brightness(pixels: Column, width: Column) -> Column:
    """[sum, sum of the lower half of rows] of a frame; null if it has no pixels."""
    return _by_frame(lambda f, _: [float(f.sum()), float(f[len(f) // 2 :].sum())], "array<double>", F.when(F.length(pixels) > 0, pixels), F.when(width > 0, width))


def first_usable(candidates: list[Column]) -> Column:
    """Of arrays of measurements, the first that is there and not all NaN, its NaN set to 0; null where none is."""
    usable = [F.when(F.exists(c, lambda x: ~F.isnan(x)), c) for c in candidates]
    return F.transform(F.coalesce(*usable), lambda x: F.nanvl(x, F.lit(0.0)))
