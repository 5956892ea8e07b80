"""Waveforms, frames and reproducible noise as expressions. A waveform is an array of doubles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.arrays import let, total

TARGET_DBFS = -20.0
SILENCE_RMS = 1e-4
#: Samples above which a waveform is resampled in blocks.
BLOCK = 1 << 20


def mono(channels: Column) -> Column:
    """Mean over an array of equally long channels."""
    return let(channels, lambda own: F.transform(F.sequence(F.lit(0), F.size(own[0]) - 1), lambda i: total(F.transform(own, lambda c: F.get(c, i))) / F.size(own)))


def low_pass(up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """Taps of the resampling filter: a sinc at the lower of both band limits under a Kaiser window, ten zeros a side, with gain `up`."""
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) * np.kaiser(2 * half + 1, beta)
    return h / h.sum() * up


def resampled_wave(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """x at the target rate by a polyphase filter: sample m is the sum of taps[half + m * down - k * up] * x[k]."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    if up == down or not len(x):
        return np.asarray(x, float)
    h = low_pass(up, down)
    half = len(h) // 2
    n = -(-len(x) * up // down)
    at = np.arange(n) * down
    reach = half // up + 1  # inputs on each side that a sample can depend on
    k = (at // up)[:, None] + np.arange(-reach, reach + 2)[None, :]
    tap = half + at[:, None] - k * up
    good = (k >= 0) & (k < len(x)) & (tap >= 0) & (tap < len(h))
    return (np.where(good, h[np.where(good, tap, 0)], 0) * np.asarray(x, float)[np.where(good, k, 0)]).sum(1)


def resampled(df: DataFrame, wave: str, rate: str, target: int) -> DataFrame:
    """df with waveforms at the target rate; those that have it, or none, pass unchanged. A frame and not a column, as what follows
    uses a waveform inside of lambdas, where Spark cannot call Python."""

    def one(x: object, r: object) -> object:
        if x is None or pd.isna(r) or int(r) == target:
            return x
        x = np.asarray(x, float)
        return _in_blocks(x, int(r), target) if len(x) > BLOCK else resampled_wave(x, int(r), target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{wave: [one(x, r) for x, r in zip(b[wave], b[rate], strict=True)]})

    return df.mapInPandas(run, df.schema)


def _in_blocks(x: np.ndarray, rate: int, target: int, block: int = 1 << 18) -> np.ndarray:
    """The same, of inputs some at a time, which overlap by the reach of the filter."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    margin = 10 * max(up, down) // up + 2
    step = block // down * down or down  # of inputs, so that each block begins on an output sample
    out = []
    for at in range(0, len(x), step):
        first = max(0, at - (-(-margin // down) * down))
        part = resampled_wave(x[first : at + step + margin], rate, target)
        begin = (at - first) // down * up
        want = -(-min(len(x) - at, step) * up // down) if at + step >= len(x) else step // down * up
        out.append(part[begin : begin + want])
    return np.concatenate(out)


def rms(wave: Column) -> Column:
    """Root mean square; 0 of an empty waveform."""
    return F.when(F.size(wave) > 0, F.sqrt(total(F.transform(wave, lambda x: x * x)) / F.size(wave))).otherwise(0.0)


def dbfs(r: Column) -> Column:
    return 20 * F.log10(F.greatest(r, F.lit(1e-12)))


def prepared(wave: Column, rate: int = 16_000, max_seconds: float | None = 10.0, pad_seconds: float = 0.05, normalise: bool = True) -> Column:
    """struct<samples, silent>: cut to max_seconds; an empty one is a silent zero; padded at both ends; level normalised.

    The level is that of the padded waveform; below SILENCE_RMS it is silent and stays as it is.
    """
    cut = wave if max_seconds is None else F.slice(wave, 1, int(rate * max_seconds))
    zeros = F.array_repeat(F.lit(0.0), int(pad_seconds * rate))

    def level(w: Column) -> Column:
        r = rms(w)
        gain = F.pow(F.lit(10.0), (F.lit(TARGET_DBFS) - 20 * F.log10(r + 1e-9)) / 20)
        loud = F.transform(w, lambda x: x * gain) if normalise else w
        return F.struct(F.when(r < SILENCE_RMS, w).otherwise(loud).alias("samples"), (r < SILENCE_RMS).alias("silent"))

    return F.when(F.size(cut) == 0, F.struct(F.array(F.lit(0.0)).alias("samples"), F.lit(True).alias("silent"))).otherwise(let(F.concat(zeros, cut, zeros), level))


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on nothing but a string: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gaussian(key: Column) -> Column:
    """A standard normal number from a string, by Box and Muller's transform of two uniforms."""
    a, b = uniform(F.concat(key, F.lit("|a"))), uniform(F.concat(key, F.lit("|b")))
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(F.lit(2 * math.pi) * b)


def noisy(wave: Column, key: Column, snr_db: float) -> Column:
    """White noise at a signal-to-noise ratio; key names the waveform."""
    sample = lambda x, i, n: x + n * gaussian(F.concat_ws("|", key, i.cast("string")))
    # let: what is used inside of a lambda is computed once a row, and not once a sample
    return let(wave, lambda w: let((rms(w) + 1e-9) / F.lit(10 ** (snr_db / 20)), lambda n: F.transform(w, lambda x, i: sample(x, i, n))))


def lossy(wave: Column, key: Column, rate: float, packet: int) -> Column:
    """Whole packets, of a sample at least, zeroed with a probability; the samples after the last whole packet stay."""
    packet = max(1, packet)
    gone = lambda i, whole: (i < whole) & (uniform(F.concat_ws("|", key, F.floor(i / packet).cast("string"))) < rate)
    return let(wave, lambda w: let(F.floor(F.size(w) / packet) * packet, lambda whole: F.transform(w, lambda x, i: F.when(gone(i, whole), F.lit(0.0)).otherwise(x))))


def sampled_frames(n: Column, k: int = 16) -> Column:
    """Uniform frame numbers: none of no frames, all of up to k, else k from first to last."""
    n = n.cast("long")
    few = F.sequence(F.lit(0).cast("long"), n - 1)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda i: F.floor(i * (n - 1) / F.lit(k - 1)).cast("long"))
    return F.when(n <= 0, F.array().cast("array<long>")).when(n <= k, few).otherwise(many)


def occlusion_frames(first: Column, end: Column, k: int = 16) -> Column:
    """Always k numbers of the half-open range, repeated where it is shorter."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (first + F.floor(i * (end - 1 - first) / F.lit(k - 1))).cast("long"))


def frame_range(start: Column, end: Column, fps: Column, frames: Column) -> Column:
    """struct<first, end>: the frames of a time window, one at least, inside the clip; a missing or zero end is the clip's."""
    rate = F.when(fps > 0, fps).otherwise(25.0)
    first = F.greatest(F.lit(0).cast("long"), F.least((F.coalesce(start, F.lit(0.0)) * rate).cast("long"), frames - 1))
    last = F.when(F.coalesce(end, F.lit(0.0)) == 0, frames / rate).otherwise(end)
    return let(first, lambda f: F.struct(f.alias("first"), F.greatest(f + 1, F.least((last * rate).cast("long"), frames)).alias("end")))
