"""Sequential work on detections of a clip: greedy box tracks and face choice, and the best track of a frame.

Tracks and choices depend on what was chosen before, so a clip is one group; a clip's detections are bounded by its length.
Detections are rows (clip, frame, box_id, box). Frames without boxes are simply not there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.geometry import chi_square
from turnweave.operators.groups import apply_to_groups


def ious(boxes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Intersection over union of each of boxes (n, 4) with one box."""
    wide = np.maximum(0.0, np.minimum(boxes[:, 2], other[2]) - np.maximum(boxes[:, 0], other[0]))
    high = np.maximum(0.0, np.minimum(boxes[:, 3], other[3]) - np.maximum(boxes[:, 1], other[1]))
    sides = lambda b: np.maximum(0.0, b[..., 2] - b[..., 0]) * np.maximum(0.0, b[..., 3] - b[..., 1])
    return wide * high / (sides(boxes) + sides(other) - wide * high + 1e-9)


def _frames(clip: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(frame, box ids, boxes) in order."""
    clip = clip.sort_values(["frame", "box_id"], kind="stable")
    boxes = clip[["x1", "y1", "x2", "y2"]].to_numpy(float)
    frame, ids = clip["frame"].to_numpy(), clip["box_id"].to_numpy()
    edges = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)) if len(frame) else []
    for a, b in zip(edges, [*edges[1:], len(frame)], strict=True):
        yield int(frame[a]), ids[a:b], boxes[a:b]


def track_clip(clip: pd.DataFrame, threshold: float, max_gap: int) -> pd.DataFrame:
    """(frame, box_id, track_id, track_order): tracks in order of creation each take their best free box of a frame.

    A track ends at a frame more than max_gap after its last one. track_order is the order in which tracks end, those still
    open at the end following in order of creation; the best track of a frame falls to it on ties.
    """
    rows: list[tuple[int, int, int]] = []
    live: list[tuple[int, int, np.ndarray]] = []  # (track, last frame, last box)
    ended: list[int] = []
    count, before = 0, None
    for frame, ids, boxes in _frames(clip):
        if before is not None and frame - before > 1:  # what frames without boxes would have closed, one after another
            ended += [t for _, t in sorted(((last, t) for t, last, _ in live if frame - 1 - last > max_gap), key=lambda x: x[0])]
            live = [x for x in live if frame - 1 - x[1] <= max_gap]
        free = np.ones(len(ids), bool)
        after = []
        for track, last, box in live:
            own = np.where(free, ious(boxes, box), -1.0)
            best = int(np.argmax(own)) if len(own) else -1
            if best >= 0 and own[best] > 0 and own[best] >= threshold:
                free[best] = False
                rows.append((frame, int(ids[best]), track))
                after.append((track, frame, boxes[best]))
            elif frame - last <= max_gap:
                after.append((track, last, box))
            else:
                ended.append(track)
        for i in np.flatnonzero(free).tolist():
            rows.append((frame, int(ids[i]), count))
            after.append((count, frame, boxes[i]))
            count += 1
        live, before = after, frame
    place = {t: i for i, t in enumerate(ended + [t for t, _, _ in live])}
    return pd.DataFrame([(f, b, t, place[t]) for f, b, t in rows], columns=["frame", "box_id", "track_id", "track_order"]).astype("int64")


def choose_clip(clip: pd.DataFrame, floor: float | None, forget_empty: bool = True, forget_rejected: bool = True) -> pd.DataFrame:
    """(frame, box_id): the largest box at first and after a cut, then the one that overlaps the last choice most.

    Below the floor nothing is chosen (-1); without a floor something always is. The first of equals wins. The last choice is
    forgotten at a cut, and, as the caller wants, at a frame without boxes (box_id null) or where nothing was chosen.
    """
    at, picks, last = [], [], None
    frames, ids = clip["frame"].to_numpy(), clip["box_id"].to_numpy()
    order = np.lexsort((ids, frames))  # NaN, a frame without boxes, is alone in its frame
    frames, ids, boxes = frames[order].tolist(), ids[order].tolist(), [clip[c].to_numpy(float)[order].tolist() for c in ("x1", "y1", "x2", "y2")]
    boxes = list(zip(*boxes, strict=True))
    cuts = set(clip["frame"].to_numpy()[clip["cut"].to_numpy().astype(bool)].tolist()) if "cut" in clip else set()
    begin = 0
    while begin < len(frames):
        frame, end = frames[begin], begin + 1
        while end < len(frames) and frames[end] == frame:
            end += 1
        if frame in cuts:
            last = None
        own, best = boxes[begin:end], -1
        if all(x != x for box in own for x in box):
            last = None if forget_empty else last
        else:
            if last is None:
                best = _first_largest([(x2 - x1) * (y2 - y1) for x1, y1, x2, y2 in own])
            else:
                over = [_iou(box, last) for box in own]
                best = _first_largest(over)
                if floor is not None and over[best] < floor:
                    best = -1
            if best >= 0:
                last = own[best]
            elif forget_rejected:
                last = None
        at.append(frame)
        picks.append(-1 if best < 0 else int(ids[begin + best]))
        begin = end
    return pd.DataFrame({"frame": np.array(at, np.int64), "box_id": np.array(picks, np.int64)})


def _iou(box: tuple[float, ...], other: tuple[float, ...]) -> float:
    """ious() of one box in plain floats, which for a few boxes are faster than arrays."""
    if any(x != x for x in (*box, *other)):
        return np.nan
    wide = max(0.0, min(box[2], other[2]) - max(box[0], other[0]))
    high = max(0.0, min(box[3], other[3]) - max(box[1], other[1]))
    sides = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    return wide * high / (sides(box) + sides(other) - wide * high + 1e-9)


def _first_largest(values: list[float]) -> int:
    """The place of the first largest value, or of the first that is no number, as np.argmax has it."""
    best = 0
    for i, x in enumerate(values):
        if x != x:
            return i
        if x > values[best]:
            best = i
    return best


def _flat(detections: DataFrame) -> DataFrame:
    return detections.select(F.col("clip").cast("long"), F.col("frame").cast("long"), F.col("box_id").cast("long"), "box.x1", "box.y1", "box.x2", "box.y2")


def face_tracks(detections: DataFrame, threshold: float = 0.5, max_gap: int = 1) -> DataFrame:
    """(clip, frame, box_id, track_id, track_order) of every detection."""

    return apply_to_groups(_flat(detections), "clip", lambda clip: track_clip(clip, threshold, max_gap), "clip long, frame long, box_id long, track_id long, track_order long")


def chosen_faces(detections: DataFrame, floor: float | None = None, frames: DataFrame | None = None, forget_empty: bool = True, forget_rejected: bool = True) -> DataFrame:
    """(clip, frame, box_id) with one row a frame; -1 where there is no box or none overlaps the last choice enough.

    frames(clip, frame[, cut]) are the frames that are looked at, in order of their numbers, those without boxes included, with
    scene cuts as a boolean; by default all frames that have boxes, without cuts.
    """
    own = _flat(detections)
    if frames is not None:
        cut = F.coalesce(F.col("cut"), F.lit(False)) if "cut" in frames.columns else F.lit(False)
        own = frames.select(F.col("clip").cast("long"), F.col("frame").cast("long"), cut.alias("cut")).join(own, ["clip", "frame"], "left")
    return apply_to_groups(own, "clip", lambda clip: choose_clip(clip, floor, forget_empty, forget_rejected), "clip long, frame long, box_id long")


def scene_cuts(histograms: DataFrame, threshold: float = 0.3) -> DataFrame:
    """histograms(clip, frame, h) with cut: whether the chi-square distance to the clip's frame before is over the threshold."""
    before = F.lag("h").over(Window.partitionBy("clip").orderBy("frame"))
    return histograms.withColumn("cut", F.coalesce(chi_square(F.col("h"), before) > threshold, F.lit(False)))


def track_scores(tracks: DataFrame, scores: DataFrame, keys: Sequence[str] = ("clip", "track_id"), shortest: int = 5) -> DataFrame:
    """(keys, score): mean of per-frame speaking probabilities; -1 for tracks under `shortest` frames, 0 without any."""
    length = tracks.groupBy(*keys).agg(F.count("*").alias("n"))
    mean = scores.groupBy(*keys).agg(F.avg("p").alias("p"))
    return length.join(mean, list(keys), "left").select(*keys, F.when(F.col("n") < shortest, -1.0).otherwise(F.coalesce("p", F.lit(0.0))).alias("score"))


def best_track(tracks: DataFrame, frame: Sequence[str], score: str, order: str, threshold: float) -> DataFrame:
    """The row of each frame with the best score from the threshold on; the first by order on ties."""
    w = Window.partitionBy(*frame).orderBy(F.col(score).desc(), order)
    return tracks.where(F.col(score) >= threshold).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def speaker_boxes(frames: DataFrame, detections: DataFrame, tracks: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """frames(clip, frame) with the box of the best-scored track that is there; null where none is."""
    t = tracks.join(scores, ["clip", "track_id"]).join(detections.select("clip", "frame", "box_id", "box"), ["clip", "frame", "box_id"])
    return frames.join(best_track(t, ["clip", "frame"], "score", "track_order", threshold).select("clip", "frame", "box"), ["clip", "frame"], "left")
