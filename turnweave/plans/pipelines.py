"""Feature extraction and evaluation end to end, as configurations and the plans they stand for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import geometry as G
from turnweave.functions import pixels as I
from turnweave.functions import signal as S
from turnweave.functions import text as T
from turnweave.functions.arrays import argmax
from turnweave.operators import dialogue as D
from turnweave.operators import fusion as X
from turnweave.operators import metrics as M
from turnweave.operators import model as N
from turnweave.operators import pooling as P
from turnweave.operators import tracking as K
from turnweave.operators.encoders import Encoder, encoded
from turnweave.sources import transcripts as R


@dataclass(frozen=True)
class TextConfig:
    context_window: int = 2
    context_sep: str = " [SEP] "
    include_speaker: bool = True
    sentiment_col: str | None = "Sentiment"
    task_prefix: str = ""
    limit: int = 0
    negative: float = 2.0
    positive: float = 3.0


@dataclass(frozen=True)
class AudioConfig:
    target_sr: int = 16_000
    max_seconds: float | None = 10.0
    missing_policy: str = "zeros"
    degradation: str = ""  # "", "noise" or "packet_loss"
    snr_db: float = 10.0
    rate: float = 0.3
    packet_ms: float = 20.0


@dataclass(frozen=True)
class VisualConfig:
    frames: int = 16
    scene_cut_threshold: float | None = 0.3  # None: cuts are not looked for
    iou_floor: float | None = None
    full_frame: bool = True  # frames without a face count whole, and the last face is then forgotten
    parts: tuple[str, ...] = ("mean",)
    shard: int = 0
    n_shards: int = 1


@dataclass(frozen=True)
class OcclusionConfig:
    """How an extractor looks at faces whose lower part is hidden; OCCLUSION has that of each extractor."""

    share: float = 0.3
    frames: int = 16
    face_margin: float = 0.2
    iou_floor: float = 0.3
    scene_cuts: bool = False
    scene_cut_threshold: float = 0.3
    full_frame: bool = True  # frames without a face count whole
    full_frame_if_empty: bool = False  # so do those of which the face's box is empty
    parts: tuple[str, ...] = ("mean",)


OCCLUSION = {
    "images": OcclusionConfig(full_frame_if_empty=True),
    "landmarks": OcclusionConfig(parts=("mean", "std", "delta")),
    "action_units": OcclusionConfig(scene_cuts=True, parts=("mean", "std", "delta")),
}


def split_frames(spark: SparkSession, train: str, dev: str | None, test: str) -> dict[str, DataFrame]:
    """Each split's utterances; a missing dev split has no rows and the columns of the training split."""
    first = R.read_utterances(spark, train, "train")
    return {"train": first, "dev": R.read_utterances(spark, dev, "dev") if dev else first.limit(0).withColumn("split", F.lit("dev")), "test": R.read_utterances(spark, test, "test")}


def split_tables(spark: SparkSession, train: str, dev: str | None, test: str) -> DataFrame:
    """The splits' utterances in one table."""
    a, b, c = split_frames(spark, train, dev, test).values()
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def degraded_test(utterances: DataFrame, folder: str, extension: str, column: str = "Audio_Path", identity: bool = False) -> DataFrame:
    """The test rows of (split, Dialogue_ID, Utterance_ID, ...) with media paths, times in seconds and new_id.

    new_id continues after the other splits' ids, so that features of degraded media line up with those of clean ones; with
    identity it is the row's own id.
    """
    test = utterances.where(F.col("split") == "test")
    own = F.col(column) if column in utterances.columns else None
    test = R.with_times(test.withColumn(column, T.media_path(folder, F.col("Dialogue_ID"), F.col("Utterance_ID"), extension, own)))
    if identity:
        return test.withColumn("new_id", F.col("Dialogue_ID").cast("long"))
    ids = D.remapped_ids(utterances.select("split", "Dialogue_ID"), "split", "Dialogue_ID").where(F.col("split") == "test")
    return D.with_new_ids(test, ids.drop("split"), ["Dialogue_ID"])


def text_features(utterances: DataFrame, make: Callable[[], Encoder], config: TextConfig = TextConfig()) -> DataFrame:
    """(split, dialogue_id, utterance_id, embedding) with remapped dialogue ids.

    Every row of every split is encoded. Ids of splits may overlap, so contexts are built within (split, dialogue).
    """
    df = D.require_columns(utterances, ["Dialogue_ID", "Utterance_ID", "Utterance", "split"])
    if config.limit:
        df = D.limited_per_split(df, config.limit, ["Dialogue_ID", "Utterance_ID"])
    df = df.withColumn("_d", F.concat_ws("|", "split", "Dialogue_ID"))
    speaker = config.include_speaker and "Speaker" in df.columns
    sentiment = config.sentiment_col if config.sentiment_col in df.columns else None
    df = D.context_text(df, "_d", "Utterance_ID", "Speaker", "Utterance", sentiment, config.context_window, config.context_sep, config.task_prefix, speaker)
    ids = D.remapped_ids(df, "split", "Dialogue_ID")
    named = D.with_new_ids(df, ids, ["split", "Dialogue_ID"]).select("split", F.col("new_id").alias("dialogue_id"), F.col("Utterance_ID").alias("utterance_id"), "context")
    return encoded(named, make, "context").drop("context")


def audio_features(clips: DataFrame, make: Callable[[], Encoder], config: AudioConfig = AudioConfig(), key: str = "path") -> DataFrame:
    """clips (key, rate, channels) with silent and embedding; clips that are missing, unreadable or silent get zeros.

    Waveforms are made mono, resampled, cut, padded and levelled; what is not silent then is degraded, and not levelled again.
    """
    if config.degradation not in ("", "noise", "packet_loss"):
        raise ValueError("degradation is noise or packet_loss")
    known = F.col("channels").isNotNull() & F.col("rate").isNotNull()
    waves = clips.withColumn("_wave", F.when(known, S.mono(F.col("channels")))).drop("channels")
    df = prepared_waves(S.resampled(waves, "_wave", "rate", config.target_sr), "_wave", key, config)
    return encoded(df, make, "_wave", skip=F.col("silent")).drop("_wave")


def prepared_waves(df: DataFrame, wave: str, key: str, config: AudioConfig) -> DataFrame:
    """df with silent, and the waveform at the target rate prepared and then, unless silent, degraded; missing ones are null and silent."""
    known = F.col(wave).isNotNull()
    missing = "struct<samples:array<double>,silent:boolean>"
    absent = F.raise_error(F.lit("a clip is missing")).cast(missing) if config.missing_policy == "error" else F.lit(None).cast(missing)
    p = df.withColumn("_p", F.when(known, S.prepared(F.col(wave), config.target_sr, config.max_seconds)).otherwise(absent))
    samples, name = F.col("_p.samples"), F.col(key).cast("string")
    if config.degradation == "noise":
        samples = S.noisy(samples, name, config.snr_db)
    elif config.degradation == "packet_loss":
        samples = S.lossy(samples, name, config.rate, int(config.target_sr * config.packet_ms / 1000))
    silent = F.coalesce(F.col("_p.silent"), F.lit(True))
    return p.withColumn("silent", silent).withColumn(wave, F.when(silent, F.col("_p.samples")).otherwise(samples)).drop("_p")


def visual_features(clips: DataFrame, detections: DataFrame, measured: DataFrame, width: int, config: VisualConfig = VisualConfig(), histograms: DataFrame | None = None, speakers: DataFrame | None = None) -> DataFrame:
    """(clip, embedding): pooled measurements of the sampled frames of clips(clip, first, end), zeros where there are none.

    measured(clip, frame, box_id, feat) has what an extractor gave for each box of a frame, and for the whole frame as box -1.
    speakers(clip, frame, box_id), where given, names the speaking face; else faces are chosen by overlap, with scene cuts from
    histograms(clip, frame, h) of the sampled frames. Frames without a face count whole, and the face chosen last is forgotten
    there; without full_frame they do not count, and it is not. A shard has every n_shards-th clip in order of their ids.
    """
    n = F.col("end") - F.col("first")
    at = F.transform(S.sampled_frames(n, config.frames), lambda i: F.col("first") + i)
    clips = D.sharded(clips, config.shard, config.n_shards, "clip") if config.n_shards > 1 else clips
    frames = clips.select("clip", F.explode(at).alias("frame"))
    if speakers is not None:
        chosen = frames.join(speakers, ["clip", "frame"], "left").select("clip", "frame", F.coalesce("box_id", F.lit(-1)).cast("long").alias("box_id"))
    else:
        seen = frames
        if histograms is not None and config.scene_cut_threshold is not None:
            seen = K.scene_cuts(frames.join(histograms, ["clip", "frame"]), config.scene_cut_threshold).select("clip", "frame", "cut")
        chosen = K.chosen_faces(detections, config.iou_floor, seen, config.full_frame, config.full_frame)
    used = chosen if config.full_frame else chosen.where("box_id >= 0")
    got = used.join(measured, ["clip", "frame", "box_id"])
    return P.pooled_or_zeros(clips, got, ["clip"], "feat", "frame", config.parts, width * len(config.parts)).withColumnRenamed("pooled", "embedding")


def occlusion_features(
    clips: DataFrame, frames: DataFrame, detections: DataFrame, measure: Callable[[Column, Column], Column], width: int, config: OcclusionConfig, histograms: DataFrame | None = None, speakers: DataFrame | None = None
) -> DataFrame:
    """(clip, embedding): pooled measurements of faces whose lower part is zeroed before they are cut out and measured.

    clips(clip, first, end) tells the frames, of which always config.frames are looked at, some more than once where there are
    fewer; frames(clip, frame, width, height, pixels) has them, and those that are not there are passed over. speakers(clip, frame,
    box), where given, has the speaking face's box or null. Else detections(clip, frame, box_id, box) are chosen from by overlap with
    the last choice, which a frame without boxes or with none that overlaps enough forgets, and so does a scene cut where
    config.scene_cuts says so, by histograms(clip, frame, h). measure(pixels, width) is an array, or null where nothing was found.
    """
    at = F.posexplode(S.occlusion_frames(F.col("first"), F.col("end"), config.frames)).alias("place", "frame")
    looks = clips.where(F.col("end") > F.col("first")).select("clip", at).join(frames, ["clip", "frame"])
    if speakers is not None:
        faces = looks.join(speakers.select("clip", "frame", "box"), ["clip", "frame"], "left")
    else:
        seen = looks.select("clip", F.col("place").cast("long").alias("frame"), F.col("frame").alias("_at"))
        placed = seen.join(detections.withColumnRenamed("frame", "_at"), ["clip", "_at"]).drop("_at")
        if config.scene_cuts and histograms is not None:
            seen = K.scene_cuts(seen.join(histograms.withColumnRenamed("frame", "_at"), ["clip", "_at"]), config.scene_cut_threshold).select("clip", "frame", "cut")
        chosen = K.chosen_faces(placed, config.iou_floor, seen, True, True).where("box_id >= 0")
        boxes = chosen.join(placed, ["clip", "frame", "box_id"]).select("clip", F.col("frame").alias("place"), "box")
        faces = looks.join(boxes, ["clip", "place"], "left")
    grown = faces.withColumn("_b", G.with_margin_truncated(F.col("box"), config.face_margin, F.col("width"), F.col("height")))
    has, b = F.col("box").isNotNull(), F.col("_b")
    empty = (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"])
    none = F.lit(None).cast("binary")
    whole = F.when(has & empty, F.col("pixels"))
    if_empty = I.occluded_pixels(whole, F.col("width"), b, config.share) if config.full_frame and (config.full_frame_if_empty or speakers is not None) else none
    part = I.hidden_pixels(F.when(has & ~empty, F.col("pixels")), F.col("width"), b, config.share)
    used = F.when(~has, F.col("pixels") if config.full_frame else none).when(empty, if_empty).otherwise(part)
    wide = F.when(has & ~empty, (b["x2"] - b["x1"]).cast("int")).otherwise(F.col("width"))
    measured = grown.select("clip", "place", used.alias("_u"), wide.alias("_w")).select("clip", "place", measure(F.col("_u"), F.col("_w")).alias("feat")).where("feat IS NOT NULL")
    return P.pooled_or_zeros(clips, measured, ["clip"], "feat", "place", config.parts, width * len(config.parts)).withColumnRenamed("pooled", "embedding")


def combo_sweep(features: DataFrame, weights: N.Weights, config: N.ModelConfig, text: str, audio: str, visual: str, va: dict[int, tuple[float, float]] | None = None, alpha: float = 0.0, tau: float = 0.5) -> DataFrame:
    """(combo, n, accuracy, weighted_f1) of the model over the seven modality subsets."""
    dropped = {combo: [m for m in "TAV" if m not in active] for combo, active in X.COMBOS.items()}
    got = N.forward(features, weights, config, text, audio, visual, combos=dropped)
    if alpha > 0 and va:
        got = got.withColumn("_run", F.concat_ws("|", "combo", F.col("dialogue_id").cast("string")))
        got = X.circumplex_prior(got, "logits", va, alpha, tau, "_run").drop("logits", "_run").withColumnRenamed("corrected", "logits")
    own = got.join(features.select("dialogue_id", "utterance_id", "label"), ["dialogue_id", "utterance_id"]).select("combo", "label", argmax(F.col("logits")).alias("pred"))
    return M.summary(M.cells(own, ["combo"]), ["combo"])


def corpus_text(spark: SparkSession, transcripts: str | list[str], evaluations: str | list[str], config: TextConfig = TextConfig()) -> DataFrame:
    """A transcript corpus as a table for text_features, with sentiment from valence."""
    u = R.corpus_utterances(R.read_transcripts(spark, transcripts), R.read_evaluations(spark, evaluations))
    return u.select("split", F.col("dialogue_id").alias("Dialogue_ID"), F.col("utterance_id").alias("Utterance_ID"), F.col("utterance").alias("Utterance"), F.col("speaker").alias("Speaker"), T.sentiment_bucket(F.col("valence"), config.negative, config.positive).alias("Sentiment"), "utt_str_id", "emotion", "valence")
