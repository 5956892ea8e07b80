"""Readers of transcripts, emotion evaluations, utterance tables, annotations and media, with explicit schemas.

Line numbers come from splitting whole files, since a line source has none; files of this kind are a dialogue each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import text as T
from turnweave.operators.dialogue import numbered_dialogues, ranked_utterances, require_columns

# The line formats; (?s) as a NEL inside a line is a character to be repaired.
TRANSCRIPT_LINE = r"(?s)^(\S+)\s+\[\d+\.\d+-\d+\.\d+\]:\s*(.*)"
EVALUATION_LINE = r"^\[(\d+\.\d+)\s*-\s*(\d+\.\d+)\]\s+(\S+)\s+(\w+)\s+\[\s*([\d.]+)\s*,\s*([\d.]+)\s*,\s*([\d.]+)\s*\]"
TIMING_LINE = r"^\[(\d+\.\d+)\s*-\s*(\d+\.\d+)\]\s+(\S+)\s+(\w+)"
# Codings of a WAVE file's samples; an extensible one names its own further on.
WHOLE, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
UTTERANCE_SCHEMA = "Dialogue_ID int, Utterance_ID int, Utterance string, Speaker string, Sentiment string, StartTime string, EndTime string"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, blanks at both ends cut; hidden resource files (`._*`) are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    whole = whole.where(~F.element_at(F.split("file", "/"), -1).startswith("._"))
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))


def read_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, utt_str_id, text) of lines `id [t0-t1]: text`; blank and // lines and all others are left out."""
    rows = lines(spark, path).where(~F.col("line").startswith("//") & F.col("line").rlike(TRANSCRIPT_LINE))
    part = lambda i: F.regexp_extract("line", TRANSCRIPT_LINE, i)
    return rows.select("file", "line_no", part(1).alias("utt_str_id"), T.repair_mojibake(part(2)).alias("text"))


def read_evaluations(spark: SparkSession, path: str | list[str], with_ratings: bool = True) -> DataFrame:
    """(utt_str_id, start, end, emotion, valence): the first line of each utterance; ratings may be left unread (and unneeded)."""
    pattern = EVALUATION_LINE if with_ratings else TIMING_LINE
    rows = lines(spark, path).where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    valence = part(5).try_cast("double") if with_ratings else F.lit(None).cast("double")
    got = rows.select("file", "line_no", part(3).alias("utt_str_id"), F.struct(part(1).cast("double").alias("start"), part(2).cast("double").alias("end"), part(4).alias("emotion"), valence.alias("valence")).alias("v"))
    return got.groupBy("utt_str_id").agg(F.min_by("v", F.struct("file", "line_no")).alias("v")).select("utt_str_id", "v.*")


def corpus_utterances(transcripts: DataFrame, evaluations: DataFrame, train_sessions: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(split, dialogue_id, utterance_id, utterance, speaker, utt_str_id, dialogue, start, end, valence, emotion).

    Dialogues are numbered over (split group, session, file name); utterances by start, missing ones last in file order. An
    utterance without an evaluation has start and end 0, a null valence and an empty emotion.
    """
    name = F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1)
    t = transcripts.withColumn("dialogue", F.when(name == "", F.element_at(F.split("file", "/"), -1)).otherwise(name))
    t = t.withColumn("split", F.when(T.in_training_sessions(F.col("utt_str_id"), train_sessions), "train").otherwise("test"))
    t = t.withColumn("_group", F.when(F.col("split") == "train", 0).otherwise(1)).join(evaluations, "utt_str_id", "left")
    t = ranked_utterances(numbered_dialogues(t, ["_group", "dialogue"]), ["dialogue_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return t.select("split", "dialogue_id", "utterance_id", F.col("text").alias("utterance"), T.speaker_from_id(F.col("utt_str_id")).alias("speaker"), "utt_str_id", "dialogue", zero("start"), zero("end"), "valence", F.coalesce("emotion", F.lit("")).alias("emotion"))


def with_media(df: DataFrame, root: str, kind: str, column: str = "media_path") -> DataFrame:
    """Where a corpus keeps an utterance's sound (a file each) or picture (a file a dialogue)."""
    session = F.concat(F.lit("Session"), F.substring("utt_str_id", 5, 1))
    if kind == "audio":
        path = F.concat_ws("/", F.lit(root), session, F.lit("sentences/wav"), T.dialogue_name(F.col("utt_str_id")), F.concat("utt_str_id", F.lit(".wav")))
    else:
        path = F.concat_ws("/", F.lit(root), session, F.lit("dialog/avi/DivX"), F.concat("dialogue", F.lit(".avi")))
    return df.withColumn(column, path)


def read_utterances(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A CSV of utterances with repaired text; ids are integers and a missing required column is an error."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, ["Dialogue_ID", "Utterance_ID", "Utterance"])
    kinds = dict(x.split() for x in UTTERANCE_SCHEMA.split(", "))
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cast = lambda c: F.col(c).cast("int") if kinds.get(c) == "int" else T.repair_mojibake(F.col(c))
    df = raw.select(*[cast(c).alias(c) for c in raw.columns])
    return df if split is None else df.withColumn("split", F.lit(split))


def with_times(df: DataFrame) -> DataFrame:
    """Start_Time and End_Time in seconds from StartTime and EndTime, unless they are there."""
    for source, name in (("StartTime", "Start_Time"), ("EndTime", "End_Time")):
        if source in df.columns and name not in df.columns:
            df = df.withColumn(name, T.to_seconds(F.col(source)))
    return df


def read_va(spark: SparkSession, path: str) -> DataFrame:
    """(utt_str_id, va) of a JSON object {id: [valence, arousal]}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("utt_str_id", "va"))


def read_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length, modificationTime) of files, for decoders in mapInPandas."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def decoded_waves(media: DataFrame) -> DataFrame:
    """(path, rate, channels) of RIFF WAVE files with 8-, 16-, 24- or 32-bit whole numbers or 32- or 64-bit floats.

    channels are arrays of samples, whole numbers scaled to [-1, 1]; null where a file is cut short before its samples or is no such
    file. Chunks other than the format and the samples are passed over, and samples end at the last whole one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a file at a time: what is decoded is several times as large
                rate, samples = wave_samples(b.column(1)[i].as_buffer() if b.column(1)[i].is_valid else b"")
                channels = None if samples is None else list(samples.T)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([rate], pa.int32()), pa.array([channels], pa.list_(pa.list_(pa.float64())))], names=["path", "rate", "channels"])

    return media.select("path", "content").mapInArrow(run, "path string, rate int, channels array<array<double>>")


def wave_samples(data: bytes) -> tuple[int | None, np.ndarray | None]:
    """(rate, samples by row, a column a channel) of a file, or nulls."""
    raw, at, layout = memoryview(data), 12, None
    if bytes(raw[:4]) != b"RIFF" or bytes(raw[8:12]) != b"WAVE":
        return None, None
    while at + 8 <= len(raw):
        name, size = bytes(raw[at : at + 4]), int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = int.from_bytes(body[24:26], "little")
            layout = (kind, channels, rate, bits)
        elif name == b"data":
            if layout is None:
                return None, None
            kind, channels, rate, bits = layout
            x = _numbers(bytes(body), kind, bits)
            return (None, None) if x is None or not channels else (rate, x[: len(x) // channels * channels].reshape(-1, channels))
        at += 8 + size + size % 2
    return None, None


def _numbers(raw: bytes, kind: int, bits: int) -> np.ndarray | None:
    """Samples as doubles; null for a coding that is not known."""
    wide = bits // 8
    raw = raw[: len(raw) // max(wide, 1) * max(wide, 1)]
    if kind == FLOAT and bits in (32, 64):
        return np.frombuffer(raw, f"<f{wide}").astype(float)
    if kind != WHOLE or bits not in (8, 16, 24, 32):
        return None
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    four = np.zeros((len(raw) // wide, 4), np.uint8)  # the sample's bytes are the highest ones
    four[:, 4 - wide :] = np.frombuffer(raw, np.uint8).reshape(-1, wide)
    return four.view("<i4")[:, 0] / float(1 << 31)


def media_size_mb(media: DataFrame) -> DataFrame:
    return media.agg((F.sum("length") / F.lit(1024.0 * 1024.0)).alias("mb"))


def missing_counts(df: DataFrame, present: Column, silent: Column) -> DataFrame:
    """(rows, missing, silent)."""
    return df.agg(F.count("*").alias("rows"), F.count_if(~present).alias("missing"), F.count_if(silent).alias("silent"))
