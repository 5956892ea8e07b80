"""Frames of uncompressed video files (YUV4MPEG2) as rows, of which only the asked ones are read from the file.

All frames of such a file have one size, so the place of each follows from the header. Large files are split by bytes, and small
ones are read many in a task; a task reads the header and then its own frames that a filter on `frame` (comparisons with a number, equality, IN) or the options
start_sec and max_seconds let through. Frames before and after them are neither read nor skipped over byte by byte.

    spark.dataSource.register(VideoFrames)
    spark.read.format("video_frames").load(folder).where("frame BETWEEN 100 AND 115")

Filters reach the source where spark.sql.python.filterPushdown.enabled is true, which read_frames() sees to.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from turnweave.storage import local_path

FRAMES = "path string, frame long, fps double, width int, height int, pixels binary"
INFO = "path string, fps double, width int, height int, frames long"
MAGIC, MARK = b"YUV4MPEG2 ", b"FRAME\n"
#: Bytes of a file for a task, of a batch of rows, and of the first read, which has the header.
SPLIT, BATCH, HEAD = 64 << 20, 4 << 20, 256
#: Bytes that opening a file counts for, so that a task takes many small files.
OPENING = 64 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), local_path(path)
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Layout:
    """What a header says, and where frames are."""

    width: int
    height: int
    fps: float
    head: int
    frame_bytes: int

    @classmethod
    def of(cls, head: bytes) -> Layout:
        line, end, _ = head.partition(b"\n")
        if not line.startswith(MAGIC) or not end:
            raise ValueError("no YUV4MPEG2 header")
        tags = {t[:1]: t[1:] for t in line[len(MAGIC) :].decode("ascii").split(" ") if t}
        width, height, (up, down) = int(tags["W"]), int(tags["H"]), (tags.get("F") or "25:1").split(":")
        chroma, half = tags.get("C", "420"), ((width + 1) // 2) * ((height + 1) // 2)
        extra = {"mono": 0, "444": 2 * width * height, "420": 2 * half, "420jpeg": 2 * half, "420paldv": 2 * half, "420mpeg2": 2 * half}.get(chroma)
        if extra is None:
            raise ValueError(f"a chroma of {chroma} is not read")
        rate = int(up) / int(down) if int(down) else 0.0
        return cls(width, height, rate if rate > 0 else 25.0, len(line) + 1, width * height + extra)

    @property
    def stride(self) -> int:
        return len(MARK) + self.frame_bytes

    def frames(self, size: int) -> int:
        """Whole frames of a file of so many bytes."""
        return max(0, (size - self.head) // self.stride)

    def at(self, frame: int) -> int:
        return self.head + frame * self.stride


def layout(read, size: int) -> Layout:
    """From read(offset, bytes)."""
    wide = HEAD
    while b"\n" not in (head := read(0, min(wide, size))) and wide < min(size, 1 << 16):
        wide *= 4
    return Layout.of(head)


@dataclass
class Part(InputPartition):
    """A part of a file, and those of other files that the task reads after it."""

    path: str
    size: int
    start: int
    end: int
    more: list[tuple[str, int, int, int]] = field(default_factory=list)

    def __iter__(self) -> Iterator[Part]:
        yield self
        yield from (Part(*x) for x in self.more)


class PlainReader(DataSourceReader):
    """Takes no filters, as one row a file needs none, so it works whatever the session says of them."""

    def __init__(self, options: dict[str, str]):
        self.path, self.info = options["path"], options.get("info", "false") == "true"
        self.split, self.start_sec = int(options.get("split_bytes", SPLIT)), float(options.get("start_sec", 0) or 0)
        self.max_seconds = float(options["max_seconds"]) if float(options.get("max_seconds") or 0) > 0 else None
        self.first, self.end = 0, None
        self.wanted: set[int] | None = None

    def partitions(self) -> list[Part]:
        where, path = opened(self.path)
        found = where.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(x.startswith((".", "_")) for x in posixpath.relpath(p, path).split("/") if x != ".")
        files = [f for f in files if f.type == fs.FileType.File and f.size and not hidden(f.path)]
        out: list[Part] = []
        total = 0
        for f in sorted(files, key=lambda f: f.path):
            step = f.size if self.info else self.split
            for at in range(0, f.size, step):
                own = (f.path, f.size, at, min(at + step, f.size))
                cost = OPENING + (0 if self.info else own[3] - at)
                if out and total + cost <= self.split:
                    out[-1].more.append(own)
                else:
                    out.append(Part(*own))
                    total = 0
                total += cost
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, _ = opened(self.path)
        held, total = [], 0
        for part in partition:
            with where.open_input_file(part.path) as file:
                for batch in self.rows(part, lambda offset, n, file=file: file.read_at(n, offset)):
                    held.append(batch)
                    total += batch.nbytes + OPENING // 64
                    if total > BATCH:
                        yield joined(held)
                        held, total = [], 0
        if held:
            yield joined(held)

    def rows(self, part: Part, read) -> Iterator[pa.RecordBatch]:
        """Batches of the part's frames, by read(offset, bytes)."""
        own = layout(read, part.size)
        if self.info:
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([own.fps]), pa.array([own.width], pa.int32()), pa.array([own.height], pa.int32()), pa.array([own.frames(part.size)])], names=["path", "fps", "width", "height", "frames"])
            return
        since = int(self.start_sec * own.fps)
        ends = [own.frames(part.size), -(-(part.end - own.head) // own.stride)]
        ends += [] if self.end is None else [int(self.end)]
        ends += [] if self.max_seconds is None else [since + int(self.max_seconds * own.fps)]
        first, end = max(0, since, self.first, -(-(part.start - own.head) // own.stride)), min(ends)
        frames = range(first, end) if self.wanted is None else sorted(f for f in self.wanted if first <= f < end)
        most = max(1, BATCH // own.stride)
        for at in range(0, len(frames), most):
            got = list(frames[at : at + most])
            runs = np.split(np.array(got), np.flatnonzero(np.diff(got) != 1) + 1)
            pixels = []
            for run in runs:  # neighbours in one read
                raw = read(own.at(int(run[0])), len(run) * own.stride)
                for i in range(len(run)):
                    frame = raw[i * own.stride : (i + 1) * own.stride]
                    if frame[: len(MARK)] != MARK or len(frame) < own.stride:
                        raise ValueError(f"frame {run[i]} of {part.path} does not begin or end where it should")
                    pixels.append(frame[len(MARK) : len(MARK) + own.width * own.height])
            n = len(got)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(got, pa.int64()), pa.array([own.fps] * n), pa.array([own.width] * n, pa.int32()), pa.array([own.height] * n, pa.int32()), pa.array(pixels, pa.binary())], names=["path", "frame", "fps", "width", "height", "pixels"])


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class FramesReader(PlainReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            number = getattr(f, "attribute", None) == ("frame",) and (isinstance(f, In) or isinstance(value, int))
            if number and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif number and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(value + isinstance(f, LessThanOrEqual), math.inf if self.end is None else self.end)
            elif number and isinstance(f, (EqualTo, In)):
                own = {x for x in (f.value if isinstance(f, In) else [value]) if x is not None}
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f


class VideoFrames(DataSource):
    """Rows (path, frame, fps, width, height, pixels), pixels being the rows of brightness; with info=true one row a file."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return INFO if self.options.get("info", "false") == "true" else FRAMES

    def reader(self, schema) -> PlainReader:
        return (PlainReader if self.options.get("info", "false") == "true" else FramesReader)(dict(self.options))


def read_frames(spark: SparkSession, path: str, start_sec: float = 0.0, max_seconds: float | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """Frames of a file or of all files below a folder (hidden ones not), from start_sec for max_seconds; null or 0: to the end."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoFrames)
    return spark.read.format("video_frames").options(start_sec=str(start_sec), max_seconds=str(max_seconds or 0), split_bytes=str(split_bytes)).load(path)


def read_video_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, fps, width, height, frames) of each file, from its header and length."""
    spark.dataSource.register(VideoFrames)
    return spark.read.format("video_frames").option("info", "true").load(path)


def write_frames(frames: DataFrame, folder: str, fps: int = 25) -> DataFrame:
    """Writes (clip, frame, width, height, pixels) as a file a clip, in order of frames, and returns (clip, path, frames).

    Files get an attempt's own name, which the result tells, so a task that runs again leaves the first attempt's files unread.
    """
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def told(done: list[tuple[int, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["clip", "path", "frames"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = opened(folder)
        where.create_dir(root, recursive=True)
        clip, out, path, count, attempt = None, None, "", 0, uuid.uuid4().hex
        done: list[tuple[int, str, int]] = []
        for b in batches:
            for c, w, h, pixels in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if out is None or c != clip:
                    if out is not None:
                        out.close()
                        done.append((clip, path, count))
                    clip, count, path = c, 0, f"{root}/{c}-{attempt}.y4m"
                    out = where.open_output_stream(path)
                    out.write(MAGIC + f"W{w} H{h} F{fps}:1 Ip A1:1 Cmono\n".encode())
                out.write(MARK + pixels)
                count += 1
            if done:
                yield told(done)
                done = []
        if out is not None:
            out.close()
            done.append((clip, path, count))
        yield told(done)

    own = frames.select(F.col("clip").cast("long"), "frame", "width", "height", "pixels")
    return own.repartition(n, "clip").sortWithinPartitions("clip", "frame").mapInArrow(run, "clip long, path string, frames long")
