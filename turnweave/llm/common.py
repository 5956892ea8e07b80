"""Helpers shared by the training-data operators: files, memory of Python workers, and document chunks."""

from __future__ import annotations

import ctypes
import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.storage import fresh_dir, local_path, materialize, quoted, shared_dir

__all__ = ["fresh_dir", "local_path", "materialize", "quoted", "shared_dir"]

def filesystem(path: str):
    """(pyarrow filesystem, path inside it) of a shared path, for files that Spark has no format for."""
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), local_path(path)
    return fs.FileSystem.from_uri(path)


def trim() -> None:
    """Give freed memory back to the machine: Python workers live on between tasks, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if release is not None:
        release(0)


def trimming(run: Callable) -> Callable:
    """A function over batches that trims when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trimmed(run: Callable) -> Callable:
    """A function of a group that trims when it ends."""

    def wrapped(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            trim()

    return wrapped


def trimmed_pair(run: Callable) -> Callable:
    """A function of two groups that trims when it ends."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            trim()

    return wrapped


def reducers(spark: SparkSession, total_bytes: int, per_task: int = 64 << 20) -> int:
    """Partitions for an exchange: what the session asks for, and more when a task would get over per_task bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // per_task), 1)


def text_size(docs: DataFrame, text_col: str) -> int:
    """Bytes of a column of texts, for the size of an exchange: twice the files' size, without a scan, where docs comes from files."""
    total = 0
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().split(" ")[0] not in ("LogicalRelation", "Relation"):
            return docs.agg(F.sum(F.octet_length(quoted(text_col).cast("string")))).first()[0] or 0
        total += int(str(leaf.stats().sizeInBytes()))
    return 2 * total


# Chunks: a few MB of whole documents in one compressed value, so that an exchange moves few rows and Python reads arrays.


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one zstd-compressed value."""
    import zstandard

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))) as z:
        return {k: z[k] for k in z.files}


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end and its n+1 offsets; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string()).fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of about `limit` bytes of `column`; a longer text is a slice of its own."""
    for b in batches:
        lengths = pc.binary_length(b.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < b.num_rows:
            yield b.slice(start)


def gathered(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Slices of consecutive batches joined to tables of about `limit` bytes of `column`."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in slices(batches, column, limit):
        n = int(pc.sum(pc.binary_length(b.column(column).cast(pa.large_binary()))).as_py() or 0)
        if held and total + n > limit:
            yield pa.Table.from_batches(held)
            held, total = [], 0
        held.append(b)
        total += n
    if held:
        yield pa.Table.from_batches(held)
