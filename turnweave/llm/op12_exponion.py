"""Vector code compression: codebooks for equal parts of whole-number vectors, entries found by exponion search.

A part starts from the entry that it had before, at squared distance u. An entry as near or nearer lies, by the triangle
inequality, within twice that distance of the starting one, so the part scans the entries of that list, sorted by their distance
from the starting entry, up to the last with a squared distance of at most 4 * u. All of this is in whole numbers, so no rounding
can lose an entry, and of equally near ones the lower index is taken. The first assignment starts at entry 0.

Vectors are written to the shared folder in blocks, together with their codes, once a round; the next round starts from
there. Sums and numbers of an entry's parts are added up in each task before they meet, one row an entry and component.
The codebooks are all that the driver holds.

Defined results: rows whose vector is null, has another number of components than dims or one that is null, not finite or
beyond 2 ** 27 when scaled (distances to it need not fit a long) are dropped; a null id comes after all others where codebooks
start, equal ids by their vectors; repeated rows are rows of their own; fewer vectors than entries give as many entries; equal
entries are told apart by their index; an empty table gives no rows; a sum of errors that no long holds is null. Extra input
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import materialize, pack, quoted, trimming, unpack
from turnweave.llm.vectors import blocks, matrix, narrow, squared, whole_vectors

BLOCK = 1 << 13
#: Labels up to which their sums are broadcast; beyond, both sides are exchanged by label.
FEW_LABELS = 10_000


def neighbours(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance from it, itself first, and those squared distances."""
    d = squared(entries, entries)
    np.fill_diagonal(d, -1)
    order = np.argsort(d, axis=1, kind="stable")
    np.fill_diagonal(d, 0)
    return order, np.take_along_axis(d, order, 1)


def search(parts: np.ndarray, start: np.ndarray, entries: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each part, scanning from its starting entry's list."""
    u = ((parts - entries[start]) ** 2).sum(1)
    reach = np.empty(len(parts), np.int64)  # entries of the list inside the radius
    for s in np.unique(start).tolist():
        own = start == s
        reach[own] = np.searchsorted(far[s], 4 * u[own], side="right")
    by = np.argsort(-reach, kind="stable")
    x, lists, wide = parts[by], order[start[by]], -reach[by]
    best, least = start[by].copy(), u[by].copy()
    for j in range(1, int(reach.max(initial=0))):
        n = int(np.searchsorted(wide, -j, side="left"))  # parts that scan further than j
        c = lists[:n, j]
        d = ((x[:n] - entries[c]) ** 2).sum(1)
        nearer = (d < least[:n]) | ((d == least[:n]) & (c < best[:n]))
        best[:n][nearer], least[:n][nearer] = c[nearer], d[nearer]
    out = np.empty_like(best), np.empty_like(least)
    out[0][by], out[1][by] = best, least
    return out


def _packed(vectors: DataFrame, dims: int, parts: int) -> DataFrame:
    """(block): vectors, ids and labels with starting codes 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, BLOCK):
            v, ids = matrix(t.column("v").combine_chunks(), dims), t.column("id").combine_chunks()
            own = {"v": narrow(v), "id": ids.fill_null(0).to_numpy(), "no_id": ids.is_null().to_numpy(zero_copy_only=False), "code": np.zeros((len(v), parts), np.uint8)}
            yield pa.RecordBatch.from_arrays([pa.array([pack(own)], pa.binary()), pa.array([t.column("label").combine_chunks().to_pylist()], pa.list_(pa.string()))], names=["block", "labels"])

    return vectors.mapInArrow(trimming(run), "block binary, labels array<string>")


def _coded(block: dict[str, np.ndarray], books: np.ndarray, lists: list) -> np.ndarray:
    """Sets the block's codes; returns each vector's error."""
    v = block["v"].astype(np.int64).reshape(len(block["v"]), len(books), -1)
    error = np.zeros(len(v), np.int64)
    for p, entries in enumerate(books):
        best, d = search(np.ascontiguousarray(v[:, p]), block["code"][:, p].astype(np.int64), entries, *lists[p])
        block["code"][:, p] = best
        error += d
    return error


def assign(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(block, labels) with new codes."""
    lists = [neighbours(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = unpack(b.column(0)[i].as_py())
                _coded(block, books, lists)
                yield pa.RecordBatch.from_arrays([pa.array([pack(block)], pa.binary()), b.column(1).slice(i, 1)], names=["block", "labels"])

    return coded.mapInArrow(trimming(run), "block binary, labels array<string>")


def _sums(coded: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(slot, total): sums of the parts of each entry by component, and their number; slot numbers (part, entry, place), the number at place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            for blob in b.column(0):
                block = unpack(blob.as_py())
                v = block["v"].astype(np.int64).reshape(-1, parts, width)
                for p in range(parts):
                    np.add.at(total[p], block["code"][:, p], np.concatenate([np.ones((len(v), 1), np.int64), v[:, p]], 1))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total.ravel()[slot])], names=["slot", "total"])

    return coded.select("block").mapInArrow(trimming(run), "slot int, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def updated(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each used entry as floor(sum / count) of its parts."""
    parts, entries, width = books.shape
    total = np.zeros((parts, entries, width + 1), object)
    for r in _sums(coded, parts, entries, width).collect():  # at most parts * entries * (width + 1) rows
        total.ravel()[r["slot"]] = int(r["total"])
    out = books.copy()
    for p, e in np.argwhere(total[..., 0] > 0):
        out[p, e] = [s // total[p, e, 0] for s in total[p, e, 1:]]
    return out


def _rows(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector under the last codebooks."""
    lists = [neighbours(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = unpack(b.column(0)[i].as_py())
                error = _coded(block, books, lists)
                text = block["code"].tobytes().hex()
                wide = 2 * len(books)
                yield pa.RecordBatch.from_arrays([pa.array(block["id"], pa.int64(), mask=block["no_id"]), b.column(1)[i].values, pa.array([text[at : at + wide] for at in range(0, len(text), wide)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return coded.mapInArrow(trimming(run), "id long, label string, code string, error long")


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dims: int = 64, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every kept vector; parts divides dims, and entries is at most 256.

    A part's codebook starts as that part of the vectors with the smallest ids. label_error sums the error over equal labels.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col, dims, scale, label=quoted(label_col).cast("string"))
    first = vectors.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1 if first else dims // parts).transpose(1, 0, 2).copy()
    coded = materialize(_packed(vectors, dims, parts), "parts")
    for _ in range(rounds if first else 0):
        coded = materialize(assign(coded, books), "coded")
        books = updated(coded, books)
    rows = materialize(_rows(coded, books), "codes")
    sums = materialize(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "labels")
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = rows.alias("r").join(sums.alias("s"), F.col("r.label").eqNullSafe(F.col("s.label")))
    return joined.select(F.col("r.id").alias(id_col), "r.code", "r.error", "s.label_error", F.lit(digest).alias("codebooks_sha256"))
