"""Removal of repeated byte strings through a multi-document suffix order built column by column.

A byte is removed where a string of SPAN bytes that starts earlier (smaller id, or same document and earlier start) covers it.

Inserting one symbol of every whole document a round would take as many rounds as the longest document has bytes, so the
collection that is sorted holds short strings instead, and still every pair of equal SPAN-byte windows meets:

1. Each window of SPAN bytes picks the KGRAM-byte string in it with the least hash (its anchor). Equal windows pick equal
   anchors at equal offsets. The windows that pick one occurrence of an anchor are consecutive; the bytes they cover are its
   neighbourhood.
2. Anchors are exchanged as hashes. A neighbourhood equal to an earlier one is removed as a whole: by the polynomial hash of its
   anchor (48 bits) and a hash of another family of all its bytes (48 bits of BLAKE2b, whose key is drawn anew for every run, so
   that no text can be made to collide). Neighbourhoods that share an
   anchor but differ go on to step 3; an anchor with very many different neighbourhoods sends its windows one by one, dealt by
   their own content, so that no anchor fills a task; those that a chunk has twice are told by their bytes.
3. The neighbourhoods of a shard are the documents of a collection Burrows-Wheeler transform, built from their last symbols on:
   each round inserts one symbol per string, re-sorts the strings stably by it and updates the common prefixes of neighbours.
   Equal windows lie equally far from their anchors, so strings are aligned there and only the current column of the
   transform is kept (its positional form). The symbols are laid out column by column in a file, which is read in sequence (in
   memory where the shared folder has no plain files). Runs with a common prefix of SPAN or more are equal windows; all but the
   first of a run are removed.

Documents travel as chunks: a few MB of whole texts in one compressed value.

Defined results: a null text is empty; null ids are later than all others; rows that repeat an id are documents of their own,
ordered by their place in the input (ties of strings fall to the earlier one); an empty table gives no rows. A very long text
is a chunk of its own and is hashed piece by piece. suffix_texts keeps extra columns of any name, suffix_digest ignores them.
"""

from __future__ import annotations

import contextlib
import hashlib
import secrets
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnweave.llm.common import gathered, local_path, materialize, pack, quoted, reducers, shared_dir, text_bytes, trimmed, trimmed_pair, trimming, unpack

SPAN = 100
KGRAM = 32
CHUNK_BYTES = 8 << 20
#: Bytes that are hashed at once, and windows of a piece of a very long document: arrays of 64 bits a byte stay small.
BLOCK_BYTES = 1 << 18
PIECE_WINDOWS = 1 << 18
#: Low bits of a key that hold a place in a block; the same for every block, so that ties fall alike everywhere.
PLACE_BITS = 24
#: Different neighbourhoods of one anchor above which its windows are dealt one by one.
MANY_CONTEXTS = 2048
#: Strings that are sorted at once, and strings that are laid out in columns at once.
SHARD_STRINGS = 65_536
LAID_STRINGS = 2048
LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1


# Anchors


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers, modulo 2^64, n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(18, (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            have = 1
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(pow(b, have, 1 << 64))
                have *= 2
            _POWERS[name] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _symbols() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def anchors(raw: np.ndarray, offsets: np.ndarray, span: int = SPAN, kgram: int = KGRAM, secret: bytes = b"") -> dict[str, np.ndarray]:
    """Of documents end to end, one an anchor: doc, first and last window start, the anchor's distance from the first, two hashes."""
    # Pieces: documents of span bytes or more; a very long one is cut, with its windows all in one piece or the next.
    doc = np.flatnonzero(np.diff(offsets) >= span)
    windows = np.diff(offsets)[doc] - span + 1
    parts = -(-windows // PIECE_WINDOWS)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    doc = np.repeat(doc, parts)
    base = offsets[doc] + nth * PIECE_WINDOWS
    size = np.minimum(np.repeat(windows, parts) - nth * PIECE_WINDOWS, PIECE_WINDOWS) + span - 1
    block = np.cumsum(size) // BLOCK_BYTES
    found = []
    for i in np.flatnonzero(np.diff(block, prepend=-1)).tolist() if len(size) else []:
        own = slice(i, int(np.searchsorted(block, block[i], side="right")))
        at = np.concatenate([raw[a : a + n] for a, n in zip(base[own].tolist(), size[own].tolist(), strict=True)])
        found.append(_block(at, base[own], size[own], doc[own], span, kgram, secret))
    if not found:
        return {k: np.zeros(0, t) for k, t in (("doc", np.int64), ("first", np.int64), ("last", np.int64), ("mid", np.int64), ("anchor", np.uint64), ("area", np.uint64))}
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _block(own: np.ndarray, base: np.ndarray, size: np.ndarray, docs: np.ndarray, span: int, kgram: int, secret: bytes) -> dict[str, np.ndarray]:
    n, w = len(own), span - kgram + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_symbols()[own] * up[:n], out=sums[1:])
    key = _mix((sums[kgram:] - sums[:-kgram]) * down[: n - kgram + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
    width = 1
    while width * 2 <= w:  # least key of growing windows
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < w:
        key = np.minimum(key[: len(key) - (w - width)], key[w - width :])
    start = np.cumsum(size) - size
    # Windows that lie in one document, in order; the anchor of consecutive windows never moves back.
    count = size - span + 1
    window = np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)
    doc = np.repeat(np.arange(len(size)), count)
    pick = (key[window] & low).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])]))
    tail = np.concatenate([head[1:], [len(pick)]]) - 1
    a, s, e, d = pick[head], window[head], window[tail], doc[head]
    hashed = _mix((sums[a + kgram] - sums[a]) * down[a])
    data = own.tobytes()
    area = b"".join([hashlib.blake2b(data[i:j], digest_size=8, key=secret).digest() for i, j in zip(s.tolist(), (e + span).tolist(), strict=True)])
    area = np.frombuffer(area, np.uint64) + (a - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)  # an anchor's bytes may stand there twice
    shift = (base - start)[d]
    return {"doc": docs[d], "first": s + shift, "last": e + shift, "mid": a - s, "anchor": hashed, "area": area}


# Collection transform


def _column(n: int, kind: type, folder: str | None) -> np.ndarray:
    """A column of n values, in memory or in a file of its own that goes with its last reader."""
    if folder is None or n == 0:
        return np.empty(n, kind)
    with tempfile.NamedTemporaryFile(dir=folder) as f:
        return np.memmap(f.name, kind, "w+", shape=(n,))


def positional_order(raw: np.ndarray, start: np.ndarray, size: np.ndarray, mid: np.ndarray, folder: str | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds over strings raw[start : start + size] of under 256 bytes that are aligned at their byte mid.

    Each round goes one column to the left and inserts one symbol of every string that has it. It yields (column, order, lcp):
    the strings that reach the column in the order of what they hold from it on, and each one's common prefix with the one
    before. Column 0 is that of the string that reaches furthest left.
    """
    m = len(size)
    left = int(mid.max(initial=0)) - mid
    width = int((left + size).max(initial=0))
    columns = _column(width * m, np.uint8, folder).reshape(width, m)
    for at in range(0, m, LAID_STRINGS):
        n = size[at : at + LAID_STRINGS]
        string = np.repeat(np.arange(at, at + len(n)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        columns[left[string] + within, string] = raw[start[string] + within]
    by_end = np.argsort(left + size, kind="stable")
    ends = (left + size)[by_end]
    begins = np.unique(left)
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    for column in range(width - 1, -1, -1):
        if len(order) and (column + 1) in begins:  # some strings began to the right of here
            stay = np.flatnonzero(left[order] <= column)
            if len(stay):
                lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
            else:
                lcp = lcp[:0]
            order = order[stay]
        new = by_end[np.searchsorted(ends, column + 1) : np.searchsorted(ends, column + 1, side="right")]
        order, lcp = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.uint8), lcp])
        if not len(order):
            continue
        symbol = columns[column][order]
        by = np.argsort(symbol, kind="stable")
        # Neighbours with one symbol had the least common prefix of what lay between them, and now one more.
        between = np.minimum.reduceat(np.append(lcp, np.uint8(0)), by + 1)
        symbol, order = symbol[by], order[by]
        lcp = np.zeros(len(order), np.uint8)
        lcp[1:] = np.where(symbol[1:] == symbol[:-1], between[:-1] + np.uint8(1), np.uint8(0))
        yield column, order, lcp


def repeated_windows(raw: np.ndarray, start: np.ndarray, size: np.ndarray, mid: np.ndarray, span: int = SPAN, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window of span bytes that an earlier string has at the same distance from mid."""
    left = int(mid.max(initial=0)) - mid
    strings, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for column, order, lcp in positional_order(raw, start, size, mid, folder):
        head = np.flatnonzero(lcp < span)
        if len(head) < len(order):
            first = np.minimum.reduceat(order, head)
            repeats = order[order != np.repeat(first, np.diff(np.append(head, len(order))))]
            strings.append(repeats)
            offsets.append(column - left[repeats])
    return np.concatenate(strings), np.concatenate(offsets)


# Exchange


def _chunks(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """(chunk, n_docs, n_bytes, blob, rest), written: whole documents in ascending id order inside each, and their other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, t in enumerate(gathered(batches, "text", CHUNK_BYTES)):
            ids = t.column("id").combine_chunks()
            rank = ids.fill_null(LAST).to_numpy()
            by = np.argsort(rank, kind="stable")
            raw, offsets = text_bytes(t.column("text").combine_chunks().take(pa.array(by)))
            others = _stream(t.drop_columns(["text"]).take(pa.array(by)))
            blob = pack({"rank": rank[by], "null": ids.is_null().to_numpy(zero_copy_only=False)[by], "raw": raw, "offsets": offsets})
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([part << 32 | i]), "n_docs": pa.array([len(rank)]), "n_bytes": pa.array([len(raw)]), "blob": pa.array([blob], pa.binary()), "rest": pa.array([others], pa.binary())})

    own = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"), *[(F.lit(None).cast("string") if c == text_col else quoted(c)).alias(f"of_{i}") for i, c in enumerate(rest)], *[quoted(text_col).isNull().alias("absent")] * bool(rest))
    return materialize(own.mapInArrow(trimming(run), "chunk long, n_docs long, n_bytes long, blob binary, rest binary"), "chunks")


def _stream(t: pa.Table) -> bytes:
    """A table in Arrow's stream format, compressed."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _entries(z: dict[str, np.ndarray], span: int, kgram: int, buckets: int, secret: bytes) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(anchors, positions of those that go out: the first of equal neighbourhoods, ordered by bucket; positions of the rest)."""
    a = anchors(z["raw"], z["offsets"], span, kgram, secret)
    by = np.lexsort((np.arange(len(a["doc"])), a["area"], a["anchor"]))
    same = np.zeros(len(by), bool)
    same[1:] = (a["anchor"][by[1:]] == a["anchor"][by[:-1]]) & (a["area"][by[1:]] == a["area"][by[:-1]])
    out, rest = np.sort(by[~same]), np.sort(by[same])
    bucket = a["anchor"][out] % np.uint64(buckets)
    return a, out[np.argsort(bucket, kind="stable")], rest


def _cut(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """(key, slice) of the runs of sorted keys below n."""
    edges = np.searchsorted(keys.astype(np.int64), np.arange(n + 1))
    return [(i, slice(int(edges[i]), int(edges[i + 1]))) for i in range(n) if edges[i] < edges[i + 1]]


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"blob": pa.binary(), "kind": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})


def _spans(chunks: DataFrame, span: int, kgram: int, shared: int, shard_strings: int, many: int) -> DataFrame:
    """(chunk, blob): removed ranges of each chunk's bytes, in any number of rows a chunk; ranges may overlap."""
    spark = chunks.sparkSession
    secret = secrets.token_bytes(16)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                z = unpack(blob.as_py())
                a, out, _ = _entries(z, span, kgram, shared, secret)
                for bucket, own in _cut(a["anchor"][out] % np.uint64(shared), shared):
                    e = out[own]
                    doc, runs = np.unique(a["doc"][e], return_counts=True)
                    hashes = {"a4": (a["anchor"][e] >> np.uint64(32)).astype(np.uint32), "a2": (a["anchor"][e] >> np.uint64(16)).astype(np.uint16), "b4": (a["area"][e] >> np.uint64(32)).astype(np.uint32), "b2": (a["area"][e] >> np.uint64(16)).astype(np.uint16)}
                    yield _rows(bucket=[bucket], chunk=[chunk], blob=[pack(hashes | {"rank": z["rank"][doc], "runs": runs.astype(np.uint32)})])

    def judge(t: pa.Table) -> pa.Table:
        bucket, chunk = t.column("bucket")[0].as_py(), t.column("chunk").to_numpy()
        parts = [unpack(x.as_py()) for x in t.column("blob")]
        size = np.array([len(p["a4"]) for p in parts])
        join = lambda hi, lo: np.concatenate([p[hi].astype(np.uint64) << np.uint64(16) | p[lo] for p in parts])
        a = join("a4", "a2")
        by = np.argsort(a, kind="stable")
        twice = np.zeros(len(a), bool)
        twice[1:] = a[by[1:]] == a[by[:-1]]
        twice[:-1] |= twice[1:]
        by = by[twice]
        b = join("b4", "b2")
        rank = np.concatenate([np.repeat(p["rank"], p["runs"]) for p in parts])
        part = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        by = by[np.lexsort((place[by], chunk[part[by]], rank[by], b[by], a[by]))]
        fresh_a = np.ones(len(by), bool)
        fresh_a[1:] = a[by[1:]] != a[by[:-1]]
        fresh = fresh_a.copy()
        fresh[1:] |= b[by[1:]] != b[by[:-1]]
        contexts = np.add.reduceat(fresh, np.flatnonzero(fresh_a)) if len(by) else np.zeros(0, np.int64)
        contexts = contexts[np.cumsum(fresh_a) - 1] if len(by) else contexts
        # 1: equals an earlier neighbourhood; 2: to be compared; 3: to be compared window by window.
        verdict = np.where(~fresh, 1, np.where(contexts < 2, 0, np.where(contexts > many, 3, 2))).astype(np.uint8)
        by, verdict = by[verdict > 0], verdict[verdict > 0]
        back = np.lexsort((place[by], part[by]))
        by, verdict = by[back], verdict[back]
        out = [(int(chunk[i]), pack({"place": place[by[own]].astype(np.uint32), "verdict": verdict[own]})) for i, own in _cut(part[by], len(parts))]
        return pa.Table.from_batches([_rows(chunk=[c for c, _ in out], bucket=[bucket] * len(out), blob=[x for _, x in out])])

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_rows(kind=[], key=[], chunk=[], blob=[])])
        chunk = left.column("chunk")[0].as_py()
        z = unpack(left.column("blob")[0].as_py())
        a, out, rest = _entries(z, span, kgram, shared, secret)
        where = dict(_cut(a["anchor"][out] % np.uint64(shared), shared))
        verdict = np.zeros(len(a["doc"]), np.uint8)
        verdict[rest] = 1
        for bucket, blob in zip(right.column("bucket").to_pylist(), right.column("blob"), strict=True):
            r = unpack(blob.as_py())
            verdict[out[where[bucket]][r["place"]]] = r["verdict"]
        gone, whole, single = (np.flatnonzero(verdict == v) for v in (1, 2, 3))
        first_gone, end_gone = a["first"][gone], a["last"][gone] + span
        begin, end, key, mid = a["first"][whole], a["last"][whole] + span, a["anchor"][whole], a["mid"][whole]
        if len(single):
            count = a["last"][single] - a["first"][single] + 1
            s = np.sort(np.repeat(a["first"][single] - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
            data = [z["raw"][x : x + span].tobytes() for x in s.tolist()]
            own = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8, key=secret).digest(), "little") for x in data], np.uint64)
            seen: set[bytes] = set()
            again = np.array([x in seen or seen.add(x) is not None for x in data], bool)
            del data, seen
            first_gone, end_gone = np.concatenate([first_gone, s[again]]), np.concatenate([end_gone, s[again] + span])
            s, own = s[~again], own[~again]
            begin, end, key = np.concatenate([begin, s]), np.concatenate([end, s + span]), np.concatenate([key, own])
            mid = np.concatenate([mid, np.zeros(len(s), np.int64)])
        rows = {"kind": [0], "key": [0], "chunk": [chunk], "blob": [pack({"first": first_gone, "end": end_gone})]}
        shard = (key >> np.uint64(8)) % np.uint64(shared)
        by = np.lexsort((begin, shard))
        begin, end, key, mid = begin[by], end[by], key[by], mid[by]
        doc = np.searchsorted(z["offsets"], begin, side="right") - 1
        for k, own in _cut(shard[by], shared):
            s, size = begin[own], (end - begin)[own]
            raw = z["raw"][np.arange(int(size.sum())) + np.repeat(s - (np.cumsum(size) - size), size)]
            rows["kind"].append(1)
            rows["key"].append(k)
            rows["chunk"].append(chunk)
            rows["blob"].append(pack({"raw": raw, "size": size.astype(np.uint8), "mid": mid[own].astype(np.uint8), "start": s, "rank": z["rank"][doc[own]], "sub": (key[own] >> np.uint64(32)).astype(np.uint32)}))
        return pa.Table.from_batches([_rows(**rows)])

    def order(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk").to_numpy()
        parts = [unpack(x.as_py()) for x in t.column("blob")]
        part = np.repeat(np.arange(len(parts)), [len(p["size"]) for p in parts])
        size, mid, start, rank, sub = (np.concatenate([p[k] for p in parts]) for k in ("size", "mid", "start", "rank", "sub"))
        size, mid = size.astype(np.int64), mid.astype(np.int64)
        raw = np.concatenate([p["raw"] for p in parts])
        at = np.cumsum(size) - size
        groups = sub % np.uint32(-(-len(size) // shard_strings))
        found: list[np.ndarray] = []
        with tempfile.TemporaryDirectory(dir=scratch) if scratch else contextlib.nullcontext() as folder:
            for g in range(int(groups.max()) + 1):
                own = np.flatnonzero(groups == g)
                own = own[np.lexsort((start[own], chunk[part[own]], rank[own]))]
                string, offset = repeated_windows(raw, at[own], size[own], mid[own], span, folder)
                found.append(np.stack([part[own[string]], start[own[string]] + offset]))
        where = np.concatenate(found, axis=1)
        where = where[:, np.lexsort((where[1], where[0]))]
        out = [(int(chunk[i]), pack({"first": where[1, own], "end": where[1, own] + span})) for i, own in _cut(where[0], len(parts))]
        return pa.Table.from_batches([_rows(kind=[2] * len(out), key=[0] * len(out), chunk=[c for c, _ in out], blob=[x for _, x in out])])

    base = shared_dir(spark)
    scratch = local_path(base) if base.startswith(("file:", "/")) else None  # a store without plain files: columns stay in memory
    held = chunks.select("chunk", "blob")
    sent = held.mapInArrow(trimming(send), "bucket long, chunk long, blob binary")
    judged = sent.repartition(shared, "bucket").groupBy("bucket").applyInArrow(trimmed(judge), "chunk long, bucket long, blob binary")
    kind = "kind int, key long, chunk long, blob binary"
    told = materialize(held.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(trimmed_pair(strings), kind), "strings")
    sorted_ = told.where("kind = 1").repartition(shared, "key").groupBy("key").applyInArrow(trimmed(order), kind)
    return told.where("kind = 0").unionByName(sorted_).select("chunk", "blob")


def _merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as maximal runs, ascending."""
    by = np.argsort(first, kind="stable")
    first, reach = first[by], np.maximum.accumulate(end[by]) if len(end) else end
    head = np.ones(len(first), bool)
    head[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return first[at], reach[np.append(at[1:] - 1, len(first) - 1)] if len(at) else reach


def _apply(chunks: DataFrame, spans: DataFrame, schema: str, build, rest: bool = False) -> DataFrame:
    """build(z, other columns, doc spans) for every chunk: the rows of a chunk from its documents and their removed ranges, doc by doc."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        z = unpack(left.column("blob")[0].as_py())
        got = [unpack(x.as_py()) for x in right.column("blob")]
        first = np.concatenate([g["first"] for g in got]) if got else np.zeros(0, np.int64)
        end = np.concatenate([g["end"] for g in got]) if got else np.zeros(0, np.int64)
        off = z["offsets"]
        doc = np.searchsorted(off, first, side="right") - 1
        stretch = doc * 1  # a gap of one between documents keeps runs of neighbours apart
        first, end = _merged(first + stretch, end + stretch)
        doc = np.searchsorted(off + np.arange(len(off)), first, side="right") - 1
        edges = np.searchsorted(doc, np.arange(len(off)))
        others = pa.ipc.open_stream(left.column("rest")[0].as_py()).read_all() if rest else None
        return build(z, others, first - doc, end - doc, edges)

    return chunks.select("chunk", "blob", *["rest"] * rest).groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(trimmed_pair(run), schema)


def _kept(z: dict[str, np.ndarray], first: np.ndarray, end: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
    """What is left of each document."""
    raw, off = z["raw"], z["offsets"]
    for i in range(len(off) - 1):
        at, left = int(off[i]), []
        for j in range(edges[i], edges[i + 1]):
            left.append(raw[at : first[j]].tobytes())
            at = int(end[j])
        left.append(raw[at : off[i + 1]].tobytes())
        yield b"".join(left)


def _prepared(docs: DataFrame, id_col: str, text_col: str, span: int, kgram: int, shard_strings: int, many: int, rest: list[str]) -> tuple[DataFrame, DataFrame]:
    if not 1 < kgram <= span or 2 * span - kgram > 255:
        raise ValueError("kgram must be in 2..span and 2 * span - kgram under 256")
    chunks = _chunks(docs, id_col, text_col, rest)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return chunks, _spans(chunks, span, kgram, reducers(docs.sparkSession, total), shard_strings, many)


def suffix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, kgram: int = KGRAM, shard_strings: int = SHARD_STRINGS, many: int = MANY_CONTEXTS) -> DataFrame:
    """One row per document: (id_col, n_bytes, n_removed, n_spans, kept_sha256)."""
    chunks, spans = _prepared(docs, id_col, text_col, span, kgram, shard_strings, many, [])

    def build(z: dict[str, np.ndarray], _: None, first: np.ndarray, end: np.ndarray, edges: np.ndarray) -> pa.Table:
        removed = np.concatenate([[0], np.cumsum(end - first)])
        return pa.table(
            {
                "id": pa.array(z["rank"], mask=z["null"]),
                "n_bytes": np.diff(z["offsets"]),
                "n_removed": removed[edges[1:]] - removed[edges[:-1]],
                "n_spans": np.diff(edges).astype(np.int64),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _kept(z, first, end, edges)], pa.string()),
            }
        )

    out = _apply(chunks, spans, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", build)
    return out.withColumnRenamed("id", id_col)


def suffix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, kgram: int = KGRAM, shard_strings: int = SHARD_STRINGS, many: int = MANY_CONTEXTS) -> DataFrame:
    """docs with what is left of each text; bytes of a character of which a part was removed are dropped, null stays null."""
    chunks, spans = _prepared(docs, id_col, text_col, span, kgram, shard_strings, many, docs.columns)
    at = docs.columns.index(text_col)
    schema = StructType([StructField(f"of_{i}", f.dataType if i != at else StringType()) for i, f in enumerate(docs.schema.fields)])

    def build(z: dict[str, np.ndarray], others: pa.Table, first: np.ndarray, end: np.ndarray, edges: np.ndarray) -> pa.Table:
        texts = [x.decode("utf-8", "ignore") for x in _kept(z, first, end, edges)]
        return others.drop_columns(["id"]).set_column(at, f"of_{at}", pa.array(texts, pa.string(), mask=others.column("absent").to_numpy())).drop_columns(["absent"])

    return _apply(chunks, spans, schema, build, rest=True).toDF(*docs.columns)
