"""BPE encoding through a distributed table of distinct words, and decoding through a table of pieces.

Texts are split into words at ASCII white space (the tokenizer's splitting never joins across it). Three exchanges follow:

1. Chunks of whole documents hold their words as positions in the chunk's own list of distinct words. These lists go to the
   tasks that own the words' hashes; a word travels once a chunk, however often it occurs.
2. The owner of a word encodes it once, with the tokenizers library, and sends its ids to every chunk that has it.
3. A chunk joins the ids back by position, document by document.

Decoding joins the ids to the pieces of the vocabulary (whose size the tokenizer file bounds) in the same way and passes them
to the file's decoder; without one, pieces are joined by a space, as the library does.

Defined results: a null text is empty; a text without words has no ids and decodes to an empty text; repeated rows and null ids
each give a row; an empty table gives no rows. A very long text is a chunk of its own. Extra input columns, also of clashing names,
are ignored.

Chunks are read twice where a lost executor's rows are made again, and have to be the same ones. Input that comes from files alone is;
any other (an exchange may give its rows in another order) is written to the shared folder first.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnweave.llm.common import materialize, quoted, reducers, text_size, trimmed, trimmed_pair, trimming

CHUNK_BYTES = 8 << 20
#: Words that are encoded at once.
BATCH = 8192
_OPEN: dict[str, object] = {}


def tokenizer_of(path: str):
    """The tokenizer of a file, once a process, without truncation and padding."""
    if path not in _OPEN:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _OPEN[path] = t
    return _OPEN[path]


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: the high bytes are mostly zero and compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _coded(place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of words, codes of places): words by falling count, then those that occur once as they come; these have code 0."""
    once = count == 1
    order = np.concatenate([(many := np.flatnonzero(~once))[np.argsort(-count[many], kind="stable")], np.flatnonzero(once)])
    code = np.zeros(len(count), np.uint32)
    code[order[: len(many)]] = np.arange(1, len(many) + 1)
    return order, code[place]


def _placed(code: np.ndarray, words: int) -> np.ndarray:
    """Places in the order of words from their codes."""
    once = code == 0
    place = code.astype(np.int64) - 1
    place[once] = np.arange(words - int(once.sum()), words)
    return place


def _rows(key: list[int], chunk: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], names=["key", "chunk", "blob"])


ROWS = "key long, chunk long, blob binary"
CHUNK_KEY = 1 << 62


def _chunks(docs: DataFrame, id_col: str, text_col: str, owners: int) -> DataFrame:
    """Rows of two kinds: of key CHUNK_KEY + chunk, the chunk's documents as places of words; of key owner, a list of words.

    Spark cuts the words, and Arrow finds the different ones of a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, t in enumerate(_by_words(batches, CHUNK_BYTES)):
            lists = t.column("words").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            known = lists.flatten().dictionary_encode()
            place = known.indices.to_numpy().astype(np.uint32)
            words = known.dictionary.cast(pa.binary()).to_pylist()
            order, code = _coded(place, np.bincount(place, minlength=len(words)))
            words = [words[j] for j in order.tolist()]
            owner = np.array([zlib.crc32(w) % owners for w in words], np.uint32)
            by = np.argsort(owner, kind="stable")
            ids = t.column("id").combine_chunks()
            head = np.array([t.num_rows, len(words)], "<i8").tobytes()
            blob = _squeeze(head + ids.fill_null(0).to_numpy().astype("<i8").tobytes() + ids.is_null().to_numpy(zero_copy_only=False).tobytes() + size.astype("<i8").tobytes() + _planes(owner) + _planes(code))
            chunk = part << 32 | i
            edges = np.searchsorted(owner[by], np.arange(owners + 1))
            own = [k for k in range(owners) if edges[k] < edges[k + 1]]
            lists = [b"\n".join([words[j] for j in by[edges[k] : edges[k + 1]].tolist()]) for k in own]
            yield _rows([CHUNK_KEY | chunk, *own], [chunk] * (len(own) + 1), [blob, *map(_squeeze, lists)])

    words = F.array_remove(F.split(F.coalesce(quoted(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return docs.select(quoted(id_col).cast("long").alias("id"), words.alias("words")).mapInArrow(trimming(run), ROWS)


def _by_words(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Consecutive rows (id, words) in tables of about `limit` bytes of words; a longer row is one of its own."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(1).flatten()).to_numpy(zero_copy_only=False))])
        sizes = np.diff(ends[(b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py())]) + np.diff(b.column(1).offsets.to_numpy())
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield pa.Table.from_batches([*held, b.slice(start, i - start)])
                held, start, total = [], i, 0
            total += n
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _settled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, or (id, text) of them written out, if their rows could come in another order when they are computed again."""
    plan, kinds = [docs._jdf.queryExecution().optimizedPlan()], set()
    while plan:
        node = plan.pop()
        kinds.add(node.nodeName().split(" ")[0])
        plan += [node.children().apply(i) for i in range(node.children().size())]
    if kinds <= {"LogicalRelation", "Relation", "Project", "Filter"}:
        return docs
    return materialize(docs.select(quoted(id_col).cast("long").alias(id_col), quoted(text_col).cast("string").alias(text_col)), "texts")


def _encode(words: list[bytes], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids end to end) of words."""
    size, flat = [], []
    for at in range(0, len(words), BATCH):
        got = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words[at : at + BATCH]], add_special_tokens=False)]
        size.append(np.fromiter(map(len, got), np.int64, len(got)))
        flat.append(np.fromiter((i for x in got for i in x), np.uint32, int(size[-1].sum())))
    return (np.concatenate(size), np.concatenate(flat)) if words else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def gather(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every entry, end to end."""
    return flat[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


def encoded(docs: DataFrame, tokenizer_path: str, build, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of build(ids or None, list of id arrays), called for every few documents; the ids are those of the library."""
    spark = docs.sparkSession
    docs = _settled(docs, id_col, text_col)
    owners = reducers(spark, text_size(docs, text_col))
    # One exchange by key serves both uses of the rows below, as Spark computes equal exchanges once.
    rows = _chunks(docs, id_col, text_col, owners).repartition(owners, "key")

    def answer(t: pa.Table) -> pa.Table:
        """Encode the distinct words of an owner once; answer each chunk in its list's order."""
        owner, tokenizer = t.column("key")[0].as_py(), tokenizer_of(tokenizer_path)
        if owner >= CHUNK_KEY:
            return pa.Table.from_batches([_rows([], [], [])])
        index: dict[bytes, int] = {}
        places = [np.array([index.setdefault(w, len(index)) for w in _expand(b.as_py()).split(b"\n")], np.int64) for b in t.column("blob")]
        size, flat = _encode(list(index), tokenizer)
        start = np.cumsum(size) - size
        blobs = [_squeeze(np.array([owner, len(p)], "<i8").tobytes() + _planes(size[p]) + _planes(gather(start[p], size[p], flat))) for p in places]
        chunk = t.column("chunk").to_pylist()
        return pa.Table.from_batches([_rows([CHUNK_KEY | c for c in chunk], chunk, blobs)])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left.column("key")[0].as_py() < CHUNK_KEY:
            return build(pa.array([], pa.int64()), [])
        data = _expand(left.column("blob")[0].as_py())
        n, distinct = (int(x) for x in np.frombuffer(data, "<i8", 2))
        doc = np.frombuffer(data, "<i8", n, 16)
        null = np.frombuffer(data, bool, n, 16 + 8 * n)
        words = np.frombuffer(data, "<i8", n, 16 + 9 * n)
        at = 16 + 17 * n
        owner, place = _unplaned(data[at : at + 4 * distinct]), _placed(_unplaned(data[at + 4 * distinct :]), distinct)
        answers = []
        for b in right.column("blob"):
            data = _expand(b.as_py())
            k, m = (int(x) for x in np.frombuffer(data, "<i8", 2))
            answers.append((k, _unplaned(data[16 : 16 + 4 * m]).astype(np.int64), _unplaned(data[16 + 4 * m :])))
        answers.sort(key=lambda x: x[0])
        rank = np.empty(distinct, np.int64)  # of each word in the order of the answers
        rank[np.argsort(owner, kind="stable")] = np.arange(distinct)
        size = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in answers)])
        flat = np.concatenate([np.zeros(0, np.uint32), *(x[2] for x in answers)])
        start = (np.cumsum(size) - size)[rank]
        size = size[rank]
        out, first = [], 0
        edges = np.concatenate([[0], np.cumsum(words)])
        while first < n:  # a few documents at a time: ids of all words of a chunk can be many
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + (1 << 18), side="right")) - 1)
            ids = []
            for i in range(first, last):
                own = place[edges[i] : edges[i + 1]]
                ids.append(gather(start[own], size[own], flat))
            out.append(build(pa.array(doc[first:last], mask=null[first:last]), ids))
            first = last
        return pa.concat_tables(out)

    asked = rows.groupBy("key").applyInArrow(trimmed(answer), ROWS)
    return rows.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(trimmed_pair(join), schema)


class Pieces:
    """The id-to-piece table of a tokenizer file, for decoding by a join."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        named = [self.tokenizer.id_to_token(i) for i in range(n)]
        self.plain = self.tokenizer.decoder is None
        self.text = np.array(["" if p is None else p for p in named], object)

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library's decode(ids, skip_special_tokens=False), in UTF-8."""
        pieces = self.text[ids].tolist()
        return (" ".join(pieces) if self.plain else self.tokenizer.decoder.decode(pieces)).encode()


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def bpe_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, n_tokens, ids_sha256, decoded_sha256)."""

    def build(doc: pa.Array, ids: list[np.ndarray]) -> pa.Table:
        pieces = pieces_of(tokenizer_path)
        return pa.table(
            {
                "id": doc,
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(pieces.decode(x)).hexdigest() for x in ids], pa.string()),
            }
        )

    return encoded(docs, tokenizer_path, build, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col).withColumnRenamed("id", id_col)


def bpe_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, ids array of ints)."""

    def build(doc: pa.Array, ids: list[np.ndarray]) -> pa.Table:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.table({"id": doc, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)))})

    return encoded(docs, tokenizer_path, build, "id long, ids array<int>", id_col, text_col)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_tokens, ids array of ints, decoded text)."""

    def build(doc: pa.Array, ids: list[np.ndarray]) -> pa.Table:
        pieces = pieces_of(tokenizer_path)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))
        return pa.table({"id": doc, "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), flat), "decoded": pa.array([pieces.decode(x).decode() for x in ids], pa.string())})

    return encoded(docs, tokenizer_path, build, "id long, n_tokens long, ids array<int>, decoded string", id_col, text_col).withColumnRenamed("id", id_col)


def decoded(encoded_docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded_docs with the decoded text of an array of ids; null ids decode to null."""
    schema = StructType([*encoded_docs.schema.fields, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = b.slice(at, 256)
                texts = [None if x is None else pieces.decode(np.array(x, np.int64)).decode() for x in own.column(own.schema.get_field_index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], schema=None, names=[*own.schema.names, out_col])

    return encoded_docs.mapInArrow(run, schema)
