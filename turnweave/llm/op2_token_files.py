"""Token ids as flat binary files: unsigned integers end to end, 64-bit document offsets, memory-mapped reading.

Format, per partition NNNNN of a folder: `tokens-NNNNN.bin` holds ids as little-endian unsigned integers (two bytes where
the vocabulary has at most 65,536 entries, else four) and `offsets-NNNNN.bin` holds n+1 little-endian signed 64-bit token
offsets, local to the partition; `docs-NNNNN.bin` holds the n document ids as little-endian signed 64-bit integers (null ids,
which come first, are counted in the table of partitions). Partition bases are the prefix sums of the partitions' totals and are kept in the returned
table, so no partition waits for another while it is written. Documents lie in ascending id order within and across
partitions. A partition is written under an attempt's own name and renamed when whole, so a task that runs again, or twice at
once, leaves the same files.

Encoding: a text is cut before single spaces and newlines that stand between non-space characters. Byte-level BPE with the
usual splitting pattern never crosses such a cut, so the pieces of some MB of texts are reduced to distinct ones by Arrow, each is
encoded once a worker (by the tokenizers library, in a table of bounded size), and ids are gathered by position. Texts that hold
a special token's string, or a zero character, are encoded whole.

Defined results: a null text is empty and has just the end id; null ids come first; equal ids are ordered by the
XXH64 of their texts; an empty
table gives no rows. Extra input columns, also of clashing names, are ignored. Very long texts are encoded whole, alone.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.common import filesystem, fresh_dir, materialize, quoted, reducers, slices, text_size

#: Distinct pieces that a worker keeps; at the limit the less used ones go.
TABLE_PIECES = 800_000
#: Bytes of texts that are cut and looked up together.
BATCH_BYTES = 16 << 20
PUNCTUATION = string.punctuation
#: White space other than the space and the newline, of the splitting pattern and of Python (which has a few more).
OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: White space that touches a space or newline or an end of the text, so that not every space and newline is a cut.
TOUCHING = rf"^[ \n]|[ \n]\z|[ \n][ \n{OTHER_SPACE}]|[{OTHER_SPACE}][ \n]"
CUTS = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
CUT = "\0"
_TABLES: dict[str, PieceTable] = {}


class PieceTable:
    """Ids of pieces of text by dictionary, each encoded once by the tokenizer of a file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        named = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.opens_space, self.opens_line = (np.array([n.startswith(c) for n in named]) for c in ("\u0120", "\u010a"))  # byte-level signs of both
        self.tails: dict[str, np.ndarray] = {}
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.clear()

    @classmethod
    def of(cls, path: str) -> PieceTable:
        if path not in _TABLES:
            _TABLES[path] = cls(path)
        return _TABLES[path]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int64)  # of piece i; its end is the start of i + 1
        self.hits = np.zeros(1 << 12, np.int32)  # texts that had piece i since it came

    def learn(self, pieces: list[str]) -> None:
        """Take in new pieces. One of letters and closing punctuation is put together from the ids of both, which never merge."""
        whole, made = [], []
        for p in pieces:
            core = p.rstrip(PUNCTUATION)
            if len(core) < len(p) and core[core[:1] == "\n" :].isalpha():
                made.append((p, core, p[len(core) :]))
            else:
                whole.append(p)
        cores = dict.fromkeys(core for _, core, _ in made if core not in self.index)
        self._encode_new(list(cores | dict.fromkeys(whole)))
        if made:
            for _, _, tail in made:
                if tail not in self.tails:
                    self.tails[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, np.uint32)
            at = np.array([self.index[core] for _, core, _ in made], np.int64)
            start, end = self.start[at].tolist(), self.start[at + 1].tolist()
            ids = [x for a, b, (_, _, tail) in zip(start, end, made, strict=True) for x in (self.flat[a:b], self.tails[tail])]
            size = np.fromiter(map(len, ids), np.int64, len(ids)).reshape(-1, 2).sum(1)
            self._add([p for p, _, _ in made], size, np.concatenate(ids))

    def _encode_new(self, pieces: list[str]) -> None:
        """Pieces that stand for themselves after a space, or, where they open with a newline, without one.

        Those without other white space are encoded many at once, as one text: just their first ids open with space or newline.
        """
        lined = [p for p in pieces if p[0] == "\n"]
        spaced = [p for p in pieces if p[0] != "\n"] if lined else pieces
        odd: list[str] = []
        if len("".join(spaced).split(None, 1)) > 1 or len(("".join(spaced)).strip()) < sum(map(len, spaced)):
            odd += [p for p in spaced if p.split() != [p]]
            spaced = [p for p in spaced if p.split() == [p]]
        if len("".join(lined).split()) != len(lined) or sum(map(len, "".join(lined).split())) != sum(map(len, lined)) - len(lined):
            odd += [p for p in lined if p.split() != [p[1:]]]
            lined = [p for p in lined if p.split() == [p[1:]]]
        for own, joined, opens in ((spaced, " ".join, self.opens_space), (lined, "".join, self.opens_line)):
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                ids = np.array(self.tokenizer.encode(" " * (own is spaced) + joined(part), add_special_tokens=False).ids, np.uint32)
                start = np.flatnonzero(opens[ids])
                if len(start) != len(part):
                    raise ValueError("the vocabulary does not mark the white space before a piece")
                self._add(part, np.diff(start, append=len(ids)), ids)
        self._add(odd, *self._whole([p if p[0] == "\n" else " " + p for p in odd]))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids end to end) of texts, each by the tokenizer alone."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    def _add(self, pieces: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.index)
        while n + len(pieces) + 1 > len(self.start):
            self.start, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.hits))
        np.cumsum(size, out=self.start[n + 1 : n + 1 + len(pieces)])
        self.start[n + 1 : n + 1 + len(pieces)] += self.start[n]
        self.hits[n : n + len(pieces)] = 0
        end = int(self.start[n + len(pieces)])
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.start[n] : end] = flat
        self.index.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _shrink(self) -> None:
        """Keep the most used half at most, of pieces that more than one text had."""
        n = len(self.index)
        hits, start, flat = self.hits[:n], self.start, self.flat
        kept = np.flatnonzero(hits > 1)
        if len(kept) > TABLE_PIECES // 2:
            kept = np.sort(kept[np.argsort(-hits[kept], kind="stable")[: TABLE_PIECES // 2]])
        pieces = list(self.index)
        pieces = [pieces[i] for i in kept.tolist()]
        size = start[kept + 1] - start[kept]
        self.clear()
        self._add(pieces, size, flat[_places(start[kept], size)])
        self.hits[: len(kept)] = hits[kept] // 2

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the tokenizer gives them without its special tokens added."""
        return self.encode_all(pa.array([text], pa.large_string()))[1]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids end to end) of texts; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring(texts, CUT)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False)
        touching = pc.match_substring_regex(texts, TOUCHING).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, "\n", CUT + "\n"), " ", CUT)
        if (whole | touching).any():
            own = texts.to_pylist()
            cut = cut.to_pylist()
            for i in np.flatnonzero(whole | touching).tolist():
                cut[i] = "" if whole[i] else CUTS.sub(CUT, own[i])
            cut = pa.array(cut, pa.large_string())
        # The first piece of a text stands alone; what follows is looked up.
        pieces = pc.split_pattern(cut, CUT)
        edges = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        place, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        opening = np.zeros(len(place), bool)
        opening[edges[:-1]] = True
        inner = np.zeros(len(known), bool)
        inner[place[~opening]] = True
        at = self._looked_up(known, inner)
        first = np.unique(place[opening])
        size, flat = self._whole([known[i] for i in first.tolist()])
        # Starts and sizes by distinct piece: those of inner ones lie in the table, those of opening ones after it.
        end = int(self.start[len(self.index)])
        begin, n = self.start[at[place]], (self.start[np.minimum(at + 1, len(self.start) - 1)] - self.start[at])[place]
        where = np.searchsorted(first, place[opening])
        begin[opening], n[opening] = end + (np.cumsum(size) - size)[where], size[where]
        ids = np.concatenate([self.flat[:end], flat])[_places(begin, n)]
        total = np.add.reduceat(np.append(n, 0), edges[:-1]) if len(texts) else np.zeros(0, np.int64)
        if not whole.any():
            return total, ids
        alone = np.flatnonzero(whole)
        size, flat = self._whole([own[i] for i in alone.tolist()])
        begin, n = np.cumsum(total) - total, total
        begin[alone], n[alone] = len(ids) + np.cumsum(size) - size, size
        return n, np.concatenate([ids, flat])[_places(begin, n)]

    def _looked_up(self, known: list[str], wanted: np.ndarray) -> np.ndarray:
        """Places in the table of the wanted ones of known pieces; 0 of the others."""
        at = np.zeros(len(known), np.int64)
        own = np.flatnonzero(wanted)
        pieces = [known[i] for i in own.tolist()]
        got = list(map(self.index.get, pieces))
        if None in got:
            new = [p for p, i in zip(pieces, got, strict=True) if i is None]
            if len(self.index) + len(new) > TABLE_PIECES:
                self._shrink()
                new = [p for p in pieces if p not in self.index]
            self.learn(new)
            got = list(map(self.index.get, pieces))
        at[own] = got
        self.hits[at[own]] += 1
        return at


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 of every entry, end to end."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files below folder; returns (part, n_docs, n_null, n_tokens, base_tokens), a row per written partition.

    Partitions are ranges of (id, hash of the text), so one id with very many rows is split too; only such keys are sampled.
    """
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    texts = texts.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = reducers(docs.sparkSession, text_size(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = PieceTable.of(tokenizer_path)
        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        mark = uuid.uuid4().hex
        names = {k: (f"{root}/.{k}-{part:05d}-{mark}", f"{root}/{k}-{part:05d}.bin") for k in ("tokens", "offsets", "docs")}
        kind, offsets, own_ids = ("<u4" if table.wide else "<u2"), [np.zeros(1, np.int64)], []
        total = docs = nulls = 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(names["tokens"][0]) as out:
            for b in slices(batches, "text", BATCH_BYTES):
                size, ids = table.encode_all(b.column(1))
                ends = np.cumsum(size)
                if end_id is not None:
                    ids = np.insert(ids, ends, np.uint32(end_id))
                    ends += np.arange(1, len(ends) + 1)
                out.write(ids.astype(kind).tobytes())
                docs += len(ends)
                nulls += b.column(0).null_count
                offsets.append(ends + total)
                total += len(ids)
                own_ids.append(b.column(0).fill_null(0).to_numpy())
        for name, arrays in (("offsets", offsets), ("docs", own_ids)):
            with fs.open_output_stream(names[name][0]) as out:
                for x in arrays:
                    out.write(x.astype("<i8").tobytes())
        if docs:
            for own, final in names.values():
                fs.move(own, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())} | {k: pa.array([v], pa.int64()) for k, v in (("n_docs", docs), ("n_null", nulls), ("n_tokens", total))})
        else:
            for own, _ in names.values():
                fs.delete_file(own)

    dealt = texts.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    parts = materialize(dealt.mapInArrow(run, "part int, n_docs long, n_null long, n_tokens long"), "parts")
    # One row a partition: the prefix sums run over a table whose size is the number of partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base_tokens"))


def read_token_files(parts: DataFrame, folder: str, wide: bool, doc_batch: int = 4096) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files, read through memory maps.

    start counts the ids of all documents before one.
    """
    n = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, nulls, base_tokens in zip(*(b.column(c).to_pylist() for c in ("part", "n_null", "base_tokens")), strict=True):
                with TokenPart(folder, part, wide) as own:
                    for at in range(0, len(own), doc_batch):
                        here = range(at, min(at + doc_batch, len(own)))
                        offsets = own.offsets[at : here.stop + 1]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "id": pa.array(own.docs[at : here.stop], mask=np.arange(at, here.stop) < nulls),
                                "start": pa.array(offsets[:-1] + base_tokens),
                                "n_tokens": pa.array(np.diff(offsets)),
                                "ids_crc32": pa.array([zlib.crc32(own[i].astype("<u4").tobytes()) for i in here], pa.int64()),
                            }
                        )

    return parts.repartition(n, "part").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


class TokenPart:
    """One partition of token files: part[i] is the array of document i's ids, a view of the mapped file."""

    def __init__(self, folder: str, part: int, wide: bool):
        fs, root = filesystem(folder)
        local = type(fs).__name__ == "LocalFileSystem"
        self.held = []

        def mapped(name: str, kind: str) -> np.ndarray:
            if local:
                f = pa.memory_map(f"{root}/{name}", "r")
            else:  # a store without memory maps: one read of the whole part
                f = fs.open_input_file(f"{root}/{name}")
            self.held.append(f)
            return np.frombuffer(f.read_buffer(), kind)

        self.ids = mapped(f"tokens-{part:05d}.bin", "<u4" if wide else "<u2")
        self.offsets = mapped(f"offsets-{part:05d}.bin", "<i8")
        self.docs = mapped(f"docs-{part:05d}.bin", "<i8")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]

    def __enter__(self) -> TokenPart:
        return self

    def __exit__(self, *_) -> None:
        self.ids = self.offsets = self.docs = None


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write docs to token files and read them back: (id_col, start, n_tokens, ids_crc32), a row per document."""
    folder = folder or fresh_dir(docs.sparkSession, "tokens")
    parts = materialize(write_token_files(docs, folder, tokenizer_path, end_id, id_col, text_col), "bases")
    read = read_token_files(parts, folder, PieceTable.of(tokenizer_path).wide)
    return read.select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
