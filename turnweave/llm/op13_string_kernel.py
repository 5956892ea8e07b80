"""Language identification with string kernels: which strings of one to four letters two texts share, landmarks, kernel ridge regression.

A text is lower-cased and read as code points; runs of what is no letter become one space. The blended-spectrum presence kernel
of two texts is the number of different strings of one to ORDER such characters that both have, divided by the root of the
product of their own numbers. Strings are told apart by a 20-bit hash, which is part of the kernel's definition.

Nyström: landmarks are some training texts; a text's kernel values with them, times the inverse root of the landmarks' own kernel
matrix, are its features. One ridge regression on these for each language (1 for its texts, -1 for the others) gives the weights.
Scoring multiplies the presence rows of a batch of texts with the landmarks' columns, and the kernel rows with the weights.

Training sees at most `max_docs` labelled documents of at most `max_bytes` in all, whole, equally many of each language as far as there
are, taken by the hash of their ids; `landmarks` of them are landmarks. Languages beyond the `max_langs` with the most documents
are not learned. These bounds hold for training alone; all of every text is scored. Language, source and id are no inputs of a score.

Defined results: a null text or one without a letter is `und` with score 0; empty texts are without one; among equal scores the language
that comes first in order wins; a score is that of the language, (1 + f) / 2 of its regression f, kept within 0 and 1; one learned
language is predicted for all texts with letters, none gives `und`; repeated rows and null ids each give a row; an empty table gives no
rows. Very long texts are read in pieces that overlap, with the result of reading them at once. Extra columns of any name are ignored.
"""

from __future__ import annotations

import functools
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import quoted, slices, trimming

ORDER, BITS = 4, 20
PIECE = 1 << 20
TEXTS = 64
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text between spaces (0), each run of others than letters being one."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([[0], np.where(_letters()[code], code, 0), [0]]).astype(np.uint32)
    return code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]


class Strings:
    """The different hashed strings of texts."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)

    def _distinct(self, own: np.ndarray) -> np.ndarray:
        at = np.arange(len(own), dtype=np.int32)
        self.last[own] = at  # of equal strings one place remains
        return own[self.last[own] == at]

    def __call__(self, text: str | None) -> np.ndarray:
        """Hashes, each once; none where there is no letter."""
        code = symbols(text) if text else np.zeros(0, np.uint32)
        if not code.any():
            return np.zeros(0, np.int64)
        found = []
        for a in range(0, len(code), PIECE):
            piece = code[a : a + PIECE + ORDER - 1]
            h, own = np.zeros(len(piece), np.uint32), []
            for n in range(1, min(ORDER, len(piece)) + 1):
                h = (h[: len(piece) - n + 1] ^ piece[n - 1 :]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                own.append(((h + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64))
            own[0] = own[0][piece != 0]
            found.append(self._distinct(np.concatenate(own)))
        return found[0] if len(found) == 1 else self._distinct(np.concatenate(found))


class Model:
    """Languages, the landmarks' strings (a column of `columns` each, -1 for others; rows of `present`) and weights by landmark."""

    def __init__(self, langs: list[str], columns: np.ndarray | None = None, present: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.langs, self.columns, self.present, self.weights = langs, columns, present, weights

    def rows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(presence of the landmarks' strings, number of all strings) of texts given by their strings."""
        x = np.zeros((len(texts), len(self.present)), np.float32)
        for i, own in enumerate(texts):
            at = self.columns[own]
            x[i, at[at >= 0]] = 1
        return x, np.array([len(t) for t in texts])

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts with the landmarks, by a matrix product a batch."""
        x, n = self.rows(texts)
        return (x @ self.present) / np.sqrt(np.maximum(n, 1))[:, None]


def train(texts: list[str | None], langs: list[str], landmarks: int, ridge: float = 1e-3) -> Model:
    """Fit to documents in a fixed order; the first texts with letters of each language, in turn, are landmarks."""
    strings = Strings()
    own = [(s, lang) for t, lang in zip(texts, langs, strict=True) if len(s := strings(t))]
    names = sorted({lang for _, lang in own})
    if len(names) < 2:
        return Model(names)
    turn: dict[str, int] = {}
    place = []
    for i, (_, lang) in enumerate(own):
        turn[lang] = turn.get(lang, -1) + 1
        place.append((turn[lang], lang, i))
    marks = [own[i][0] for _, _, i in sorted(place)[:landmarks]]
    model = Model(names, np.full(1 << BITS, -1, np.int32))
    known = np.unique(np.concatenate(marks))
    model.columns[known] = np.arange(len(known), dtype=np.int32)
    model.present = np.zeros((len(known), len(marks)), np.float32)
    for j, m in enumerate(marks):
        model.present[model.columns[m], j] = 1 / np.sqrt(len(m))
    kernel = np.concatenate([model.kernel([s for s, _ in own[i : i + TEXTS]]) for i in range(0, len(own), TEXTS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(np.concatenate([model.kernel(marks[i : i + TEXTS]) for i in range(0, len(marks), TEXTS)]).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.where(np.array([lang for _, lang in own])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * len(own) * np.eye(features.shape[1]), features.T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def predict(model: Model, strings: Strings, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(languages, scores) of a batch of texts."""
    own = [strings(t) for t in texts]
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    able = [i for i, s in enumerate(own) if len(s)] if model.langs else []
    if len(model.langs) == 1:
        for i in able:
            lang[i], score[i] = model.langs[0], 1.0
    elif able:
        f = (model.kernel([own[i] for i in able]) @ model.weights).astype(np.float64)
        for i, k, best in zip(able, f.argmax(1).tolist(), f.max(1).tolist(), strict=True):
            lang[i], score[i] = model.langs[k], min(1.0, max(0.0, (1 + best) / 2))
    return lang, score


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1024, max_bytes: int = 16 << 20, landmarks: int = 96, max_langs: int = 256, exclude=held_out) -> Model:
    """Train on the driver from documents with a language that `exclude` does not name, within the bounds.

    Two passes over ids and languages: the numbers by language, then the documents whose hash is below each language's share. Only
    those texts are read and come to the driver.
    """
    spark = docs.sparkSession
    own = docs.where(~exclude(id_col)).select(quoted(id_col).cast("string").alias("id"), quoted(text_col).cast("string").alias("t"), quoted(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND t IS NOT NULL")
    by = [(r["lang"], r["n"]) for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()]
    if not by:
        return Model([])
    each = max(1, max_docs // len(by))
    span = 1 << 32
    hashed = F.pmod(F.xxhash64("id"), F.lit(span))
    shares = spark.createDataFrame([(lang, min(span, int(span * min(1.0, (2 * each + 20) / n)))) for lang, n in by], "lang string, below long")
    drawn = own.join(F.broadcast(shares), "lang").withColumn("h", hashed).where("h < below")  # at most max_langs shares; some 2 * each + 20 documents of each
    sized = drawn.select("lang", "h", "id", F.octet_length("t").alias("n"), F.xxhash64("t").alias("of")).distinct()
    few = sized.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("h", "id", "of", "n"))).alias("docs")).select("lang", F.slice("docs", 1, each).alias("docs")).collect()
    chosen, total = [], 0
    for k in range(each):
        for r in sorted(few, key=lambda r: r["lang"]):
            if k < len(r["docs"]) and total + r["docs"][k]["n"] <= max_bytes:
                total += r["docs"][k]["n"]
                chosen.append((r["lang"], r["docs"][k]["id"], r["docs"][k]["of"]))
    if not chosen:
        return Model([])
    wanted = F.broadcast(spark.createDataFrame(chosen, "lang string, id string, of long"))  # at most max_docs rows
    rows = drawn.withColumn("of", F.xxhash64("t")).join(wanted, ["lang", "id", "of"]).select("lang", "id", "t").distinct().collect()
    rows.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["lang"], r["t"]))
    return train([r["t"] for r in rows], [r["lang"] for r in rows], landmarks)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks of bounded size and 4 MB of columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Strings()
        for b in slices(batches, "text", 4 << 20):
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                lang, score = predict(shared.value, strings, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    own = docs.select(quoted(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), quoted(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimming(run), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
