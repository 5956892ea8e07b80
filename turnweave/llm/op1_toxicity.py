"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy.

A text is lower-cased and cut into words: runs of letters and digits, and runs of other signs, in pieces of at most PIECE
characters, so that all but white space is read. A word's input is
its embedding next to what a small bidirectional network with attention pooling makes of its characters, each given as the
hashed strings of two to four characters that end there. A second such network reads windows of WINDOW words that overlap by
half, and a document's logit is the largest of all its windows', so no part of a text is left out. A final scale and shift of
the logit are fitted on the training documents.

Training sees the whole texts of at most `max_docs` labelled documents of at most `max_bytes` in all, half of them toxic where
there are as many, taken in the order of the hash of their ids; these bounds hold for training alone. Embeddings start from how each word
and character string goes with the labels of the training documents. Windows that the network thinks most toxic of each
document are trained on, with some others. The label of a document, its language, source and id are no inputs of its score.

Scoring keeps what it has computed for distinct words in a table of bounded size; scores do not depend on it.

Defined results: a null text is empty; an empty text is one window of padding and gets its score; repeated rows and null ids
each give a row (an id that repeats is trained on once, with its least text, and toxic if any of its labels is); a score of
exactly 0.5 is toxic; with labels of one kind only, or none, all scores are that kind's share (or 0); an empty table gives no
rows. A very long text is scored in all its windows, and held whole meanwhile. Extra columns of any name are ignored by scored() and
kept by without_toxic().
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import quoted, slices, trimming

WINDOW, STRIDE, PIECE = 32, 16, 12
WORD = re.compile(r"[^\W_]{1,%d}|(?:[^\w\s]|_){1,%d}" % (PIECE, PIECE))
BUCKETS = 1 << 16
VOCABULARY = 8192
E_WORD, E_CHAR, H_CHAR, H_WORD, ATTEND = 4, 4, 4, 8, 8
MAX_DOCS = 3000
MAX_BYTES = 32 << 20
EPOCHS, STEPS, BATCH = 3, 48, 256  # epochs before and after windows are picked anew; more where they would be fewer steps
TABLE_WORDS = 200_000
WINDOWS_AT_ONCE = 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def char_units(words: list[str]) -> np.ndarray:
    """(characters, words, 3) of words of one length: the hashed strings of two, three and four characters that end at each character."""
    n = len(words[0])
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, n).T.astype(np.uint64)
    code = np.concatenate([np.zeros((3, len(words)), np.uint64), code + np.uint64(2)])
    code[2] = 1  # the start of a word
    out = np.empty((n, len(words), 3), np.int64)
    x = code[3:]
    for k in (1, 2, 3):  # string lengths are told apart by how far back they reach
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[3 - k : 3 - k + n] * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        out[..., k - 1] = (x >> np.uint64(20)) % np.uint64(BUCKETS)
    return out


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


# Network parts: forward passes return what backward passes need.


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(gx: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states of a gated recurrent layer over gx = inputs @ w + b of shape (time, batch, 3 * hidden)."""
    hidden = u.shape[0]
    h = np.zeros((gx.shape[1], hidden), gx.dtype)
    out, held = np.empty((*gx.shape[:2], hidden), gx.dtype), []
    for t in range(len(gx)):
        gh = h @ u
        gate = _sigmoid(gx[t, :, : 2 * hidden] + gh[:, : 2 * hidden])
        r, z = gate[:, :hidden], gate[:, hidden:]
        n = np.tanh(gx[t, :, 2 * hidden :] + r * gh[:, 2 * hidden :])
        if keep:
            held.append((h, r, z, n, gh[:, 2 * hidden :]))
        h = n + z * (h - n)
        out[t] = h
    return out, held


def gru_back(d_out: np.ndarray, held: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of gx, gradient of u) from that of the hidden states."""
    d_gx, d_u, d_h = np.empty((*d_out.shape[:2], 3 * u.shape[0]), d_out.dtype), np.zeros_like(u), np.zeros_like(d_out[0])
    for t in range(len(d_out) - 1, -1, -1):
        h, r, z, n, gh_n = held[t]
        d_h = d_h + d_out[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (h - n) * z * (1 - z)
        d_r = d_n * gh_n * r * (1 - r)
        d_gx[t] = np.concatenate([d_r, d_z, d_n], 1)
        d_gh = np.concatenate([d_r, d_z, d_n * r], 1)
        d_u += h.T @ d_gh
        d_h = d_h * z + d_gh @ u.T
    return d_gx, d_u


def attend(h: np.ndarray, a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Weighted mean over time of h by a softmax of tanh(h @ a) @ v."""
    u = np.tanh(h @ a)
    s = u @ v
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    return np.einsum("tb,tbh->bh", w, h), (h, u, w)


def attend_back(d: np.ndarray, held: tuple, a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, u, w = held
    d_w = np.einsum("bh,tbh->tb", d, h)
    d_s = w * (d_w - (w * d_w).sum(0))
    d_u = d_s[..., None] * v * (1 - u * u)
    d_h = w[..., None] * d[None] + d_u @ a.T
    return d_h, np.einsum("tbh,tbk->hk", h, d_u), np.einsum("tb,tbk->k", d_s, u)


class Net:
    """Parameters in p; the vocabulary maps known words to rows of p["word"], of which row 0 is for others and 1 for padding."""

    def __init__(self, vocabulary: dict[str, int], p: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, p

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        near = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        wide = E_WORD + 2 * H_CHAR
        p = {"word": near(len(vocabulary) + 2, E_WORD) * 0.1, "unit": near(BUCKETS, E_CHAR) * 0.1, "out": near(2 * H_WORD), "bias": np.zeros(1, np.float32)}
        for name, inputs, hidden in (("c", E_CHAR, H_CHAR), ("w", wide, H_WORD)):
            for side in "fb":
                p |= {f"{name}{side}w": near(inputs, 3 * hidden), f"{name}{side}b": np.zeros(3 * hidden, np.float32), f"{name}{side}u": near(hidden, 3 * hidden)}
            p |= {f"{name}a": near(2 * hidden, ATTEND), f"{name}v": near(ATTEND)}
        return cls(vocabulary, p)

    def _both(self, name: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """Both directions over x (time, batch, input), pooled."""
        p = self.p
        f, held_f = gru(x @ p[f"{name}fw"] + p[f"{name}fb"], p[f"{name}fu"], keep)
        b, held_b = gru((x @ p[f"{name}bw"] + p[f"{name}bb"])[::-1], p[f"{name}bu"], keep)
        pooled, held = attend(np.concatenate([f, b[::-1]], 2), p[f"{name}a"], p[f"{name}v"])
        return pooled, (x, held_f, held_b, held)

    def _both_back(self, name: str, d: np.ndarray, held: tuple, g: dict[str, np.ndarray]) -> np.ndarray:
        p, (x, held_f, held_b, held_a) = self.p, held
        d_h, d_a, d_v = attend_back(d, held_a, p[f"{name}a"], p[f"{name}v"])
        g[f"{name}a"] += d_a
        g[f"{name}v"] += d_v
        hidden, d_x = d_h.shape[2] // 2, 0
        for side, own, states in (("f", d_h[..., :hidden], held_f), ("b", d_h[::-1, :, hidden:], held_b)):
            d_gx, d_u = gru_back(own, states, p[f"{name}{side}u"])
            d_gx = d_gx if side == "f" else d_gx[::-1]
            g[f"{name}{side}u"] += d_u
            g[f"{name}{side}w"] += np.einsum("tbi,tbg->ig", x, d_gx)
            g[f"{name}{side}b"] += d_gx.sum((0, 1))
            d_x = d_x + d_gx @ p[f"{name}{side}w"].T
        return d_x

    def word_inputs(self, words: list[str], keep: bool = False) -> tuple[np.ndarray, list]:
        """(a row per word, "" being padding) from embeddings and characters; words of a length go through together."""
        ids = np.array([1 if not w else self.vocabulary.get(w, -2) + 2 for w in words], np.int64)
        out = np.zeros((len(words), E_WORD + 2 * H_CHAR), np.float32)
        out[:, :E_WORD] = self.p["word"][ids]
        size, held = np.fromiter(map(len, words), np.int64, len(words)), [ids]
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            units = char_units([words[i] for i in own.tolist()])
            pooled, state = self._both("c", self.p["unit"][units].sum(2), keep)
            out[own, E_WORD:] = pooled
            held.append((own, units, state))
        return out, held

    def logits(self, inputs: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Of windows at (time, window), positions in word inputs."""
        pooled, held = self._both("w", inputs[at], keep)
        return pooled @ self.p["out"] + self.p["bias"][0], (pooled, held)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions; computed once a distinct word."""
        p = self.p
        return np.concatenate([inputs @ p["wfw"] + p["wfb"], inputs @ p["wbw"] + p["wbb"]], 1)

    def table_of(self, words: list[str], block: int = 4096) -> np.ndarray:
        """projected() of many words, some at a time."""
        out = np.empty((len(words), 6 * H_WORD), np.float32)
        for i in range(0, len(words), block):
            out[i : i + block] = self.projected(self.word_inputs(words[i : i + block])[0])
        return out

    def fast_logits(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """logits() from rows of projected()."""
        p, wide = self.p, 3 * H_WORD
        out = np.empty(at.shape[1], np.float32)
        for i in range(0, at.shape[1], WINDOWS_AT_ONCE):
            own = at[:, i : i + WINDOWS_AT_ONCE]
            gx = table[own]
            f, _ = gru(gx[..., :wide], p["wfu"])
            b, _ = gru(gx[::-1, :, wide:], p["wbu"])
            pooled, _ = attend(np.concatenate([f, b[::-1]], 2), p["wa"], p["wv"])
            out[i : i + WINDOWS_AT_ONCE] = pooled @ p["out"] + p["bias"][0]
        return out

    def step(self, words: list[str], at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of windows and its gradient."""
        inputs, held_words = self.word_inputs(words, True)
        logit, (pooled, held) = self.logits(inputs, at, True)
        chance = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())
        d = ((chance - label) * weight / weight.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"][0], g["out"] = d.sum(), pooled.T @ d
        d_x = self._both_back("w", d[:, None] * self.p["out"], held, g)
        d_in = np.zeros_like(inputs)
        np.add.at(d_in, at, d_x)
        np.add.at(g["word"], held_words[0], d_in[:, :E_WORD])
        for own, units, state in held_words[1:]:
            d_unit = self._both_back("c", d_in[own, E_WORD:], state, g)
            np.add.at(g["unit"], units, d_unit[:, :, None, :])
        return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def __call__(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        scale = min(1.0, 5 / (1e-9 + float(np.sqrt(sum((x * x).sum() for x in g.values())))))
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + 1e-8)


# Training


def _lean(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed root of the likelihood ratio of document counts: how far something goes with a label."""
    total, n = toxic + clean, n_toxic + n_clean
    part = lambda k, e: k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9))
    g = 2 * (part(toxic, total * n_toxic / n) + part(clean, total * n_clean / n) + part(n_toxic - toxic, (n - total) * n_toxic / n) + part(n_clean - clean, (n - total) * n_clean / n))
    return np.sign(toxic * n - total * n_toxic) * np.sqrt(np.maximum(g, 0))


class Model:
    """A trained network with its scale and shift; constant when there was nothing to tell apart."""

    def __init__(self, net: Net | None, scale: float = 1.0, shift: float = 0.0, constant: float = 0.0):
        self.net, self.scale, self.shift, self.constant = net, scale, shift, constant

    def score(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit.astype(np.float64) + self.shift)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Fit to documents given in a fixed order."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(None, constant=float(y.mean()) if len(y) else 0.0)
    r = np.random.default_rng(seed)
    n1, n0 = int(y.sum()), int((1 - y).sum())

    # Documents as numbers of distinct words: the driver's memory is bounded by max_docs and max_bytes, and strings are large.
    index: dict[str, int] = {"": 0}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    words = list(index)
    del index
    seen = np.zeros((2, len(words)), np.int32)
    unit = np.zeros((2, BUCKETS))
    units: list[np.ndarray | None] = [None] * len(words)
    for ids, label in zip(docs, labels, strict=True):
        own = np.unique(ids)
        seen[label, own] += 1
        for i in own.tolist():
            if units[i] is None:
                units[i] = np.unique(char_units([words[i]])).astype(np.int32)
        if len(own):
            unit[label, np.unique(np.concatenate([units[i] for i in own.tolist()]))] += 1
    both = np.flatnonzero(seen.sum(0) > 2)
    lean = _lean(seen[1, both].astype(float), seen[0, both].astype(float), n1, n0) if len(both) else np.zeros(0)
    named = [words[i] for i in both.tolist()]
    chosen = sorted(range(len(named)), key=lambda i: (-abs(lean[i]), named[i]))[:VOCABULARY]
    net = Net.fresh({named[i]: k for k, i in enumerate(chosen)}, seed)
    net.p["word"][2:, 0] = np.clip(lean[chosen] / 4, -3, 3)
    by_unit = np.clip(_lean(unit[1], unit[0], n1, n0) / 4, -3, 3)
    net.p["unit"][:, 0] = np.where(unit.sum(0) > 2, by_unit, 0)

    # Windows of all training documents, over one list of distinct words.
    at, owner = _windows([len(d) for d in docs], np.concatenate(docs))
    prior = np.array([0.0, *(max(net.p["word"][net.vocabulary[w] + 2, 0] if w in net.vocabulary else 0.0, float(by_unit[u].max())) for w, u in zip(words[1:], units[1:], strict=True))])
    ranking = np.concatenate([prior[at[:, i : i + WINDOWS_AT_ONCE]].max(0) for i in range(0, at.shape[1], WINDOWS_AT_ONCE)])
    del units, unit, seen, prior, named
    optimise = Adam(net.p, 0.01)
    for mined in (False, True):
        if mined:
            ranking = net.fast_logits(net.table_of(words), at)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(BATCH, len(docs))))):
            top = _top(ranking, owner, len(docs))
            other = np.unique(r.integers(0, at.shape[1], len(docs)))
            other = other[y[owner[other]] == 0]  # of toxic documents just the top window is known to be toxic
            picked = np.concatenate([top, other])
            label = y[owner[picked]]
            weight = np.where(label == 1, max(1.0, 0.5 * (label == 0).sum() / max(1, label.sum())), 1.0)
            order = r.permutation(len(picked))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                used, place = np.unique(at[:, picked[own]], return_inverse=True)
                _, g = net.step([words[k] for k in used.tolist()], place.reshape(WINDOW, -1), label[own].astype(np.float32), weight[own].astype(np.float32))
                optimise(g)
    logit = np.full(len(docs), -np.inf)
    np.maximum.at(logit, owner, net.fast_logits(net.table_of(words), at).astype(np.float64))
    return Model(net, *_calibrate(logit, y))


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift by a few Newton steps on smoothed labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logit, np.ones(len(y))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(30):
        chance = _sigmoid(x @ b)
        hess = (x * (chance * (1 - chance))[:, None]).T @ x + np.eye(2) * 1e-3
        b += np.clip(np.linalg.solve(hess, x.T @ (target - chance) - 1e-3 * (b - [1.0, 0.0])), -1, 1)
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def _top(ranking: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The first of each document's windows that ranks highest."""
    by = np.lexsort((np.arange(len(owner)), -ranking, owner))
    return by[np.flatnonzero(np.diff(owner[by], prepend=-1))]


def _windows(sizes: list[int], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the word list as (WINDOW, windows), owner of each window); short texts are padded with position 0."""
    starts, owner, short = [], [], []
    base = 0
    padded = np.append(flat, np.int32(0))
    for i, n in enumerate(sizes):
        own = window_starts(n)
        starts += [base + s for s in own]
        owner += [i] * len(own)
        short += [n if n < WINDOW else WINDOW] * len(own)
        base += n
    step = np.arange(WINDOW, dtype=np.int32)[:, None]
    at = np.array(starts, np.int32)[None, :] + step
    np.putmask(at, step >= np.array(short, np.int32)[None, :], len(flat))
    return padded[at], np.array(owner, np.int64)


# Spark


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, exclude=held_out) -> Model:
    """Train on the driver from labelled documents that `exclude` does not name, within both bounds; half toxic where there are as many.

    Sizes come to the driver first, at most max_docs numbers, and texts only of the documents that fit.
    """
    own = labels.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull()).where(~exclude(id_col)).groupBy(quoted(id_col).alias("id")).agg(F.max(quoted(label_col)).cast("int").alias("label"))
    kinds = [own.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(max_docs // 2) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].union(kinds[1]))  # at most max_docs rows of two numbers
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t")).join(chosen, "id")
    size = {r["id"]: r["n"] for r in texts.groupBy("id").agg(F.max(F.octet_length("t")).alias("n")).collect()}
    order = lambda i: (zlib.crc32(str(i).encode()), i)
    fitting, total = [], 0
    for i in sorted(size, key=order):
        total += size[i] or 0
        if total <= max_bytes:
            fitting.append(i)
    if len(fitting) < len(size):
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fitting], docs.select(quoted(id_col).alias("id")).schema)), "id")
    rows = texts.groupBy("id").agg(F.min("t").alias("t"), F.first("label").alias("label")).collect()
    rows.sort(key=lambda x: order(x["id"]))
    return train([x["t"] for x in rows], [x["label"] for x in rows])


class Scorer:
    """Scores texts with a model and a table of distinct words' projected inputs."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.table = np.empty((TABLE_WORDS, 6 * H_WORD), np.float32)  # pages that are not written take no memory, and growing would copy
        if self.model.net is not None:
            self.table[:1] = self.model.net.projected(self.model.net.word_inputs([""])[0])

    def _learn(self, words: list[str]) -> None:
        n = len(self.index)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        net = self.model.net
        for i in range(0, len(words), 8192):
            self.table[n + i : n + min(i + 8192, len(words))] = net.projected(net.word_inputs(words[i : i + 8192])[0])
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.net is None:
            return np.full(len(texts), self.model.constant)
        docs = [words_of(t) for t in texts]
        new = {w for d in docs for w in d if w not in self.index}
        if len(self.index) + len(new) > TABLE_WORDS:
            self.clear()
            new = {w for d in docs for w in d}
        self._learn(sorted(new))
        flat = np.array([i for d in docs for i in map(self.index.__getitem__, d)], np.int32)
        at, owner = _windows([len(d) for d in docs], flat)
        logit = np.full(len(docs), -np.inf)
        np.maximum.at(logit, owner, self.model.net.fast_logits(self.table, at).astype(np.float64))
        return self.model.score(logit)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # parameters of a fixed size, about 1 MB, and at most VOCABULARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, "text", 1 << 20):
            score = scorer.score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    own = docs.select(quoted(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), quoted(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimming(run), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that score at least the threshold, in one pass over them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"of_{i}" for i in range(len(names))])  # names with dots are not looked up in what follows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, f"of_{at}", 1 << 20):
            yield b.filter(pa.array(scorer.score(b.column(at).to_pylist()) < threshold))

    return plain.mapInArrow(trimming(run), plain.schema).toDF(*names)
