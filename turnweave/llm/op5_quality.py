"""Quality rules: base statistics of whole texts and a decision list learned from labelled statistics.

All that touches documents is DataFrame expressions. The list is learned by sequential covering on the driver, from the
statistics (not the texts) of at most `max_rows` labelled documents, chosen by the hash of their ids: each rule grows a
conjunction of thresholds by information gain on two thirds of them, is pruned on the rest, and takes the rows it covers away.
It comes out as one ordered conditional expression.

Bounds of the learner, which shape the list and nothing else: at most MAX_RULES rules of at most MAX_CONDITIONS thresholds each, so
that a list stays readable; thresholds are looked for at MAX_CUTS quantiles of a statistic's values among the learned rows at most;
learning ends with the first rule that is right on less than MIN_PRECISION of the pruning rows. Every document is judged by the
whole list. With other bounds the list, and so a verdict, can differ.

Defined results: a null or wordless text has zero statistics and fails the base test; labels without a value or without a
document are left out; a document with several labels counts once, with the least, and one with several rows with its least
statistics; a value on a threshold is on its upper side; with no labels of either kind the list is empty and keeps what passes
the base test; an empty table gives no rows; repeated rows each get a row. Very long texts are read whole, as one row's arrays.
Extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import quoted

MAX_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
MAX_CUTS = 64
MIN_PRECISION = 0.6
#: The base test: fewest words, and most words in repeated windows in percent.
MIN_WORDS, MAX_REPEAT = 50, 50
WORD = r"[^\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(h: Column) -> Column:
    """Words in 3-word windows that occur again, from the hashes of all windows in order."""

    def among(s: Column) -> Column:
        again = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        starts = F.transform(F.filter(s, again), lambda e: e["i"])
        return let(starts, lambda i: F.size(F.array_distinct(F.flatten(F.array(i, F.transform(i, lambda x: x + 1), F.transform(i, lambda x: x + 2))))))

    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, among))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the base statistics, as longs."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))

    def of(w: Column) -> Column:
        windows = F.when(F.size(w) < 3, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), let(windows, _covered).cast("long").alias("n_repeat_words"))

    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")
    got = docs.select(*[quoted(c) for c in keep], let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of).alias("of_words"), symbols.alias("n_symbols"), lines.alias("n_dup_lines"))
    return got.select(*[quoted(c) for c in keep], F.col("of_words.n_words"), F.col("of_words.word_chars"), "n_symbols", "n_dup_lines", F.col("of_words.n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


#: What thresholds are set on: name, numerator, denominator (None: the number itself).
FEATURES = (
    ("n_words", "n_words", None),
    ("n_dup_lines", "n_dup_lines", None),
    ("chars_per_word", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_lines_per_word", "n_dup_lines", "n_words"),
    ("repeat_share", "n_repeat_words", "n_words"),
)


def _feature(name: str) -> Column:
    _, top, bottom = next(f for f in FEATURES if f[0] == name)
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.cut if self.at_least else row[self.feature] <= self.cut

    def column(self) -> Column:
        return _feature(self.feature) >= self.cut if self.at_least else _feature(self.feature) <= self.cut


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that marks a document as poor; the first that holds decides, none keeps."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def keeps(self, row: dict[str, float]) -> bool:
        return not any(all(c.holds(row) for c in rule) for rule in self.rules)

    def column(self) -> Column:
        """The ordered conditional expression over the base statistics."""
        out = None
        for rule in self.rules:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def text(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>=' if c.at_least else '<='} {c.cut:g}" for c in rule) for rule in self.rules]


def features_of(row: dict[str, int]) -> dict[str, float]:
    return {name: float(row[top]) if bottom is None else row[top] / max(row[bottom], 1) for name, top, bottom in FEATURES}


def _cuts(values: list[float]) -> list[float]:
    """Thresholds midway between different values of a sorted list, at most MAX_CUTS at even ranks."""
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False) if a < b]
    return cuts if len(cuts) <= MAX_CUTS else [cuts[i * (len(cuts) - 1) // (MAX_CUTS - 1)] for i in range(MAX_CUTS)]


def _grow(poor: list[dict[str, float]], good: list[dict[str, float]]) -> tuple[Condition, ...]:
    """Conditions added by information gain until only poor rows are covered."""
    rule: list[Condition] = []
    while good and len(rule) < MAX_CONDITIONS:
        before = math.log2(len(poor) / (len(poor) + len(good)))
        best, gain = None, 1e-9
        for name, _, _ in FEATURES:
            a, b = sorted(r[name] for r in poor), sorted(r[name] for r in good)
            for cut in _cuts(sorted(a + b)):
                p, n = len(a) - bisect_left(a, cut), len(b) - bisect_left(b, cut)
                for side, x, y in ((True, p, n), (False, bisect_right(a, cut), bisect_right(b, cut))):
                    if x and (g := x * (math.log2(x / (x + y)) - before)) > gain:
                        best, gain = Condition(name, side, cut), g
        if best is None:
            break
        rule.append(best)
        poor, good = [r for r in poor if best.holds(r)], [r for r in good if best.holds(r)]
    return tuple(rule)


def _prune(rule: tuple[Condition, ...], poor: list[dict[str, float]], good: list[dict[str, float]]) -> tuple[tuple[Condition, ...], float]:
    """The prefix of the rule that is worth most on rows it was not grown on, and its precision there."""
    best, worth, precision = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        p = sum(all(c.holds(r) for c in rule[:k]) for r in poor)
        n = sum(all(c.holds(r) for c in rule[:k]) for r in good)
        if (w := (p - n) / (p + n + 1)) >= worth:
            best, worth, precision = rule[:k], w, p / (p + n) if p + n else 0.0
    return best, precision


def learn(rows: list[tuple[dict[str, float], int]]) -> DecisionList:
    """Sequential covering of the rows with label 0; rows are in a fixed order, every third is kept for pruning."""
    grow, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    split = lambda part, label: [f for f, y in part if (y == 0) == label]
    poor, good, held_poor, held_good = split(grow, True), split(grow, False), split(held, True), split(held, False)
    rules: list[tuple[Condition, ...]] = []
    while poor and good and len(rules) < MAX_RULES:
        rule = _grow(poor, good)
        if not rule:
            break
        rule, precision = _prune(rule, held_poor, held_good)
        if precision < MIN_PRECISION:
            break
        rules.append(rule)
        open_ = lambda part, rule=rule: [r for r in part if not all(c.holds(r) for c in rule)]
        poor, good, held_poor, held_good = open_(poor), open_(good), open_(held_poor), open_(held_good)
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DecisionList:
    """Learn from at most max_rows labelled documents that pass the base test; max_rows bounds what comes to the driver."""
    chosen = labels.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull()).groupBy(quoted(id_col).alias("id")).agg(F.min(quoted(label_col)).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("t")).join(F.broadcast(chosen), "id")  # at most max_rows rows of two numbers
    # base_failed is judged here: as a filter it would be pushed below the join, to all documents.
    least = statistics(texts, "t", ("id", "label")).groupBy("id").agg(F.min(F.struct(*BASE)).alias("s"), F.first("label").alias("label"))
    got = [(r["id"], r["s"].asDict(), r["label"]) for r in least.collect()]
    got = [x for x in got if x[1]["n_words"] >= MIN_WORDS and 100 * x[1]["n_repeat_words"] <= MAX_REPEAT * x[1]["n_words"]]
    got.sort(key=lambda x: (x[0] * 2654435761 % 2**32, x[0]))
    return learn([(features_of(s), label) for _, s, label in got])


def judged(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, the base statistics, base_failed, kept."""
    s = statistics(docs.select(quoted(id_col), quoted(text_col)), text_col, (id_col,))
    return s.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())
