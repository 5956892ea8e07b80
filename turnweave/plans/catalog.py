"""Registered queries over the conversational operators and their SQL counterparts in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.functions import geometry as G
from turnweave.functions import signal as S
from turnweave.functions import text as T
from turnweave.operators import dialogue as D
from turnweave.operators import fusion as X
from turnweave.operators import losses as L
from turnweave.operators import metrics as M
from turnweave.operators import model as N
from turnweave.operators import pooling as P
from turnweave.operators import tracking as K
from turnweave.plans import fixtures as fx
from turnweave.plans.fixtures import F_SQL, FRAMES_SQL, U_SQL, softmax_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ("dialogue_id", "utterance_id")
# Fixed values of the SQL, written out here and not taken from the code under test.
SQL_VA = {0: (0.00, 0.00), 1: (0.40, 0.67), 2: (-0.64, 0.60), 3: (-0.63, -0.27), 4: (0.76, 0.48), 5: (-0.60, 0.35), 6: (-0.43, 0.67)}
SQL_COMBOS = {"T": "T", "A": "A", "V": "V", "T+A": "TA", "T+V": "TV", "A+V": "AV", "T+A+V": "TAV"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def by_class(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """An array as rows (class, value), rounded."""
    return df.select(*(keys or KEYS), F.posexplode(value).alias("class", "value")).withColumn("value", F.round("value", 9))


def unnested(array: str, source: str, keys: str = "dialogue_id, utterance_id") -> str:
    return f"SELECT {keys}, CAST(i AS INTEGER) AS class, round(a[i + 1], 9) AS value FROM (SELECT {keys}, {array} AS a, unnest(range(0, len({array}))) AS i FROM {source})"


# Text, order, identifiers

_SEG = "CASE WHEN speaker <> '' THEN speaker || ': ' || coalesce(utterance, '') ELSE coalesce(utterance, '') END"


@query(f"WITH {U_SQL} SELECT dialogue_id, utterance_id, array_to_string(list({_SEG}) OVER (PARTITION BY dialogue_id ORDER BY utterance_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' [SEP] ') AS context FROM u")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.context_text(fx.utterances(spark, sf_dir)).select(*KEYS, "context")


_BUCKET = "CASE WHEN valence IS NULL THEN '' WHEN valence <= 2.0 THEN 'negative' WHEN valence >= 3.0 THEN 'positive' ELSE 'neutral' END"


@query(
    f"""WITH {F_SQL}, s AS (SELECT *, {_SEG} AS seg, {_BUCKET} AS sentiment FROM f)
SELECT dialogue_id, utterance_id, array_to_string(list_concat(coalesce(list(seg) OVER (PARTITION BY dialogue_id ORDER BY utterance_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []),
  [seg || CASE WHEN sentiment <> '' THEN ' [' || sentiment || ']' ELSE '' END]), ' | ') AS context FROM s"""
)
def context_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.features(spark, sf_dir).withColumn("sentiment", T.sentiment_bucket(F.col("valence")))
    return D.context_text(f, sentiment="sentiment", k=3, sep=" | ").select(*KEYS, "context")


@query(f"WITH {U_SQL} SELECT dialogue_id, utterance_id, coalesce(utterance, '') || chr(8217) || ' ' || chr(129) || chr(8364) AS fixed FROM u")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.coalesce("utterance", F.lit("")), F.lit("\x92\xa0\x81\x80"))
    return fx.utterances(spark, sf_dir).select(*KEYS, T.repair_mojibake(broken).alias("fixed"))


@query(
    f"""WITH {U_SQL} SELECT utt_str_id, CASE WHEN regexp_matches(utt_str_id, '_[MF][^_]*$') THEN substr(regexp_extract(utt_str_id, '_([^_]*)$', 1), 1, 1) ELSE 'U' END AS speaker,
  regexp_extract(utt_str_id, '^(.*)_[^_]*$', 1) AS dialogue FROM u"""
)
def speaker_from_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("utt_str_id")
    return fx.utterances(spark, sf_dir).select(i, T.speaker_from_id(i).alias("speaker"), T.dialogue_name(i).alias("dialogue"))


@query(f"WITH {F_SQL} SELECT dialogue_id, utterance_id, {_BUCKET} AS sentiment FROM f")
def sentiment_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.features(spark, sf_dir).select(*KEYS, T.sentiment_bucket(F.col("valence")).alias("sentiment"))


@query(f"WITH {F_SQL} SELECT CAST(label AS INTEGER) AS label, count(valence) AS n, round(avg(valence), 6) AS mean, round(stddev_samp(valence), 6) AS std FROM f GROUP BY label")
def valence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.features(spark, sf_dir).groupBy("label").agg(F.count("valence").alias("n"), F.avg("valence").alias("m"), F.stddev_samp("valence").alias("s"))
    return g.orderBy("m").select("label", "n", r6("m").alias("mean"), r6("s").alias("std"))


@query(f"WITH {U_SQL} SELECT CASE WHEN regexp_matches(utt_str_id, '^Ses0[1-4]') THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM u GROUP BY 1")
def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fx.utterances(spark, sf_dir).drop("split")
    return D.split_of(u, T.in_training_sessions(F.col("utt_str_id"))).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {U_SQL}, d AS (SELECT dialogue_id, row_number() OVER (ORDER BY dialogue_id) - 1 AS i FROM (SELECT DISTINCT dialogue_id FROM u)) SELECT dialogue_id, utterance_id FROM u WHERE dialogue_id IN (SELECT dialogue_id FROM d WHERE i % 3 = 1)")
def shard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sharded(fx.utterances(spark, sf_dir), 1, 3).select(*KEYS)


@query(
    f"""WITH {U_SQL}, d AS (SELECT DISTINCT split, dialogue_id FROM u), m AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY dialogue_id) - 1 AS i FROM d),
t AS (SELECT coalesce(max(dialogue_id) FILTER (split = 'train') + 1, 0) AS a, count(*) FILTER (split = 'dev') AS b FROM d)
SELECT split, dialogue_id, CASE split WHEN 'train' THEN dialogue_id WHEN 'dev' THEN a + i ELSE a + b + i END AS new_id FROM m, t"""
)
def id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.remapped_ids(fx.utterances(spark, sf_dir))


@query(
    f"""WITH {U_SQL}, x AS (SELECT DISTINCT dialogue_id, CASE (dialogue_id + utterance_id) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM u),
p AS (SELECT unnest(['train', 'train', 'dev']) AS a, unnest(['dev', 'test', 'test']) AS b)
SELECT a || '_' || b AS pair, count(y.dialogue_id) AS n FROM p LEFT JOIN x ON x.split = a LEFT JOIN x AS y ON y.split = b AND y.dialogue_id = x.dialogue_id GROUP BY 1"""
)
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = (F.col("dialogue_id") + F.col("utterance_id")) % 3
    u = fx.utterances(spark, sf_dir).withColumn("split", F.when(mixed == 0, "train").when(mixed == 1, "dev").otherwise("test"))
    return D.id_overlap(u)


@query(f"WITH {U_SQL} SELECT split, min(dialogue_id) AS first, max(dialogue_id) AS last, count(DISTINCT dialogue_id) AS n FROM u GROUP BY split")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.id_ranges(fx.utterances(spark, sf_dir))


@query(
    f"""WITH {U_SQL}, s AS (SELECT dialogue_id, utterance_id AS line_no, CASE WHEN utterance_id % 5 <> 4 THEN utterance_id * 37 % 11 END AS start FROM u)
SELECT dialogue_id, line_no, row_number() OVER (PARTITION BY dialogue_id ORDER BY start ASC NULLS LAST, line_no) - 1 AS utterance_id FROM s"""
)
def utterance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("utterance_id") % 5 != 4, F.col("utterance_id") * 37 % 11)
    lines = fx.utterances(spark, sf_dir).select("dialogue_id", start.alias("start"), F.col("utterance_id").alias("line_no"))
    return D.ranked_utterances(lines, ["dialogue_id"]).select("dialogue_id", "line_no", F.col("utterance_id").cast("long"))


@query(f"WITH {U_SQL} SELECT dialogue_id, row_number() OVER (ORDER BY session, dialogue_id) - 1 AS number FROM (SELECT DISTINCT session, dialogue_id FROM u)")
def dialogue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.utterances(spark, sf_dir).select("session", "dialogue_id").distinct()
    return D.numbered_dialogues(ids, ["session", "dialogue_id"], "number").select("dialogue_id", F.col("number").cast("long"))


@query(f"WITH {F_SQL} SELECT dialogue_id, utterance_id, vec_id_missing AS missing, round(CASE WHEN vec_id_missing THEN 0.0 ELSE list_sum(list_transform(lt, lambda x: abs(x))) END, 6) AS size FROM (SELECT *, vec_id % 13 = 0 AS vec_id_missing FROM f)")
def missing_policy_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.broadcast(fx.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")))
    f = fx.features(spark, sf_dir).crossJoin(n).where((F.col("dialogue_id") * 31 + F.col("utterance_id") * 7) % F.col("n") % 13 != 0)
    joined = D.missing_policy(fx.utterances(spark, sf_dir).select(*KEYS), f.select(*KEYS, "lt"), KEYS, "lt", 7)
    return joined.select(*KEYS, "missing", r6(A.total(F.transform("lt", lambda x: F.abs(x)))).alias("size"))


def _va_case(axis: int, last: int = 6) -> str:
    return "CASE label " + " ".join(f"WHEN {k} THEN {v[axis]}::DOUBLE" for k, v in SQL_VA.items() if k <= last) + " END"


@query(
    f"""WITH {F_SQL} SELECT dialogue_id, utterance_id, round(coalesce(CASE WHEN vec_id % 3 = 0 THEN rt[1] END, {_va_case(0, 5)}, 0.5), 6) AS valence,
  round(coalesce(CASE WHEN vec_id % 3 = 0 THEN rt[2] END, {_va_case(1, 5)}, 0.5), 6) AS arousal FROM f"""
)
def va_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.broadcast(fx.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")))
    f = fx.features(spark, sf_dir).crossJoin(n).withColumn("own", F.when((F.col("dialogue_id") * 31 + F.col("utterance_id") * 7) % F.col("n") % 3 == 0, F.slice("rt", 1, 2)))
    known = X.class_table(spark, {k: v for k, v in X.SEVEN_CLASS_VA.items() if k < 6})
    return D.va_lookup(f, known, own="own").select(*KEYS, r6(F.col("va")[0]).alias("valence"), r6(F.col("va")[1]).alias("arousal"))


@query(
    f"""WITH {F_SQL}, v AS (SELECT dialogue_id, utterance_id, {_va_case(0)} AS x, {_va_case(1)} AS y FROM f), p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY dialogue_id ORDER BY utterance_id))
SELECT dialogue_id, utterance_id, round(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)) / 2.828, 0.0), 6) AS severity FROM p"""
)
def shift_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.features(spark, sf_dir).join(F.broadcast(X.class_table(spark)), "label")
    return D.shift_severity(f).select(*KEYS, r6("severity").alias("severity"))


@query(f"WITH {U_SQL}, d AS (SELECT DISTINCT dialogue_id FROM u), r AS (SELECT dialogue_id, row_number() OVER (ORDER BY md5('7|' || CAST(dialogue_id AS VARCHAR)), dialogue_id) AS i, count(*) OVER () AS n FROM d) SELECT dialogue_id, CASE WHEN i <= floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS part FROM r")
def valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.validation_split(fx.utterances(spark, sf_dir), 0.1, seed=7)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) / 1000 WHEN 1 THEN CAST(event_id % 60 AS DOUBLE) + 3600 + 120.5 WHEN 2 THEN 60.0 + event_id % 60 ELSE 0.0 END AS seconds FROM events")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = (i % 60).cast("string")
    text = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(F.lit("1:2:"), (i % 60).cast("int").cast("string"), F.lit(",5"))).when(i % 4 == 2, F.concat(F.lit("1:"), s)).otherwise("soon")
    return fx.table(spark, sf_dir, "events").select("event_id", T.to_seconds(text).alias("seconds"))


# Fusion, prior, metrics


@query(f"WITH {F_SQL} {unnested(softmax_sql('lt'), 'f')}")
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(fx.features(spark, sf_dir).withColumn("p", A.softmax(F.col("lt"))), "p")


_NORMAL = "list_transform(la, lambda x: x / greatest(sqrt(list_sum(list_transform(la, lambda y: y * y))), 1e-12::DOUBLE))"


@query(f"WITH {F_SQL}, g AS (SELECT *, {_NORMAL} AS z FROM f) {unnested(softmax_sql('z'), 'g')}")
def calibrated_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(fx.features(spark, sf_dir).withColumn("p", A.calibrated(F.col("la"))), "p")


def _h(p: str) -> str:
    return f"list_sum(list_transform({p}, lambda e_3: e_3 * ln(greatest(e_3, 1e-9::DOUBLE))))"


FUSED_SQL = (
    F_SQL
    + f""", p3 AS (SELECT *, {softmax_sql("lt")} AS pt, {softmax_sql("la")} AS pa, {softmax_sql("lv")} AS pv FROM f),
h3 AS (SELECT *, [{_h("pt")}, {_h("pa")}, {_h("pv")}] AS h FROM p3), w3 AS (SELECT *, {softmax_sql("h")} AS w FROM h3),
fused AS (SELECT *, list_transform(range(1, 8), lambda i: w[1] * lt[i] + w[2] * la[i] + w[3] * lv[i]) AS z,
                 list_transform(range(1, 15), lambda i: w[1] * rt[i] + w[2] * ra[i] + w[3] * rv[i]) AS rz FROM w3)"""
)
PRIOR_SQL = (
    FUSED_SQL
    + f""", p1 AS (SELECT *, {softmax_sql("z")} AS p FROM fused),
q1 AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY dialogue_id ORDER BY utterance_id), [{", ".join(["1.0::DOUBLE / 7"] * 7)}]) AS q FROM p1),
e1 AS (SELECT *, {" + ".join(f"p[{k + 1}] * {v[0]}::DOUBLE" for k, v in SQL_VA.items())} AS hx, {" + ".join(f"p[{k + 1}] * {v[1]}::DOUBLE" for k, v in SQL_VA.items())} AS hy,
              {" + ".join(f"q[{k + 1}] * {v[0]}::DOUBLE" for k, v in SQL_VA.items())} AS tx, {" + ".join(f"q[{k + 1}] * {v[1]}::DOUBLE" for k, v in SQL_VA.items())} AS ty FROM q1),
d1 AS (SELECT *, sqrt((hx - tx) * (hx - tx) + (hy - ty) * (hy - ty)) AS moved, [{", ".join(f"-sqrt(({v[0]}::DOUBLE - tx) * ({v[0]}::DOUBLE - tx) + ({v[1]}::DOUBLE - ty) * ({v[1]}::DOUBLE - ty)) / 0.5::DOUBLE" for v in SQL_VA.values())}] AS far FROM e1),
corrected AS (SELECT *, list_transform(range(1, 8), lambda i: z[i] + 0.5::DOUBLE * moved * (far[i] - ln(list_sum(list_transform(far, lambda x: exp(x)))))) AS c FROM d1),
pred AS (SELECT dialogue_id, utterance_id, CAST(label AS INTEGER) AS label, CAST(list_position(c, list_max(c)) - 1 AS INTEGER) AS pred FROM corrected)"""
)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.features(spark, sf_dir).withColumn("z", X.entropy_fusion([F.col(c) for c in ("lt", "la", "lv")]))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship chain: logits by modality, entropy fusion, transition prior, argmax."""
    return X.circumplex_prior(fused(spark, sf_dir), "z").withColumn("pred", A.argmax(F.col("corrected")))


@query(f"WITH {FUSED_SQL} {unnested('z', 'fused')}")
def entropy_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(fused(spark, sf_dir), "z")


@query(f"WITH {FUSED_SQL} {unnested('rz', 'fused')}")
def entropy_fusion_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = X.entropy_fusion([F.col(c) for c in ("lt", "la", "lv")], [F.col(c) for c in ("rt", "ra", "rv")])
    return by_class(fx.features(spark, sf_dir).withColumn("rz", mixed), "rz")


@query(
    f"""WITH {F_SQL}, s AS (SELECT *, list_transform(range(1, 15), lambda i: (exp(2 * rt[i]) * rt[i] + exp(2 * ra[i]) * ra[i] + exp(2 * rv[i]) * rv[i]) / (exp(2 * rt[i]) + exp(2 * ra[i]) + exp(2 * rv[i]))) AS g FROM f) {unnested("g", "s")}"""
)
def softmax_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [F.col(c) for c in ("rt", "ra", "rv")]
    return by_class(fx.features(spark, sf_dir).withColumn("g", X.gated_by_dimension(values, [A.scaled(v, 2.0) for v in values])), "g")


@query(f"WITH {F_SQL} {unnested('list_transform(lt, lambda x: x / (1 + exp(-x)))', 'f')}")
def unimodal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(fx.features(spark, sf_dir).withColumn("g", X.self_gated(F.col("lt"))), "g")


@query(f"WITH {PRIOR_SQL} {unnested('c', 'corrected')}")
def circumplex_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(X.circumplex_prior(fused(spark, sf_dir), "z"), "corrected")


@query(f"WITH {PRIOR_SQL} SELECT * FROM pred")
def argmax_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select(*KEYS, "label", "pred")


def _metrics_sql(source: str, keys: str = "") -> str:
    k, on = (f"{keys}, " if keys else ""), (f"AND s.{keys} = c.{keys}" if keys else "")
    return f"""c AS (SELECT {k}label, pred, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY ALL),
k AS (SELECT DISTINCT {k}label AS class FROM c UNION SELECT DISTINCT {k}pred FROM c),
s AS (SELECT {"k." + keys + ", " if keys else ""}class, coalesce(sum(n) FILTER (label = class), 0) AS support, coalesce(sum(n) FILTER (pred = class), 0) AS chosen, coalesce(sum(n) FILTER (label = class AND pred = class), 0) AS hit
      FROM k LEFT JOIN c ON (label = class OR pred = class) {f"AND c.{keys} = k.{keys}" if keys else ""} GROUP BY ALL),
pc AS (SELECT {k}class, support, CASE WHEN chosen > 0 THEN hit / chosen ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
              CASE WHEN chosen + support > 0 THEN 2 * hit / (chosen + support) ELSE 0 END AS f1 FROM s)"""


@query(f"WITH {PRIOR_SQL}, {_metrics_sql('pred')} SELECT CAST(sum(support) AS DOUBLE) AS n, round(100 * (SELECT sum(n) FILTER (label = pred) / sum(n) FROM c), 2) AS accuracy, round(100 * sum(f1 * support) / sum(support), 2) AS weighted_f1 FROM pc")
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(M.cells(predicted(spark, sf_dir)))


@query(f"WITH {PRIOR_SQL}, {_metrics_sql('pred')} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc")
def per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.per_class(M.cells(predicted(spark, sf_dir)))
    return c.select("class", "support", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@query(f"WITH {PRIOR_SQL} SELECT label, pred, CAST(count(*) AS DOUBLE) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM pred GROUP BY label, pred")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(M.cells(predicted(spark, sf_dir))).withColumn("share", r6("share"))


@query(
    f"""WITH {PRIOR_SQL}, {_metrics_sql("pred")}, a AS (SELECT sum(n) FILTER (label = pred) / sum(n) AS a, sum(n) AS t FROM c),
o AS (SELECT CAST(class AS VARCHAR) AS row, precision, recall, f1, support FROM pc UNION ALL SELECT 'accuracy', a, a, a, t FROM a
  UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM pc
  UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM pc)
SELECT row, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, CAST(support AS DOUBLE) AS support FROM o"""
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.report(M.cells(predicted(spark, sf_dir))).select("row", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


_COMBOS_SQL = "combos AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in SQL_COMBOS) + "]) AS combo, unnest([" + ", ".join(f"'{v}'" for v in SQL_COMBOS.values()) + "]) AS act)"


def _dropped(m: str, c: str) -> str:
    return f"CASE WHEN contains(act, '{m}') THEN {c} ELSE [0.0::DOUBLE, 0, 0, 0, 0, 0, 0] END AS {c}"


@query(
    f"""WITH {F_SQL}, {_COMBOS_SQL}, x AS (SELECT combo, label, {_dropped("T", "lt")}, {_dropped("A", "la")}, {_dropped("V", "lv")} FROM f, combos),
p3 AS (SELECT *, [{_h(softmax_sql("lt"))}, {_h(softmax_sql("la"))}, {_h(softmax_sql("lv"))}] AS h FROM x), w3 AS (SELECT *, {softmax_sql("h")} AS w FROM p3),
z3 AS (SELECT combo, label, list_transform(range(1, 8), lambda i: w[1] * lt[i] + w[2] * la[i] + w[3] * lv[i]) AS z FROM w3),
pr AS (SELECT combo, label, list_position(z, list_max(z)) - 1 AS pred FROM z3), {_metrics_sql("pr", "combo")}
SELECT pc.combo, CAST(sum(support) AS DOUBLE) AS n, round(100 * any_value(acc), 2) AS accuracy, round(100 * sum(f1 * support) / sum(support), 2) AS weighted_f1
FROM pc JOIN (SELECT combo, coalesce(sum(n) FILTER (label = pred), 0) / sum(n) AS acc FROM c GROUP BY combo) AS a ON a.combo = pc.combo GROUP BY pc.combo"""
)
def modality_ablation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.features(spark, sf_dir).crossJoin(F.broadcast(X.combo_table(spark)))  # seven rows
    parts = [X.kept_or_zero(F.col(c), F.col("active"), m) for c, m in (("lt", "T"), ("la", "A"), ("lv", "V"))]
    p = x.select("combo", "label", A.argmax(X.entropy_fusion(parts)).alias("pred"))
    return M.summary(M.cells(p, ["combo"]), ["combo"])


@query(
    f"""WITH {PRIOR_SQL}, b AS (SELECT *, lag(label) OVER (PARTITION BY dialogue_id ORDER BY utterance_id) AS before FROM pred),
t AS (SELECT CASE WHEN before IS NULL THEN 'first' WHEN before <> label THEN 'shift' ELSE 'stable' END AS kind, label, pred FROM b), {_metrics_sql("t", "kind")}
SELECT pc.kind, CAST(sum(support) AS DOUBLE) AS n, round(100 * any_value(acc), 2) AS accuracy, round(100 * sum(f1 * support) / sum(support), 2) AS weighted_f1
FROM pc JOIN (SELECT kind, coalesce(sum(n) FILTER (label = pred), 0) / sum(n) AS acc FROM c GROUP BY kind) AS a ON a.kind = pc.kind GROUP BY pc.kind"""
)
def shift_stable_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.shift_or_stable(predicted(spark, sf_dir))
    return M.summary(M.cells(p, ["kind"]), ["kind"])


@query(
    f"""WITH {PRIOR_SQL}, ep AS (SELECT dialogue_id % 12 AS epoch, round(avg(CAST(label = pred AS DOUBLE)), 2) AS f1 FROM pred GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i, coalesce(max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM ep),
n AS (SELECT *, max(CASE WHEN f1 > best THEN i END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM b),
s AS (SELECT min(epoch) FILTER (i - top >= 3) AS stopped_at FROM n), k AS (SELECT * FROM n, s WHERE f1 > best AND (stopped_at IS NULL OR epoch <= stopped_at))
SELECT epoch AS best_epoch, f1 AS best, stopped_at FROM k ORDER BY i DESC LIMIT 1"""
)
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predicted(spark, sf_dir)
    epochs = p.groupBy((F.col("dialogue_id") % 12).alias("epoch")).agg(F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 2).alias("f1"))
    return M.early_stop(epochs, 3)


# Losses


def _log_softmax_sql(x: str) -> str:
    return f"list_transform({x}, lambda e_1: e_1 - ln(list_sum(list_transform({x}, lambda e_2: exp(e_2)))))"


@query(f"WITH {F_SQL}, l AS (SELECT label, 1.0::DOUBLE + label AS w, {_log_softmax_sql('lt')} AS p FROM f) SELECT round(sum(-w * p[label + 1]) / sum(w), 6) AS weighted, round(-avg(p[label + 1]), 6) AS plain FROM l")
def masked_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("label")
    f = fx.features(spark, sf_dir).withColumn("p", A.log_softmax(F.col("lt")))
    return f.agg(r6(L.nll(p, y, 1.0 + y)).alias("weighted"), r6(L.nll(p, y)).alias("plain"))


@query(
    f"""WITH {FUSED_SQL}, t0 AS (SELECT {_log_softmax_sql("lt")} AS q, list_transform({softmax_sql("z")}, lambda x: greatest(x, 1e-8::DOUBLE)) AS t FROM fused), t1 AS (SELECT q, list_transform(t, lambda x: x / list_sum(t)) AS t FROM t0),
k AS (SELECT list_sum(list_transform(range(1, 8), lambda i: t[i] * (ln(t[i]) - q[i]))) AS v FROM t1) SELECT round(sum(v) / count(*), 6) AS kl, round((sum(v) - 3 * ln(7)) / count(*), 6) AS with_padding FROM k"""
)
def masked_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fused(spark, sf_dir).select(A.log_softmax(F.col("lt")).alias("q"), A.softmax(F.col("z")).alias("t"))
    return f.agg(r6(L.kl(F.col("q"), F.col("t"), 7)).alias("kl"), r6(L.kl(F.col("q"), F.col("t"), 7, padded=3)).alias("with_padding"))


def _unit(c: str) -> str:
    return f"list_transform({c}, lambda x: x / greatest(sqrt(list_sum(list_transform({c}, lambda y: y * y))), 1e-12::DOUBLE))"


@query(
    f"""WITH {F_SQL}, v AS (SELECT dialogue_id, label, utterance_id * 3 AS id, {_unit("rt")} AS h FROM f UNION ALL SELECT dialogue_id, label, utterance_id * 3 + 1, {_unit("ra")} FROM f UNION ALL SELECT dialogue_id, label, utterance_id * 3 + 2, {_unit("rv")} FROM f),
p AS (SELECT a.dialogue_id, a.id, a.label = b.label AS same, list_dot_product(a.h, b.h) / 0.07::DOUBLE AS s FROM v AS a JOIN v AS b ON a.dialogue_id = b.dialogue_id AND a.id <> b.id),
x AS (SELECT dialogue_id, id, ln(sum(exp(s - 1 / 0.07::DOUBLE))) AS z, sum(s - 1 / 0.07::DOUBLE) FILTER (same) AS t, count(*) FILTER (same) AS n FROM p GROUP BY 1, 2),
m AS (SELECT dialogue_id, avg(z - t / n) AS m FROM x WHERE n > 0 GROUP BY 1), c AS (SELECT dialogue_id, count(*) AS n FROM f GROUP BY 1)
SELECT c.dialogue_id, round(CASE WHEN c.n < 2 THEN 0 ELSE coalesce(m, 0) END, 6) AS loss FROM c LEFT JOIN m ON m.dialogue_id = c.dialogue_id"""
)
def supcon_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.supervised_contrastive(fx.features(spark, sf_dir), "dialogue_id", "label", ["rt", "ra", "rv"])
    return out.select("dialogue_id", r6("loss").alias("loss"))


# Frames, waveforms, boxes


@query(f"WITH {FRAMES_SQL}, p AS (SELECT clip, [avg(v), avg(k), stddev_pop(v), stddev_pop(k)] AS a FROM fr GROUP BY clip) {unnested('a', 'p', 'clip')}")
def mean_std_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(P.pooled(fx.frames(spark, sf_dir), ["clip"], "feat", "frame", ("mean", "std")), "pooled", "clip")


@query(
    f"""WITH {FRAMES_SQL}, d AS (SELECT *, v - lag(v) OVER w AS dv, k - lag(k) OVER w AS dk FROM fr WINDOW w AS (PARTITION BY clip ORDER BY frame)),
p AS (SELECT clip, [avg(v), avg(k), stddev_pop(v), stddev_pop(k), coalesce(avg(dv), 0), coalesce(avg(dk), 0)] AS a FROM d GROUP BY clip) {unnested("a", "p", "clip")}"""
)
def mean_std_delta_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(P.pooled(fx.frames(spark, sf_dir), ["clip"], "feat", "frame", ("mean", "std", "delta")), "pooled", "clip")


@query(f"WITH {FRAMES_SQL}, p AS (SELECT clip, [arg_min(v, frame), arg_min(k, frame), sum(v) FILTER (frame % 3 <> 1) / greatest(count(*) FILTER (frame % 3 <> 1), 1), sum(k) FILTER (frame % 3 <> 1) / greatest(count(*) FILTER (frame % 3 <> 1), 1)] AS a FROM fr GROUP BY clip) {unnested('a', 'p', 'clip')}")
def token_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(P.token_pooled(fx.frames(spark, sf_dir), ["clip"], "feat", "frame", F.col("frame") % 3 != 1, "cls+mean"), "pooled", "clip")


@query(
    f"""WITH {FRAMES_SQL}, n AS (SELECT clip, count(*) AS n FROM fr GROUP BY clip), a AS (SELECT clip, CASE WHEN n <= 16 THEN range(0, n) ELSE list_transform(range(0, 16), lambda i: i * (n - 1) // 15) END AS a FROM n)
SELECT clip, unnest(a) AS frame FROM a"""
)
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.frames(spark, sf_dir).groupBy("clip").agg(F.count("*").alias("n"))
    return n.select("clip", F.explode(S.sampled_frames(F.col("n"))).alias("frame"))


@query(
    f"""WITH {FRAMES_SQL}, n AS (SELECT clip, count(*) AS n, CAST(clip % 7 AS DOUBLE) / 4 AS s, CAST(clip % 9 AS DOUBLE) / 3 AS e FROM fr GROUP BY clip),
a AS (SELECT *, greatest(0, least(CAST(floor(s * 25) AS BIGINT), n - 1)) AS first FROM n)
SELECT clip, first, greatest(first + 1, least(CAST(floor(CASE WHEN e = 0 THEN n / 25.0::DOUBLE ELSE e END * 25) AS BIGINT), n)) AS "end" FROM a"""
)
def time_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.frames(spark, sf_dir).groupBy("clip").agg(F.count("*").alias("n"))
    window = S.frame_range((F.col("clip") % 7).cast("double") / 4, (F.col("clip") % 9).cast("double") / 3, F.lit(0.0), F.col("n"))
    return n.select("clip", window.alias("w")).select("clip", "w.first", "w.end")


@query(
    f"""WITH {FRAMES_SQL}, w AS (SELECT clip, list_concat([0.0::DOUBLE, 0], list_concat(list(v / 500 ORDER BY frame)[1:160], [0.0::DOUBLE, 0])) AS w FROM fr GROUP BY clip),
r AS (SELECT clip, w, sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)) AS r FROM w)
SELECT clip, r < 1e-4 AS silent, len(w) AS n, round(CASE WHEN r < 1e-4 THEN r ELSE pow(10.0::DOUBLE, (-20.0 - 20 * log10(r + 1e-9)) / 20) * r END, 6) AS rms FROM r"""
)
def rms_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.waves(spark, sf_dir).select("clip", S.prepared(F.col("wave"), rate=40, max_seconds=4.0).alias("p"))
    return w.select("clip", F.col("p.silent"), F.size("p.samples").cast("long").alias("n"), r6(S.rms(F.col("p.samples"))).alias("rms"))


@query(
    f"""WITH {FRAMES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n FROM fr)
SELECT clip, round(sum(CASE WHEN frame < n // 20 * 20 AND CAST('0x' || substr(md5(CAST(clip AS VARCHAR) || '|' || CAST(frame // 20 AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3 THEN 0 ELSE v / 500 END), 6) AS left_over FROM n GROUP BY clip"""
)
def packet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.waves(spark, sf_dir)
    return w.select("clip", r6(A.total(S.lossy(F.col("wave"), F.col("clip").cast("string"), 0.3, 20))).alias("left_over"))


def _chance(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


_KEY = "CAST(clip AS VARCHAR) || '|' || CAST(frame AS VARCHAR) || '|"


@query(
    f"""WITH {FRAMES_SQL}, n AS (SELECT clip, v / 500 AS x, sqrt(-2 * ln(1 - {_chance(_KEY + "a'")})) * cos(2 * pi() * {_chance(_KEY + "b'")}) AS g FROM fr)
SELECT clip, round((sqrt(avg(x * x)) + 1e-9) / pow(10.0::DOUBLE, 0.5::DOUBLE) * sqrt(avg(g * g)) / sqrt(avg(x * x)), 6) AS noise_share FROM n GROUP BY clip"""
)
def noise_at_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.waves(spark, sf_dir).withColumn("noisy", S.noisy(F.col("wave"), F.col("clip").cast("string"), 10.0))
    return w.select("clip", r6(S.rms(F.zip_with("noisy", "wave", lambda a, b: a - b)) / S.rms(F.col("wave"))).alias("noise_share"))


_IOU = "greatest(0, least(v, pv) + 50 - greatest(v, pv)) * greatest(0, least(k, pk) + 50 - greatest(k, pk))"


@query(f"WITH {FRAMES_SQL}, p AS (SELECT *, lag(v) OVER w AS pv, lag(k) OVER w AS pk FROM fr WINDOW w AS (PARTITION BY clip ORDER BY frame)) SELECT clip, frame, round({_IOU} / (5000.0 - {_IOU} + 1e-9), 6) AS iou FROM p WHERE pv IS NOT NULL")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("clip").orderBy("frame")
    p = fx.boxes(spark, sf_dir).withColumn("before", F.lag("box").over(order)).where("before IS NOT NULL")
    return p.select("clip", F.col("frame").cast("long"), r6(G.iou(F.col("box"), F.col("before"))).alias("iou"))


@query(
    f"""WITH {FRAMES_SQL} SELECT clip, frame, CAST(greatest(0, floor(v - 0.2::DOUBLE * 50)) AS BIGINT) AS x1, CAST(least(320, ceil(v + 50 + 0.2::DOUBLE * 50)) AS BIGINT) AS x2,
  greatest(0, CAST(trunc(k - 0.2::DOUBLE * 50) AS BIGINT)) AS y1, least(120, CAST(trunc(k + 50 + 0.2::DOUBLE * 50) AS BIGINT)) AS y2 FROM fr"""
)
def box_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.boxes(spark, sf_dir).select("clip", F.col("frame").cast("long"), G.with_margin(F.col("box"), 0.2, 320, 240).alias("m"), G.with_margin_truncated(F.col("box"), 0.2, 320, 120).alias("t"))
    return b.select("clip", "frame", "m.x1", "m.x2", "t.y1", "t.y2")


@query(
    f"""WITH {FRAMES_SQL}, p AS (SELECT frame // 4 AS g, clip, list([v, k] ORDER BY frame) AS pts FROM fr GROUP BY ALL HAVING count(*) = 4),
q AS (SELECT *, sqrt(pow(pts[2][1] - pts[3][1], 2) + pow(pts[2][2] - pts[3][2], 2)) + 1e-6 AS u FROM p)
SELECT clip, g, round((pts[4][1] - pts[1][1]) / u, 6) AS x, round((pts[4][2] - pts[1][2]) / u, 6) AS y FROM q"""
)
def landmark_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = fx.frames(spark, sf_dir).groupBy("clip", F.floor(F.col("frame") / 4).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "feat"))), lambda s: s["feat"]).alias("pts"))
    p = grouped.where(F.size("pts") == 4).withColumn("n", G.normalised_landmarks(F.col("pts"), 0, 1, 2))
    return p.select("clip", "g", r6(F.element_at("n", 4)[0]).alias("x"), r6(F.element_at("n", 4)[1]).alias("y"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    f"""WITH h AS (SELECT user_id AS clip, CAST(ts AS DATE) AS day, {", ".join(f"CAST(count(*) FILTER (event_type = '{k}') AS DOUBLE) / count(*) AS {k}" for k in _KINDS)} FROM events GROUP BY 1, 2),
p AS (SELECT *, {", ".join(f"lag({k}) OVER w AS p_{k}" for k in _KINDS)} FROM h WINDOW w AS (PARTITION BY clip ORDER BY day))
SELECT clip, day, round(d, 6) AS distance, d > 0.3 AS cut FROM (SELECT clip, day, {" + ".join(f"({k} - p_{k}) * ({k} - p_{k}) / ({k} + p_{k} + 1e-9)" for k in _KINDS)} AS d FROM p WHERE p_click IS NOT NULL)"""
)
def scene_cut_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    h = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip"), F.to_date("ts").alias("day")).agg(F.array(*[F.count_if(F.col("event_type") == k).cast("double") / n for k in _KINDS]).alias("h"))
    p = h.withColumn("before", F.lag("h").over(Window.partitionBy("clip").orderBy("day"))).where("before IS NOT NULL")
    return p.withColumn("d", G.chi_square(F.col("h"), F.col("before"))).select("clip", "day", r6("d").alias("distance"), (F.col("d") > 0.3).alias("cut"))


@query("WITH t AS (SELECT user_id % 5 AS track, event_id % 100 AS frame, value / 500 AS score, event_id FROM events WHERE value / 500 >= 0.5) SELECT frame, track, event_id, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC, event_id) = 1")
def best_track_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("track"), (F.col("event_id") % 100).alias("frame"), (F.col("value") / 500).alias("score"), "event_id")
    return K.best_track(t, ["frame"], "score", "event_id", 0.5).select("frame", "track", "event_id", r6("score").alias("score"))


@query()
def face_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chosen_faces(fx.whole_boxes(spark, sf_dir), floor=0.3)


@query()
def face_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    detections = fx.boxes(spark, sf_dir).select("clip", F.floor(F.col("frame") / 3).alias("frame"), (F.col("frame") % 3).alias("box_id"), "box")
    return K.face_tracks(detections, threshold=0.3, max_gap=1)


@query()
def dialogue_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full forward pass with seeded weights: shows that the plan runs, not what trained weights would say."""
    config = N.ModelConfig(text=14, audio=14, visual=14, hidden=16, heads=2, classes=7, fusion="class_reliability")
    f = fx.features(spark, sf_dir).withColumn("speaker_index", F.when(F.col("speaker") == "user", 0).otherwise(1))
    out = N.forward(f, N.seeded_weights(config), config, text="rt", audio="ra", visual="rv")
    return out.select(*KEYS, A.argmax(F.col("logits")).alias("pred"), F.size("logits").alias("n_classes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context texts, fused and corrected predictions, and each utterance's outcome."""
    context = D.context_text(fx.utterances(spark, sf_dir)).select(*KEYS, "context")
    return predicted(spark, sf_dir).select(*KEYS, "label", "pred").join(context, list(KEYS)).withColumn("right", F.col("label") == F.col("pred"))


def queries() -> dict[str, Query]:
    from turnweave.plans import catalog_gates, catalog_media, catalog_more, catalog_sources  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
