"""Queries over files: the given tables are written in the formats that the sources read, and read back through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import text as T
from turnweave.operators import dialogue as D
from turnweave.operators import metrics as M
from turnweave.plans import catalog as C
from turnweave.plans import fixtures as fx
from turnweave.plans import pipelines as L
from turnweave.plans.catalog import KEYS, query, r6
from turnweave.plans.fixtures import F_SQL, U_SQL
from turnweave.sources import sinks as K
from turnweave.sources import transcripts as R
from turnweave.storage import fresh_dir

#: Files that a table is dealt to; a dialogue's lines are in one.
FILES = 8

# The repairs of Windows-1252 controls that the fixtures use, by code point.
FIXED_SQL = "replace(replace(replace(replace({x}, chr(146), chr(8217)), chr(133), chr(8230)), chr(160), ' '), chr(151), chr(8212))"


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+", " "))


_LINE_SQL = "trim(regexp_replace(coalesce(utterance, ''), '[ \\t\\r\\n]+', ' ', 'g'))"


def _broken(text: Column) -> Column:
    return F.concat(text, F.lit("\x92s\x85\xa0\x97."))


_BROKEN_SQL = "({x} || chr(146) || 's' || chr(133) || chr(160) || chr(151) || '.')"


def _written(df: DataFrame, line: Column, order: list[str], name: str) -> str:
    """df's lines in text files, in order, a dialogue in one file."""
    path = fresh_dir(df.sparkSession, name)
    dealt = df.repartition(FILES, "dialogue_id").sortWithinPartitions("dialogue_id", *order)
    dealt.select(line.alias("value")).write.text(path)
    return path


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fx.utterances(spark, sf_dir)
    said = F.format_string("%s [%03d.2900-%03d.4000]: %s", "utt_str_id", F.col("utterance_id"), F.col("utterance_id") + 2, _broken(_line(F.col("utterance"))))
    line = F.when(F.col("utterance_id") % 7 == 6, F.lit("M: an aside")).when(F.col("utterance_id") % 5 == 4, F.concat(F.lit("// "), said)).when(F.col("utterance_id") % 5 == 3, F.lit("")).otherwise(said)
    return R.read_transcripts(spark, _written(u, line, ["utterance_id"], "transcripts"))


_SAID = "utterance_id % 7 <> 6 AND utterance_id % 5 < 3"


@query(f"WITH {U_SQL} SELECT utt_str_id, {FIXED_SQL.format(x=_BROKEN_SQL.format(x=_LINE_SQL))} AS text FROM u WHERE {_SAID}")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("utt_str_id", "text")


def evaluations(spark: SparkSession, sf_dir: str, with_ratings: bool) -> DataFrame:
    """Lines of two in three utterances; of those with even turns a second, different one."""
    u = fx.utterances(spark, sf_dir).where("(dialogue_id + utterance_id) % 3 <> 0")
    both = u.select("*", F.explode(F.when(F.col("utterance_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    rating = F.format_string("\t[%d.%d000, 2.5000, 3.0000]", 1 + (F.col("dialogue_id") + F.col("copy")) % 4, F.col("utterance_id") % 10) if with_ratings else F.lit("")
    line = F.concat(F.format_string("[%d.2500 - %d.7500]\t%s\t%s", F.col("utterance_id") + 10 * F.col("copy"), F.col("utterance_id") + 1 + 10 * F.col("copy"), "utt_str_id", F.when(F.col("copy") == 0, "neu").otherwise("ang")), rating)
    return R.read_evaluations(spark, _written(both, line, ["utterance_id", "copy"], "evaluations"), with_ratings)


_EVAL_SQL = "ev AS (SELECT utt_str_id, utterance_id + 0.25::DOUBLE AS start, utterance_id + 1.75::DOUBLE AS \"end\", 'neu' AS emotion, 1 + dialogue_id % 4 + (utterance_id % 10) / 10.0::DOUBLE AS valence FROM u WHERE (dialogue_id + utterance_id) % 3 <> 0)"


@query(f'WITH {U_SQL}, {_EVAL_SQL} SELECT utt_str_id, start, "end", emotion, round(valence, 6) AS valence FROM ev')
def evaluation_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir, True).select("utt_str_id", "start", "end", "emotion", r6("valence").alias("valence"))


@query(f"WITH {U_SQL}, {_EVAL_SQL} SELECT utt_str_id, start FROM ev")
def evaluation_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir, False).select("utt_str_id", "start")


@query(f'WITH {U_SQL}, {_EVAL_SQL} SELECT utt_str_id, start, "end" FROM ev')
def evaluation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir, False).select("utt_str_id", "start", "end")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcripts(spark, sf_dir).withColumn("file", F.concat(F.lit("/corpus/"), T.dialogue_name(F.col("utt_str_id")), F.lit(".txt")))
    return R.corpus_utterances(lines, evaluations(spark, sf_dir, True))


_CORPUS_SQL = f"""{U_SQL}, {_EVAL_SQL}, t AS (
  SELECT utt_str_id, dialogue_id AS d, utterance_id AS line_no, {FIXED_SQL.format(x=_BROKEN_SQL.format(x=_LINE_SQL))} AS utterance, CASE WHEN session <= 4 THEN 'train' ELSE 'test' END AS split,
         CASE WHEN session <= 4 THEN 0 ELSE 1 END AS g, regexp_extract(utt_str_id, '^(.*)_[^_]*$', 1) AS dialogue FROM u WHERE {_SAID}),
j AS (SELECT t.*, start, "end", emotion, valence FROM t LEFT JOIN ev ON ev.utt_str_id = t.utt_str_id),
n AS (SELECT g, dialogue, row_number() OVER (ORDER BY g, dialogue) - 1 AS dialogue_id FROM (SELECT DISTINCT g, dialogue FROM t)),
co AS (SELECT split, n.dialogue_id, row_number() OVER (PARTITION BY n.dialogue_id ORDER BY start ASC NULLS LAST, line_no) - 1 AS utterance_id, utterance, utt_str_id, substr(regexp_extract(utt_str_id, '_([^_]*)$', 1), 1, 1) AS speaker,
         coalesce(start, 0) AS start, coalesce("end", 0) AS "end", valence, coalesce(emotion, '') AS emotion FROM j JOIN n ON n.g = j.g AND n.dialogue = j.dialogue)"""


@query(f'WITH {_CORPUS_SQL} SELECT split, dialogue_id, utterance_id, utterance, utt_str_id, speaker, start, "end", round(valence, 6) AS valence, emotion FROM co')
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return c.select("split", "dialogue_id", F.col("utterance_id").cast("long").alias("utterance_id"), "utterance", "utt_str_id", "speaker", "start", "end", r6("valence").alias("valence"), "emotion")


@query(f"""WITH {_CORPUS_SQL} SELECT utt_str_id, '/r/Session' || substr(utt_str_id, 5, 1) || '/sentences/wav/' || regexp_extract(utt_str_id, '^(.*)_[^_]*$', 1) || '/' || utt_str_id || '.wav' AS audio,
  '/r/Session' || substr(utt_str_id, 5, 1) || '/dialog/avi/DivX/' || regexp_extract(utt_str_id, '^(.*)_[^_]*$', 1) || '.avi' AS video FROM co""")
def corpus_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = R.with_media(R.with_media(corpus(spark, sf_dir), "/r", "audio", "audio"), "/r", "video", "video")
    return both.select("utt_str_id", "audio", "video")


def csv_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The utterances as CSV files by split; the dev split is not there."""
    u = fx.utterances(spark, sf_dir).where("split <> 'dev'")
    paths = {s: fresh_dir(spark, f"csv-{s}") for s in ("train", "test")}
    seconds = F.format_string("0:%d:%d,500", F.col("utterance_id") % 60, F.col("dialogue_id") % 60)
    out = u.select("split", F.col("dialogue_id").alias("Dialogue_ID"), F.col("utterance_id").alias("Utterance_ID"), _broken(F.coalesce("utterance", F.lit(""))).alias("Utterance"), F.when(F.col("utterance_id") % 3 != 0, F.col("speaker")).alias("Speaker"), seconds.alias("StartTime"), F.lit("").alias("EndTime"))
    for s, path in paths.items():
        out.where(F.col("split") == s).drop("split").write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    return paths


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = csv_files(spark, sf_dir)
    return L.split_tables(spark, paths["train"], None, paths["test"])


@query(
    f"""WITH {U_SQL} SELECT split, CAST(dialogue_id AS INTEGER) AS dialogue_id, CAST(utterance_id AS INTEGER) AS utterance_id, {FIXED_SQL.format(x=_BROKEN_SQL.format(x="coalesce(utterance, '')"))} AS utterance,
  CASE WHEN utterance_id % 3 <> 0 THEN speaker END AS speaker, (utterance_id % 60) * 60 + dialogue_id % 60 + 0.5::DOUBLE AS start FROM u WHERE split <> 'dev'"""
)
def utterance_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.with_times(D.require_columns(tables(spark, sf_dir), ["Dialogue_ID", "Utterance_ID", "Utterance"]))
    return t.select("split", F.col("Dialogue_ID").alias("dialogue_id"), F.col("Utterance_ID").alias("utterance_id"), F.col("Utterance").alias("utterance"), F.nullif("Speaker", F.lit("")).alias("speaker"), F.col("Start_Time").alias("start"))


@query(f"WITH {U_SQL}, s AS (SELECT unnest(['train', 'dev', 'test']) AS split) SELECT s.split, count(u.dialogue_id) AS n, count(DISTINCT u.dialogue_id) AS dialogues, 'Dialogue_ID int,EndTime string,Speaker string,StartTime string,Utterance string,Utterance_ID int,split string' AS columns FROM s LEFT JOIN u ON u.split = s.split AND s.split <> 'dev' GROUP BY 1")
def empty_dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split's frame on its own: its rows, and the columns that it has with or without rows."""
    paths, out = csv_files(spark, sf_dir), None
    for name, frame in L.split_frames(spark, paths["train"], None, paths["test"]).items():
        columns = ",".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema))
        one = frame.agg(F.count("*").alias("n"), F.count_distinct("Dialogue_ID").alias("dialogues")).select(F.lit(name).alias("split"), "n", "dialogues", F.lit(columns).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


_DEGRADED = """, d AS (SELECT DISTINCT split, dialogue_id FROM u), o AS (SELECT coalesce(max(dialogue_id) FILTER (split = 'train') + 1, 0) AS a, count(*) FILTER (split = 'dev') AS b FROM d),
m AS (SELECT dialogue_id, row_number() OVER (ORDER BY dialogue_id) - 1 AS i FROM d WHERE split = 'test')"""


def _degraded(spark: SparkSession, sf_dir: str, identity: bool) -> DataFrame:
    own = F.when(F.col("utterance_id") % 4 == 0, F.format_string("/own/%d.wav", "utterance_id"))
    u = fx.utterances(spark, sf_dir).select("split", F.col("dialogue_id").alias("Dialogue_ID"), F.col("utterance_id").alias("Utterance_ID"), own.alias("Audio_Path"), F.format_string("%d", F.col("utterance_id") * 1500).alias("StartTime"))
    got = L.degraded_test(u, "/test", ".wav", identity=identity)
    return got.select(F.col("Dialogue_ID").alias("dialogue_id"), F.col("Utterance_ID").alias("utterance_id"), "new_id", F.col("Audio_Path").alias("path"), F.col("Start_Time").alias("start"))


_PATH = "CASE WHEN utterance_id % 4 = 0 THEN '/own/' || CAST(utterance_id AS VARCHAR) || '.wav' ELSE '/test/dia' || CAST(u.dialogue_id AS VARCHAR) || '_utt' || CAST(utterance_id AS VARCHAR) || '.wav' END AS path, utterance_id * 1.5::DOUBLE AS start"


@query(f"WITH {U_SQL}{_DEGRADED} SELECT u.dialogue_id, utterance_id, a + b + i AS new_id, {_PATH} FROM u JOIN m ON m.dialogue_id = u.dialogue_id, o WHERE split = 'test'")
def degraded_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degraded(spark, sf_dir, False)


@query(f"WITH {U_SQL} SELECT dialogue_id, utterance_id, dialogue_id AS new_id, {_PATH} FROM u WHERE split = 'test'")
def degraded_test_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degraded(spark, sf_dir, True)


@query(f"WITH {F_SQL} SELECT utt_str_id, round(rt[1], 9) AS valence, round(rt[2], 9) AS arousal FROM f")
def va_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.features(spark, sf_dir)
    line = F.to_json(F.create_map("utt_str_id", F.slice("rt", 1, 2)))
    path = fresh_dir(spark, "va")
    # A file holds one object: the maps of a dialogue's utterances are joined by dialogue.
    one = f.select("dialogue_id", F.regexp_extract(line, r"^\{(.*)\}$", 1).alias("x")).groupBy("dialogue_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("x"), ","), F.lit("}")).alias("value"))
    merged = one.groupBy(F.pmod("dialogue_id", F.lit(FILES)).alias("k")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.collect_list("value"), lambda v: F.substring(v, F.lit(2), F.length(v) - 2)), ","), F.lit("}")).alias("value"))
    merged.repartition(FILES, "k").select("k", "value").write.partitionBy("k").text(path)
    va = R.read_va(spark, path + "/*/*.txt")
    return va.select("utt_str_id", F.round(F.get("va", F.lit(0)), 9).alias("valence"), F.round(F.get("va", F.lit(1)), 9).alias("arousal"))


@query(f"WITH {F_SQL}{_DEGRADED}, n AS (SELECT split, dialogue_id, row_number() OVER (PARTITION BY split ORDER BY dialogue_id) - 1 AS i FROM d) SELECT f.split, CASE f.split WHEN 'train' THEN f.dialogue_id WHEN 'dev' THEN a + i ELSE a + b + i END AS dialogue_id, utterance_id, round(lt[1], 9) AS first, len(lt) AS width FROM f JOIN n ON n.split = f.split AND n.dialogue_id = f.dialogue_id, o")
def embedding_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and the id map are written, read back and joined; an unknown id would be an error."""
    f = fx.features(spark, sf_dir).select("split", *KEYS, F.col("lt").alias("embedding"))
    vectors, ids = fresh_dir(spark, "vectors"), fresh_dir(spark, "ids")
    K.write_embeddings(f, vectors)
    K.write_id_map(D.remapped_ids(f), ids)
    back = spark.read.schema("dialogue_id long, utterance_id long, embedding array<double>, split string").parquet(vectors)
    named = D.with_new_ids(back, spark.read.parquet(ids), ["split", "dialogue_id"])
    return named.select("split", F.col("new_id").alias("dialogue_id"), "utterance_id", F.round(F.get("embedding", F.lit(0)), 9).alias("first"), F.size("embedding").cast("long").alias("width"))


@query(
    f"""WITH {C.PRIOR_SQL}, x AS (SELECT CASE WHEN dialogue_id % 2 = 0 THEN 'even' ELSE 'odd' END AS combo, label, pred FROM pred), {C._metrics_sql("x", "combo")},
a AS (SELECT combo, coalesce(sum(n) FILTER (label = pred), 0) / sum(n) AS acc, sum(n) AS n FROM c GROUP BY combo)
SELECT 'set' AS dataset, pc.combo, any_value(a.n) AS n, round(100 * any_value(acc), 2) AS accuracy, round(100 * sum(f1 * support) / sum(support), 2) AS weighted_f1, count(*) AS classes, CAST(sum(support) AS DOUBLE) AS support
FROM pc JOIN a ON a.combo = pc.combo GROUP BY pc.combo"""
)
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.predicted(spark, sf_dir).withColumn("combo", F.when(F.col("dialogue_id") % 2 == 0, "even").otherwise("odd"))
    counts = M.cells(p, ["combo"])
    path = fresh_dir(spark, "metrics")
    K.write_metrics(K.metrics_document(M.summary(counts, ["combo"]), M.per_class(counts, ["combo"]), dataset="set"), path)
    entry = "struct<n:double,accuracy:double,weighted_f1:double,classes:array<struct<class:int,f1:double,accuracy:double,support:double>>>"
    back = spark.read.schema(f"dataset string, combos map<string,{entry}>").json(path)
    each = back.select("dataset", F.explode("combos").alias("combo", "m"))
    support = F.aggregate("m.classes", F.lit(0.0), lambda s, c: s + c["support"])
    return each.select("dataset", "combo", "m.n", "m.accuracy", "m.weighted_f1", F.size("m.classes").cast("long").alias("classes"), support.alias("support"))


_WAV = "frame % 3 <> 2 AND clip % 4 <> 3"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a WAV file of two channels, of 16 or 24 bits, for three in four clips, and something else for the fourth.

    A clip with a sample beyond 16 bits is written in floats of 64 bits, which hold it.
    """
    import pandas as pd

    def run(batches):
        import struct

        import numpy as np

        for b in batches:
            out = []
            for clip, samples in zip(b["clip"], b["samples"], strict=True):
                x = np.asarray(samples, np.int64)
                both = np.stack([x, -x // 2], 1)
                loud = both.min(initial=0) < -(1 << 15) or both.max(initial=0) >= 1 << 15
                kind, wide = (3, 8) if loud else (1, 2 + int(clip) % 2)
                body = (both / 32768.0).astype("<f8").tobytes() if loud else (both << 8 * (wide - 2)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()
                head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, 2, 8000, 16000 * wide, 2 * wide, 8 * wide) + b"data" + struct.pack("<I", len(body))
                out.append((f"/w/{clip}.wav", head + body if clip % 4 != 3 else b"RIFFnope"))
            yield pd.DataFrame(out, columns=["path", "content"])

    whole = F.array_sort(F.collect_list(F.struct("frame", F.coalesce(F.floor(F.get("feat", F.lit(0)) * 40), F.lit(0)).alias("x"))))
    clips = fx.frames(spark, sf_dir).groupBy("clip").agg(F.transform(whole, lambda s: s["x"]).alias("samples"))
    return clips.mapInPandas(run, "path string, content binary")


@query("SELECT '/w/' || CAST(user_id AS VARCHAR) || '.wav' AS path, CASE WHEN user_id % 4 <> 3 THEN 8000 END AS rate, CASE WHEN user_id % 4 <> 3 THEN 2 END AS channels, CASE WHEN user_id % 4 <> 3 THEN count(*) END AS samples, CASE WHEN user_id % 4 <> 3 THEN round(sum(floor(value * 40)) / 32768, 6) END AS total FROM events GROUP BY user_id")
def wav_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.decoded_waves(media(spark, sf_dir))
    first = F.get("channels", F.lit(0))
    return d.select("path", "rate", F.when(F.col("channels").isNotNull(), F.size("channels")).alias("channels"), F.when(F.col("channels").isNotNull(), F.size(first)).cast("long").alias("samples"), r6(F.aggregate(first, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("WITH c AS (SELECT user_id, sqrt(avg(value * value)) AS level FROM events GROUP BY 1) SELECT count(*) AS rows, count(*) FILTER (user_id % 4 = 3) AS missing, count(*) FILTER (user_id % 4 <> 3 AND level < 50) AS silent FROM c")
def media_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("level"))
    there = F.col("user_id") % 4 != 3
    return R.missing_counts(c, there, there & (F.col("level") < 50))


@query("WITH e AS (SELECT label, avg(embedding[1]) AS f1 FROM embeddings GROUP BY 1), b AS (SELECT label FROM e ORDER BY round(f1, 9) DESC, label LIMIT 1) SELECT 'w' || CAST(vec_id AS VARCHAR) AS name, e.label AS epoch, round(CAST(embedding[2] AS DOUBLE), 6) AS value FROM embeddings AS e JOIN b ON b.label = e.label")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by epoch, of which those of the best epoch are kept; labels stand for epochs."""
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("label").alias("epoch"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").cast("array<double>").alias("value"))
    epochs = e.groupBy("epoch").agg(F.round(F.avg(F.get("value", F.lit(0))), 9).alias("f1"))
    path = fresh_dir(spark, "checkpoint")
    K.write_best(epochs, e, path)
    return spark.read.parquet(path).select("name", "epoch", r6(F.get("value", F.lit(1))).alias("value"))


@query("SELECT event_type AS run, CAST(user_id AS BIGINT) AS step, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, user_id, 'mean', round(avg(value), 6) FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of runs appended step by step, some of them twice, the later one counting."""
    steps = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").cast("long").alias("step")).agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"))
    path = fresh_dir(spark, "log")
    K.append_metrics(steps.select("run", "step", (F.col("n") + 1).alias("n")).where("step % 3 = 0"), path, 1)
    K.append_metrics(steps.select("run", "step", "n", F.when(F.col("step") % 2 == 0, F.col("mean")).alias("mean")), path, 2)
    return K.read_metrics(spark, path).select("run", "step", "metric", r6("value").alias("value"))
