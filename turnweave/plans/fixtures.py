"""Inputs of the registered queries, derived from the given tables by equal expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialogue_id, utterance_id, speaker, utterance, session, split, utt_str_id)."""
    session = F.col("conv_id") % 5 + 1
    letter = F.when(F.col("role") == "user", "M").otherwise("F")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("dialogue_id"),
        F.col("turn").alias("utterance_id"),
        F.col("role").alias("speaker"),
        F.col("text").alias("utterance"),
        session.alias("session"),
        F.when(session <= 3, "train").when(session == 4, "dev").otherwise("test").alias("split"),
        F.concat(F.lit("Ses0"), session.cast("string"), F.lit("F_conv"), F.col("conv_id").cast("string"), F.lit("_"), letter, F.lpad(F.col("turn").cast("string"), 3, "0")).alias("utt_str_id"),
    )


U_SQL = """u AS (
  SELECT conv_id AS dialogue_id, turn AS utterance_id, role AS speaker, text AS utterance, conv_id % 5 + 1 AS session,
         CASE WHEN conv_id % 5 + 1 <= 3 THEN 'train' WHEN conv_id % 5 + 1 = 4 THEN 'dev' ELSE 'test' END AS split,
         'Ses0' || CAST(conv_id % 5 + 1 AS VARCHAR) || 'F_conv' || CAST(conv_id AS VARCHAR) || '_' || CASE WHEN role = 'user' THEN 'M' ELSE 'F' END || lpad(CAST(turn AS VARCHAR), 3, '0') AS utt_str_id
  FROM conversations)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utterances with label, three modalities' logits (lt, la, lv) and representations (rt, ra, rv), and valence.

    The number of vectors is one row, so the cross join with it adds a column.
    """
    e = table(spark, sf_dir, "embeddings")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    u = utterances(spark, sf_dir).crossJoin(n).withColumn("vec_id", (F.col("dialogue_id") * 31 + F.col("utterance_id") * 7) % F.col("n")).drop("n")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    e = e.select("vec_id", (F.col("label") % 7).cast("int").alias("label"), wide.alias("e"))
    part = lambda first, n, by=1.0: F.transform(F.slice("e", first, n), lambda x: x * by)
    valence = F.when(F.col("vec_id") % 17 != 0, F.greatest(F.lit(1.0), F.least(F.lit(5.0), 3 + 8 * F.element_at("e", 64))))
    return u.join(e, "vec_id").select(*u.columns, "label", part(1, 7, 8.0).alias("lt"), part(8, 7, 8.0).alias("la"), part(15, 7, 8.0).alias("lv"), part(22, 14).alias("rt"), part(36, 14).alias("ra"), part(50, 14).alias("rv"), valence.alias("valence"))


F_SQL = (
    U_SQL
    + """, e AS (SELECT vec_id, label % 7 AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
f AS (SELECT u.*, e.vec_id, e.label, list_transform(e.e[1:7], lambda x: x * 8.0) AS lt, list_transform(e.e[8:14], lambda x: x * 8.0) AS la, list_transform(e.e[15:21], lambda x: x * 8.0) AS lv,
             e.e[22:35] AS rt, e.e[36:49] AS ra, e.e[50:63] AS rv,
             CASE WHEN e.vec_id % 17 <> 0 THEN greatest(1.0::DOUBLE, least(5.0::DOUBLE, 3 + 8 * e.e[64])) END AS valence
      FROM u JOIN e ON e.vec_id = (u.dialogue_id * 31 + u.utterance_id * 7) % (SELECT count(*) FROM embeddings))"""
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, feat): the events of a user in order, two values each."""
    k = F.get_json_object("props", "$.k").cast("double")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).alias("frame"), F.array(F.col("value").cast("double"), k).alias("feat"))


FRAMES_SQL = """fr AS (
  SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CAST(value AS DOUBLE) AS v, CAST(json_extract(props, '$.k') AS DOUBLE) AS k
  FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, box): a box of 50 by 50 a frame."""
    at = lambda i: F.get("feat", F.lit(i))
    return frames(spark, sf_dir).select("clip", "frame", G.box(at(0), at(1), at(0) + 50, at(1) + 50).alias("box"))


def whole_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, box_id, box): three boxes a frame, on whole pixels, so that equal areas are equal."""
    x, y = F.floor(F.get("feat", F.lit(0))), F.get("feat", F.lit(1))
    return frames(spark, sf_dir).select("clip", F.floor(F.col("frame") / 3).alias("frame"), (F.col("frame") % 3).alias("box_id"), G.box(x, y, x + 50, y + 50).alias("box"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, wave): value / 500 in order; a clip's frames are few here, as an utterance's samples are bounded by its length."""
    return frames(spark, sf_dir).groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", (F.get("feat", F.lit(0)) / 500).alias("x")))), lambda s: s["x"]).alias("wave"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, width, height, pixels): a grey frame of 12 by 9 for every third event."""
    base = F.floor(F.get("feat", F.lit(0))) + 7 * F.col("frame")
    row = lambda i: F.floor(i / 12)
    value = lambda i: (base + 3 * (i % 12) + 5 * row(i) * row(i)) % 256
    digits = F.transform(F.sequence(F.lit(0), F.lit(107)), lambda i: F.lpad(F.hex(value(i).cast("long")), 2, "0"))
    third = frames(spark, sf_dir).where("frame % 3 = 0").withColumn("frame", F.floor(F.col("frame") / 3))
    return third.select("clip", "frame", F.lit(12).alias("width"), F.lit(9).alias("height"), F.unhex(F.array_join(digits, "")).alias("pixels"))


def picture_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, box_id, box): up to three boxes of whole pixels in or beside a picture, none in some."""
    e, k = F.col("frame"), F.get("feat", F.lit(1)).cast("long")
    x, y = F.floor(F.get("feat", F.lit(0))) % 13 - 2, k % 9 - 1
    boxed = frames(spark, sf_dir).select("clip", F.floor(e / 3).alias("frame"), (e % 3).alias("box_id"), G.box(x, y, x + 3 + k % 4, y + 3 + (k + e) % 3).alias("box"))
    return boxed.where("(clip + frame) % 7 <> 3")


PICTURES_SQL = (
    FRAMES_SQL
    + """, pic AS (SELECT clip, frame // 3 AS frame, CAST(floor(v) AS BIGINT) + 7 * (frame // 3) AS base FROM fr WHERE frame % 3 = 0),
pix AS (SELECT clip, frame, i % 12 AS x, i // 12 AS y, (base + 3 * (i % 12) + 5 * (i // 12) * (i // 12)) % 256 AS p FROM pic, range(0, 108) AS r(i)),
xy AS (SELECT clip, frame // 3 AS frame, frame % 3 AS id, CAST(floor(v) AS BIGINT) % 13 - 2 AS x, CAST(k AS BIGINT) % 9 - 1 AS y, 3 + CAST(k AS BIGINT) % 4 AS w, 3 + (CAST(k AS BIGINT) + frame) % 3 AS h FROM fr),
box AS (SELECT clip, frame, id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM xy WHERE (clip + frame) % 7 <> 3)"""
)


def softmax_sql(x: str) -> str:
    return f"list_transform({x}, lambda e_1: exp(e_1 - list_max({x})) / list_sum(list_transform({x}, lambda e_2: exp(e_2 - list_max({x})))))"
