"""Queries over loaders, degradation, pooling, tracking and model outputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.functions import geometry as G
from turnweave.functions import pixels as I
from turnweave.functions import signal as S
from turnweave.functions import text as T
from turnweave.operators import dialogue as D
from turnweave.operators import fusion as X
from turnweave.operators import losses as L
from turnweave.operators import metrics as M
from turnweave.operators import model as N
from turnweave.operators import pooling as P
from turnweave.operators import tracking as K
from turnweave.operators.encoders import HashEncoder, encoded
from turnweave.plans import catalog as C
from turnweave.plans import fixtures as fx
from turnweave.plans import pipelines as W
from turnweave.plans.catalog import FUSED_SQL, KEYS, by_class, query, r6, unnested
from turnweave.plans.fixtures import F_SQL, FRAMES_SQL, U_SQL, softmax_sql


def chance_sql(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


# Dialogues


@query(f"WITH {U_SQL} SELECT split, dialogue_id, utterance_id FROM u QUALIFY row_number() OVER (PARTITION BY split ORDER BY dialogue_id, utterance_id) <= 37")
def limit_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.limited_per_split(fx.utterances(spark, sf_dir), 37, KEYS).select("split", *KEYS)


@query(f"WITH {U_SQL} SELECT dialogue_id, max(utterance_id) + 1 AS length FROM u GROUP BY 1")
def dialogue_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dialogue_lengths(fx.utterances(spark, sf_dir))


@query(f"WITH {F_SQL} SELECT split, CAST(label AS INTEGER) AS label, count(*) AS n FROM f WHERE valence IS NOT NULL AND label <> 3 GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.features(spark, sf_dir).where("valence IS NOT NULL").withColumn("label", F.nullif("label", F.lit(3)))
    return D.value_counts(f, "label", ["split"])


@query(f"WITH {U_SQL} SELECT dialogue_id, utterance_id, CASE WHEN role = 'M' THEN 1 ELSE 0 END AS first, CASE WHEN role = 'M' THEN 0 ELSE 1 END AS second, CASE WHEN role = 'M' THEN 0 ELSE 1 END AS index FROM (SELECT *, substr(regexp_extract(utt_str_id, '_([^_]*)$', 1), 1, 1) AS role FROM u)")
def speaker_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.utterances(spark, sf_dir).withColumn("v", D.speaker_vector(T.speaker_from_id(F.col("utt_str_id"))))
    return v.select(*KEYS, F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(1)).alias("second"), D.speaker_index(F.col("v")).alias("index"))


@query(f"WITH {F_SQL} SELECT dialogue_id, utterance_id, utt_str_id, CASE WHEN speaker = 'user' THEN 1 ELSE 0 END AS is_user, CAST(label AS INTEGER) AS label, round(rt[1], 9) AS text, round(ra[1], 9) AS audio, round(rv[1], 9) AS visual FROM f WHERE split = 'test'")
def dialogue_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, speakers, labels and three modalities, each a table of its own, of the test dialogues."""
    f = fx.features(spark, sf_dir)
    part = lambda c, name: f.select(*KEYS, F.col(c).alias(name))
    parts = {"utt_str_id": part("utt_str_id", "utt_str_id"), "speaker": part("speaker", "speaker"), "label": part("label", "label"), "text": part("rt", "text"), "audio": part("ra", "audio"), "visual": part("rv", "visual")}
    d = D.dialogue_dataset(f.select("dialogue_id", "split").distinct(), parts, "test")
    one = lambda c: F.round(F.get(c, F.lit(0)), 9).alias(c)
    return d.select(*KEYS, "utt_str_id", (F.col("speaker") == "user").cast("int").alias("is_user"), "label", one("text"), one("audio"), one("visual"))


# What odd times stand for, in seconds.
TIMES = {"1500": 1.5, "1:02:03,5": 3723.5, "2:30": 150.0, "2:30.25": 150.25, "12,5": 12.5, "": 0.0, " ": 0.0, "NaN": 0.0, "soon": 0.0, "1.5:30": 0.0, "x:30": 0.0, "1:2:3:4": 0.0, "-250": -0.25, "1:00:00": 3600.0, "00:00:07,250": 7.25, "5:": 0.0, ":5": 0.0}


@query("SELECT event_id, " + "CASE event_id % 18 " + " ".join(f"WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(TIMES.values())) + " ELSE 0 END AS seconds FROM events")
def odd_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(k) for k in TIMES], F.lit(None)), (F.col("event_id") % 18).cast("int"))
    return fx.table(spark, sf_dir, "events").select("event_id", T.to_seconds(text).alias("seconds"))


@query(f"WITH {U_SQL} SELECT dialogue_id, utterance_id, CASE WHEN utterance_id % 3 = 0 THEN '/own/' || CAST(utterance_id AS VARCHAR) ELSE '/f/dia' || CAST(dialogue_id AS VARCHAR) || '_utt' || CAST(utterance_id AS VARCHAR) || '.mp4' END AS path FROM u")
def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("utterance_id") % 3 == 0, F.concat(F.lit("/own/"), F.col("utterance_id").cast("string")))
    return fx.utterances(spark, sf_dir).select(*KEYS, T.media_path("/f", F.col("dialogue_id"), F.col("utterance_id"), ".mp4", own).alias("path"))


@query("SELECT event_id, 'noise_snr' || CAST(CAST(event_id % 30 AS DOUBLE) AS VARCHAR) || 'dB' AS noise, 'pktloss' || CAST(CAST(trunc(event_id % 10 / 10.0::DOUBLE * 100) AS INTEGER) AS VARCHAR) || 'pct' AS loss, 'blur_s' || CAST(event_id % 16 / 2.0::DOUBLE AS VARCHAR) AS blur, 'occlude' || CAST(CAST(trunc(event_id % 8 / 8.0::DOUBLE * 100) AS INTEGER) AS VARCHAR) || 'pct' AS hidden FROM events")
def degradation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select(i, T.noise_tag(i % 30).alias("noise"), T.packet_loss_tag(i % 10 / 10.0).alias("loss"), T.blur_tag(i % 16 / 2.0).alias("blur"), T.occlusion_tag(i % 8 / 8.0).alias("hidden"))


@query(
    f"""WITH {F_SQL}, c AS (SELECT unnest(['T', 'A', 'V', 'TA', 'TV', 'AV', 'TAV']) AS key, unnest(['A,V', 'T,V', 'T,A', 'V', 'A', 'T', '']) AS dropped)
SELECT key, dropped, dialogue_id, utterance_id, round(CASE WHEN key LIKE '%T%' THEN lt[1] ELSE 0 END, 6) AS t, round(CASE WHEN key LIKE '%A%' THEN la[1] ELSE 0 END, 6) AS a, round(CASE WHEN key LIKE '%V%' THEN lv[1] ELSE 0 END, 6) AS v FROM f, c WHERE split = 'test'"""
)
def combo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance of the test split under each combination, with the modalities that it drops as zeros."""
    f = fx.features(spark, sf_dir).where("split = 'test'").crossJoin(F.broadcast(X.combo_table(spark)))  # seven rows
    own = lambda m, c: r6(F.when(F.array_contains("dropped", m), 0.0).otherwise(F.get(c, F.lit(0))))
    return f.select(T.combo_key(F.col("combo")).alias("key"), F.array_join("dropped", ",").alias("dropped"), *KEYS, own("T", "lt").alias("t"), own("A", "la").alias("a"), own("V", "lv").alias("v"))


_GONE = ", ".join(f"CASE WHEN {chance_sql(f"k || '|{m}'")} < 0.6 THEN '{m}' END" for m in "TAV")


@query(
    f"""WITH k AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS k FROM conversations), g AS (SELECT k, list_filter([{_GONE}], lambda x: x IS NOT NULL) AS g, ['T', 'A', 'V'][CAST(floor({chance_sql("k || '|keep'")} * 3) AS INTEGER) + 1] AS spared FROM k)
SELECT CAST(k AS BIGINT) AS batch, array_to_string(CASE WHEN len(g) = 3 THEN list_filter(g, lambda x: x <> spared) ELSE g END, ',') AS dropped FROM g"""
)
def modality_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = fx.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return k.select(F.col("conv_id").alias("batch"), F.array_join(X.dropped_modalities(F.col("conv_id").cast("string"), 0.6), ",").alias("dropped"))


# Waveforms

_WAVES = FRAMES_SQL + ", w0 AS (SELECT clip, list(CASE WHEN clip % 7 = 0 THEN 0 ELSE v / 500 END ORDER BY frame) AS w FROM fr GROUP BY clip)"
_PREPARED = (
    _WAVES
    + """, w1 AS (SELECT clip, list_concat([0.0::DOUBLE, 0], list_concat(w[1:160], [0.0::DOUBLE, 0])) AS w FROM w0), r1 AS (SELECT *, sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)) AS r FROM w1),
p1 AS (SELECT clip, r < 1e-4 AS silent, CASE WHEN r < 1e-4 THEN w ELSE list_transform(w, lambda x: x * pow(10.0::DOUBLE, (-20.0 - 20 * log10(r + 1e-9::DOUBLE)) / 20)) END AS w FROM r1)"""
)


def _quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.transform("wave", lambda x: F.when(F.col("clip") % 7 == 0, 0.0).otherwise(x))
    return fx.waves(spark, sf_dir).select("clip", w.alias("wave"))


def _config(kind: str) -> W.AudioConfig:
    return W.AudioConfig(target_sr=40, max_seconds=4.0, degradation=kind, snr_db=6.0, rate=0.3, packet_ms=500.0)


def _sums(df: DataFrame) -> DataFrame:
    return df.select("clip", "silent", F.size("wave").cast("long").alias("n"), r6(A.total(F.col("wave"))).alias("total"), r6(S.rms(F.col("wave"))).alias("rms"))


_SUMS = "clip, silent, len(w) AS n, round(list_sum(w), 6) AS total, round(sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)), 6) AS rms"


@query(
    f"""WITH {_PREPARED}, z AS (SELECT clip, silent, CASE WHEN silent THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i <= len(w) // 20 * 20 AND {chance_sql("CAST(clip AS VARCHAR) || '|' || CAST((i - 1) // 20 AS VARCHAR)")} < 0.3 THEN 0 ELSE x END) END AS w FROM p1) SELECT {_SUMS} FROM z"""
)
def degraded_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared, then silent or not, then packets are lost; the level is not set again."""
    return _sums(W.prepared_waves(_quiet(spark, sf_dir), "wave", "clip", _config("packet_loss")))


_NORMAL = f"sqrt(-2 * ln(1 - {chance_sql("CAST(clip AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR) || '|a'")})) * cos(2 * pi() * {chance_sql("CAST(clip AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR) || '|b'")})"


@query(
    f"""WITH {_PREPARED}, l AS (SELECT *, (sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)) + 1e-9) / pow(10.0::DOUBLE, 0.3::DOUBLE) AS n FROM p1),
z AS (SELECT clip, silent, CASE WHEN silent THEN w ELSE list_transform(w, lambda x, i: x + n * {_NORMAL}) END AS w FROM l) SELECT {_SUMS} FROM z"""
)
def noisy_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(W.prepared_waves(_quiet(spark, sf_dir), "wave", "clip", _config("noise")))


@query(f"WITH {FRAMES_SQL} SELECT clip, count(*) AS n, round(sum((v + k) / 2), 6) AS total, round(max((v + k) / 2), 6) AS most FROM fr GROUP BY clip")
def mono_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("frame", "feat")))
    channel = lambda i: F.transform("s", lambda x: F.get(x["feat"], F.lit(i)))
    c = fx.frames(spark, sf_dir).groupBy("clip").agg(rows.alias("s")).select("clip", S.mono(F.array(channel(0), channel(1))).alias("m"))
    return c.select("clip", F.size("m").cast("long").alias("n"), r6(A.total(F.col("m"))).alias("total"), r6(F.array_max("m")).alias("most"))


_BESSEL = "list_sum(list_transform(range(30), lambda j: pow({x} / 2, 2 * j) / pow(gamma(j + 1.0::DOUBLE), 2)))"


@query(
    f"""WITH {FRAMES_SQL}, t AS (SELECT unnest(range(-30, 31)) AS t), h0 AS (SELECT t, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / 3.0::DOUBLE) / (pi() * t / 3.0::DOUBLE) END * {_BESSEL.format(x="(5 * sqrt(1 - (t / 30.0::DOUBLE) * (t / 30.0::DOUBLE)))")} / {_BESSEL.format(x="5.0::DOUBLE")} AS h FROM t),
h AS (SELECT t, h / sum(h) OVER () * 2 AS h FROM h0), n AS (SELECT clip, count(*) AS n FROM fr GROUP BY clip), o AS (SELECT clip, unnest(range(0, (n * 2 + 2) // 3)) AS m FROM n),
y AS (SELECT o.clip, o.m, sum(h.h * fr.v / 500) AS y FROM o JOIN fr ON fr.clip = o.clip AND abs(o.m * 3 - fr.frame * 2) <= 30 JOIN h ON h.t = o.m * 3 - fr.frame * 2 GROUP BY 1, 2)
SELECT clip, count(*) AS n, round(sum(y), 6) AS total, round(sum(y * (m + 1)), 5) AS weighted FROM y GROUP BY clip"""
)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.resampled(fx.waves(spark, sf_dir).withColumn("rate", F.lit(60)), "wave", "rate", 40)
    return w.select("clip", F.size("wave").cast("long").alias("n"), r6(A.total(F.col("wave"))).alias("total"), F.round(A.total(F.transform("wave", lambda x, i: x * (i + 1))), 5).alias("weighted"))


# Frames, boxes, pooling


@query(f"WITH {F_SQL} SELECT dialogue_id, utterance_id, len(rt) AS appearance, len(ra) AS geometry, round(list_sum(rt), 6) AS a, round(list_sum(ra), 6) AS g FROM f")
def visual_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.features(spark, sf_dir).select(*KEYS, N.visual_parts(F.concat("rt", "ra"), 14, 28).alias("p"))
    return p.select(*KEYS, F.size("p.appearance").cast("long").alias("appearance"), F.size("p.geometry").cast("long").alias("geometry"), r6(A.total(F.col("p.appearance"))).alias("a"), r6(A.total(F.col("p.geometry"))).alias("g"))


@query(f"WITH {FRAMES_SQL}, c AS (SELECT DISTINCT user_id AS clip FROM events), p AS (SELECT c.clip, [coalesce(avg(v), 0), coalesce(avg(k), 0)] AS a FROM c LEFT JOIN fr ON fr.clip = c.clip AND c.clip % 3 <> 0 GROUP BY 1) {unnested('a', 'p', 'clip')}")
def pooled_or_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir)
    return by_class(P.pooled_or_zeros(f, f.where("clip % 3 <> 0"), ["clip"], "feat", "frame", ("mean",), 2), "pooled", "clip")


@query("SELECT round(sum(value * (event_id % 9)) / sum(event_id % 9), 4) AS loss FROM events")
def epoch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.epoch_loss(fx.table(spark, sf_dir, "events").select(F.col("value").alias("loss"), (F.col("event_id") % 9).alias("n_valid")))


@query(f"WITH {F_SQL}, s AS (SELECT sum(lt[1]) AS a, sum(la[1]) AS b, sum(lv[1]) AS c FROM f) SELECT round(a + 0.5::DOUBLE * b + 2 * c, 6) AS loss FROM s")
def total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.sum(F.get(c, F.lit(0)))
    return fx.features(spark, sf_dir).agg(r6(L.total_loss({"a": one("lt"), "b": one("la"), "c": one("lv")}, {"b": 0.5, "c": 2.0})).alias("loss"))


@query("SELECT event_id, CASE WHEN value / 1000 < 0.15 THEN 'stable' WHEN value / 1000 < 0.35 THEN 'moderate' ELSE 'large' END AS bucket FROM events")
def shift_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", M.shift_buckets(F.col("value") / 1000).alias("bucket"))


@query("WITH t AS (SELECT user_id AS clip, event_id % 40 AS track_id, count(*) AS n, avg(value / 500) FILTER (event_id % 3 = 0) AS p FROM events GROUP BY 1, 2) SELECT clip, track_id, round(CASE WHEN n < 3 THEN -1 ELSE coalesce(p, 0) END, 6) AS score FROM t")
def track_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.col("event_id") % 40).alias("track_id"), (F.col("value") / 500).alias("p"), "event_id")
    return K.track_scores(e, e.where("event_id % 3 = 0"), shortest=3).select("clip", "track_id", r6("score").alias("score"))


@query("WITH e AS (SELECT event_id, event_id % 50 AS first, event_id % 50 + 1 + event_id % 40 AS \"end\" FROM events) SELECT event_id, CAST(list_sum(a) AS BIGINT) AS total, a[1] AS first, a[16] AS last FROM (SELECT *, list_transform(range(16), lambda i: first + i * (\"end\" - 1 - first) // 15) AS a FROM e)")
def occlusion_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a = fx.table(spark, sf_dir, "events").select(i, S.occlusion_frames(i % 50, i % 50 + 1 + i % 40).alias("a"))
    return a.select("event_id", F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(15)).alias("last"))


@query(f"WITH {FRAMES_SQL} SELECT clip, frame, round(v + 25, 6) AS x, round(k + 25, 6) AS y, CAST(trunc(k + 50 - greatest(1, CAST(trunc(50 * 0.3::DOUBLE) AS BIGINT))) AS BIGINT) AS first, CAST(trunc(k + 50) AS BIGINT) AS \"end\" FROM fr")
def box_centres_and_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.boxes(spark, sf_dir).select("clip", F.col("frame").cast("long"), G.centre(F.col("box")).alias("c"), G.occluded_rows(F.col("box"), 0.3).alias("o"))
    return b.select("clip", "frame", r6("c.x").alias("x"), r6("c.y").alias("y"), "o.first", "o.end")


@query(
    """WITH t AS (SELECT user_id AS clip, event_id % 20 AS frame, event_id % 3 AS track, value / 500 AS score, event_id, value AS x1 FROM events),
b AS (SELECT * FROM t WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY score DESC, event_id) = 1), f AS (SELECT DISTINCT user_id AS clip, event_id % 25 AS frame FROM events)
SELECT f.clip, f.frame, round(b.x1, 6) AS x1 FROM f LEFT JOIN b ON b.clip = f.clip AND b.frame = f.frame"""
)
def speaker_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.col("event_id") % 20).alias("frame"), F.col("event_id").alias("box_id"), F.col("event_id").alias("track_order"), "value", "event_id")
    detections = e.select("clip", "frame", "box_id", G.box(F.col("value"), F.lit(0), F.col("value") + 50, F.lit(50)).alias("box"))
    tracks = e.select("clip", "frame", "box_id", F.col("event_id").alias("track_id"), "track_order")
    scores = e.select("clip", F.col("event_id").alias("track_id"), (F.col("value") / 500).alias("score"))
    frames = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.col("event_id") % 25).alias("frame")).distinct()
    return K.speaker_boxes(frames, detections, tracks, scores, 0.6).select("clip", "frame", r6("box.x1").alias("x1"))


_OVERLAP = "(greatest(0, least(b.v, last.v) + 50 - greatest(b.v, last.v)) * greatest(0, least(b.k, last.k) + 50 - greatest(b.k, last.k)))"


def _choice_sql(cut: str, blank: str) -> str:
    return f"""WITH RECURSIVE {FRAMES_SQL}, g AS (SELECT clip, frame // 3 AS frame, list({{'id': frame % 3, 'v': floor(v), 'k': k}} ORDER BY frame) AS boxes, {cut} AS cut, {blank} AS blank FROM fr GROUP BY ALL),
c AS (SELECT clip, CAST(-1 AS BIGINT) AS frame, CAST(-1 AS BIGINT) AS id, CAST(NULL AS STRUCT(id BIGINT, v DOUBLE, k DOUBLE)) AS last FROM (SELECT DISTINCT clip FROM g)
  UNION ALL SELECT clip, frame, CASE WHEN best IS NULL THEN -1 ELSE best.id END, best FROM (
    SELECT clip, f2 AS frame, CASE WHEN blank THEN NULL WHEN last IS NULL OR cut THEN boxes[1] ELSE list_filter([boxes[list_position(s, list_max(s))]], lambda b: list_max(s) >= 0.3)[1] END AS best
    FROM (SELECT c.clip, c.last, g.frame AS f2, g.boxes, g.cut, g.blank, list_transform(g.boxes, lambda b: {_OVERLAP.replace("last.", "c.last.")} / (5000 - {_OVERLAP.replace("last.", "c.last.")} + 1e-9)) AS s FROM c JOIN g ON g.clip = c.clip AND g.frame = c.frame + 1)))
SELECT clip, frame, id AS box_id FROM c WHERE frame >= 0"""


C.SQL["face_choice"] = _choice_sql("FALSE", "FALSE")


@query(_choice_sql("(clip + frame // 3) % 11 = 0", "(clip + frame // 3) % 5 = 4"))
def face_choice_with_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces by overlap, with scene cuts and frames without boxes; boxes lie on whole pixels, so that equal areas are equal."""
    f = fx.whole_boxes(spark, sf_dir)
    frames = f.select("clip", "frame", ((F.col("clip") + F.col("frame")) % 11 == 0).alias("cut")).distinct()
    return K.chosen_faces(f.where((F.col("clip") + F.col("frame")) % 5 != 4), 0.3, frames)


@query(
    f"""WITH {FRAMES_SQL}, n AS (SELECT clip, count(*) AS n FROM fr GROUP BY clip), s AS (SELECT clip, unnest(CASE WHEN n <= 16 THEN range(0, n) ELSE list_transform(range(0, 16), lambda i: i * (n - 1) // 15) END) AS frame FROM n),
m AS (SELECT s.clip, fr.v * CASE WHEN (s.clip + s.frame) % 3 = 0 THEN 1 ELSE 2 END AS a, fr.k AS b FROM s JOIN fr ON fr.clip = s.clip AND fr.frame = s.frame WHERE s.clip % 6 <> 5),
p AS (SELECT n.clip, [coalesce(avg(a), 0), coalesce(avg(b), 0), coalesce(stddev_pop(a), 0), coalesce(stddev_pop(b), 0)] AS a FROM n LEFT JOIN m ON m.clip = n.clip GROUP BY 1) {unnested("a", "p", "clip")}"""
)
def visual_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled frames, the speaking face or the whole frame, its measurements, pooled; some clips have none."""
    f = fx.frames(spark, sf_dir)
    clips = f.groupBy("clip").agg(F.lit(0).cast("long").alias("first"), F.count("*").alias("end"))
    speakers = f.where((F.col("clip") + F.col("frame")) % 3 == 0).select("clip", F.col("frame").cast("long"), F.lit(7).cast("long").alias("box_id"))
    v, k = F.get("feat", F.lit(0)), F.get("feat", F.lit(1))
    measured = f.where("clip % 6 <> 5").select("clip", F.col("frame").cast("long"), F.explode(F.array(F.struct(F.lit(7).cast("long").alias("box_id"), F.array(v, k).alias("feat")), F.struct(F.lit(-1).cast("long").alias("box_id"), F.array(v * 2, k).alias("feat")))).alias("x")).select("clip", "frame", "x.*")
    got = W.visual_features(clips, measured, measured, 2, W.VisualConfig(parts=("mean", "std")), speakers=speakers)
    return by_class(got, "embedding", "clip")


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN [CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 6 = 0 THEN 2.0::DOUBLE END] END AS a, CASE WHEN event_id % 5 <> 0 THEN [CASE WHEN event_id % 7 <> 0 THEN 1.0::DOUBLE END, NULL] END AS b FROM events),
u AS (SELECT event_id, CASE WHEN len(list_filter(a, lambda x: x IS NOT NULL)) > 0 THEN a WHEN len(list_filter(b, lambda x: x IS NOT NULL)) > 0 THEN b END AS u FROM e)
SELECT event_id, u IS NOT NULL AS found, round(CASE WHEN u IS NOT NULL THEN coalesce(u[1], 0) END, 6) AS first, CASE WHEN u IS NOT NULL THEN coalesce(u[2], 0) END AS second FROM u"""
)
def usable_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop's measurements, else the whole frame's, without NaN."""
    i, nan = F.col("event_id"), F.lit(float("nan"))
    a = F.when(i % 4 != 0, F.array(F.when(i % 3 == 0, F.col("value")).otherwise(nan), F.when(i % 6 == 0, F.lit(2.0)).otherwise(nan)))
    b = F.when(i % 5 != 0, F.array(F.when(i % 7 != 0, F.lit(1.0)).otherwise(nan), nan))
    u = fx.table(spark, sf_dir, "events").select(i, I.first_usable([a, b]).alias("u"))
    return u.select("event_id", F.col("u").isNotNull().alias("found"), r6(F.get("u", F.lit(0))).alias("first"), F.get("u", F.lit(1)).alias("second"))


# Model outputs

_NAMES = {"log_p_t": "lt", "log_p_a": "la", "log_p_v": "lv", "log_p": "z", "p": "z", "kl_log_p_t": "lt", "kl_log_p_a": "la", "kl_log_p_v": "lv", "kl_p": "z"}


def _output_sql(name: str, source: str) -> str:
    x = f"list_transform({source}, lambda e_0: e_0 / 2)" if name.startswith("kl") else source
    p = softmax_sql("x")
    value = p if name in ("p", "kl_p") else f"list_transform({p}, lambda e_4: ln(e_4))"
    return f"SELECT '{name}' AS output, dialogue_id, utterance_id, CAST(i AS INTEGER) AS class, round(a[i + 1], 6) AS value FROM (SELECT dialogue_id, utterance_id, {value} AS a, unnest(range(0, 7)) AS i FROM (SELECT dialogue_id, utterance_id, {x} AS x FROM fused))"


@query(f"WITH {FUSED_SQL} " + " UNION ALL ".join(_output_sql(n, s) for n, s in _NAMES.items()))
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.fused(spark, sf_dir).select(*KEYS, F.col("lt").alias("logits_t"), F.col("la").alias("logits_a"), F.col("lv").alias("logits_v"), F.col("z").alias("logits"))
    out = N.outputs(f, 2.0)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("output"), F.col(n).alias("a")) for n in _NAMES]))
    return out.select(*KEYS, rows.alias("o")).select("o.output", *KEYS, F.posexplode("o.a").alias("class", "value")).withColumn("value", F.round("value", 6))


@query("WITH w AS (SELECT 'part' || CAST(label AS VARCHAR) AS part, CAST(sum(len(embedding) - vec_id % 5) AS BIGINT) AS n FROM embeddings GROUP BY label) SELECT * FROM w UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM w")
def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths as a model's parameters, their labels as its parts."""
    e = fx.table(spark, sf_dir, "embeddings")
    weights = e.select(F.format_string("part%d.w%d", "label", "vec_id").alias("name"), F.slice("embedding", F.lit(1), (F.size("embedding") - F.col("vec_id") % 5).cast("int")).alias("value"))
    return N.parameters_by_part(weights)


@query(
    f"""WITH {F_SQL}, s AS (SELECT vec_id AS speaker, embedding AS e FROM embeddings WHERE vec_id < 2), p AS (SELECT f.*, s.e, row_number() OVER (PARTITION BY dialogue_id ORDER BY utterance_id) - 1 AS place FROM f JOIN s ON s.speaker = CASE WHEN f.speaker = 'user' THEN 0 ELSE 1 END),
k AS (SELECT dialogue_id, utterance_id, rt, e, place, unnest(range(0, 14)) AS k FROM p)
SELECT dialogue_id, utterance_id, CAST(k AS INTEGER) AS class, round(rt[k + 1] + CASE WHEN k % 2 = 0 THEN sin(place * exp(-k * ln(10000.0::DOUBLE) / 14)) ELSE cos(place * exp(-(k - 1) * ln(10000.0::DOUBLE) / 14)) END + CAST(e[k + 1] AS DOUBLE), 9) AS value FROM k"""
)
def positional_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances' vectors with their place in the dialogue and their speaker's vector added."""
    speakers = fx.table(spark, sf_dir, "embeddings").where("vec_id < 2").select(F.col("vec_id").alias("_s"), F.slice(F.col("embedding").cast("array<double>"), 1, 14).alias("_e"))
    f = fx.features(spark, sf_dir).withColumn("_s", F.when(F.col("speaker") == "user", 0).otherwise(1)).join(F.broadcast(speakers), "_s")  # two rows
    placed = f.withColumn("place", F.row_number().over(Window.partitionBy("dialogue_id").orderBy("utterance_id")) - 1)
    return by_class(placed.withColumn("v", N.positioned(F.col("rt"), F.col("place"), F.col("_e"))), "v")


_BYTE = "CAST('0x' || substr(sha256('0|''' || utt_str_id || ''''), 2 * i + 1, 2) AS INTEGER) / 128.0::DOUBLE - 1"


@query(f"WITH {U_SQL}, i AS (SELECT utt_str_id, utterance_id, unnest(range(0, 6)) AS i FROM u) SELECT utt_str_id, CAST(i AS INTEGER) AS class, round(CASE WHEN utterance_id % 5 = 0 THEN 0 ELSE {_BYTE} END, 9) AS value FROM i")
def encoder_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encoder over batches of rows; skipped rows get zeros."""
    u = fx.utterances(spark, sf_dir).select("utt_str_id", "utterance_id")
    return by_class(encoded(u, lambda: HashEncoder(6), "utt_str_id", skip=F.col("utterance_id") % 5 == 0), "embedding", "utt_str_id")


@query("SELECT user_id AS run, round(sum(value), 6) AS seconds, count(*) AS n, round(1000 * sum(value) / count(*), 4) AS ms_each FROM events GROUP BY 1")
def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.timing(fx.table(spark, sf_dir, "events").withColumnRenamed("user_id", "run"), "value", ["run"])
    return t.select("run", r6("seconds").alias("seconds"), "n", F.round("ms_each", 4).alias("ms_each"))
