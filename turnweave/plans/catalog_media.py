"""Queries over sound, frames and tracks, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import geometry as G
from turnweave.functions import pixels as I
from turnweave.operators import batches as B
from turnweave.operators import sound as O
from turnweave.operators import tracking as K
from turnweave.plans import catalog as C
from turnweave.plans import fixtures as fx
from turnweave.plans import pipelines as W
from turnweave.plans.catalog import by_class, query, r6, unnested
from turnweave.plans.fixtures import F_SQL, FRAMES_SQL, PICTURES_SQL, U_SQL
from turnweave.sources import frames as V
from turnweave.storage import fresh_dir, materialize

#: The fixtures' waveforms count as sampled so often, so windows have 20 samples and steps 8.
RATE = 800

# The mel scale by its definition: 200 / 3 Hz a step up to 1,000 Hz; half the rate is below that here, so all 130 edges are 400 / 129 Hz apart.
_CEPSTRA = (
    FRAMES_SQL
    + """, wav AS (SELECT clip, list(v / 500 ORDER BY frame) AS w FROM fr GROUP BY clip), win AS (SELECT clip, w, unnest(range(0, 1 + len(w) // 8)) AS t FROM wav),
smp AS (SELECT clip, t, i, coalesce(CASE WHEN t * 8 - 10 + i >= 0 THEN w[t * 8 - 10 + i + 1] END, 0) * (0.5 - 0.5 * cos(2 * pi() * i / 20)) AS x FROM win, range(0, 20) AS r(i)),
pow AS (SELECT clip, t, k, pow(sum(x * cos(2 * pi() * k * i / 512)), 2) + pow(sum(x * sin(2 * pi() * k * i / 512)), 2) AS p FROM smp, range(0, 257) AS r(k) GROUP BY ALL),
fil AS (SELECT * FROM (SELECT m, k, greatest(0, least((k * 800 / 512.0::DOUBLE - m * 400 / 129.0::DOUBLE), ((m + 2) * 400 / 129.0::DOUBLE - k * 800 / 512.0::DOUBLE)) / (400 / 129.0::DOUBLE)) * 2 / (800 / 129.0::DOUBLE) AS f FROM range(0, 128) AS a(m), range(0, 257) AS b(k)) WHERE f > 0),
mel AS (SELECT clip, t, m, 10 * log10(greatest(1e-10::DOUBLE, sum(p * f))) AS d FROM pow JOIN fil USING (k) GROUP BY ALL),
flo AS (SELECT clip, t, m, greatest(d, max(d) OVER (PARTITION BY clip) - 80) AS d FROM mel),
cep AS (SELECT clip, t, c, sum(d * cos(pi() * c * (2 * m + 1) / 256)) * sqrt(CASE WHEN c = 0 THEN 1 ELSE 2 END / 128.0::DOUBLE) AS x FROM flo, range(0, 13) AS r(c) GROUP BY clip, t, c)"""
)


def _kernel_sql(source: str, keys: str) -> str:
    """Weights g of row t, of have, in row j, of want: a sum of cosines of the lower of both numbers' frequencies."""
    return f"""SELECT {keys}, j, t, (1 + coalesce(list_sum(list_transform(range(1, least(have, want) // 2 + 1), lambda q: CASE WHEN 2 * q = least(have, want) AND want >= have THEN 1 ELSE 2 END * cos(2 * pi() * q * (j / want::DOUBLE - t / have::DOUBLE)))), 0)) / have AS g
        FROM (SELECT {keys}, have, want, j, unnest(range(0, have)) AS t FROM (SELECT *, unnest(range(0, want)) AS j FROM {source}))"""


def _by_frame(samples: int) -> str:
    return (
        _CEPSTRA
        + f""", dim AS (SELECT clip, 1 + len(w) // 8 AS have, (len(w) + {samples - 1}) // {samples} * 4 AS want FROM wav),
ker AS ({_kernel_sql("dim", "clip")}), snd AS (SELECT clip, CAST(j AS INTEGER) AS row, CAST(c AS INTEGER) AS c, sum(x * g) AS x FROM ker JOIN cep USING (clip, t) GROUP BY ALL)"""
    )


def cepstra_frames(spark: SparkSession, sf_dir: str, samples: int) -> DataFrame:
    """(clip, row, cepstrum) of the fixtures' waveforms, so many samples a frame."""
    waves = fx.waves(spark, sf_dir)
    return O.cepstra_by_frame(waves, RATE, F.floor((F.size("wave") + samples - 1) / samples))


@query(f"WITH {_CEPSTRA} SELECT clip, CAST(t AS INTEGER) AS t, CAST(c AS INTEGER) AS c, round(x, 4) AS x FROM cep")
def mfcc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = O.cepstra(fx.waves(spark, sf_dir), RATE)
    return got.select("clip", "t", F.posexplode("cepstrum").alias("c", "x")).withColumn("x", F.round("x", 4))


@query(f"WITH {_by_frame(32)} SELECT clip, row, c, round(x, 4) AS x FROM snd")
def mfcc_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cepstra_frames(spark, sf_dir, 32)
    return got.select("clip", "row", F.posexplode("cepstrum").alias("c", "x")).withColumn("x", F.round("x", 4))


@query(
    f"""WITH {_by_frame(4)}, trk AS (SELECT DISTINCT clip, frame // 3 // 8 AS track_id, frame // 3 AS frame FROM fr WHERE (clip + frame // 3) % 4 <> 0),
spn AS (SELECT clip, track_id, min(frame) AS first, max(frame) AS last, count(*) * 4 AS want FROM trk GROUP BY ALL HAVING count(*) >= 5),
met AS (SELECT spn.*, s.c, s.x, row_number() OVER (PARTITION BY spn.clip, track_id, c ORDER BY row) - 1 AS t FROM spn JOIN snd AS s ON s.clip = spn.clip AND s.row // 4 BETWEEN first AND last),
len AS (SELECT spn.clip, spn.track_id, want, coalesce(have, 0) AS have FROM spn LEFT JOIN (SELECT clip, track_id, max(t) + 1 AS have FROM met GROUP BY ALL) AS h ON h.clip = spn.clip AND h.track_id = spn.track_id),
gen AS ({_kernel_sql("len", "clip, track_id")}),
fit AS (SELECT clip, track_id, j, c, sum(x * g) AS x FROM gen JOIN met USING (clip, track_id, t) GROUP BY ALL)
SELECT clip, track_id, CAST(j AS INTEGER) AS place, c, round(x, 4) AS x FROM fit
UNION ALL SELECT clip, track_id, CAST(j AS INTEGER), CAST(c AS INTEGER), 0.0::DOUBLE FROM (SELECT *, unnest(range(0, want)) AS j FROM len WHERE have = 0), range(0, 13) AS r(c)"""
)
def sound_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that skip frames, and that go on when the sound has ended, with their share of the sound."""
    frame = F.floor(F.col("frame") / 3)
    tracks = fx.frames(spark, sf_dir).select("clip", F.floor(frame / 8).alias("track_id"), frame.alias("frame")).where((F.col("clip") + F.col("frame")) % 4 != 0).distinct()
    got = O.sound_of_tracks(tracks, cepstra_frames(spark, sf_dir, 4))
    return got.select("clip", "track_id", "place", F.posexplode("cepstrum").alias("c", "x")).withColumn("x", F.round("x", 4))


# Frames and pixels


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The pictures of each clip in a file: the folder, and (clip, path, frames) of the files."""
    folder = fresh_dir(spark, "video")
    return folder, materialize(V.write_frames(fx.pictures(spark, sf_dir), folder, fps=5), "files")


_BRIGHT = "CAST(sum(p) AS DOUBLE) AS total, CAST(sum(p) FILTER (y >= 4) AS DOUBLE) AS lower"


def _bright(df: DataFrame) -> DataFrame:
    got = df.withColumn("_b", I.total_brightness(F.col("pixels"), F.col("width")))
    return got.select("clip", "frame", F.get("_b", F.lit(0)).alias("total"), F.get("_b", F.lit(1)).alias("lower"))


@query(f"WITH {PICTURES_SQL} SELECT clip, frame, {_BRIGHT} FROM pix WHERE frame BETWEEN 5 AND 12 GROUP BY ALL")
def video_frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from the first second on for one and a half seconds, but for the last; only they are read from the files."""
    folder, files = _files(spark, sf_dir)
    read = V.read_frames(spark, folder, start_sec=1.0, max_seconds=1.8).where("frame < 13")
    return _bright(read.join(files.select("clip", "path"), "path"))


@query(f"WITH {PICTURES_SQL} SELECT clip, count(*) AS frames, 12 AS width, 9 AS height, 5.0::DOUBLE AS fps FROM pic GROUP BY clip")
def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = _files(spark, sf_dir)
    return V.read_video_info(spark, folder).join(files.select("clip", "path"), "path").select("clip", "frames", "width", "height", "fps")


_MIRROR = "CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * {n} - 2 - ({i}) ELSE {i} END"
_KERNEL = "exp(-d * d / 2.0::DOUBLE) / (1 + 2 * (exp(-0.5::DOUBLE) + exp(-2.0::DOUBLE) + exp(-4.5::DOUBLE)))"


@query(
    f"""WITH {PICTURES_SQL}, ker AS (SELECT d, {_KERNEL} AS g FROM range(-3, 4) AS r(d)),
down AS (SELECT a.clip, a.frame, a.x, a.y, sum(g * b.p) AS p FROM pix AS a, ker JOIN pix AS b ON b.clip = a.clip AND b.frame = a.frame AND b.x = a.x AND b.y = {_MIRROR.format(i="a.y + d", n=9)} GROUP BY ALL),
smooth AS (SELECT a.clip, a.frame, a.x, a.y, sum(g * b.p) AS p FROM down AS a, ker JOIN down AS b ON b.clip = a.clip AND b.frame = a.frame AND b.y = a.y AND b.x = {_MIRROR.format(i="a.x + d", n=12)} GROUP BY ALL),
pix2 AS (SELECT clip, frame, x, y, greatest(0, least(255, round_even(p, 0))) AS p FROM smooth)
SELECT clip, frame, {_BRIGHT} FROM pix2 GROUP BY ALL"""
)
def blurred_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pictures(spark, sf_dir)
    return _bright(p.withColumn("pixels", I.blurred_pixels(F.col("pixels"), F.col("width"), 1.0)))


@query(
    f"""WITH {PICTURES_SQL}, m AS (SELECT clip, frame, greatest(0, floor(x1 - 0.2 * greatest(1, x2 - x1))) AS x1, greatest(0, floor(y1 - 0.2 * greatest(1, y2 - y1))) AS y1, least(12, ceil(x2 + 0.2 * greatest(1, x2 - x1))) AS x2, least(9, ceil(y2 + 0.2 * greatest(1, y2 - y1))) AS y2 FROM box WHERE id = 0),
n AS (SELECT clip, frame, CASE WHEN x2 <= x1 OR y2 <= y1 THEN [0, 0, 12, 9] ELSE [x1, y1, x2 - x1, y2 - y1] END AS b FROM m),
q AS (SELECT clip, frame, b, i, j, greatest(0, least(b[3] - 1, (i + 0.5::DOUBLE) * b[3] / 8 - 0.5)) AS u, greatest(0, least(b[4] - 1, (j + 0.5::DOUBLE) * b[4] / 8 - 0.5)) AS v FROM n, range(0, 8) AS a(i), range(0, 8) AS c(j)),
r AS (SELECT *, least(floor(u), greatest(b[3] - 2, 0)) AS ul, least(floor(v), greatest(b[4] - 2, 0)) AS vl FROM q),
s AS (SELECT *, list_transform([[ul, vl], [least(ul + 1, b[3] - 1), vl], [ul, least(vl + 1, b[4] - 1)], [least(ul + 1, b[3] - 1), least(vl + 1, b[4] - 1)]], lambda c: (base + 3 * CAST(b[1] + c[1] AS BIGINT) + 5 * CAST(b[2] + c[2] AS BIGINT) * CAST(b[2] + c[2] AS BIGINT)) % 256) AS w, u - ul AS fu, v - vl AS fv FROM r JOIN pic USING (clip, frame)),
pix2 AS (SELECT clip, frame, j AS y, round_even((w[1] * (1 - fu) + w[2] * fu) * (1 - fv) + (w[3] * (1 - fu) + w[4] * fu) * fv, 0) AS p FROM s)
SELECT clip, frame, {_BRIGHT} FROM pix2 GROUP BY ALL"""
)
def face_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with a margin, cut out and resized; a face beside the frame gives the whole frame."""
    p = fx.pictures(spark, sf_dir).join(fx.picture_boxes(spark, sf_dir).where("box_id = 0"), ["clip", "frame"])
    grown = p.withColumn("b", G.with_margin(F.col("box"), 0.2, F.col("width"), F.col("height")))
    return _bright(grown.select("clip", "frame", F.lit(8).alias("width"), I.face_pixels(F.col("pixels"), F.col("width"), F.col("b"), 8).alias("pixels")))


def _choice(floor: float | None, forget: bool) -> str:
    """c(clip, step, pick) from g(clip, step, boxes, cut): the recursion over a clip's steps that chooses a box each."""
    area = "list_transform(boxes, lambda b: (b.x2 - b.x1) * (b.y2 - b.y1))"
    cross = "(greatest(0, least(b.x2, seen.x2) - greatest(b.x1, seen.x1)) * greatest(0, least(b.y2, seen.y2) - greatest(b.y1, seen.y1)))"
    ious = f"list_transform(boxes, lambda b: {cross} / ((b.x2 - b.x1) * (b.y2 - b.y1) + (seen.x2 - seen.x1) * (seen.y2 - seen.y1) - {cross} + 1e-9))"
    enough = "TRUE" if floor is None else f"list_max({ious}) >= {floor}"
    kind = "STRUCT(id BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)"
    return f"""c AS (SELECT clip, CAST(-1 AS BIGINT) AS step, CAST(NULL AS {kind}) AS pick, CAST(NULL AS {kind}) AS last FROM (SELECT DISTINCT clip FROM g)
  UNION ALL SELECT clip, step, pick, CASE WHEN pick IS NOT NULL THEN pick WHEN {str(forget).upper()} THEN NULL ELSE seen END AS last FROM (
    SELECT clip, step, seen, CASE WHEN boxes IS NULL OR len(boxes) = 0 THEN NULL WHEN seen IS NULL THEN boxes[list_position({area}, list_max({area}))] WHEN {enough} THEN boxes[list_position({ious}, list_max({ious}))] END AS pick
    FROM (SELECT c.clip, g.step, CASE WHEN g.cut THEN NULL ELSE c.last END AS seen, g.boxes FROM c JOIN g ON g.clip = c.clip AND g.step = c.step + 1)))"""


_BOXES = "lst AS (SELECT clip, frame, list({'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY id) AS boxes FROM box GROUP BY ALL)"
_SHADES = "(abs(a.s - b.s) * abs(a.s - b.s) / (a.s + b.s + 1e-9) + abs(a.s - b.s) * abs(a.s - b.s) / (2 - a.s - b.s + 1e-9))"


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, h): two shares a picture, from its events' values."""
    f = fx.frames(spark, sf_dir).where("frame % 3 = 0")
    share = F.floor(F.get("feat", F.lit(0))) % 10 / 10.0
    return f.select("clip", F.floor(F.col("frame") / 3).alias("frame"), F.array(share, 1 - share).alias("h"))


def _occlusion_sql(cuts: bool, if_empty: bool, parts: str) -> str:
    p = "(base + 3 * x + 5 * y * y) % 256"
    pooled = {"mean": "[avg(t), avg(l)]", "mean,std,delta": "[avg(t), avg(l), stddev_pop(t), stddev_pop(l), CASE WHEN count(*) > 1 THEN (max_by(t, step) - min_by(t, step)) / (count(*) - 1) ELSE 0 END, CASE WHEN count(*) > 1 THEN (max_by(l, step) - min_by(l, step)) / (count(*) - 1) ELSE 0 END]"}[parts]
    zeros = "[0.0::DOUBLE" + ", 0.0" * (1 if parts == "mean" else 5) + "]"
    cut = f"coalesce({_SHADES} > 0.3, FALSE)" if cuts else "FALSE"
    return f"""WITH RECURSIVE {PICTURES_SQL}, {_BOXES}, num AS (SELECT clip, count(*) AS n FROM pic GROUP BY clip), sam AS (SELECT clip, i AS step, i * (n - 1) // 15 AS frame FROM num, range(0, 16) AS r(i)),
shd AS (SELECT sam.*, base, ((base - 7 * sam.frame) % 10) / 10.0::DOUBLE AS s FROM sam JOIN pic USING (clip, frame)),
g AS (SELECT a.clip, a.step, lst.boxes, {cut} AS cut FROM shd AS a LEFT JOIN shd AS b ON b.clip = a.clip AND b.step = a.step - 1 LEFT JOIN lst ON lst.clip = a.clip AND lst.frame = a.frame),
{_choice(0.3, True)},
mar AS (SELECT clip, step, base, pick IS NOT NULL AS has, greatest(0, CAST(trunc(pick.x1 - 0.2::DOUBLE * (pick.x2 - pick.x1)) AS BIGINT)) AS x1, greatest(0, CAST(trunc(pick.y1 - 0.2::DOUBLE * (pick.y2 - pick.y1)) AS BIGINT)) AS y1,
  least(12, CAST(trunc(pick.x2 + 0.2::DOUBLE * (pick.x2 - pick.x1)) AS BIGINT)) AS x2, least(9, CAST(trunc(pick.y2 + 0.2::DOUBLE * (pick.y2 - pick.y1)) AS BIGINT)) AS y2 FROM c JOIN shd USING (clip, step)),
hid AS (SELECT *, has AND (x2 <= x1 OR y2 <= y1) AS none, y2 - greatest(1, CAST(trunc((y2 - y1) * 0.3::DOUBLE) AS BIGINT)) AS dark FROM mar),
see AS (SELECT * FROM hid WHERE {str(if_empty).upper()} OR NOT none),
val AS (SELECT clip, step, y, none OR NOT has AS whole, y1, y2, CASE WHEN has AND x >= x1 AND x < x2 AND y >= dark AND y < y2 THEN 0 ELSE {p} END AS p FROM see, range(0, 12) AS a(x), range(0, 9) AS b(y) WHERE none OR NOT has OR (x >= x1 AND x < x2 AND y >= y1 AND y < y2)),
tot AS (SELECT clip, step, CAST(sum(p) AS DOUBLE) AS t, coalesce(CAST(sum(p) FILTER (CASE WHEN whole THEN y >= 4 ELSE y - y1 >= (y2 - y1) // 2 END) AS DOUBLE), 0) AS l FROM val GROUP BY ALL),
poo AS (SELECT clip, {pooled} AS a FROM tot GROUP BY clip), res AS (SELECT num.clip, coalesce(a, {zeros}) AS a FROM num LEFT JOIN poo USING (clip)) {unnested("a", "res", "clip").replace(", 9)", ", 6)")}"""


def _occlusion(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    p, config = fx.pictures(spark, sf_dir), W.OCCLUSION[name]
    clips = p.groupBy("clip").agg(F.lit(0).cast("long").alias("first"), F.count("*").alias("end"))
    got = W.occlusion_features(clips, p, fx.picture_boxes(spark, sf_dir), I.total_brightness, 2, config, _histograms(spark, sf_dir))
    return by_class(got, "embedding", "clip").withColumn("value", r6("value"))


@query(_occlusion_sql(False, True, "mean"))
def occlusion_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occlusion(spark, sf_dir, "images")


@query(_occlusion_sql(False, False, "mean,std,delta"))
def occlusion_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occlusion(spark, sf_dir, "landmarks")


@query(_occlusion_sql(True, False, "mean,std,delta"))
def occlusion_action_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occlusion(spark, sf_dir, "action_units")


def _faces_sql(full: bool) -> str:
    return f"""SELECT {str(full).upper()} AS full_frame, * FROM (WITH RECURSIVE {PICTURES_SQL}, {_BOXES}, num AS (SELECT clip, count(*) AS n FROM pic GROUP BY clip), sam AS (SELECT clip, i AS step, CASE WHEN n <= 16 THEN i ELSE i * (n - 1) // 15 END AS frame FROM num, range(0, 16) AS r(i) WHERE i < n),
shd AS (SELECT sam.*, ((base - 7 * sam.frame) % 10) / 10.0::DOUBLE AS s FROM sam JOIN pic USING (clip, frame)),
g AS (SELECT a.clip, a.step, lst.boxes, coalesce({_SHADES} > 0.3, FALSE) AS cut FROM shd AS a LEFT JOIN shd AS b ON b.clip = a.clip AND b.step = a.step - 1 LEFT JOIN lst ON lst.clip = a.clip AND lst.frame = a.frame),
{_choice(None, full)},
fea AS (SELECT clip, coalesce(CAST(pick.x1 AS DOUBLE), 100.0::DOUBLE + step) AS a FROM c WHERE step >= 0 {"" if full else "AND pick IS NOT NULL"}),
res AS (SELECT num.clip, coalesce(avg(a), 0) AS x, coalesce(stddev_pop(a), 0) AS d FROM num LEFT JOIN fea USING (clip) GROUP BY num.clip) SELECT clip, round(x, 6) AS mean, round(d, 6) AS deviation FROM res)"""


@query(_faces_sql(True) + " UNION ALL " + _faces_sql(False))
def visual_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path on which faces are chosen, with scene cuts, frames without boxes and both settings of full_frame."""
    p, boxes = fx.pictures(spark, sf_dir), fx.picture_boxes(spark, sf_dir)
    clips = p.groupBy("clip").agg(F.lit(0).cast("long").alias("first"), F.count("*").alias("end"))
    n = F.col("end")
    step = clips.select("clip", F.posexplode(F.when(n <= 16, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(i * (n - 1) / 15)))).alias("step", "frame"))
    whole = step.select("clip", "frame", F.lit(-1).cast("long").alias("box_id"), F.array(100.0 + F.col("step")).alias("feat"))
    measured = boxes.select("clip", "frame", "box_id", F.array("box.x1").alias("feat")).unionByName(whole)
    made = [W.visual_features(clips, boxes, measured, 1, W.VisualConfig(full_frame=full, parts=("mean", "std")), _histograms(spark, sf_dir)).withColumn("full_frame", F.lit(full)) for full in (True, False)]
    return made[0].unionByName(made[1]).select("full_frame", "clip", r6(F.get("embedding", F.lit(0))).alias("mean"), r6(F.get("embedding", F.lit(1))).alias("deviation"))


@query(
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, list_transform(e[1:3], lambda x: x / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3])) AS a, list_transform(e[5:7], lambda x: x / sqrt(e[5] * e[5] + e[6] * e[6] + e[7] * e[7])) AS b FROM e),
t AS (SELECT *, [a[2] * b[3] - a[3] * b[2], a[3] * b[1] - a[1] * b[3], a[1] * b[2] - a[2] * b[1]] AS c FROM u),
p AS (SELECT vec_id, list_concat(e[53:62], CASE WHEN c[1] > 0.998 THEN [90.0::DOUBLE, degrees(atan2(-a[2], -a[3])), 0] WHEN c[1] < -0.998 THEN [-90.0::DOUBLE, degrees(atan2(a[2], a[3])), 0]
  ELSE [degrees(asin(c[1])), degrees(atan2(c[2] / cos(asin(c[1])), c[3] / cos(asin(c[1])))), degrees(atan2(b[1] / cos(asin(c[1])), a[1] / cos(asin(c[1]))))] END) AS v FROM t)
{unnested("v", "p", "vec_id").replace(", 9)", ", 4)")}"""
)
def expression_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression and pose from vectors that stand for a face model's parameters."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return by_class(e.withColumn("v", I.expression_vector(F.slice("e", 1, 62))), "v", "vec_id").withColumn("value", F.round("value", 4))


# Tracks

_IOU = "(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _tracks_sql(threshold: float, max_gap: int) -> str:
    """The tracker as a recursion: a step matches one live track, and when none is left to match, opens tracks and goes on a frame.

    State: todo (live tracks still to match), kept (those that are done), free (boxes), found (frame, id, track), ended, count.
    """
    box = "STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)"
    live = f"STRUCT(track BIGINT, seen BIGINT, b {box})[]"
    cross = _IOU.format(a="c", b="todo[1].b")
    side = lambda n: f"greatest(0, {n}.x2 - {n}.x1) * greatest(0, {n}.y2 - {n}.y1)"
    ious = f"list_transform(free, lambda c: {cross} / ({side('c')} + {side('todo[1].b')} - {cross} + 1e-9))"
    old = f"list_filter(kept, lambda k: g.frame - 1 - k.seen > {max_gap} AND g.frame - s.frame > 1)"
    stay = f"list_filter(kept, lambda k: NOT (g.frame - 1 - k.seen > {max_gap} AND g.frame - s.frame > 1))"
    begun = "list_transform(range(1, len(free) + 1), lambda i: {'track': s.count + i - 1, 'seen': s.frame, 'b': s.free[i]})"
    return f"""st AS (SELECT clip, CAST(-1 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS frame, CAST([] AS {live}) AS todo, CAST([] AS {live}) AS kept, CAST([] AS {box}[]) AS free, CAST([] AS STRUCT(frame BIGINT, id BIGINT, track BIGINT)[]) AS found, CAST([] AS BIGINT[]) AS ended, CAST(0 AS BIGINT) AS count, FALSE AS over FROM (SELECT DISTINCT clip FROM g)
  UNION ALL (
  SELECT clip, n, frame, todo[2:], CASE WHEN hit OR frame - todo[1].seen <= {max_gap} THEN list_append(kept, {{'track': todo[1].track, 'seen': CASE WHEN hit THEN frame ELSE todo[1].seen END, 'b': CASE WHEN hit THEN best ELSE todo[1].b END}}) ELSE kept END,
    CASE WHEN hit THEN list_filter(free, lambda c: c.id <> best.id) ELSE free END, CASE WHEN hit THEN list_append(found, {{'frame': frame, 'id': best.id, 'track': todo[1].track}}) ELSE found END,
    CASE WHEN NOT hit AND frame - todo[1].seen > {max_gap} THEN list_append(ended, todo[1].track) ELSE ended END, count, FALSE
  FROM (SELECT *, coalesce(list_max(s) > 0 AND list_max(s) >= {threshold}, FALSE) AS hit, free[list_position(s, list_max(s))] AS best FROM (SELECT *, {ious} AS s FROM st WHERE NOT over AND len(todo) > 0))
  UNION ALL
  SELECT s.clip, s.n + 1, coalesce(g.frame, s.frame), CASE WHEN g.clip IS NULL THEN CAST([] AS {live}) ELSE {stay} END, CASE WHEN g.clip IS NULL THEN kept ELSE CAST([] AS {live}) END, coalesce(g.boxes, CAST([] AS {box}[])), s.found,
    CASE WHEN g.clip IS NULL THEN list_concat(ended, list_transform(kept, lambda k: k.track)) ELSE list_concat(ended, list_transform(list_sort(list_transform({old}, lambda k: {{'seen': k.seen, 'track': k.track}})), lambda k: k.track)) END, s.count, g.clip IS NULL
  FROM (SELECT clip, n, frame, list_concat(kept, {begun}) AS kept, list_concat(found, list_transform(range(1, len(free) + 1), lambda i: {{'frame': s.frame, 'id': s.free[i].id, 'track': s.count + i - 1}})) AS found, ended, count + len(free) AS count FROM st AS s WHERE NOT over AND len(todo) = 0) AS s
  LEFT JOIN g ON g.clip = s.clip AND g.step = s.n + 1))
SELECT clip, f.frame, f.id AS box_id, f.track AS track_id, list_position(ended, f.track) - 1 AS track_order FROM (SELECT clip, ended, unnest(found) AS f FROM st WHERE over)"""


def _detected_sql(source: str) -> str:
    return f"g AS (SELECT clip, frame, boxes, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS step FROM (SELECT clip, frame, list({{'id': id, 'x1': CAST(x1 AS DOUBLE), 'y1': CAST(y1 AS DOUBLE), 'x2': CAST(x2 AS DOUBLE), 'y2': CAST(y2 AS DOUBLE)}} ORDER BY id) AS boxes FROM ({source}) GROUP BY ALL))"


C.SQL["face_tracks"] = f"WITH RECURSIVE {FRAMES_SQL}, {_detected_sql('SELECT clip, frame // 3 AS frame, frame % 3 AS id, v AS x1, k AS y1, v + 50 AS x2, k + 50 AS y2 FROM fr')}, {_tracks_sql(0.3, 1)}"


@query(f"WITH RECURSIVE {PICTURES_SQL}, {_detected_sql('SELECT * FROM box')}, {_tracks_sql(0.2, 2)}")
def face_tracks_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that live on over frames without boxes."""
    return K.face_tracks(fx.picture_boxes(spark, sf_dir), threshold=0.2, max_gap=2)


# Batches and tokens


@query(
    f"""WITH {F_SQL}, l AS (SELECT dialogue_id, count(*) AS length FROM f GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY length, dialogue_id) - 1 AS n FROM l),
b AS (SELECT dialogue_id, length, n // 8 AS batch, n % 8 AS place, max(length) OVER (PARTITION BY n // 8) AS longest FROM n), t AS (SELECT *, unnest(range(0, longest)) AS t FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY utterance_id) - 1 AS t FROM f)
SELECT t.batch, CAST(t.place AS INTEGER) AS place, t.dialogue_id, CAST(t.t AS INTEGER) AS t, CAST(length AS INTEGER) AS length, CAST(o.dialogue_id IS NOT NULL AS INTEGER) AS mask, CASE WHEN o.dialogue_id IS NULL THEN 2 WHEN speaker = 'user' THEN 0 ELSE 1 END AS speaker, CAST(coalesce(label, 0) AS INTEGER) AS label,
  14 AS width, round(coalesce(rt[2], 0), 6) AS text, round(coalesce(ra[14], 0), 6) AS audio FROM t LEFT JOIN o ON o.dialogue_id = t.dialogue_id AND o.t = t.t"""
)
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight dialogues by length, as rows (batch, place, t)."""
    f = fx.features(spark, sf_dir).withColumn("speaker_index", F.when(F.col("speaker") == "user", 0).otherwise(1))
    b = B.padded_batches(f, 8, ["rt", "ra"])
    lists = ["dialogue_id", "length", "mask", "speaker_index", "label", "rt", "ra"]
    of = b.select("batch", F.posexplode(F.arrays_zip(*lists)).alias("place", "d")).select("batch", "place", "d.dialogue_id", "d.length", F.posexplode(F.arrays_zip(*[F.col(f"d.{c}").alias(c) for c in lists[2:]])).alias("t", "u"))
    return of.select("batch", "place", "dialogue_id", "t", "length", "u.mask", F.col("u.speaker_index").alias("speaker"), "u.label", F.size("u.rt").alias("width"), r6(F.get("u.rt", F.lit(1))).alias("text"), r6(F.get("u.ra", F.lit(13))).alias("audio"))


_WORD = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece, id): the first and last letters, two and three of them too, of the benchmark's words, but for rests that begin with x; ids by hash."""
    word = fx.table(spark, sf_dir, "benchmark").select(F.explode(B.words_of(F.col("text"))).alias("w"))
    first = [F.substring("w", 1, n) for n in (1, 2, 3)]
    last = [F.concat(F.lit("##"), F.substring("w", -n, n)) for n in (1, 2, 3)]
    pieces = word.select(F.explode(F.array(*first, *last)).alias("piece")).where("piece NOT LIKE '##x%'").distinct()
    return pieces.select("piece", F.conv(F.substring(F.md5("piece"), 1, 7), 16, 10).cast("long").alias("id"))


@query(
    rf"""WITH RECURSIVE {U_SQL}, bw AS (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM benchmark),
vo AS (SELECT DISTINCT piece, CAST('0x' || substr(md5(piece), 1, 7) AS BIGINT) AS id FROM (SELECT unnest([left(w, 1), left(w, 2), left(w, 3), '##' || right(w, 1), '##' || right(w, 2), '##' || right(w, 3)]) AS piece FROM bw) WHERE piece NOT LIKE '##x%'),
tx AS (SELECT dialogue_id, utterance_id, regexp_extract_all(coalesce(utterance, ''), '{_WORD}') AS w FROM u), pl AS (SELECT dialogue_id, utterance_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM tx),
wd AS (SELECT DISTINCT word FROM pl), sb AS (SELECT word, p, unnest(range(1, length(word) - p + 2)) AS n FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM wd WHERE length(word) <= 100)),
lo AS (SELECT word, p, max(n) AS n, max_by(id, n) AS id FROM (SELECT sb.*, id FROM sb JOIN vo ON piece = CASE WHEN p > 1 THEN '##' ELSE '' END || substr(word, p, n)) GROUP BY ALL),
wk AS (SELECT word, CAST(1 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS ids FROM wd UNION ALL SELECT wk.word, wk.p + lo.n, list_append(ids, lo.id) FROM wk JOIN lo ON lo.word = wk.word AND lo.p = wk.p),
pc AS (SELECT wd.word, coalesce(ids, [CAST(1 AS BIGINT)]) AS ids FROM wd LEFT JOIN (SELECT * FROM wk WHERE p = length(word) + 1) AS k ON k.word = wd.word),
al AS (SELECT dialogue_id, utterance_id, flatten(list(ids ORDER BY pos)) AS ids FROM pl JOIN pc USING (word) GROUP BY ALL),
ev AS (SELECT tx.dialogue_id, tx.utterance_id, coalesce(ids, []) AS ids FROM tx LEFT JOIN al ON al.dialogue_id = tx.dialogue_id AND al.utterance_id = tx.utterance_id)
SELECT dialogue_id, utterance_id, CAST(least(len(ids), 62) + 2 AS INTEGER) AS n_tokens, len(ids) > 62 AS truncated, array_to_string(list_concat([2], list_concat(ids[1:62], [3])), ' ') AS ids FROM ev"""
)
def truncated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances in pieces of a vocabulary that is made of the benchmark's words, 64 tokens at most."""
    got = B.token_ids(fx.utterances(spark, sf_dir), ["dialogue_id", "utterance_id"], "utterance", _vocabulary(spark, sf_dir), unknown=1, start=2, end=3, max_tokens=64)
    return got.select("dialogue_id", "utterance_id", "n_tokens", "truncated", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


_STEPS = f"""{PICTURES_SQL}, {_BOXES}, num AS (SELECT clip, count(*) AS n FROM pic GROUP BY clip), sam AS (SELECT clip, i AS step, CASE WHEN n <= 16 THEN i ELSE i * (n - 1) // 15 END AS frame FROM num, range(0, 16) AS r(i) WHERE i < n),
shd AS (SELECT sam.*, ((base - 7 * sam.frame) % 10) / 10.0::DOUBLE AS s FROM sam JOIN pic USING (clip, frame)),
g AS (SELECT a.clip, a.step, lst.boxes, coalesce({_SHADES} > 0.3, FALSE) AS cut FROM shd AS a LEFT JOIN shd AS b ON b.clip = a.clip AND b.step = a.step - 1 LEFT JOIN lst ON lst.clip = a.clip AND lst.frame = a.frame)"""


def _measured_sql(floor: float | None, feature: str, width: int, parts: tuple[str, ...]) -> str:
    """Pooled features of the chosen boxes (x1 to y2; those of the frame where none is chosen); a null feature counts for nothing."""
    made = {"mean": "avg(v)", "std": "stddev_pop(v)", "delta": "CASE WHEN count(*) > 1 THEN (max_by(v, step) - min_by(v, step)) / (count(*) - 1) ELSE 0 END"}
    rows = " UNION ALL ".join(f"SELECT clip, CAST(k + {i * width} AS INTEGER) AS class, {made[p]} AS value FROM one GROUP BY clip, k" for i, p in enumerate(parts))
    return f"""WITH RECURSIVE {_STEPS}, {_choice(floor, True)},
fea AS (SELECT clip, step, {feature} AS f FROM (SELECT clip, step, pick IS NULL AS whole, coalesce(pick.x1, 0) AS x1, coalesce(pick.y1, 0) AS y1, coalesce(pick.x2, 12) AS x2, coalesce(pick.y2, 9) AS y2 FROM c WHERE step >= 0)),
one AS (SELECT clip, step, k, f[k + 1] AS v FROM fea, range(0, {width}) AS r(k) WHERE f IS NOT NULL), pld AS ({rows})
SELECT num.clip, CAST(q AS INTEGER) AS class, round(coalesce(value, 0), 4) AS value FROM num CROSS JOIN range(0, {width * len(parts)}) AS r(q) LEFT JOIN pld ON pld.clip = num.clip AND pld.class = q"""


def _measured(spark: SparkSession, sf_dir: str, feature: Callable[[Column], Column], width: int, config: W.VisualConfig) -> DataFrame:
    p, boxes = fx.pictures(spark, sf_dir), fx.picture_boxes(spark, sf_dir)
    clips = p.groupBy("clip").agg(F.lit(0).cast("long").alias("first"), F.count("*").alias("end"))
    whole = p.select("clip", "frame", F.lit(-1).cast("long").alias("box_id"), G.box(F.lit(0), F.lit(0), F.col("width"), F.col("height")).alias("box"))
    measured = boxes.unionByName(whole).select("clip", "frame", "box_id", feature(F.col("box")).alias("feat")).where("feat IS NOT NULL")
    got = W.visual_features(clips, boxes, measured, width, config, _histograms(spark, sf_dir))
    return by_class(got, "embedding", "clip").withColumn("value", F.round("value", 4))


_POINT = "/ (sqrt(pow(x2 - x1, 2) + pow(y1 - y2, 2)) + 1e-6)"


@query(_measured_sql(None, f"[0.0::DOUBLE, 0, (x2 - x1) {_POINT}, 0, 0, (y2 - y1) {_POINT}, (x2 + 1 - x1) {_POINT}, (y2 + 2 - y1) {_POINT}]", 8, ("mean", "std")))
def landmark_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points of each chosen box, normalised, pooled by mean and deviation."""

    def points(b: Column) -> Column:
        own = F.array(F.array(b["x1"], b["y1"]), F.array(b["x2"], b["y1"]), F.array(b["x1"], b["y2"]), F.array(b["x2"] + 1, b["y2"] + 2))
        return F.flatten(G.normalised_landmarks(own, 0, 1, 2))

    return _measured(spark, sf_dir, points, 8, W.VisualConfig(parts=("mean", "std")))


@query(_measured_sql(0.3, "CASE WHEN (x1 + 2) % 3 <> 0 THEN [CASE WHEN (y1 + 1) % 4 <> 0 THEN CAST(x2 AS DOUBLE) ELSE 0 END, CAST(y2 AS DOUBLE)] WHEN (y1 + 1) % 2 = 0 THEN [0.0::DOUBLE, 7] END", 2, ("mean", "std", "delta")))
def action_unit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of each chosen box with NaN among them, or of a second source, or none."""
    nan = F.lit(float("nan"))

    def units(b: Column) -> Column:
        first = F.when((b["x1"] + 2) % 3 != 0, F.array(F.when((b["y1"] + 1) % 4 != 0, b["x2"]).otherwise(nan), b["y2"])).otherwise(F.array(nan, nan))
        return I.first_usable([first, F.when((b["y1"] + 1) % 2 == 0, F.array(nan, F.lit(7.0)))])

    return _measured(spark, sf_dir, units, 2, W.VisualConfig(iou_floor=0.3, parts=("mean", "std", "delta")))
