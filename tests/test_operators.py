import json
import math
import wave

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.functions import geometry as G
from turnweave.functions import pixels as PX
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
from turnweave.operators.groups import apply_to_groups
from turnweave.operators.ranks import numbered
from turnweave.plans import pipelines
from turnweave.sources import sinks
from turnweave.sources import transcripts as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


# Text and order


def test_text_expressions(spark):
    df = spark.createDataFrame([("a\x92b\xa0c\x81", "Ses01F_impro01_F000", "1:02:03,5"), ("\x80", "x_Q1", "bad"), (None, "Ses05", None)], "s string, i string, t string")
    got = df.select(T.repair_mojibake(F.col("s")), T.speaker_from_id(F.col("i")), T.dialogue_name(F.col("i")), T.in_training_sessions(F.col("i")), T.to_seconds(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a’b c\x81", "F", "Ses01F_impro01", True, 3723.5), ("€", "U", "x", False, 0.0), (None, "U", "", False, 0.0)]
    times = spark.createDataFrame([("1500",), ("2:03",), ("nan",), ("",), ("1:2",)], "t string").select(T.to_seconds(F.col("t"))).collect()
    assert [r[0] for r in times] == [1.5, 123.0, 0.0, 0.0, 62.0]


def test_sentiment_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([(None,), (2.0,), (2.1,), (3.0,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(T.sentiment_bucket(F.col("v"))).collect()] == ["", "negative", "neutral", "positive", ""]


def test_tags_and_paths(spark):
    r = one(spark, a=T.noise_tag(F.lit(10.0)), b=T.packet_loss_tag(F.lit(0.3)), c=T.occlusion_tag(F.lit(0.5)), d=T.blur_tag(F.lit(3.0)), e=T.combo_key(F.lit("T+A+V")), f=T.media_path("d", F.lit(3), F.lit(4), ".wav"), g=T.media_path("d", F.lit(3), F.lit(4), ".wav", F.lit("own")))
    assert tuple(r) == ("noise_snr10.0dB", "pktloss30pct", "occlude50pct", "blur_s3.0", "TAV", "d/dia3_utt4.wav", "own")


def test_context_nulls_and_ends(spark):
    df = spark.createDataFrame([(1, 0, "a", "x", ""), (1, 1, None, None, "pos"), (1, 2, "b", "z", None), (2, 0, "c", "w", "neg")], "dialogue_id int, utterance_id int, speaker string, utterance string, s string")
    got = {(r[0], r[1]): r.context for r in D.context_text(df, sentiment="s", prefix="> ").collect()}
    assert got == {(1, 0): "> a: x", (1, 1): "> a: x [SEP]  [pos]", (1, 2): "> a: x [SEP]  [SEP] b: z", (2, 0): "> c: w [neg]"}
    assert [r.context for r in D.context_text(df.where("dialogue_id = 2"), k=0).collect()] == ["w"]


def test_remap_with_and_without_dev(spark):
    rows = [("train", 3), ("train", 9), ("dev", 0), ("dev", 5), ("test", 0), ("test", 9), ("test", 0)]
    got = lambda rows: {(r[0], r[1]): r[2] for r in D.remapped_ids(spark.createDataFrame(rows, "split string, dialogue_id int")).collect()}
    assert got(rows) == {("train", 3): 3, ("train", 9): 9, ("dev", 0): 10, ("dev", 5): 11, ("test", 0): 12, ("test", 9): 13}
    assert got([r for r in rows if r[0] != "dev"])[("test", 0)] == 10
    assert got([("test", 4)]) == {("test", 4): 0}


def test_columns_shards_and_missing(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(40)], "u int, dialogue_id int")
    with pytest.raises(KeyError):
        D.require_columns(df, ["nope"])
    shards = [{r.dialogue_id for r in D.sharded(df, k, 3).collect()} for k in range(3)]
    assert shards == [{0, 3, 6}, {1, 4}, {2, 5}]
    parts = D.validation_split(df, 0.3).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"valid": 2, "train": 5}
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, [1.0, 2.0])], "k int, v array<double>")
    assert sorted(tuple(r) for r in D.missing_policy(left, right, ["k"], "v", 2).collect()) == [(1, [1.0, 2.0], False), (2, [0.0, 0.0], True)]
    with pytest.raises(Exception, match="missing"):
        D.missing_policy(left, right, ["k"], "v", 2, "error").collect()


def test_numbers_ids_and_datasets(spark):
    r = np.random.default_rng(4)
    rows = [(None if k == 3 else k, int(v)) for k, v in zip(r.integers(0, 4, 300).tolist(), r.permutation(300).tolist(), strict=True)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    seen: dict = {}
    for k, v in sorted(rows, key=lambda x: x[1]):
        seen.setdefault(k, []).append(v)
    assert {(x.k, x.v, x.i) for x in numbered(df, ["v"], "i", ["k"]).collect()} == {(k, v, i) for k, own in seen.items() for i, v in enumerate(own)}
    assert [x.i for x in numbered(df, ["v"], "i").orderBy("v").collect()] == list(range(300)) and numbered(df.limit(0), ["v"], "i").collect() == []
    ids = spark.createDataFrame([(1, 10)], "k int, new_id long")
    assert D.with_new_ids(spark.createDataFrame([(1, "a")], "k int, x string"), ids, ["k"]).first().new_id == 10
    with pytest.raises(Exception, match="no id for 2"):
        D.with_new_ids(spark.createDataFrame([(2, "a")], "k int, x string"), ids, ["k"]).collect()
    keys = spark.createDataFrame([(1, "test"), (2, "train")], "dialogue_id long, split string")
    part = lambda name, rows: spark.createDataFrame(rows, f"dialogue_id long, utterance_id long, {name} string")
    parts = {"a": part("a", [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")]), "b": part("b", [(1, 0, "u"), (1, 1, None)])}
    assert sorted(map(tuple, D.dialogue_dataset(keys, parts, "test").collect())) == [(1, 0, "x", "u"), (1, 1, "y", None)]
    with pytest.raises(Exception, match="no b of 2/0"):
        D.dialogue_dataset(keys, parts, "train").collect()


def test_groups_are_whole_across_batches(spark):
    rows = [(i % 7 if i % 50 else None, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = apply_to_groups(df, "k", lambda g: pd.DataFrame({"n": [len(g)], "s": [int(g["v"].sum())]}), "k int, n long, s long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert {(r.k, r.n, r.s) for r in got} == {(k, len(v), sum(v)) for k, v in want.items()} and len(got) == len(want)


def test_limits_hold_in_each_split(spark):
    df = spark.createDataFrame([(s, d, 0) for s in ("train", "dev", "test") for d in range(5)], "split string, d int, u int")
    assert {r.split: r["count"] for r in D.limited_per_split(df, 2, ["d", "u"]).groupBy("split").count().collect()} == {"train": 2, "dev": 2, "test": 2}
    assert D.limited_per_split(df, 0, ["d"]).count() == 15
    plan = D.limited_per_split(df, 2, ["d", "u"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# Arrays, fusion, prior


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=9))
def test_softmax_properties(spark, x):
    r = one(spark, p=A.softmax(A.literal(x)), q=A.log_softmax(A.literal(x)), c=A.calibrated(A.literal(x)), i=A.argmax(A.literal(x)))
    assert sum(r.p) == pytest.approx(1) and sum(r.c) == pytest.approx(1)
    assert np.exp(r.q) == pytest.approx(r.p, abs=1e-12) and r.i == int(np.argmax(x))


def test_prior_is_off_without_alpha_and_first_turn_starts_uniform(spark):
    df = spark.createDataFrame([(1, 0, [5.0] + [0.0] * 6), (1, 1, [0.0] * 4 + [9.0, 0.0, 0.0])], "dialogue_id int, utterance_id int, z array<double>")
    off = X.circumplex_prior(df, "z", alpha=0).collect()
    assert all(r.corrected == r.z for r in off)
    va = np.array([X.SEVEN_CLASS_VA[i] for i in range(7)])
    q = np.full(7, 1 / 7)
    for r in sorted(X.circumplex_prior(df, "z", alpha=0.7, tau=0.3).collect(), key=lambda r: r.utterance_id):
        p = N.softmax(np.array(r.z))
        d = -np.linalg.norm(va - q @ va, axis=1) / 0.3
        prior = (d - np.log(np.exp(d).sum())) * np.linalg.norm(p @ va - q @ va)
        assert r.prior == pytest.approx(prior.tolist()) and r.corrected == pytest.approx((np.array(r.z) + 0.7 * prior).tolist())
        q = p


def test_dropped_modalities_leave_one(spark):
    df = spark.range(300).select(X.dropped_modalities(F.col("id").cast("string"), 0.9).alias("d"))
    sizes = [len(r.d) for r in df.collect()]
    assert max(sizes) == 2 and sizes.count(2) > 200
    assert one(spark, d=X.dropped_modalities(F.lit("x"), 0.0)).d == []


# Losses and metrics, against a restatement


def test_contrastive_loss(spark):
    r = np.random.default_rng(1)
    rows = [(b, u, int(r.integers(3)), r.standard_normal(4).tolist(), r.standard_normal(4).tolist(), r.standard_normal(4).tolist()) for b in range(3) for u in range([1, 4, 6][b])]
    got = {x.b: x.loss for x in L.supervised_contrastive(spark.createDataFrame(rows, "b int, u int, y int, t array<double>, a array<double>, v array<double>"), "b", "y", ["t", "a", "v"]).collect()}
    assert got[0] == 0
    for b in (1, 2):
        own = [x for x in rows if x[0] == b]
        h = np.array([x[k] for k in (3, 4, 5) for x in own])
        h /= np.linalg.norm(h, axis=1, keepdims=True)
        y = np.array([x[2] for x in own] * 3)
        s = h @ h.T / 0.07
        np.fill_diagonal(s, -1e9)
        log_p = s - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)) - s.max(1, keepdims=True)
        pos = (y[:, None] == y) & ~np.eye(len(y), dtype=bool)
        assert got[b] == pytest.approx(float((-(log_p * pos).sum(1) / pos.sum(1)).mean()))


def test_losses(spark):
    p, t = [math.log(0.7), math.log(0.3)], [0.0, 1.0]
    df = spark.createDataFrame([(p, 0, t), (p, 1, t)], "p array<double>, y int, t array<double>")
    r = df.agg(L.nll(F.col("p"), F.col("y")).alias("n"), L.kl(F.col("p"), F.col("t"), 2).alias("k"), L.kl(F.col("p"), F.col("t"), 2, padded=2).alias("kp")).first()
    assert r.n == pytest.approx(-(p[0] + p[1]) / 2) and r.k == pytest.approx(-math.log(0.3), abs=1e-6) and r.kp == pytest.approx(-math.log(0.3) - math.log(2), abs=1e-6)
    assert one(spark, x=L.total_loss({"a": F.lit(2.0), "b": F.lit(3.0)}, {"b": 0.5})).x == 3.5
    assert L.epoch_loss(spark.createDataFrame([(1.0, 1), (2.0, 3)], "loss double, n_valid int")).first().loss == 1.75


def test_metrics_of_classes_without_support_or_choice(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 1), (2, 2)], "label int, pred int")
    c = {r["class"]: r for r in M.per_class(M.cells(df)).collect()}
    assert c[1].support == 0 and c[1].recall == 0 and c[1].f1 == 0
    s = M.summary(M.cells(df)).first()
    assert (s.n, s.accuracy, s.weighted_f1) == (4, 50.0, 66.67)
    report = {r.row: r for r in M.report(M.cells(df)).collect()}
    assert report["macro"].f1 == pytest.approx(4 / 9) and report["accuracy"].f1 == 0.5
    assert sum(r.share for r in M.confusion(M.cells(df)).collect()) == 2.0


def test_early_stop(spark):
    run = lambda scores, patience: tuple(M.early_stop(spark.createDataFrame(list(enumerate(scores)), "epoch int, f1 double"), patience).first())
    assert run([0.1, 0.5, 0.5, 0.4, 0.9], 2) == (1, 0.5, 3)
    assert run([0.1, 0.5, 0.4, 0.9], 2) == (3, 0.9, None)


# Signals, frames, boxes


@settings(max_examples=15, deadline=None)
@given(st.integers(-2, 60), st.integers(2, 20))
def test_sampled_frames(spark, n, k):
    got = one(spark, f=S.sampled_frames(F.lit(n), k)).f
    want = [] if n <= 0 else list(range(n)) if n <= k else np.linspace(0, n - 1, k).astype(int).tolist()
    assert got == want


def test_waveforms(spark):
    r = one(spark, m=S.mono(F.array(A.literal([1, 2]), A.literal([3, 4]))), e=S.prepared(F.array().cast("array<double>")), q=S.prepared(A.literal([1e-6] * 10), rate=100), l=S.prepared(A.literal([0.5, -0.5] * 50), rate=100, max_seconds=0.5))
    assert r.m == [2.0, 3.0] and (r.e.samples, r.e.silent) == ([0.0], True) and r.q.silent and len(r.q.samples) == 20
    assert len(r.l.samples) == 60 and math.sqrt(np.mean(np.square(r.l.samples))) == pytest.approx(0.1)
    lossy = one(spark, w=S.lossy(F.array_repeat(F.lit(1.0), 1005), F.lit("k"), 0.4, 10)).w
    assert lossy[1000:] == [1.0] * 5
    assert all(len(set(lossy[i : i + 10])) == 1 for i in range(0, 1000, 10))
    assert 400 < sum(lossy[:1000]) < 800
    clean = A.literal(np.sin(np.arange(2000)).tolist())
    noise = one(spark, n=F.zip_with(S.noisy(clean, F.lit("k"), 10.0), clean, lambda a, b: a - b)).n
    assert np.std(noise) == pytest.approx(np.sqrt(0.5) / 10**0.5, rel=0.1)


def test_frame_range(spark):
    got = lambda s, e, fps, n: tuple(one(spark, r=S.frame_range(F.lit(s).cast("double"), F.lit(e).cast("double"), F.lit(fps).cast("double"), F.lit(n).cast("long"))).r)
    assert got(1.0, 2.0, 25, 100) == (25, 50) and got(0, 0, 25, 100) == (0, 100) and got(9.0, 1.0, 25, 100) == (99, 100) and got(None, None, 0, 10) == (0, 10)
    assert one(spark, f=S.occlusion_frames(F.lit(3), F.lit(5), 4)).f == np.linspace(3, 4, 4).astype(int).tolist()


sides = st.floats(-100, 100)


@settings(max_examples=15, deadline=None)
@given(st.tuples(sides, sides, sides, sides), st.tuples(sides, sides, sides, sides))
def test_iou_is_symmetric_and_bounded(spark, a, b):
    box = lambda v: G.box(*[F.lit(x) for x in v])
    r = one(spark, x=G.iou(box(a), box(b)), y=G.iou(box(b), box(a)))
    assert r.x == pytest.approx(r.y) and 0 <= r.x <= 1
    assert r.x == pytest.approx(float(K.ious(np.array([a]), np.array(b))[0]))


def test_box_variants_and_landmarks(spark):
    b = G.box(F.lit(-1.5), F.lit(2.2), F.lit(8.5), F.lit(12.7))
    r = one(spark, m=G.with_margin(b, 0.1, 9, 100), t=G.with_margin_truncated(b, 0.1, 9, 100), o=G.occluded_rows(G.box(F.lit(0), F.lit(0), F.lit(5), F.lit(9)), 0.5), c=G.centre(b), h=G.chi_square(A.literal([0.5, 0.5]), A.literal([1, 0])))
    assert tuple(r.m) == (0, 1, 9, 14) and tuple(r.t) == (0, 1, 9, 13) and tuple(r.o) == (5, 9) and tuple(r.c) == pytest.approx((3.5, 7.45)) and r.h == pytest.approx(0.25 / 1.5 + 0.5)
    points = F.array(*[A.literal([i, 2 * i]) for i in range(68)])
    n = one(spark, n=G.normalised_landmarks(points)).n
    unit = math.hypot(9, 18) + 1e-6
    assert n[30] == [0, 0] and n[31] == pytest.approx([1 / unit, 2 / unit])


# Pooling and tracking


def test_pooling(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 4.0]), ("a", 2, [3.0, 4.0]), ("b", 0, [7.0, 8.0])], "clip string, frame int, feat array<double>")
    clips = spark.createDataFrame([("a",), ("b",), ("c",)], "clip string")
    got = {r.clip: r.pooled for r in P.pooled_or_zeros(clips, df, ["clip"], "feat", "frame", ("mean", "std", "delta"), 6).collect()}
    assert got == {"a": [2, 4, 1, 0, 2, 0], "b": [7, 8, 0, 0, 0, 0], "c": [0.0] * 6}
    tok = P.token_pooled(df, ["clip"], "feat", "frame", F.col("frame") > 0, "cls+mean")
    assert {r.clip: r.pooled for r in tok.collect()} == {"a": [1, 4, 3, 4], "b": [7, 8, 0, 0]}


def check_tracks(frames, rows, threshold, max_gap):
    """That a result is what the rule says, read off the result: who was free, who took what, who began, who ended when."""
    of_box = {(f, b): t for f, b, t, _ in rows}
    assert len(rows) == len(of_box) == sum(map(len, frames.values()))
    held = {}
    for f, b, t, _ in sorted(rows):
        assert (t, f) not in held
        held[t, f] = b
    begun = 0
    last = {}
    for f in sorted(frames):
        free = set(range(len(frames[f])))
        for t in sorted(last):
            if f - 1 - last[t] > max_gap:
                assert (t, f) not in held
                continue
            reach = {i: float(K.ious(np.array([frames[f][i]]), np.array(frames[last[t]][held[t, last[t]]]))[0]) for i in free}
            good = {i: v for i, v in reach.items() if v >= threshold and v > 0}
            if (t, f) in held:
                assert held[t, f] == min(i for i, v in good.items() if v == max(good.values()))
                free.discard(held[t, f])
                last[t] = f
            else:
                assert not good
        for i in sorted(free):
            assert of_box[f, i] == begun
            last[begun] = f
            begun += 1
    ends = {t: (f + max_gap + 1 if f + max_gap + 1 <= max(frames) else math.inf, t) for t, f in last.items()}
    assert {t: o for _, _, t, o in rows} == {t: i for i, t in enumerate(sorted(ends, key=ends.get))}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 14), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=4), min_size=1), st.integers(0, 3), st.sampled_from([0.1, 0.3, 0.5]))
def test_tracks_follow_the_rule(frames, gap, threshold):
    frames = {f: [[x, y, x + 4, y + 4] for x, y in b] for f, b in frames.items()}
    clip = pd.DataFrame([(f, i, *b) for f, bs in frames.items() for i, b in enumerate(bs)], columns=["frame", "box_id", "x1", "y1", "x2", "y2"])
    check_tracks(frames, [tuple(map(int, r)) for r in K.track_clip(clip, threshold, gap).to_numpy()], threshold, gap)


def test_face_choice_and_best_track(spark):
    rows = [(1, 0, 0, 0, 0, 5, 5), (1, 0, 1, 0, 0, 9, 9), (1, 1, 0, 50, 50, 60, 60), (1, 1, 1, 1, 1, 9, 9), (1, 2, 0, 80, 80, 90, 90), (1, 3, 0, 0, 0, 3, 3), (1, 3, 1, 0, 0, 4, 4)]
    df = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], "clip long, frame long, box_id long, x1 double, y1 double, x2 double, y2 double").select("clip", "frame", "box_id", G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("box"))
    pick = lambda floor: [r.box_id for r in K.chosen_faces(df, floor).orderBy("frame").collect()]
    assert pick(0.3) == [1, 1, -1, 1] and pick(None) == [1, 1, 0, 0]
    frames = spark.createDataFrame([(1, f, f == 1) for f in range(5)], "clip long, frame long, cut boolean")
    at = lambda **k: [r.box_id for r in K.chosen_faces(df, 0.3, frames, **k).orderBy("frame").collect()]
    assert at() == [1, 0, -1, 1, -1]  # the cut at 1 takes the largest, which 2 does not overlap
    assert at(forget_rejected=False) == [1, 0, -1, -1, -1]
    holes = df.where("frame <> 1")
    assert [r.box_id for r in K.chosen_faces(holes, 0.3, frames.drop("cut"), forget_empty=False).orderBy("frame").collect()] == [1, -1, -1, 1, -1]
    assert [r.box_id for r in K.chosen_faces(holes, 0.3, frames.drop("cut")).orderBy("frame").collect()] == [1, -1, 0, -1, -1]
    tracks = K.face_tracks(df, 0.3)
    scores = K.track_scores(tracks, spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.6)], "clip long, track_id long, p double"), shortest=1)
    got = K.speaker_boxes(spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "clip long, frame long"), df, tracks, scores, 0.5).orderBy("frame").collect()
    assert [r.box is not None for r in got] == [True, True, False]


# Model


@pytest.mark.parametrize("fusion", N.FUSIONS)
@pytest.mark.parametrize("extra", [{}, {"disentangle": True, "identity_gates": False}, {"intra_visual": "learned"}, {"intra_visual": "fixed"}, {"landmark_projector": True, "dropout_site": "representation"}])
def test_forward_variants(fusion, extra):
    c = N.ModelConfig(text=5, audio=4, visual=7, hidden=8, heads=2, classes=3, speakers=2, appearance=4, gate_dim=6, fusion=fusion, **extra)
    w, r = N.seeded_weights(c, 1), np.random.default_rng(2)
    x = [r.standard_normal((6, n)) for n in (5, 4, 7)]
    out = N.run_dialogue(*x, np.array([0, 1, 0, 1, 2, 0]), w, c)
    assert out["all"].shape == (6, 3) and np.isfinite(out["all"]).all()
    gone = N.run_dialogue(*x, np.zeros(6, int), w, c, ["A"])
    same = N.run_dialogue(x[0], x[1] * 9 + 1, x[2], np.zeros(6, int), w, c, ["A"])
    if c.dropout_site == "input":
        assert np.allclose(gone["all"], same["all"])
    elif c.fusion in ("scalar_reliability", "transformer_reliability", "entropy", "softmax"):
        assert np.allclose(gone["h.a"], 0)


def test_attention_against_loops():
    c = N.ModelConfig(text=3, audio=3, visual=3, hidden=4, heads=2, classes=2, speakers=2)
    w, r = N.seeded_weights(c), np.random.default_rng(0)
    a, b = r.standard_normal((3, 4)), r.standard_normal((3, 4))
    got = N.attention(a, b, w, "at.", 2)
    q, k, v = (x @ w[f"at.{n}"].T + w[f"at.{n}.b"] for x, n in ((b, "q"), (a, "k"), (a, "v")))
    want = np.zeros((3, 4))
    for h in (slice(0, 2), slice(2, 4)):
        for i in range(3):
            s = np.array([q[i, h] @ k[j, h] / math.sqrt(2) for j in range(3)])
            p = np.exp(s) / np.exp(s).sum()
            want[i, h] = sum(p[j] * v[j, h] for j in range(3))
    assert np.allclose(got, want @ w["at.o"].T + w["at.o.b"])
    assert N.gelu(np.array([1.0]))[0] == pytest.approx(0.8413447) and N.positions(2, 4)[1].tolist() == pytest.approx([math.sin(1), math.cos(1), math.sin(0.01), math.cos(0.01)])


def test_forward_and_sweep(spark):
    c = N.ModelConfig(text=2, audio=2, visual=2, hidden=4, heads=2, classes=3, speakers=2)
    rows = [(d, u, (d + u) % 3, u % 2, [float(d), 1.0], [float(u), 0.5], [0.3, 0.2]) for d in range(3) for u in range(4)]
    f = spark.createDataFrame(rows, "dialogue_id long, utterance_id long, label int, speaker_index int, t array<double>, a array<double>, v array<double>")
    w = N.seeded_weights(c)
    got = {(r.dialogue_id, r.utterance_id): r.logits for r in N.forward(f, w, c, "t", "a", "v").collect()}
    own = [x for x in rows if x[0] == 1]
    want = N.run_dialogue(*[np.array([x[k] for x in own]) for k in (4, 5, 6)], np.array([x[3] for x in own]), w, c)["all"]
    assert [got[(1, u)] for u in range(4)] == [pytest.approx(x.tolist()) for x in want]
    sweep = pipelines.combo_sweep(f, w, c, "t", "a", "v", {i: (0.1 * i, 0.2) for i in range(3)}, 0.5).collect()
    assert {r.combo for r in sweep} == set(X.COMBOS) and all(r.n == 12 for r in sweep)


def test_model_parts(spark):
    c = N.ModelConfig(text=2, audio=2, visual=2, hidden=4, heads=2, classes=3, speakers=2, disentangle=True)
    counts = N.parameter_counts(N.seeded_weights(c))
    assert counts["all"] == sum(v for k, v in counts.items() if k != "all") and counts["head"] == 4 * (4 * 3 + 3)
    rows = [(1, u, u % 2, [0.1 * u, 1.0], [0.5, 0.2], [0.3, u / 7]) for u in range(3)]
    f = spark.createDataFrame(rows, "dialogue_id long, utterance_id long, speaker_index int, t array<double>, a array<double>, v array<double>")
    got = N.outputs(N.forward(f, N.seeded_weights(c), c, "t", "a", "v", combos={"all": [], "T": ["A", "V"]}), 3.0).collect()
    assert len(got) == 6 and all(r.orthogonality >= 0 for r in got)
    for r in got:
        z = np.array(r.logits)
        assert r.p == pytest.approx(N.softmax(z).tolist()) and r.kl_p == pytest.approx(N.softmax(z / 3).tolist()) and np.exp(r.kl_log_p_a) == pytest.approx(N.softmax(np.array(r.logits_a) / 3).tolist())
    alone = {r.utterance_id: r.logits for r in N.forward(f, N.seeded_weights(c), c, "t", "a", "v", ["A", "V"]).collect()}
    assert all(alone[r.utterance_id] == pytest.approx(r.logits) for r in got if r.combo == "T")
    with pytest.raises(Exception, match="width"):
        f.select(N.visual_parts(F.col("t"), 2, 5)).collect()


@pytest.mark.parametrize("rate, target", [(24_000, 16_000), (44_100, 16_000), (8_000, 16_000), (48_000, 16_000), (16_000, 16_000)])
def test_resampling_is_a_filtered_comb(rate, target):
    x = np.random.default_rng(0).standard_normal(3000)
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    comb = np.zeros(len(x) * up)
    comb[::up] = x
    h = S.low_pass(up, down) if up != down else np.ones(1)
    want = np.convolve(comb, h)[len(h) // 2 :][::down][: -(-len(x) * up // down)]
    assert S.resampled_wave(x, rate, target) == pytest.approx(want)
    assert S._in_blocks(x, rate, target, 700) == pytest.approx(want)
    tone = np.sin(np.arange(4000) * 2 * math.pi * 300 / rate)
    got = S.resampled_wave(tone, rate, target)[200:-200]
    assert got == pytest.approx(np.sin((np.arange(len(got)) + 200) * 2 * math.pi * 300 / target), abs=2e-2)


def test_pixels():
    frame = np.random.default_rng(1).integers(0, 256, (9, 12, 3)).astype(np.uint8)
    flat = np.full((9, 12), 77, np.uint8)
    assert (PX.blurred(flat, 2.0) == 77).all() and PX.blurred(frame, 1.0).std() < frame.std() and PX.blurred(frame, 1.0).dtype == np.uint8
    w = PX.gaussian_kernel(1.0)
    line = np.arange(12.0)[None, :] ** 2
    want = [sum(w[k + len(w) // 2] * line[0, 11 - abs(11 - abs(i + k))] for k in range(-(len(w) // 2), len(w) // 2 + 1)) for i in range(12)]
    assert PX.blurred(line, 1.0)[0] == pytest.approx(want)
    hidden = PX.occluded(frame, 2, 1, 8, 7, 0.5)
    assert (hidden[4:7, 2:8] == 0).all() and (np.delete(hidden, range(4, 7), 0) == np.delete(frame, range(4, 7), 0)).all()
    assert (PX.occluded(frame, 0, 0, 3, 3, 0.01)[2, :3] == 0).all()


# Sources, sinks, pipelines


@pytest.fixture
def corpus(tmp_path):
    t, e = tmp_path / "t", tmp_path / "e"
    t.mkdir()
    e.mkdir()
    (t / "Ses01F_a.txt").write_text("Ses01F_a_F000 [006.29-008.24]: Excuse me.\n\n// note\nSes01F_a_M000 [001.00-002.00]: Early\x92s.\nM: dropped\nSes01F_a_F001 [009.0-010.0]:\n")
    (t / "Ses05F_b.txt").write_text("Ses05F_b_M000 [001.0-002.0]: Test.\n")
    (t / "._x.txt").write_text("Ses01F_x_M000 [001.0-002.0]: no\n")
    (e / "a.txt").write_text("% head\n[6.29 - 8.24]\tSes01F_a_F000\tneu\t[2.5, 2.5, 2.5]\n[7.00 - 8.24]\tSes01F_a_F000\tang\t[1.0, 2.5, 2.5]\n[1.00 - 2.00]\tSes01F_a_M000\thap\t[4.5, 2.5, 2.5]\n[1.0 - 2.0]\tSes05F_b_M000\txxx\n")
    return str(t), str(e)


def test_transcript_corpus(spark, corpus):
    t, e = corpus
    ev = {r.utt_str_id: r for r in R.read_evaluations(spark, e).collect()}
    assert (ev["Ses01F_a_F000"].emotion, ev["Ses01F_a_F000"].valence) == ("neu", 2.5) and "Ses05F_b_M000" not in ev
    assert {r.utt_str_id for r in R.read_evaluations(spark, e, with_ratings=False).collect()} == {"Ses01F_a_F000", "Ses01F_a_M000", "Ses05F_b_M000"}
    u = R.corpus_utterances(R.read_transcripts(spark, t), R.read_evaluations(spark, e))
    got = [(r.split, r.dialogue_id, r.utterance_id, r.utt_str_id, r.utterance, r.speaker, r.start, r.emotion) for r in u.orderBy("dialogue_id", "utterance_id").collect()]
    assert got == [("train", 0, 0, "Ses01F_a_M000", "Early’s.", "M", 1.0, "hap"), ("train", 0, 1, "Ses01F_a_F000", "Excuse me.", "F", 6.29, "neu"), ("train", 0, 2, "Ses01F_a_F001", "", "F", 0.0, ""), ("test", 1, 0, "Ses05F_b_M000", "Test.", "M", 0.0, "")]
    assert R.with_media(u, "/r", "audio").where("utterance_id = 1").first().media_path == "/r/Session1/sentences/wav/Ses01F_a/Ses01F_a_F000.wav"
    text = pipelines.corpus_text(spark, t, e)
    assert {r.Sentiment for r in text.collect()} == {"positive", "neutral", ""}
    assert pipelines.text_features(text, HashEncoder).count() == 4


def test_csv_to_features(spark, tmp_path):
    for name, ids in (("train", (0, 4)), ("test", (0, 1))):
        (tmp_path / f"{name}.csv").write_text("Dialogue_ID,Utterance_ID,Utterance,Speaker,StartTime\n" + "".join(f'{d},{u},"say, {u}",S,"0:0:{u},5"\n' for d in ids for u in range(2)))
    both = pipelines.split_tables(spark, f"{tmp_path}/train.csv", None, f"{tmp_path}/test.csv")
    assert R.with_times(both).agg(F.max("Start_Time")).first()[0] == 1.5
    got = pipelines.text_features(both, HashEncoder)
    assert sorted((r.split, r.dialogue_id, r.utterance_id) for r in got.collect()) == sorted([("train", d, u) for d in (0, 4) for u in (0, 1)] + [("test", d, u) for d in (5, 6) for u in (0, 1)])
    sinks.write_embeddings(got, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
    bad = tmp_path / "bad.csv"
    bad.write_text("Dialogue_ID,Utterance\n1,x\n")
    with pytest.raises(KeyError):
        R.read_utterances(spark, str(bad))


def test_audio_and_annotations(spark, tmp_path):
    for name, amp in (("loud", 0.5), ("quiet", 0.0)):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes((amp * 32767 * np.sin(np.arange(3200))).astype("<i2").repeat(2).tobytes())
    (tmp_path / "broken.wav").write_bytes(b"RIFFnope")
    media = R.read_media(spark, str(tmp_path), "*.wav")
    for config in (pipelines.AudioConfig(), pipelines.AudioConfig(degradation="packet_loss"), pipelines.AudioConfig(degradation="noise")):
        got = {r.path.rsplit("/", 1)[1]: r for r in pipelines.audio_features(R.decoded_waves(media), lambda: HashEncoder(4), config).collect()}
        assert [got[k].silent for k in ("loud.wav", "broken.wav")] == [False, True] and got["broken.wav"].embedding == [0.0] * 4 and any(got["loud.wav"].embedding)
    (tmp_path / "va.json").write_text(json.dumps({"u1": [0.1, 0.2]}))
    assert [tuple(r) for r in R.read_va(spark, f"{tmp_path}/va.json").collect()] == [("u1", [0.1, 0.2])]
    assert R.media_size_mb(media).first().mb > 0


def test_encoder_and_metric_document(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k int, x string")
    got = {r.k: r.embedding for r in encoded(df, lambda: HashEncoder(5), "x").collect()}
    assert got[1] == got[3] and got[2] == [0.0] * 5 and len(got[1]) == 5
    counts = M.cells(spark.createDataFrame([("T", 0, 0), ("T", 1, 0), ("A", 1, 1)], "combo string, label int, pred int"), ["combo"])
    doc = sinks.metrics_document(M.summary(counts, ["combo"]), M.per_class(counts, ["combo"]), dataset="d")
    sinks.write_metrics(doc, f"{tmp_path}/m")
    read = spark.read.json(f"{tmp_path}/m").first()
    assert read.dataset == "d" and read.combos["A"]["accuracy"] == 100.0
