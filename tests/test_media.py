"""Sound, frames and tracks: odd inputs, and rules restated plainly."""

import dataclasses
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.functions import pixels as I
from turnweave.operators import batches as B
from turnweave.operators import gates as G
from turnweave.operators import model as N
from turnweave.operators import sound as O
from turnweave.plans import catalog_gates
from turnweave.plans import pipelines as W
from turnweave.sources import frames as V
from turnweave.sources import sinks as K
from turnweave.sources import transcripts as R


def test_rows_of_a_fourier_series_are_those_of_its_cosines():
    r = np.random.default_rng(1)
    for have, want in ((1, 4), (2, 4), (3, 4), (4, 4), (5, 4), (8, 4), (9, 4), (4, 9), (6, 7), (7, 3), (1, 1), (6, 1)):
        x = r.standard_normal((have, 2))
        both = min(have, want)
        weight = [1, *(1 if 2 * q == both and want >= have else 2 for q in range(1, both // 2 + 1))]
        g = np.array([[sum(w * math.cos(2 * math.pi * q * (j / want - t / have)) for q, w in enumerate(weight)) for t in range(have)] for j in range(want)]) / have
        assert O.resampled_rows(x, want) == pytest.approx(g @ x, abs=1e-12)


def test_mel_frequencies_join_at_a_thousand_hertz():
    f = O.mel_frequencies(131, 8000.0)
    assert f[0] == 0 and f[-1] == pytest.approx(8000)
    low, high = f[f < 1000], f[f > 1000]
    assert np.diff(low) == pytest.approx(np.diff(low)[0])
    assert (high[1:] / high[:-1]) == pytest.approx(high[1] / high[0])
    assert O.mel_filters(16_000, 512, 128).shape == (128, 257) and (O.mel_filters(16_000, 512, 128) >= 0).all()


def test_cepstra_of_odd_waveforms(spark):
    tone = [math.sin(i / 3) for i in range(4000)]
    rows = [(1, None, 25.0), (2, [], 25.0), (3, [0.0] * 1000, None), (4, [0.5], 0.0), (5, tone, 25.0), (6, tone, 50.0), (7, tone, -1.0)]
    waves = spark.createDataFrame(rows, "clip long, wave array<double>, fps double")
    got = {c: sorted((r.t, r.cepstrum) for r in rs) for c, rs in _by(O.cepstra(waves, 16_000, fps=F.col("fps")).collect()).items()}
    assert sorted(got) == [3, 4, 5, 6, 7]
    assert [t for t, _ in got[5]] == list(range(1 + 4000 // 160)) and [t for t, _ in got[6]] == list(range(1 + 4000 // 80))
    assert np.array([x for _, x in got[7]]) == pytest.approx(np.array([x for _, x in got[5]]))
    assert got[3][0][1][0] == pytest.approx(-100 * math.sqrt(128)) and max(map(abs, got[3][0][1][1:])) < 1e-9
    # a window in the middle, from its definition
    wide = np.array(tone[10 * 160 - 200 : 10 * 160 + 200]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400))
    power = [abs(sum(wide * np.exp(-2j * np.pi * k * np.arange(400) / 512))) ** 2 for k in range(257)]
    db = 10 * np.log10(np.maximum(O.mel_filters(16_000, 512, 128) @ power, 1e-10))
    all_db = [O.log_mel(np.array([([0.0] * 200 + tone + [0.0] * 200)[t * 160 : t * 160 + 400]]), 16_000, 512, 128) for t in range(26)]
    db = np.maximum(db, np.max(all_db) - 80)
    want = [math.sqrt((1 if k == 0 else 2) / 128) * sum(db * np.cos(np.pi * k * (2 * np.arange(128) + 1) / 256)) for k in range(13)]
    assert got[5][10][1] == pytest.approx(want, abs=1e-8)
    framed = O.cepstra_by_frame(waves, 16_000, F.when(F.col("clip") == 6, 0).otherwise(F.col("clip"))).groupBy("clip").count().collect()
    assert {r["clip"]: r["count"] for r in framed} == {3: 12, 4: 16, 5: 20, 7: 28}


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.clip, []).append(r)
    return out


def test_sound_of_tracks_over_buckets_and_without_sound(spark):
    sound = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(4 * 150)], "clip long, row int, cepstrum array<double>")
    tracks = spark.createDataFrame([(1, 0, f) for f in range(40, 140)] + [(1, 1, f) for f in range(4)] + [(1, 2, f) for f in range(145, 155)] + [(2, 0, f) for f in range(5)], "clip long, track_id long, frame long")
    plan = O.sound_of_tracks(tracks, sound, width=2)
    got = {}
    for r in plan.collect():
        got.setdefault((r.clip, r.track_id), []).append((r.place, r.cepstrum))
    assert sorted(got) == [(1, 0), (1, 2), (2, 0)]  # four frames are too few
    assert [x[0] for _, x in sorted(got[1, 0])] == [float(i) for i in range(160, 560)]
    assert len(got[1, 2]) == 40 and [x[1] for _, x in got[1, 2]] == pytest.approx([1.0] * 40)
    assert [x for _, x in got[2, 0]] == [[0.0, 0.0]] * 20
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


# Pixels


def test_resized_frames():
    r = np.random.default_rng(1)
    frame = r.integers(0, 256, (9, 12)).astype(np.uint8)
    assert (I.resized(np.full((3, 5), 9, np.uint8), 7) == 9).all()
    assert (I.resized(frame[:9, :9], 9) == frame[:9, :9]).all()
    assert I.resized(np.array([[5]], np.uint8), 3).tolist() == [[5] * 3] * 3
    small = I.resized(frame, 4)
    for j in range(4):
        for i in range(4):
            x, y = min(max((i + 0.5) * 12 / 4 - 0.5, 0), 11), min(max((j + 0.5) * 9 / 4 - 0.5, 0), 8)
            at = lambda a, b: float(frame[min(b, 8), min(a, 11)])
            u, v = int(x), int(y)
            want = (at(u, v) * (1 - x + u) + at(u + 1, v) * (x - u)) * (1 - y + v) + (at(u, v + 1) * (1 - x + u) + at(u + 1, v + 1) * (x - u)) * (y - v)
            assert abs(float(small[j, i]) - want) <= 0.5 + 1e-9


def test_pixel_columns_with_nulls_and_empty_boxes(spark):
    frame = np.arange(12, dtype=np.uint8).reshape(3, 4)
    box = "struct<x1:long,y1:long,x2:long,y2:long>"
    rows = [(1, frame.tobytes(), 4, (1, 0, 3, 3)), (2, frame.tobytes(), 4, (2, 2, 2, 3)), (3, None, 4, (0, 0, 1, 1)), (4, frame.tobytes(), 4, None), (5, frame.tobytes(), 4, (0, 0, 4, 3))]
    df = spark.createDataFrame(rows, f"i int, p binary, w int, b {box}")
    c = [F.col(x) for x in "pwb"]
    got = {r.i: r for r in df.select("i", I.cropped_pixels(*c).alias("crop"), I.occluded_pixels(*c, 0.5).alias("dark"), I.face_pixels(*c, 3).alias("face"), I.blurred_pixels(c[0], c[1], 1.0).alias("blur"), I.total_brightness(c[0], c[1]).alias("sum")).collect()}
    assert got[1].crop == frame[:, 1:3].tobytes() and got[1].dark == I.occluded(frame, 1, 0, 3, 3, 0.5).tobytes()
    assert got[2].crop == b"" and got[2].face == I.resized(frame, 3).tobytes() and got[1].face == I.resized(frame[:, 1:3], 3).tobytes()
    assert got[3].crop is None and got[3].blur is None and got[4].crop is None and got[4].blur == I.blurred(frame, 1.0).tobytes()
    assert got[5].crop == frame.tobytes() and got[5].sum == [66.0, 60.0]


def turned(a, b, c):
    """Rotations about three axes one after another."""
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    return rz @ ry @ rx


def test_pose_and_expression(spark):
    cases = [(0.3, -0.4, 0.2), (0.0, 0.0, 0.0), (-1.0, 1.2, 3.0), (0.5, -math.pi / 2, 0.0), (0.5, math.pi / 2, 0.0)]
    rows = []
    for i, angles in enumerate(cases):
        camera = np.concatenate([turned(*angles) * 7.5, [[1.0], [2.0], [3.0]]], 1)
        rows.append((i, [*camera.ravel().tolist(), *[0.0] * 40, *map(float, range(10))]))
    got = spark.createDataFrame([*rows, (9, None), (10, [1.0] * 61)], "i int, p array<double>").select("i", I.expression_vector(F.col("p")).alias("v")).orderBy("i").collect()
    assert got[5].v is None and got[6].v is None
    for (a, b, c), r in zip(cases, got[:5], strict=True):
        assert r.v[:10] == list(map(float, range(10)))
        if abs(math.sin(b)) < 0.998:
            assert r.v[10:] == pytest.approx([math.degrees(x) for x in (-b, a, c)])
        else:  # roll and pitch turn about one axis
            assert r.v[10] == pytest.approx(math.degrees(-b)) and r.v[12] == 0


# Frames of files


def write_video(path, n, width=4, height=3, header=b"YUV4MPEG2 W4 H3 F10:1 Ip A1:1 Cmono\n"):
    frames = [bytes([(f + i) % 256 for i in range(width * height)]) for f in range(n)]
    path.write_bytes(header + b"".join(b"FRAME\n" + f for f in frames))
    return frames


def test_only_asked_frames_are_read_from_the_file(spark, tmp_path):
    frames = write_video(tmp_path / "a.y4m", 100)
    raw = bytearray((tmp_path / "a.y4m").read_bytes())
    own = V.Layout.of(bytes(raw))
    raw[own.head : own.at(20)] = b"x" * (20 * own.stride)  # no frames any more: reading them is an error
    raw[own.at(30) :] = b"x" * (70 * own.stride)
    (tmp_path / "a.y4m").write_bytes(bytes(raw))
    for split in (1 << 20, 64):  # whole files and parts of a few frames
        df = V.read_frames(spark, str(tmp_path), split_bytes=split)
        for found, want in (
            (df.where("frame >= 20 AND frame < 30"), range(20, 30)),
            (df.where("frame > 24 AND frame <= 29"), range(25, 30)),
            (df.where("frame = 21"), [21]),
            (df.where("frame IN (29, 20, 23)"), [20, 23, 29]),
            (df.where("frame IN (21, 22, 60) AND frame < 30 AND fps = 10"), [21, 22]),
            (V.read_frames(spark, str(tmp_path), 2.0, 0.5, split).where("width = 4"), range(20, 25)),
            (df.where("frame >= 5000"), []),
        ):
            assert [(r.frame, bytes(r.pixels)) for r in found.orderBy("frame").collect()] == [(f, frames[f]) for f in want]
    with pytest.raises(Exception, match="does not begin"):
        V.read_frames(spark, str(tmp_path)).where("frame < 25").collect()


def test_bytes_that_a_part_reads(tmp_path):
    write_video(tmp_path / "a.y4m", 1000)
    raw = (tmp_path / "a.y4m").read_bytes()
    asked = []

    def read(offset, n):
        asked.append((offset, n))
        return raw[offset : offset + n]

    reader = V.FramesReader({"path": str(tmp_path)})
    reader.wanted = {500, 501, 502, 900}
    part = reader.partitions()[0]
    assert sum(b.num_rows for b in reader.rows(part, read)) == 4
    own = V.Layout.of(raw)
    assert asked == [(0, V.HEAD), (own.at(500), 3 * own.stride), (own.at(900), own.stride)]


def test_video_info_needs_no_filter_setting(spark, tmp_path):
    write_video(tmp_path / "a.y4m", 5)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        got = V.read_video_info(spark, str(tmp_path)).where("frames > 1").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert [(r.width, r.height, r.frames) for r in got] == [(4, 3, 5)]


def test_small_files_share_tasks(spark, tmp_path):
    frames = {f"{i:03}.y4m": write_video(tmp_path / f"{i:03}.y4m", i % 4 + 1) for i in range(300)}
    parts = V.FramesReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 1
    assert len(V.FramesReader({"path": str(tmp_path), "split_bytes": str(100 * V.OPENING)}).partitions()) == 4
    assert [(p.path, p.start, p.end) for p in parts[0]] == [(str(tmp_path / n), 0, (tmp_path / n).stat().st_size) for n in frames]
    got = V.read_frames(spark, str(tmp_path)).where("frame >= 1").groupBy("path").count().collect()
    assert sorted((r.path.rsplit("/", 1)[1], r["count"]) for r in got) == [(n, i % 4) for i, n in enumerate(frames) if i % 4]
    assert V.read_video_info(spark, str(tmp_path)).count() == 300


def test_odd_files_and_metadata(spark, tmp_path):
    write_video(tmp_path / "a.y4m", 3)
    (tmp_path / "cut.y4m").write_bytes((tmp_path / "a.y4m").read_bytes()[:-5])
    (tmp_path / "none.y4m").write_bytes(b"YUV4MPEG2 W4 H3 F0:0 C444 " + b"X" * 300 + b"\n")
    (tmp_path / "empty.y4m").write_bytes(b"")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "b.y4m").write_bytes(b"not a video")
    colour = b"YUV4MPEG2 W4 H3 F30000:1001\n"  # four by three pixels and twice two by two of colour
    (tmp_path / "colour.y4m").write_bytes(colour + (b"FRAME\n" + bytes(range(12)) + b"c" * 8) * 2)
    info = {r.path.rsplit("/", 1)[1]: (r.fps, r.width, r.height, r.frames) for r in V.read_video_info(spark, str(tmp_path)).collect()}
    assert info == {"a.y4m": (10.0, 4, 3, 3), "cut.y4m": (10.0, 4, 3, 2), "none.y4m": (25.0, 4, 3, 0), "colour.y4m": (30000 / 1001, 4, 3, 2)}
    got = V.read_frames(spark, str(tmp_path)).groupBy("path").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2, 3]
    assert bytes(V.read_frames(spark, str(tmp_path / "colour.y4m")).where("frame = 1").first().pixels) == bytes(range(12))
    with pytest.raises(Exception, match="no YUV4MPEG2 header"):
        V.read_video_info(spark, str(tmp_path / "_hidden" / "b.y4m")).collect()


def test_written_frames_come_back(spark, tmp_path):
    rows = [(c, f, 2, 1, bytes([c, f])) for c in range(5) for f in range(c)]
    files = V.write_frames(spark.createDataFrame(rows, "clip long, frame long, width int, height int, pixels binary").repartition(3), str(tmp_path)).collect()
    assert sorted((r.clip, r.frames) for r in files) == [(c, c) for c in range(1, 5)]
    by = {r.path: r.clip for r in files}
    got = V.read_frames(spark, str(tmp_path)).collect()
    assert sorted((by[r.path], r.frame, bytes(r.pixels)) for r in got) == [(c, f, bytes([c, f])) for c, f, _, _, _ in rows]


# Memory


def test_states_of_many_short_vectors_are_handed_on(spark, monkeypatch):
    """A task hands on a row for every few keys, and rows of one key still meet."""
    from turnweave.operators import pooling as P

    monkeypatch.setattr(P, "HELD", 10 * (P.STATE + 10))
    rows = [(k, f, [float(k), float(f)]) for f in range(3) for k in range(100)]
    df = spark.createDataFrame(rows, "clip long, frame long, v array<double>").coalesce(1)
    got = {r.clip: list(r.pooled) for r in P.pooled(df, ["clip"], "v", "frame", ("mean", "delta")).collect()}
    assert got == {k: [float(k), 1.0, 0.0, 1.0] for k in range(100)}


def test_windows_are_transformed_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(O, "AT_ONCE", 7)
    waves = spark.createDataFrame([(c, [float((c * i) % 5) for i in range(50 * c)]) for c in range(4)], "clip long, wave array<double>")
    some = {(r.clip, r.t): list(r.cepstrum) for r in O.cepstra(waves, 800).collect()}
    monkeypatch.setattr(O, "AT_ONCE", 10_000)
    whole = {(r.clip, r.t): list(r.cepstrum) for r in O.cepstra(waves, 800).collect()}
    assert some.keys() == whole.keys() and len(some) > 30
    assert all(some[k] == pytest.approx(whole[k]) for k in some)


def test_hidden_pixels_are_those_of_both_steps(spark):
    rows = [(bytes(range(1, 109)), 12, {"x1": a, "y1": b, "x2": a + 4, "y2": b + 5}) for a in range(9) for b in range(5)]
    df = spark.createDataFrame(rows, "p binary, w int, b struct<x1: long, y1: long, x2: long, y2: long>")
    p, w, b = F.col("p"), F.col("w"), F.col("b")
    got = df.select(I.hidden_pixels(p, w, b, 0.3).alias("one"), I.cropped_pixels(I.occluded_pixels(p, w, b, 0.3), w, b).alias("two")).collect()
    assert all(bytes(r.one) == bytes(r.two) and len(r.one) == 20 for r in got)


# Occlusion


def test_occlusion_of_speaking_faces(spark):
    p = bytes(range(1, 17))
    frames = spark.createDataFrame([(1, f, 4, 4, p) for f in range(3)] + [(2, 0, 4, 4, p)], "clip long, frame long, width int, height int, pixels binary")
    clips = spark.createDataFrame([(1, 0, 3), (2, 0, 2), (3, 0, 0), (4, 0, 5)], "clip long, first long, end long")
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    speakers = spark.createDataFrame([(1, 0, (0.0, 0.0, 2.0, 4.0)), (1, 1, None), (1, 2, (9.0, 9.0, 9.5, 9.5))], f"clip long, frame long, box {box}")
    config = W.OcclusionConfig(share=0.5, frames=3, face_margin=0.0)
    got = {r.clip: r.embedding for r in W.occlusion_features(clips, frames, frames.limit(0), I.total_brightness, 2, config, speakers=speakers).collect()}
    total = [1 + 2 + 5 + 6, sum(p), sum(p)]  # the lower half of a face, a whole frame, a face beside the frame
    assert got[1][0] == pytest.approx(np.mean(total)) and got[2] == [sum(p), sum(p[8:])] and got[3] == got[4] == [0.0, 0.0]
    none = W.occlusion_features(clips, frames, frames.limit(0), I.total_brightness, 2, dataclasses.replace(config, full_frame=False), speakers=speakers).collect()
    assert {r.clip: r.embedding for r in none} == {1: [14.0, 0.0], 2: [0.0] * 2, 3: [0.0] * 2, 4: [0.0] * 2}


# Batches and tokens


def test_padded_batches(spark):
    rows = [(d, u, [float(d), float(u)] if u != 1 else None, None if u == 2 else d, u % 2) for d, n in ((1, 3), (2, 1), (3, 5), (4, 1), (5, 2)) for u in range(0, 2 * n, 2 if d == 3 else 1) if u < n or d == 3]
    df = spark.createDataFrame(rows, "dialogue_id long, utterance_id long, v array<double>, label int, speaker_index int")
    got = sorted(B.padded_batches(df, 2, ["v"]).collect(), key=lambda r: r.batch)
    assert [(r.batch, r.longest, r.dialogue_id, r.length) for r in got] == [(0, 1, [2, 4], [1, 1]), (1, 3, [5, 1], [2, 3]), (2, 5, [3], [5])]
    assert got[1].mask == [[1, 1, 0], [1, 1, 1]] and got[1].speaker_index == [[0, 1, 2], [0, 1, 0]] and got[1].label == [[5, 5, 0], [1, 1, 0]]
    assert got[1].v == [[[5.0, 0.0], [0.0, 0.0], [0.0, 0.0]], [[1.0, 0.0], [0.0, 0.0], [1.0, 2.0]]]
    plain = B.padded_batches(df, 3, ["v"], labels=(), speaker=None, by_length=False).collect()
    assert sorted((r.batch, r.dialogue_id) for r in plain) == [(0, [1, 2, 3]), (1, [4, 5])] and "label" not in plain[0].asDict()
    assert B.padded_batches(df.limit(0), 2, ["v"]).collect() == []


def test_pieces_and_truncation(spark):
    vocabulary = spark.createDataFrame([("un", 10), ("##aff", 11), ("##able", 12), ("una", 13), ("##ffable", 14), ("a", 15), ("##a", 16), (",", 17), ("été", 18)], "piece string, id long")
    texts = [(1, "unaffable"), (2, None), (3, ""), (4, "a, aa été"), (5, "b unb"), (6, "a " * 300), (7, "a" * 101), (8, "aaaa aaaa aaaa"), (None, "a"), (9, "a" * 100)]
    df = spark.createDataFrame(texts, "k long, t string")
    got = {r.k: (r.ids, r.n_tokens, r.truncated) for r in B.token_ids(df, ["k"], "t", vocabulary, 1, 2, 3, 12).collect()}
    assert got[1] == ([2, 13, 14, 3], 4, False)
    assert got[2] == got[3] == ([2, 3], 2, False)
    assert got[4][0] == [2, 15, 17, 15, 16, 18, 3]
    assert got[5][0] == [2, 1, 1, 3]  # no piece for b, at the front or in a word
    assert got[6] == ([2, *[15] * 10, 3], 12, True) and got[7][0] == [2, 1, 3]
    assert got[8] == ([2, 15, 16, 16, 16, 15, 16, 16, 16, 15, 16, 3], 12, True)
    assert got[None][0] == [2, 15, 3] and got[9][2] and len(got) == len(texts)


# Sound files


def riff(*chunks):
    body = b"WAVE" + b"".join(n + len(c).to_bytes(4, "little") + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def test_wave_codings():
    layout = lambda kind, channels, bits, more=b"": (b"fmt ", struct.pack("<HHIIHH", kind, channels, 8000, 0, 0, bits) + more)
    want = np.array([[0.5, -0.25], [-1.0, 0.0]])
    for bits in (16, 24, 32):
        data = b"".join(int(v * (1 << (bits - 1))).to_bytes(bits // 8, "little", signed=True) for v in want.ravel())
        rate, got = R.wave_samples(riff((b"LIST", b"odd"), layout(1, 2, bits), (b"data", data)))
        assert rate == 8000 and (got == want).all()
    assert (R.wave_samples(riff(layout(1, 2, 8), (b"data", bytes([192, 96, 0, 128]))))[1] == want).all()
    for bits, kind in ((32, "<f4"), (64, "<f8")):
        assert (R.wave_samples(riff(layout(3, 2, bits), (b"data", want.astype(kind).tobytes())))[1] == want).all()
    extensible = layout(0xFFFE, 1, 16, struct.pack("<HHIH", 22, 16, 0, 1) + b"\0" * 14)
    assert R.wave_samples(riff(extensible, (b"data", b"\0\x40")))[1].tolist() == [[0.5]]
    cut = riff(layout(1, 2, 16), (b"data", b"\0\x40" * 5))
    assert R.wave_samples(cut)[1].shape == (2, 2) and R.wave_samples(cut[:-6])[1].shape == (1, 2)
    for bad in (b"", b"RIFFnope", riff((b"data", b"1234")), riff(layout(2, 1, 4), (b"data", b"1234")), riff(layout(1, 0, 16), (b"data", b"1234")), riff(layout(1, 1, 16))):
        assert R.wave_samples(bad) == (None, None)


def test_best_weights_and_metric_log(spark, tmp_path):
    weights = spark.createDataFrame([(e, "a", [float(e)]) for e in range(4)], "epoch int, name string, value array<double>")
    epochs = spark.createDataFrame([(0, 0.1), (1, 0.7), (2, 0.7), (3, math.nan), (4, None)], "epoch int, f1 double")
    K.write_best(epochs, weights, f"{tmp_path}/best")
    assert [r.epoch for r in spark.read.parquet(f"{tmp_path}/best").collect()] == [1]
    K.append_metrics(spark.createDataFrame([("r", 1, 0.5, None)], "run string, step int, a double, b double"), f"{tmp_path}/log", 1)
    K.append_metrics(spark.createDataFrame([("r", 1, 0.6), ("r", 2, 0.1)], "run string, step int, a double"), f"{tmp_path}/log", 2)
    assert sorted(tuple(r) for r in K.read_metrics(spark, f"{tmp_path}/log").collect()) == [("r", 1, "a", 0.6), ("r", 2, "a", 0.1)]


# Gates


def test_gates_with_nulls_and_dropped_modalities(spark):
    w = catalog_gates.weights()
    r = np.random.default_rng(1)
    rows = [(i, *[r.standard_normal(14).tolist() if i != 1 or m != "a" else None for m in "tav"], *[r.standard_normal(7).tolist() for _ in "tav"]) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, zt array<double>, za array<double>, zv array<double>, lt array<double>, la array<double>, lv array<double>")
    z, y = [F.col(c) for c in ("zt", "za", "zv")], [F.col(c) for c in ("lt", "la", "lv")]
    got = {r.i: r for r in df.select("i", *z, *y, G.class_reliability(G.reliability_scores(z, y, w), y).alias("x"), G.landmark_projection(F.col("za"), w).alias("p")).collect()}
    for i in (0, 2):
        zs, ys = ({m: np.array([got[i][p + m]]) for m in "tav"} for p in "zl")
        want = (N.reliability(zs, ys, w) * np.stack([ys[m] for m in "tav"])).sum(0)[0]
        assert got[i].x == pytest.approx(want)
        c = N.ModelConfig(visual=14, hidden=8, heads=2, landmark_projector=True)
        assert got[i].p == pytest.approx(N.visual_input(zs["a"], w, c)[0])
    assert got[1].p is None
    with pytest.raises(Exception, match="mismatch|shape|dimension"):
        df.select(G.landmark_projection(F.slice("zt", 1, 5), w)).collect()


def test_choice_of_faces_equals_that_of_arrays():
    """_iou and _first_largest against ious and np.argmax, which chose faces before."""
    import numpy as np

    from turnweave.operators import tracking

    r = np.random.default_rng(1)
    for n in range(1, 60):
        boxes = np.c_[r.integers(0, 9, (n, 2)), r.integers(0, 15, (n, 2))].astype(float)
        boxes[r.random((n, 4)) < 0.01] = np.nan
        last = np.array([1.0, 2.0, 7.0, 9.0])
        own, want = [tracking._iou(tuple(b), tuple(last)) for b in boxes.tolist()], tracking.ious(boxes, last)
        assert np.array_equal(np.array(own), want, equal_nan=True)
        assert tracking._first_largest(own) == int(np.argmax(want))
