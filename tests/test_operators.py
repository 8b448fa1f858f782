import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaflow.functions import books, scalars
from lumaflow.operators import closed_set, fingerprints, grids, motion, narrative, planner, storyboard, titles
from lumaflow.sources import media

STORY = books.narratives()


def one(spark, column, ddl="x int", row=(1,)):
    return spark.createDataFrame([row], ddl).select(column.alias("y")).first()["y"]


def test_window_times(spark):
    assert one(spark, grids.window_times(F.lit(10.0), F.lit(60.0))) == [10.0, 11.0, 12.0]
    assert one(spark, grids.window_times(F.lit(9.5), F.lit(10.0))) == [9.5]
    assert one(spark, grids.window_times(F.lit(0.0), F.lit(60.0), "burst_1s_3fps")) == [0.0, 0.333333, 0.666667]


@pytest.mark.parametrize("ratios, means, pattern", [([0.01, 0.02, 0.01], None, "stable"), ([0.2, 0.25, 0.3], None, "continuous"), ([0.2, 0.01, 0.3], None, "intermittent"), ([0.01, 0.8, 0.01], [0.001, 0.5, 0.001], "abrupt")])
def test_patterns(spark, ratios, means, pattern):
    rows = [(1, r, m, r) for r, m in zip(ratios, means or [0.0] * 3)]
    s = motion.summary(spark.createDataFrame(rows, "w int, changed_ratio double, mean_diff double, lum_diff double"), ["w"]).first()
    assert s["pattern"] == pattern


def test_pixel_change(spark):
    d = spark.createDataFrame([([0.0] * 64, [1.0] * 64)], "a array<double>, b array<double>")
    assert tuple(d.select(*motion.pixel_change(F.col("a"), F.col("b"))).first()) == (1.0, 1.0)
    assert tuple(d.select(*motion.pixel_change(F.col("a"), F.col("a"))).first()) == (0.0, 0.0)
    with pytest.raises(Exception, match="shape"):
        d.select(*motion.pixel_change(F.col("a"), F.slice("b", 1, 8))).first()
    with pytest.raises(ValueError):
        motion.crop(F.col("a"), 8, 8, (0.0, 0.01, 0.0, 0.01))


def test_shots(spark):
    videos = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4)], "video_id string, n int")
    cuts = spark.createDataFrame([("a", 0.02), ("a", 2.0), ("b", 1.0), ("b", 1.02)], "video_id string, ts double")
    s = {}
    for r in storyboard.shots(cuts, videos).orderBy("video_id", "index").collect():
        s.setdefault(r["video_id"], []).append((r["index"], r["start_seconds"], r["end_seconds"]))
    assert s == {"a": [(0, 0.02, 2.0), (1, 2.0, 4.0)], "b": [(0, 0.0, 1.0), (1, 1.02, 4.0)], "c": [(0, 0.0, 4.0)]}


def test_exact_round(spark):
    """Python's round on random numbers, on ties of the binary value, and on decimals that only look like ties."""
    rng = random.Random(4)
    rows = [rng.uniform(-1, 1) for _ in range(30_000)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 17) for _ in range(30_000)]
    rows += [rng.randrange(-(10**6), 10**6) / 2 ** rng.randrange(1, 20) for _ in range(20_000)] + [rng.randrange(-(10**7), 10**7) / 10**5 for _ in range(20_000)] + [rng.randrange(10**9) / 1000 + 0.0005 for _ in range(5_000)]
    rows += [0.0, -0.0, 0.5, 1.5, 2.5, 2.675, 1.005, 0.125, 0.375, 1e300, -1e-300, 5e-324, 2.0**52 + 0.5, 2.0**53, 4503599628.123457, 1e22, 0.00005, 0.00015]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    for digits in (0, 1, 3, 4, 6, 9, 12):
        got = df.select("x", scalars.exact_round(F.col("x"), digits).alias("y")).collect()
        assert [(r["x"], r["y"], round(r["x"], digits)) for r in got if r["y"] != round(r["x"], digits)] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(scalars.exact_round(F.col("x"), 4)).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0] and [r[0] for r in odd[2:]] == [float("inf"), float("-inf")]
    with pytest.raises(ValueError):
        scalars.exact_round(F.col("x"), 16)


SHOT3 = [("v", 0, 0.0, 2.0, 2.0, 3, 0.05, 0.05, 0.0, 0.0), ("v", 1, 2.05, 4.0, 1.95, 3, 0.45, 0.45, 0.3, 0.0), ("v", 2, 4.1, 6.0, 1.9, 3, 0.12, 0.12, 0.0, 0.0)]


def test_targets(spark):
    from lumaflow.schemas import SHOTS

    m = narrative.match_targets(spark.createDataFrame(SHOT3, SHOTS), STORY).collect()
    got = {(r["target_id"], tuple(r["shot_indexes"])): r["score"] for r in m}
    assert got[("daily_turbulence", (0, 1))] == 0.4 and got[("battle_effects", (1,))] == 0.6
    assert ("romance_intimacy", (0,)) in got and ("romance_intimacy", (2,)) in got
    late = [list(r) for r in SHOT3]
    late[1][2] = 5.0
    assert "pair" not in {r["kind"] for r in narrative.match_targets(spark.createDataFrame([tuple(r) for r in late], SHOTS), STORY).collect()}


PLANS = [
    ([(0, 5, 0.3), (20, 5, 0.9), (40, 5, 0.6)], 10, [(20, 25), (40, 45)]),
    ([(10, 5, 0.8), (15, 5, 0.7)], 15, [(10, 20)]),
    ([(0, 10, 0.9), (2, 8, 0.8), (20, 5, 0.7)], 15, [(0, 10), (20, 25)]),
    ([(0, 10, 0.9), (30, 10, 0.8)], 15, [(0, 10), (30, 35)]),
    ([(0, 10, 0.9), (30, 10, 0.8)], 10.5, [(0, 10)]),
    ([(0, 0.5, 0.99), (5, 3, 0.4)], 15, [(5, 8)]),
]


@pytest.mark.parametrize("windows, target, expected", PLANS)
def test_plans(spark, windows, target, expected):
    rows = [("v", float(a), float(d), s) for a, d, s in windows]
    p = planner.plan_clips(spark.createDataFrame(rows, "video_id string, start_seconds double, duration_seconds double, score double"), target)
    assert [(r["start_seconds"], r["end_seconds"]) for r in p.orderBy("start_seconds").collect()] == expected


def test_plan_rejects(spark):
    with pytest.raises(ValueError):
        planner.plan_clips(spark.createDataFrame([], "video_id string, start_seconds double, duration_seconds double, score double"), 0)


def covered(windows):
    """Seconds of the union, counted on a fine grid of their own ends."""
    points = sorted({p for a, d in windows for p in (a, a + d)})
    return sum(y - x for x, y in zip(points, points[1:]) if any(a <= x and y <= a + d for a, d in windows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8), st.integers(0, 5)), max_size=12), st.integers(1, 30))
def test_choice_is_greedy(windows, target):
    got, have = planner.choose([tuple(map(float, w)) for w in windows], float(target), 1.0), []
    for k in sorted(range(len(windows)), key=lambda k: (-windows[k][2], windows[k][0], windows[k][1])):
        if covered(have) >= target:
            break
        if covered([*have, windows[k][:2]]) > covered(have):
            have.append(windows[k][:2])
    assert [windows[k][:2] for k in got] == have


SEGMENTS = "video_id int, position int, start_seconds double, end_seconds double, score double, shot_indexes array<int>, target_ids array<string>, role string"
MATCHES = "video_id int, target_pos int, target_id string, kind string, shot_indexes array<int>, start_seconds double, end_seconds double, score double"


def steady(spark, *videos, book=STORY):
    rows = [(v, k, float(a), float(b), 0.5, [k], [f"t{k}"], "opening" if k == 0 else "body") for v, pieces in enumerate(videos) for k, (a, b) in enumerate(pieces)]
    return {r["video_id"]: ([(p["start"], p["end"], p["role"], p["shots"]) for p in r["pieces"]], r["dropped"]) for r in narrative.steadied(spark.createDataFrame(rows, SEGMENTS), book).collect()}


def test_rhythm(spark):
    got = steady(spark, [(0, 3), (10, 10.5), (20, 20.4), (30, 33)], [(0, 3), (10, 10.5), (30, 33)], [(0, 3), (3, 3.5), (30, 33)], [(10, 10.5), (10.5, 13)], [(0, 3), (9, 9.5)])
    assert len(got[0][0]) == 4 and got[0][1] == 0
    assert len(got[1][0]) == 2 and got[1][1] == 1
    assert got[2] == ([(0.0, 3.5, "opening", [0, 1]), (30.0, 33.0, "body", [2])], 0)
    # what is carried forward takes the receiver's role
    assert got[3] == ([(10.0, 13.0, "body", [0, 1])], 0)
    assert got[4] == ([(0.0, 3.0, "opening", [0])], 1)


def told(spark, pieces, template, target=15.0, interleave=False, book=STORY):
    rows = [(1, k, t, kind, [shot], float(a), float(b), s) for k, (a, b, s, t, kind, shot) in enumerate(pieces)]
    r = narrative.tell(spark.createDataFrame(rows, MATCHES), book, template, target, interleave).collect()
    return ([(p["start"], p["role"]) for p in r[0]["pieces"]], r[0]["notes"]) if r else ([], [])


def test_chain_goes_to_what_is_near(spark):
    pieces = [(50, 53, 0.9, "t", "shot", 1), (5, 8, 0.5, "u", "shot", 2), (55, 57, 0.4, "t", "shot", 3)]
    assert [s for s, _ in told(spark, pieces, "hook_first")[0]] == [50, 55, 5]


def test_templates(spark):
    pieces = [(0, 4, 0.2, "t", "shot", 1), (5, 9, 0.9, "t", "shot", 2), (10, 14, 0.4, "p", "pair", 3)]
    assert told(spark, pieces, "linear")[0][0] == (0.0, "body")
    assert told(spark, pieces, "hook_first")[0][0] == (5.0, "opening")
    assert told(spark, pieces, "twist_bridge") == ([(10.0, "opening")], [])
    assert told(spark, pieces[:2], "twist_bridge") == ([(5.0, "opening"), (0.0, "body")], ["no pair matched; opened with the peak"])
    assert told(spark, [], "linear") == ([], [])
    from dataclasses import replace

    assert "interleaving is disabled" in told(spark, pieces, "linear", interleave=True, book=replace(STORY, interleave=False))[1]
    assert "timeline truncated to target duration" in told(spark, pieces, "linear", 4.0)[1]
    # the tail of a quarter of a second goes after the cut
    assert told(spark, [(0, 4, 0.2, "t", "shot", 1), (9, 12, 0.9, "t", "shot", 2)], "linear", 4.25) == ([(0.0, "body")], ["1 lone short pieces dropped"])
    with pytest.raises(ValueError):
        told(spark, pieces, "nope")


def plain_chain(pieces):
    """Re-sorting of all that is left, step by step."""
    def related(a, b):
        gap = max(0.0, b[0] - a[1], a[0] - b[1])
        return max(0.0, 1 - gap / 10) + 0.5 * (a[3] == b[3]) + 0.25 * max(0.0, 1 - abs(a[2] - b[2]) / max(a[2], b[2], 1e-6))

    left = sorted(pieces, key=lambda p: (-p[2], p[0]))
    out = [left.pop(0)]
    while left:
        left.sort(key=lambda p: (-related(out[-1], p), -p[2]))
        out.append(left.pop(0))
    return [p[0] for p in out]


def test_chains_of_many_videos(spark):
    """Whole seconds and few scores and targets, so that ties abound."""
    rng = random.Random(3)
    videos = {v: [(float(4 * k), 4.0 * k + 2, rng.choice([0.2, 0.5, 0.5]), rng.choice("ab")) for k in rng.sample(range(40), rng.randrange(1, 14))] for v in range(60)}
    rows = [(v, "ab".index(p[3]), p[3], "shot", [int(p[0])], p[0], p[1], p[2]) for v, ps in videos.items() for p in ps]
    got = {}
    for r in narrative.plan(spark.createDataFrame(rows, MATCHES), STORY, "hook_first", 1e9).orderBy("video_id", "position").collect():
        got.setdefault(r["video_id"], []).append(r["start_seconds"])
    assert got == {v: plain_chain(ps) for v, ps in videos.items()}


def test_timelines_keep_their_limits(spark):
    rng = random.Random(9)
    rows, n = [], {}
    for v in range(80):
        cuts = sorted(rng.sample(range(0, 240), rng.randrange(2, 14)))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            rows.append((v, k % 3, f"t{k % 3}", rng.choice(["shot", "shot", "pair"]), [k], a / 4, b / 4, rng.random()))
            n[v] = n.get(v, 0) + 1
    d = spark.createDataFrame(rows, MATCHES)
    for template in ("linear", "hook_first", "twist_bridge"):
        for interleave in (False, True):
            by = {}
            for r in narrative.plan(d, STORY, template, 15.0, interleave).collect():
                by.setdefault(r["video_id"], []).append(r)
            for v, out in by.items():
                shots = [s for r in out for s in r["shot_indexes"]]
                assert len(shots) == len(set(shots)) and len(out) <= n[v]
                assert sum(r["end_seconds"] - r["start_seconds"] for r in out) <= 15.0 + 1e-3
                assert sorted(r["position"] for r in out) == list(range(len(out)))


def test_average_hash(spark):
    rng = random.Random(1)
    rows = [(k, [rng.random() for _ in range(64)]) for k in range(20)] + [(99, [0.5] * 64)]
    got = {r["k"]: r["h"] for r in spark.createDataFrame(rows, "k int, px array<double>").select("k", fingerprints.average_hash(F.col("px")).alias("h")).collect()}
    for k, px in rows:
        mean = sum(px) / 64
        bits = sum(1 << i for i, x in enumerate(px) if x > mean)
        assert got[k] % (1 << 64) == bits


def test_likeness(spark):
    p = spark.createDataFrame([("a", 0), ("a", -1), ("b", 0)], "video_id string, hash long")
    s = fingerprints.similarity(spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string"), p).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in s} == {("a", "b"): 0.5, ("a", "z"): 0.0}
    near = fingerprints.near_hashes(spark.createDataFrame([("a", 0), ("b", 127), ("c", 0xFFFF), ("d", 0)], "video_id string, hash long")).collect()
    assert {(r["hash"], r["other"]) for r in near} == {(0, 127)}
    many = spark.createDataFrame([("a", k) for k in range(65)] + [("b", 0)], "video_id string, hash long")
    with pytest.raises(Exception, match="more frames"):
        fingerprints.similarity(spark.createDataFrame([("a", "b")], "a string, b string"), many).collect()


def test_verdicts(spark):
    rows = [(0.95, 0.1, 0.0), (0.8, 0.1, 0.0), (0.2, 0.1, 0.0), (0.2, 0.9, 0.0), (None, 0.1, 0.2)]
    d = spark.createDataFrame([(k, s, c, 0.0, 0.0, 0.0, b) for k, (s, c, b) in enumerate(rows)], "k int, similarity double, top_left double, top_right double, bottom_left double, bottom_right double, black_bar_ratio double")
    v = fingerprints.verdict(d, books.DEDUP_THRESHOLDS).orderBy("k").collect()
    assert [r["verdict"] for r in v] == ["block", "review", "pass", "review", "review"]
    assert v[3]["flags"] == ["suspected_watermark_residual"] and v[4]["flags"] == ["suspected_black_bars"]


def test_titles(spark):
    c = spark.createDataFrame([(1, "ran_xiang", ["battle_effects"], None, None, 15.2), (2, None, [], "Ann", "runs", 9.0)], "item_id int, style_hint string, target_ids array<string>, subject string, action string, duration_seconds double")
    t = titles.titles(c).collect()
    assert len(t) == 6 and not any("{" in r["title"] for r in t) and any("Ann" in r["title"] for r in t)


@pytest.mark.parametrize("raw, name", [(" a<b>/c ", "abc"), ("...", "untitled_clip"), ("CON", "untitled_clip"), ("x" * 80, "x" * 60), ("why?", "why?"), ("　看\x01这里。 ", "看这里。")])
def test_sanitize(spark, raw, name):
    assert one(spark, scalars.sanitize_title(F.col("x")), "x string", (raw,)) == name


def test_file_names(spark):
    d = titles.file_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, t string"), "t", "k").orderBy("k")
    assert [r["file_name"] for r in d.collect()] == ["a.mp4", "a_2.mp4", "b.mp4"]


def test_reports(spark):
    probe = "width=1920\nheight=1080\navg_frame_rate=30000/1001\ncodec_type=audio\nduration=12.5\n"
    r = media.media_info(spark.createDataFrame([(probe,)], "probe string")).first()
    assert (r["duration_seconds"], r["width"], r["height"], r["has_audio"]) == (12.5, 1920, 1080, True) and abs(r["fps"] - 29.97) < 0.01
    with pytest.raises(Exception, match="duration"):
        media.media_info(spark.createDataFrame([("width=1",)], "probe string")).collect()
    assert one(spark, media.scene_cut_times(F.lit("x pts_time:4.5 y pts_time:1.25"))) == [1.25, 4.5]
    assert one(spark, media.mean_volume(F.lit("mean_volume: -23.4 dB"))) == -23.4
    assert one(spark, media.mean_volume(F.lit("nothing"))) is None
    assert one(spark, media.scene_cut_times(F.lit("pts_time:x pts_time: 2\n pts_time:0.5\tpos"))) == [0.5, 2.0] and one(spark, media.scene_cut_times(F.lit(""))) == []


FRAME = "video_id string, t long, height int, width int, gray binary"


def test_gray_frames(spark):
    """Frame pairs of all shapes, and a video of two shots: moving, then still."""
    black, white = bytes(64), bytes([255] * 64)
    half = bytes([255] * 32 + [0] * 32)
    rows = [("same", 0, 8, 8, half), ("same", 1, 8, 8, half), ("flip", 0, 8, 8, black), ("flip", 1, 8, 8, white), ("half", 0, 8, 8, black), ("half", 1, 8, 8, half)]
    w = Window.partitionBy("video_id").orderBy("t")
    got = {r["video_id"]: (r["mean_diff"], r["changed_ratio"], r["lum_diff"]) for r in motion.with_steps(spark.createDataFrame(rows, FRAME), w).where("t = 1").collect()}
    assert got == {"same": (0.0, 0.0, 0.0), "flip": (1.0, 1.0, 1.0), "half": (0.5, 0.5, 0.5)}
    with pytest.raises(Exception, match="shape"):
        motion.with_steps(spark.createDataFrame([("v", 0, 8, 8, black), ("v", 1, 8, 9, bytes(72))], FRAME), w).collect()
    rng = random.Random(2)
    video = [("v", t, 8, 8, bytes(rng.randrange(120) for _ in range(64)) if t < 6 else white) for t in range(12)]
    info = spark.createDataFrame([("v", 1920, 1080, 25.0, -14.0)], "video_id string, width int, height int, fps double, audio_mean_volume_db double")
    f = spark.createDataFrame(video, FRAME)
    s = motion.video_signals(f, info=info).first()
    assert (s["width"], s["height"], s["fps"], s["audio_mean_volume_db"], s["scene_count"]) == (1920, 1080, 25.0, -14.0, 1)
    shots_ = storyboard.shot_signals(f, motion.scene_cuts(f)).orderBy("index").collect()
    assert len(shots_) == 2 and shots_[0]["mean_motion_intensity"] > shots_[1]["mean_motion_intensity"] == 0
    # a mean change without many changed pixels isn't abrupt, nor are many slight changes
    two = lambda a, b: motion.motion_windows(d := spark.createDataFrame([("v", 0, 8, 8, a), ("v", 1, 8, 8, b)], FRAME), motion.tumbling(d)).first()
    assert two(black, white)["pattern"] == "abrupt" and two(black, bytes([255] * 40 + [0] * 24))["pattern"] == "continuous"
    assert two(black, bytes([60] * 64))["pattern"] == "continuous" and two(black, bytes([20] * 64))["pattern"] == "stable"


def test_catalog_size(spark):
    frames = spark.createDataFrame([(1, [1.0, 0.0])], "item_id int, v array<double>")
    cat = lambda n: spark.createDataFrame([("mood", f"m{k}", [1.0, float(k)]) for k in range(n)], "question string, value string, v array<double>")
    assert closed_set.answers(frames, cat(12)).first()["answer"] == "m0"
    for n in (1, 13):
        with pytest.raises(ValueError):
            closed_set.answers(frames, cat(n))
    # 0.09 is enough for a mood, not for an action
    low = lambda q: closed_set.answers(frames, spark.createDataFrame([(q, "a", [0.09, 1.0]), (q, "b", [-1.0, 0.0])], "question string, value string, v array<double>")).first()["status"]
    assert low("mood") == "answered" and low("action") == "abstained"


def test_answers(spark):
    assert one(spark, scalars.parse_answer(F.lit('```json\n{"verdict": "keep"}\n```'))) == {"verdict": "keep"}
    assert one(spark, scalars.parse_answer(F.lit("[1]")))["verdict"] == "uncertain"
    with pytest.raises(ValueError):
        books.catalog({"one": {"a": "b"}})


def test_gray_frames_measure_as_their_pixels_do(spark):
    """To the last bit, so that a mean on a tie of its digits is rounded to the same side (F2)."""
    levels = [[(37 * k * k + 11 * i * (k + 3)) % 256 for i in range(64)] for k in range(40)]
    df = spark.createDataFrame([(1, k, 8, 8, bytes(v), [x / 255 for x in v]) for k, v in enumerate(levels)], "video_id int, t int, height int, width int, gray binary, px array<double>")
    w = Window.partitionBy("video_id").orderBy("t")
    got, want = (motion.with_steps(df.drop(other), w).select("t", "mean_diff", "changed_ratio", "lum_diff").orderBy("t").collect() for other in ("px", "gray"))
    assert len(got) == 40 and got == want
