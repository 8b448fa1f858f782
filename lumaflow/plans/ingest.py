"""Queries that go through files: reports of media tools and decoded streams, written from the tables and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import decode, providers, scalars
from ..operators import closed_set, fingerprints, grids, motion, narrative, storyboard, styles
from ..sources import files
from ..sources.views import durations, gray_frames, pictures, table, timelines
from ..streaming import frames as live
from . import reviewer
from .registry import CAND, FR, MATCH, MEASURE, ORACLE_SQL, PATTERN, PX, RULES, SHOTS, SIG, STORY, STORY_SQL, STYLE, WS, _chain_sql, _matches, _told_sql, query

CONF = EngineConf()

# what the reports of a video say, as the oracles have it
SAID = "320 + 16 * (video_id % 40) AS width, 240 + 8 * (video_id % 30) AS height, (24000 + 1000 * (video_id % 7)) / 1001.0::DOUBLE AS fps, video_id % 3 <> 0 AS has_audio, CASE WHEN video_id % 3 <> 0 THEN -(100 + video_id * 7 % 300) / 10.0::DOUBLE END AS db"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Probe, scene and volume reports for every video, as files, read back by the data source."""
    f = timelines(spark, d)
    v = F.col("video_id")
    kv = lambda key, x: F.concat(F.lit(key + "="), x.cast("string"))
    audio = v % 3 != 0
    probe = F.concat_ws("\n", F.lit("codec_type=video"), kv("width", 320 + 16 * (v % 40)), kv("height", 240 + 8 * (v % 30)), F.lit("avg_frame_rate=0/0"), F.concat(kv("avg_frame_rate", 24000 + 1000 * (v % 7)), F.lit("/1001")), F.when(audio, "codec_type=audio"), kv("duration", F.col("n")))
    volume = F.concat(F.lit("[Parsed_volumedetect_0] n_samples: 9\nmean_volume: "), F.format_number(-(100 + v * 7 % 300) / 10.0, 1), F.lit(" dB\nmax_volume: -1.0 dB"))
    told = durations(f)
    row = lambda df, ending, text: df.select(F.concat(v.cast("string"), F.lit(ending)).alias("path"), text.cast("binary").alias("content"))
    line = F.concat(F.lit("[Parsed_showinfo_1] n:0 pts_time:"), F.col("ts").cast("decimal(18,3)").cast("string"), F.lit(" pos:1"))
    cuts = motion.scene_cuts(f).groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_list(line), asc=False), "\n").alias("log"))
    all_ = row(told, ".probe", probe).union(row(told.where(audio), ".volume", volume)).union(row(cuts, ".scenes", F.col("log")))
    files.commit(all_, folder := files.work_folder(spark, "reports"))
    return files.reports(spark, folder).withColumn("video_id", F.col("video_id").cast("long"))


@query(f"""WITH {FR}, c AS (SELECT video_id, count(*) AS cuts, round(sum(t), 3) AS cut_seconds FROM pr WHERE d > 0.3 GROUP BY video_id)
SELECT video_id, CAST(n AS DOUBLE) AS duration_seconds, CAST(width AS INT) AS width, CAST(height AS INT) AS height, round(fps, 6) AS fps, has_audio, cuts, CAST(cut_seconds AS DOUBLE) AS cut_seconds, db AS audio_mean_volume_db FROM (SELECT *, {SAID} FROM n) LEFT JOIN c USING (video_id)""")
def media_reports(spark, d):
    r = _reports(spark, d)
    total = F.aggregate("scene_cuts", F.lit(0.0), lambda s, x: s + x)
    return r.select("video_id", "duration_seconds", "width", "height", F.round("fps", 6).alias("fps"), "has_audio", F.when(F.col("scene_cuts").isNotNull(), F.size("scene_cuts")).cast("long").alias("cuts"), F.round(total, 3).alias("cut_seconds"), "audio_mean_volume_db")


def _told(spark: SparkSession, d: str) -> DataFrame:
    return motion.video_signals(timelines(spark, d), CONF, _reports(spark, d))


@query(f"WITH {FR}, {SIG} SELECT * EXCLUDE (fps, db, has_audio, width, height), CAST(width AS INT) AS width, CAST(height AS INT) AS height, round(fps, 6) AS fps, db AS audio_mean_volume_db FROM (SELECT *, {SAID} FROM sig)")
def signals_with_reports(spark, d):
    """Whole signal rows: frames measured, the rest as the reports say."""
    return _told(spark, d).withColumn("fps", F.round("fps", 6))


@query(f"""WITH {FR}, {SIG}, {RULES}, q AS (SELECT *, {SAID} FROM ru),
s AS (SELECT *, 0.5 * greatest(0, least(1, (mean_motion_intensity - 0.42) / 0.30)) + 0.3 * greatest(0, least(1, (luminance_spike_ratio - 0.08) / 0.12)) AS seen, greatest(0, least(1, (db + 30) / 15)) AS heard FROM q)
SELECT video_id, CASE WHEN db IS NULL THEN round(seen / 0.8, 6) ELSE round(seen + 0.2 * heard, 6) END AS style_score, r1 AS matches FROM s""")
def style_scores_with_audio(spark, d):
    """Scores of the profile that listens: where a video has sound its volume weighs, too."""
    return styles.scores(_told(spark, d), STYLE).where("profile_id = 'ran_xiang'").drop("profile_id")


#: So few that the decoder's budget binds on the tables.
MOST = 16
LEVEL = "greatest(0.0, least(255.0, round_even((CAST(x AS DOUBLE) + 0.5) * 255, 0)))"
ASKED = f"""{PX.replace('CAST(x AS DOUBLE)', LEVEL)}, n AS (SELECT video_id, count(*) AS n FROM px GROUP BY video_id),
us AS (SELECT DISTINCT video_id, n, round(greatest(n - 3.0, 0.0) * i / 3, 3) AS start FROM n, range(4) r(i)), ut AS (SELECT video_id, n, start + j AS ts FROM us, range(3) r(j) WHERE start + j < n),
lk AS (SELECT video_id, n, least(120, greatest(2, n)) AS k FROM n), lt AS (SELECT video_id, n, round(i * (n::DOUBLE / k) + (n::DOUBLE / k) / 2, 3) AS ts FROM lk, range(120) r(i) WHERE i < k AND round(i * (n::DOUBLE / k) + (n::DOUBLE / k) / 2, 3) < n),
asked AS (SELECT video_id, n, ts, max(ts) OVER (PARTITION BY video_id) + 1.0 AS span FROM (SELECT * FROM ut UNION SELECT * FROM lt)),
ra AS (SELECT *, least(1.0, {MOST} / span) AS rate FROM asked), fi AS (SELECT *, CAST(least(round_even(ts * rate, 0), ceil(span * rate) - 1) AS BIGINT) AS frame_index FROM ra),
de AS (SELECT fi.video_id, ts, frame_index, 8 AS height, 8 AS width, v FROM fi JOIN px ON px.video_id = fi.video_id AND px.t = least(round_even(frame_index / rate, 0), n - 1))"""


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, ts, frame_index, height, width, gray) of the asked times, out of one raw stream a video.

    The streams are what a decoder gives at the rate it is asked for: files, read as binary and sampled by the table function.
    """
    n = F.col("n").cast("double")
    windows = F.flatten(F.transform(grids.window_starts(n, CONF.signal_motion_window_count), lambda s: grids.window_times(s, n)))
    asked = durations(pictures(spark, d)).select("video_id", "n", grids.all_times(windows, grids.luminance_times(n)).alias("asked"))
    span = F.array_max("asked") + 1.0
    rate = grids.decode_rate(span, MOST)
    made = asked.select("video_id", "n", rate.alias("rate"), F.explode(F.sequence(F.lit(0), F.ceil(span * rate).cast("int") - 1)).alias("k"))
    made = made.select("video_id", "k", F.least(F.bround(F.col("k") / F.col("rate"), 0).cast("long"), F.col("n") - 1).alias("t"))
    frames = made.join(gray_frames(spark, d), ["video_id", "t"])
    stream = frames.groupBy("video_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.hex("gray").alias("h")))), lambda x: x["h"]), "")).alias("content"))
    files.commit(stream.select(F.concat(F.col("video_id").cast("string"), F.lit(".gray")).alias("path"), "content"), folder := files.work_folder(spark, "streams"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gray").load(folder)
    streams = read.select(F.regexp_extract("path", r"([0-9]+)\.gray$", 1).cast("long").alias("video_id"), "content").join(asked, "video_id")
    got = decode.SampleFrames(F.col("content").outer(), F.lit(8), F.lit(8), F.col("asked").outer(), F.lit(MOST))
    return streams.lateralJoin(got).select("video_id", "ts", "frame_index", "height", "width", "gray")


@query(f"WITH {ASKED} SELECT * EXCLUDE (v), list_aggregate(list_transform(v, lambda x: printf('%02X', CAST(x AS INT))), 'string_agg', '') AS pixels FROM de")
def decoded_frames(spark, d):
    return _decoded(spark, d).withColumn("pixels", F.hex("gray")).drop("gray")


@query(f"""WITH {ASKED}, q AS (SELECT video_id, ts, v, lag(v) OVER (PARTITION BY video_id ORDER BY ts) AS u FROM de), z AS (SELECT video_id, ts, unnest(v) / 255 AS a, unnest(u) / 255 AS b FROM q WHERE u IS NOT NULL)
SELECT video_id, ts, round(avg(abs(a - b)), 6) AS mean_diff, round(avg(CAST(abs(a - b) >= 0.1 AS DOUBLE)), 6) AS changed_ratio FROM z GROUP BY video_id, ts""")
def decoded_pair_change(spark, d):
    """Pair measures between the frames of consecutive asked times."""
    from pyspark.sql import Window

    s = motion.with_steps(_decoded(spark, d), Window.partitionBy("video_id").orderBy("ts")).where("mean_diff IS NOT NULL")
    return s.select("video_id", "ts", F.round("mean_diff", 6).alias("mean_diff"), F.round("changed_ratio", 6).alias("changed_ratio"))


@query(f"WITH {FR}, w AS (SELECT video_id, t // 3 * 3.0 AS start, abs(lum - lag(lum) OVER (PARTITION BY video_id, t // 3 ORDER BY t)) AS d FROM fr), m AS (SELECT video_id, CAST(start AS DOUBLE) AS start, {MEASURE} FROM w GROUP BY video_id, start) SELECT video_id, start, samples, pairs, active AS active_pairs, round(mean, 6) AS mean_ratio, round(peak, 6) AS peak_ratio, round(spike, 6) AS spike, CASE WHEN pairs > 0 THEN {PATTERN} END AS pattern, CASE WHEN samples >= 2 THEN 'completed' ELSE 'insufficient_data' END AS status FROM m")
def live_motion_windows(spark, d):
    """The batch's windows, measured by the stream."""
    f = timelines(spark, d).select("video_id", live.media_time(F.col("t")).alias("ts"), "lum")
    w = live.replayed(f, live.live_windows, files.work_folder(spark, "live"))
    return w.select("video_id", "start", "samples", "pairs", "active_pairs", F.round("mean_ratio", 6).alias("mean_ratio"), F.round("peak_ratio", 6).alias("peak_ratio"), F.round("spike", 6).alias("spike"), "pattern", "status")


@query(f"WITH {FR}, p AS (SELECT * FROM pr WHERE d IS NOT NULL) SELECT video_id, t, round(d, 6) AS diff FROM p")
def live_pair_diff(spark, d):
    f = timelines(spark, d).select("video_id", live.media_time(F.col("t")).alias("ts"), "lum")
    p = live.replayed(f, live.live_pairs, files.work_folder(spark, "live"))
    return p.select("video_id", (F.unix_seconds("ts") - live.BASE).alias("t"), F.round("mean_diff", 6).alias("diff"))


@query(f"""WITH {PX}, b AS (SELECT video_id * 100000 + t AS id, 5 * t + video_id % 5 AS day, list_transform(v, lambda x: CASE WHEN x > list_aggregate(v, 'sum') / 64 THEN 1 ELSE 0 END) AS bits FROM px),
h AS (SELECT *, list_aggregate(list_transform(bits, lambda x: x::VARCHAR), 'string_agg', '') AS h FROM b),
p AS (SELECT a.id, a.day, z.id AS earlier, z.day AS before_day, z.h AS of, 64 - list_aggregate(list_transform(list_zip(a.bits, z.bits), lambda q: CASE WHEN q[1] = q[2] THEN 1 ELSE 0 END), 'sum') AS apart FROM h a JOIN h z ON z.day < a.day OR z.day = a.day AND z.id::VARCHAR < a.id::VARCHAR),
l AS (SELECT *, row_number() OVER (PARTITION BY id, of ORDER BY before_day DESC, earlier::VARCHAR DESC) AS k FROM p WHERE apart <= 6)
SELECT id::VARCHAR AS upload_id, earlier::VARCHAR AS earlier_id, CAST(apart AS INT) AS bits, CAST(day - before_day AS INT) AS days FROM l WHERE k = 1 AND day - before_day <= 90""")
def repeated_uploads(spark, d):
    """Frames as uploads some days apart, against the stock of the last ninety days."""
    p = pictures(spark, d)
    day = 5 * F.col("t") + F.col("video_id") % 5
    u = p.select((F.col("video_id") * 100000 + F.col("t")).cast("string").alias("upload_id"), F.timestamp_seconds(live.BASE * (1 + day)).alias("ts"), fingerprints.average_hash(F.col("px")).alias("hash"))
    r = live.replayed(u, live.near_repeats, files.work_folder(spark, "live"))
    return r.select("upload_id", "earlier_id", "bits", F.date_diff("ts", "earlier_ts").alias("days"))


def _rubric(request: str) -> str:
    """A reviewer's rule in place of a service: it keeps a video whose best candidate scores one half or more."""
    text = json.loads(request)["messages"][1]["content"][0]["text"]
    best = json.loads(text.partition("INPUT:\n")[2])["candidates"]
    return json.dumps({"verdict": "keep" if best and best[0]["score"] >= 0.5 else "drop", "seen": len(best), "prompt": text.partition("\n")[0]})


@query(f"""WITH {FR}, {SIG}, {RULES}, {CAND.removeprefix(WS).lstrip(', ')}, k AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS c FROM pm),
rf AS (SELECT video_id, profile_id, CASE profile_id WHEN 'ran_xiang' THEN 3 ELSE 2 END AS most, CASE profile_id WHEN 'ran_xiang' THEN 'prompts/style_ran_xiang.md' WHEN 'fast_dialogue' THEN 'prompts/style_dialogue.md' ELSE 'prompts/quality_review.md' END AS prompt_ref FROM k WHERE profile_id <> 'ran_xiang' OR c >= 2)
SELECT video_id, profile_id, prompt_ref, 'answered' AS status, CASE WHEN max(score) FILTER (rank <= most) >= 0.5 THEN 'keep' ELSE 'drop' END AS verdict, count(*) FILTER (rank <= most) AS seen, 'Rubric ' || prompt_ref AS prompt FROM rf JOIN cand USING (video_id) GROUP BY video_id, profile_id, prompt_ref""")
def review_answers(spark, d):
    """Referred videos with a reviewer's answers: prompts from files, a request for each referral, each asked once."""
    f = timelines(spark, d)
    signals = motion.video_signals(f)
    referred = styles.referrals(styles.evaluate(signals, STYLE), STYLE)
    refs = sorted({p.fallback.prompt_ref for p in STYLE.profiles if p.fallback})
    texts = spark.createDataFrame([(r, f"Rubric {r}\nKeep what moves.") for r in refs], "path string, text string").select("path", F.col("text").cast("binary").alias("content"))
    files.commit(texts, folder := files.work_folder(spark, "prompts"))
    asked = reviewer.requests(referred, signals, motion.candidates(f), reviewer.prompts(spark, folder), "local-rule")
    a = reviewer.results(reviewer.ask(asked, _rubric, files.work_folder(spark, "ledger")))
    return a.select("video_id", "profile_id", "prompt_ref", "status", F.col("result")["verdict"].alias("verdict"), F.col("result")["seen"].cast("long").alias("seen"), F.col("result")["prompt"].alias("prompt"))


EXACT = lambda x, digits: f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"  # noqa: E731  by the exact value, ties to even


@query(f"SELECT event_id, {EXACT('value / 8', 4)} AS eighth, {EXACT('value / 3', 4)} AS third, {EXACT('value * 1.0009765625', 3)} AS scaled, {EXACT('value', 1)} AS tenth FROM events")
def exact_rounding(spark, d):
    e = table(spark, d, "events")
    r = lambda x, digits: scalars.exact_round(x, digits)
    v = F.col("value")
    return e.select("event_id", r(v / 8, 4).alias("eighth"), r(v / 3, 4).alias("third"), r(v * 1.0009765625, 3).alias("scaled"), r(v, 1).alias("tenth"))


@query(f"""WITH {FR}, {WS}, c AS (SELECT video_id, start AS start_seconds, least(1.0, mean / 0.5) AS m, CASE WHEN active = pairs THEN 1.0 ELSE 0.0 END AS k, least(1.0, spike / 0.12) AS l, mean, peak, spike FROM ws)
SELECT video_id, start_seconds, {EXACT('0.65 * m + 0.20::DOUBLE * k + 0.15 * l', 4)} AS score, {EXACT('mean', 4)} AS motion_intensity, {EXACT('peak', 4)} AS peak_motion_intensity, {EXACT('spike', 4)} AS luminance_spike_ratio, {EXACT('m', 4)} AS motion, CAST(k AS DOUBLE) AS continuity, {EXACT('l', 4)} AS luminance FROM c""")
def candidates_as_shipped(spark, d):
    """Candidates with the components of their score, in the digits that are shipped."""
    c = motion.candidates(timelines(spark, d), shipped=True)
    part = lambda name: F.col("score_components")[name].alias(name)
    return c.select("video_id", "start_seconds", "score", "motion_intensity", "peak_motion_intensity", "luminance_spike_ratio", part("motion"), part("continuity"), part("luminance"))


@query(f"""WITH {FR}, {SHOTS}, sv AS (SELECT video_id, "index", start_seconds, end_seconds, count(*) AS sampled_frames, coalesce(avg(d), 0) AS m, coalesce(max(d), 0) AS p, coalesce(avg(CAST(d >= 0.12 AS DOUBLE)), 0) AS s FROM sf GROUP BY ALL)
SELECT video_id, "index", start_seconds, end_seconds, sampled_frames, {EXACT('m', 4)} AS mean_motion_intensity, {EXACT('p', 4)} AS peak_motion_intensity, {EXACT('s', 4)} AS luminance_spike_ratio, {EXACT('p', 4)} AS luminance_delta_max FROM sv""")
def shots_as_shipped(spark, d):
    f = timelines(spark, d)
    return storyboard.shot_signals(f, motion.scene_cuts(f), shipped=True).drop("duration_seconds")


@query(ORACLE_SQL["closed_set_answers"])
def provided_answers(spark, d):
    """The closed-set question with vectors from a provider that was given a file of them: the answers are those of the vectors themselves."""
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").withColumn("name", F.concat(F.lit("frames/"), F.col("vec_id"), F.lit(".jpg")))
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    texts = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector")).select(F.concat(F.lit("label "), F.col("label")).alias("key"), "vector", "label")
    held = texts.select("key", "vector").union(e.select(F.substring_index("name", "/", -1), F.transform("embedding", lambda x: x.cast("double"))))
    held.write.parquet(folder := files.work_folder(spark, "vectors"))
    spec = f"file:{folder}"
    catalog = providers.catalog_vectors(texts.select(F.lit("label").alias("question"), F.col("label").cast("string").alias("value"), F.col("key").alias("prompt")), spec)
    frames = providers.with_images(e.select(F.col("vec_id").alias("item_id"), "name"), F.col("name"), None, spec).select("item_id", "v")
    return closed_set.answers(frames, catalog).select("item_id", "answer", "status", "margin", "confidence", "top_score")


@query("WITH h AS (SELECT page_id, sha256('image:' || page_id || '.jpg') AS i, sha256('text:' || url) AS t FROM pages) SELECT page_id, round(('0x' || substr(i, 1, 2))::INT / 255.0 - 0.5, 6) AS image_first, round(('0x' || substr(i, 63, 2))::INT / 255.0 - 0.5, 6) AS image_last, round(('0x' || substr(t, 1, 2))::INT / 255.0 - 0.5, 6) AS text_first FROM h")
def fake_provider(spark, d):
    """The stand-in provider on images, which it tells by their names without folders, and on texts."""
    p = table(spark, d, "pages").withColumn("name", F.concat(F.lit("/a/b/"), F.col("page_id"), F.lit(".jpg")))
    v = p.select("page_id", providers.image_vectors(F.col("name"), None, "fake").alias("i"), providers.text_vectors(F.col("url"), "fake:64").alias("t"))
    at = lambda c, k: F.round(F.col(c)[k], 6)
    return v.select("page_id", at("i", 0).alias("image_first"), at("i", 31).alias("image_last"), at("t", 0).alias("text_first"))


@query(f"WITH {FR}, {CAND} SELECT c.video_id, rank, start_seconds AS ts, t, lum FROM cand c JOIN fr ON fr.video_id = c.video_id AND fr.t = CAST(least(round_even(start_seconds, 0), (SELECT n FROM n WHERE n.video_id = c.video_id) - 1) AS BIGINT) WHERE rank <= 3")
def review_frames(spark, d):
    f = timelines(spark, d)
    return motion.review_frames(motion.candidates(f), f).select("video_id", "rank", "ts", "t", "lum")


#: The matches of a response in their order; ties beyond the order of the book don't occur in one target.
SHOWN = f"WITH {FR}, {SHOTS}, {MATCH}, sh AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_seconds, target_pos, shot_indexes) AS place FROM mt)"


@query(f"{SHOWN} SELECT video_id, place, target_id, kind, start_seconds, end_seconds, score FROM sh WHERE place <= 5")
def shown_matches(spark, d):
    return narrative.shown(_matches(spark, d), 5).select("video_id", "place", "target_id", "kind", "start_seconds", "end_seconds", "score")


@query(f"{SHOWN} SELECT video_id, array_to_string(list_sort(list(DISTINCT target_id)), ',') AS target_ids FROM sh WHERE place <= 8 GROUP BY video_id")
def title_targets(spark, d):
    return narrative.title_targets(_matches(spark, d)).withColumn("target_ids", F.array_join("target_ids", ","))


@query(f"""{STORY_SQL}, {_chain_sql(False)}, {_told_sql(True, 1.0).rpartition('SELECT video_id, position')[0].rstrip()},
w AS (SELECT video_id, count(*) AS found FROM mt GROUP BY video_id), x AS (SELECT video_id, count(*) AS told FROM un GROUP BY video_id), y AS (SELECT video_id, count(*) AS kept FROM tr GROUP BY video_id), z AS (SELECT video_id, count(*) AS segments, round(sum(p.e - p.s), 3) AS total FROM fin GROUP BY video_id)
SELECT video_id, least(found, 64) AS matches, coalesce(segments, 0) AS segments, coalesce(total, 0) AS total_duration_seconds, coalesce(kept, 0) < told AS truncated FROM w JOIN x USING (video_id) LEFT JOIN y USING (video_id) LEFT JOIN z USING (video_id)""")
def narrative_response(spark, d):
    r = narrative.response(_matches(spark, d), STORY, "hook_first")
    n = lambda c: F.size(c).cast("long").alias(c)
    return r.select("video_id", n("matches"), n("segments"), "total_duration_seconds", F.array_contains("notes", "timeline truncated to target duration").alias("truncated"))
