"""Queries of the media-signal engine over the star-schema tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import books, scalars
from ..operators import closed_set, fingerprints, gate, grids, motion, narrative, planner, platforms, storyboard, styles, titles
from ..sources import media
from ..sources.views import durations, gray_frames, pictures, table, timelines
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CONF, STYLE, STORY = EngineConf(), books.styles(), books.narratives()


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# common table expressions of the oracles
FR = """fr AS (SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, least(value / 500.0, 1.0) AS lum FROM events),
n AS (SELECT video_id, count(*) AS n FROM fr GROUP BY video_id),
pr AS (SELECT video_id, t, lum, abs(lum - lag(lum) OVER (PARTITION BY video_id ORDER BY t)) AS d FROM fr)"""
PATTERN = "CASE WHEN abrupt THEN 'abrupt' WHEN active = pairs THEN 'continuous' WHEN active > 0 THEN 'intermittent' ELSE 'stable' END"
MEASURE = "count(*) AS samples, count(d) AS pairs, count(*) FILTER (d >= 0.05) AS active, coalesce(bool_or(d >= 0.65 AND d >= 0.35), false) AS abrupt, avg(d) AS mean, max(d) AS peak, avg(CAST(d >= 0.12 AS DOUBLE)) AS spike"
WS = f"""us AS (SELECT DISTINCT video_id, n, round(greatest(n - 3.0, 0.0) * i / 3, 3) AS start FROM n, range(4) r(i)),
ut AS (SELECT video_id, n, start, start + j AS ts FROM us, range(3) r(j) WHERE start + j < n),
ui AS (SELECT *, CAST(least(round_even(ts, 0), n - 1) AS BIGINT) AS t FROM ut),
up AS (SELECT ui.video_id, ui.n, ui.start, abs(lum - lag(lum) OVER (PARTITION BY ui.video_id, ui.start ORDER BY ts)) AS d FROM ui JOIN fr ON ui.video_id = fr.video_id AND ui.t = fr.t),
ws AS (SELECT video_id, n, start, {MEASURE} FROM up GROUP BY video_id, n, start HAVING count(*) >= 2)"""
GRID = """lk AS (SELECT video_id, n, least(120, greatest(2, n)) AS k FROM n),
lt AS (SELECT video_id, n, round(i * (n::DOUBLE / k) + (n::DOUBLE / k) / 2, 3) AS ts FROM lk, range(120) r(i) WHERE i < k AND round(i * (n::DOUBLE / k) + (n::DOUBLE / k) / 2, 3) < n),
ld AS (SELECT lt.video_id, abs(lum - lag(lum) OVER (PARTITION BY lt.video_id ORDER BY ts)) AS d FROM lt JOIN fr ON lt.video_id = fr.video_id AND fr.t = CAST(least(round_even(ts, 0), n - 1) AS BIGINT)),
sp AS (SELECT video_id, round(coalesce(avg(CAST(d >= 0.12 AS DOUBLE)), 0), 6) AS luminance_spike_ratio FROM ld GROUP BY video_id)"""
SIG = f"""{WS},
mo AS (SELECT video_id, round(avg(mean), 8) AS mean_motion_intensity, round(max(mean), 6) AS peak_motion_intensity, round(CAST(count(*) FILTER (active = pairs) AS DOUBLE) / count(*), 3) AS continuous_motion_window_ratio FROM ws GROUP BY video_id),
cu AS (SELECT video_id, count(*) AS c FROM pr WHERE d > 0.3 GROUP BY video_id),
{GRID},
sig AS (SELECT n.video_id, round(coalesce(c, 0) / greatest(n / 60.0, 1e-6), 3) AS shot_cut_rate_per_min, coalesce(c, 0) AS scene_count, mean_motion_intensity, peak_motion_intensity, continuous_motion_window_ratio, luminance_spike_ratio, CAST(n AS DOUBLE) AS duration_seconds
        FROM n JOIN mo USING (video_id) LEFT JOIN cu USING (video_id) JOIN sp USING (video_id))"""
CAND = f"""{WS},
cs AS (SELECT video_id, start AS start_seconds, least(3.0, n - start) AS duration_seconds, round(0.65 * least(1.0, mean / 0.5) + 0.20 * CASE WHEN active = pairs THEN 1.0 ELSE 0.0 END + 0.15 * least(1.0, spike / 0.12), 6) AS score,
              round(mean, 6) AS motion_intensity, round(peak, 6) AS peak_motion_intensity, {PATTERN} AS temporal_pattern, round(spike, 6) AS luminance_spike_ratio FROM ws),
cand AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_seconds) AS rank FROM cs)"""
SHOTS = """bo AS (SELECT video_id, 0.0::DOUBLE AS ts FROM n UNION ALL SELECT video_id, n::DOUBLE FROM n UNION ALL SELECT pr.video_id, t::DOUBLE FROM pr JOIN n USING (video_id) WHERE d > 0.3 AND t > 0 AND t < n),
bp AS (SELECT video_id, ts, lead(ts) OVER (PARTITION BY video_id ORDER BY ts) AS e FROM bo),
shots AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts) - 1 AS "index", round(ts, 3) AS start_seconds, round(e, 3) AS end_seconds FROM bp WHERE e - ts > 0.05),
sn AS (SELECT shots.*, n.n, greatest(1, least(3, 240 // count(*) OVER (PARTITION BY video_id))) AS k, start_seconds + least(0.1, (end_seconds - start_seconds) * 0.2) AS lo, end_seconds - least(0.1, (end_seconds - start_seconds) * 0.2) AS hi FROM shots JOIN n USING (video_id)),
st AS (SELECT sn.*, CASE WHEN hi <= lo THEN round((start_seconds + end_seconds) / 2, 3) WHEN k <= 1 THEN round((lo + hi) / 2, 3) ELSE round(lo + j * ((hi - lo) / (k - 1)), 3) END AS ts FROM sn, range(3) r(j) WHERE j < k),
sd AS (SELECT DISTINCT video_id, "index", start_seconds, end_seconds, n, ts FROM st),
sf AS (SELECT sd.*, abs(lum - lag(lum) OVER (PARTITION BY sd.video_id, "index" ORDER BY ts)) AS d FROM sd JOIN fr ON sd.video_id = fr.video_id AND fr.t = CAST(least(round_even(ts, 0), n - 1) AS BIGINT)),
ss AS (SELECT video_id, "index", start_seconds, end_seconds, round(end_seconds - start_seconds, 3) AS duration_seconds, count(*) AS sampled_frames, round(coalesce(avg(d), 0), 6) AS mean_motion_intensity, round(coalesce(max(d), 0), 6) AS peak_motion_intensity,
              round(coalesce(avg(CAST(d >= 0.12 AS DOUBLE)), 0), 6) AS luminance_spike_ratio, round(coalesce(max(d), 0), 6) AS luminance_delta_max FROM sf GROUP BY ALL)"""
RULES = """ru AS (SELECT *, coalesce(mean_motion_intensity >= 0.42 AND peak_motion_intensity >= 0.60 AND shot_cut_rate_per_min >= 18, false) AS r1, shot_cut_rate_per_min >= 25 AND mean_motion_intensity < 0.40 AS r2, continuous_motion_window_ratio <= 0.5 OR luminance_spike_ratio >= 0.14 AS r3,
  round((0.5 * greatest(0, least(1, (mean_motion_intensity - 0.42) / 0.30)) + 0.3 * greatest(0, least(1, (luminance_spike_ratio - 0.08) / 0.12))) / 0.8, 6) AS s1 FROM sig),
pm AS (SELECT video_id, 0 AS position, 'ran_xiang' AS profile_id, s1 AS style_score FROM ru WHERE r1 UNION ALL SELECT video_id, 1, 'fast_dialogue', 1.0 FROM ru WHERE r2 UNION ALL SELECT video_id, 3, 'quality_flag', 1.0 FROM ru WHERE r3)"""
MATCH = """nx AS (SELECT *, lead("index") OVER w AS i2, lead(start_seconds) OVER w AS b2, lead(end_seconds) OVER w AS e2, lead(mean_motion_intensity) OVER w AS m2 FROM ss WINDOW w AS (PARTITION BY video_id ORDER BY "index")),
sm AS (SELECT video_id, "index", start_seconds, end_seconds, round(mean_motion_intensity + 0.5 * luminance_spike_ratio, 8) AS score, UNNEST([CASE WHEN mean_motion_intensity >= 0.30 AND luminance_spike_ratio >= 0.10 THEN 0 END, CASE WHEN luminance_delta_max >= 0.25 THEN 1 END, CASE WHEN mean_motion_intensity <= 0.18 AND duration_seconds >= 1.0 THEN 2 END, CASE WHEN mean_motion_intensity >= 0.20 AND duration_seconds >= 0.8 THEN 4 END]) AS target_pos FROM ss),
ma AS (SELECT video_id, target_pos, 'shot' AS kind, [CAST("index" AS INT)] AS shot_indexes, start_seconds, end_seconds, score FROM sm WHERE target_pos IS NOT NULL
       UNION ALL SELECT video_id, 3, 'pair', [CAST("index" AS INT), CAST(i2 AS INT)], start_seconds, e2, round(m2 - mean_motion_intensity, 8) FROM nx WHERE b2 - end_seconds <= 0.5 AND mean_motion_intensity <= 0.15 AND m2 >= 0.30),
mt AS (SELECT *, ['battle_effects', 'blood_intensity', 'romance_intimacy', 'daily_turbulence', 'group_action'][target_pos + 1] AS target_id FROM ma),
md AS (SELECT * EXCLUDE (rk), list_distinct_in_order FROM (SELECT *, row_number() OVER (PARTITION BY video_id, start_seconds, end_seconds ORDER BY score DESC, target_pos) AS rk, list(target_id) OVER (PARTITION BY video_id, start_seconds, end_seconds ORDER BY score DESC, target_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS list_distinct_in_order FROM mt) WHERE rk = 1)"""
PX = """px AS (SELECT CAST(label AS BIGINT) AS video_id, CAST(count(*) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = timelines(spark, sf_dir)
    return storyboard.shot_signals(f, motion.scene_cuts(f))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.match_targets(_shots(spark, sf_dir), STORY, digits=8)


@query(f"WITH {FR} SELECT video_id, t, round(d, 6) AS diff FROM pr WHERE d IS NOT NULL")
def frame_pair_diff(spark, d):
    return motion.pair_diffs(timelines(spark, d)).withColumn("diff", F.round("diff", 6))


@query(f"""WITH {PX}, q AS (SELECT video_id, t, v, lag(v) OVER (PARTITION BY video_id ORDER BY t) AS u FROM px), z AS (SELECT video_id, t, unnest(v) AS a, unnest(u) AS b FROM q WHERE u IS NOT NULL)
SELECT video_id, t, round(avg(abs(a - b)), 6) AS mean_diff, round(avg(CAST(abs(a - b) >= 0.1 AS DOUBLE)), 6) AS changed_ratio FROM z GROUP BY video_id, t""")
def pixel_pair_change(spark, d):
    p = pictures(spark, d).withColumn("before", F.lag("px").over(Window.partitionBy("video_id").orderBy("t"))).where("before IS NOT NULL")
    mean, changed = motion.pixel_change(F.col("px"), F.col("before"))
    return p.select("video_id", "t", F.round(mean, 6).alias("mean_diff"), F.round(changed, 6).alias("changed_ratio"))


PIX = """q AS (SELECT video_id, t, t // 3 * 3.0 AS start, v, lag(v) OVER (PARTITION BY video_id, t // 3 ORDER BY t) AS u FROM px),
z AS (SELECT video_id, CAST(start AS DOUBLE) AS start, t, u IS NOT NULL AS pair, CASE WHEN u IS NOT NULL THEN list_aggregate(list_transform(list_zip(u, v), lambda p: abs(p[2] - p[1])), 'avg') END AS m,
             CASE WHEN u IS NOT NULL THEN list_aggregate(list_transform(list_zip(u, v), lambda p: CASE WHEN abs(p[2] - p[1]) >= least_change THEN 1.0 ELSE 0.0 END), 'avg') END AS c, abs(list_aggregate(v, 'avg') - list_aggregate(u, 'avg')) AS l FROM q, one),
mw AS (SELECT video_id, start, count(*) AS samples, count(c) AS pairs, count(*) FILTER (c >= 0.05) AS active, coalesce(bool_or(c >= 0.65 AND m >= 0.35), false) AS abrupt, avg(c) AS mean, max(c) AS peak, avg(m) AS difference, avg(CAST(l >= 0.12 AS DOUBLE)) AS spike FROM z GROUP BY video_id, start)"""
PIXEL_WINDOWS = f"SELECT video_id, start, samples, active AS active_pairs, round(mean, 6) AS mean_ratio, round(peak, 6) AS peak_ratio, round(difference, 6) AS mean_difference, round(spike, 6) AS spike, CASE WHEN pairs > 0 THEN {PATTERN} END AS pattern FROM mw"


def _pixel_windows(frames: DataFrame) -> DataFrame:
    w = motion.motion_windows(frames, motion.tumbling(frames))
    six = lambda c: F.round(c, 6).alias(c)
    return w.select("video_id", "start", "samples", "active_pairs", six("mean_ratio"), six("peak_ratio"), six("mean_difference"), six("spike"), "pattern")


@query(f"WITH {PX}, one AS (SELECT 0.1 AS least_change), {PIX} {PIXEL_WINDOWS}")
def pixel_window_summary(spark, d):
    return _pixel_windows(pictures(spark, d))


@query(f"WITH {PX.replace('CAST(x AS DOUBLE)', 'greatest(0.0, least(255.0, round_even((CAST(x AS DOUBLE) + 0.5) * 255, 0))) / 255')}, one AS (SELECT 0.1 AS least_change), {PIX} {PIXEL_WINDOWS}")
def gray_window_summary(spark, d):
    return _pixel_windows(gray_frames(spark, d))


@query(f"WITH {FR} SELECT video_id, t, CAST(t + j AS DOUBLE) AS ts FROM fr JOIN n USING (video_id), range(3) r(j) WHERE t + j < n")
def window_timestamps(spark, d):
    f = timelines(spark, d).join(durations(timelines(spark, d)), "video_id")
    return f.select("video_id", "t", F.explode(grids.window_times(F.col("t").cast("double"), F.col("n").cast("double"))).alias("ts"))


@query(f"WITH {FR}, {WS} SELECT video_id, start FROM us")
def window_starts(spark, d):
    return motion.uniform(timelines(spark, d)).select("video_id", "start")


@query(f"WITH {FR}, g AS (SELECT video_id, n, least(120, greatest(2, n)) AS k FROM n) SELECT video_id, round(i * (n::DOUBLE / k) + (n::DOUBLE / k) / 2, 3) AS ts FROM g, range(120) r(i) WHERE i < k AND round(i * (n::DOUBLE / k) + (n::DOUBLE / k) / 2, 3) < n")
def luminance_grid(spark, d):
    return durations(timelines(spark, d)).select("video_id", F.explode(grids.luminance_times(F.col("n").cast("double"))).alias("ts"))


@query(f"WITH {FR}, g AS (SELECT video_id, n, greatest(4, least(16, greatest(4, n))) AS k FROM n) SELECT video_id, round(n * (i + 0.5) / k, 3) AS ts FROM g, range(16) r(i) WHERE i < k")
def uniform_frames(spark, d):
    return durations(timelines(spark, d)).select("video_id", F.explode(grids.uniform_times(F.col("n").cast("double"), 16)).alias("ts"))


@query(f"WITH {FR}, w AS (SELECT video_id, t // 3 * 3.0 AS start, abs(lum - lag(lum) OVER (PARTITION BY video_id, t // 3 ORDER BY t)) AS d FROM fr), m AS (SELECT video_id, CAST(start AS DOUBLE) AS start, {MEASURE} FROM w GROUP BY video_id, start) SELECT video_id, start, samples, pairs, active AS active_pairs, round(mean, 6) AS mean_ratio, round(peak, 6) AS peak_ratio, CASE WHEN pairs > 0 THEN {PATTERN} END AS pattern, CASE WHEN samples >= 2 THEN 'completed' ELSE 'insufficient_data' END AS status FROM m")
def motion_window_summary(spark, d):
    f = timelines(spark, d)
    w = motion.motion_windows(f, motion.tumbling(f))
    return w.select("video_id", "start", "samples", "pairs", "active_pairs", F.round("mean_ratio", 6).alias("mean_ratio"), F.round("peak_ratio", 6).alias("peak_ratio"), "pattern", "status")


@query(f"WITH {FR}, {GRID} SELECT * FROM sp")
def luminance_spike_ratio(spark, d):
    return motion.spike_ratio(timelines(spark, d)).withColumn("luminance_spike_ratio", F.round("luminance_spike_ratio", 6))


@query(f"WITH {FR}, {SIG} SELECT * FROM sig")
def video_signals(spark, d):
    return motion.video_signals(timelines(spark, d)).drop("audio_mean_volume_db", "width", "height", "fps")


@query(f"WITH {FR}, {CAND} SELECT * FROM cand")
def candidate_windows_ranked(spark, d):
    return motion.candidates(timelines(spark, d)).drop("score_components")


@query(f"WITH {FR}, {CAND} SELECT video_id, rank, start_seconds, score FROM cand WHERE rank <= 3")
def l2_topk(spark, d):
    return motion.top_windows(motion.candidates(timelines(spark, d)), 3).select("video_id", "rank", "start_seconds", "score")


@query(f"WITH {FR} SELECT video_id, CAST(t AS DOUBLE) AS ts, round(d, 6) AS scene_score FROM pr WHERE d > 0.3")
def scene_cuts(spark, d):
    return motion.scene_cuts(timelines(spark, d)).withColumn("scene_score", F.round("scene_score", 6))


@query(f"WITH {FR}, {SHOTS} SELECT video_id, \"index\", start_seconds, end_seconds FROM shots")
def storyboard_shots(spark, d):
    f = timelines(spark, d)
    return storyboard.shots(motion.scene_cuts(f), durations(f))


@query(f"WITH {FR}, {SHOTS} SELECT * FROM ss")
def shot_signals(spark, d):
    return _shots(spark, d)


@query(f"WITH {FR}, {SIG}, {RULES} SELECT * FROM pm")
def profile_matches(spark, d):
    return styles.evaluate(motion.video_signals(timelines(spark, d)), STYLE, digits=6).drop("notes")


@query(f"WITH {FR}, {SIG}, {RULES} SELECT video_id, 'ran_xiang' AS profile_id, s1 AS style_score, r1 AS matches FROM ru UNION ALL SELECT video_id, 'fast_dialogue', 1.0, r2 FROM ru UNION ALL SELECT video_id, 'quality_flag', 1.0, r3 FROM ru")
def style_scores(spark, d):
    return styles.scores(motion.video_signals(timelines(spark, d)), STYLE)


@query(f"""WITH {FR}, {SIG}, {RULES}, k AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS c, row_number() OVER (PARTITION BY video_id ORDER BY position) - 1 AS rank_index FROM pm)
SELECT video_id, profile_id, rank_index, CASE profile_id WHEN 'ran_xiang' THEN 'ambiguous_multi_hit' ELSE 'always' END AS "trigger", CASE profile_id WHEN 'ran_xiang' THEN 3 ELSE 2 END AS max_windows,
       CASE profile_id WHEN 'ran_xiang' THEN 'prompts/style_ran_xiang.md' WHEN 'fast_dialogue' THEN 'prompts/style_dialogue.md' ELSE 'prompts/quality_review.md' END AS prompt_ref, CASE WHEN c >= 2 THEN 'multi_hit_ambiguous' ELSE 'profile_requires_l2' END AS reason FROM k WHERE profile_id <> 'ran_xiang' OR c >= 2""")
def l2_referrals(spark, d):
    return styles.referrals(styles.evaluate(motion.video_signals(timelines(spark, d)), STYLE), STYLE)


@query(f"WITH {FR}, {SHOTS}, {MATCH} SELECT video_id, target_id, shot_indexes[1] AS \"index\", start_seconds, end_seconds, score FROM mt WHERE kind = 'shot'")
def target_matches_shot(spark, d):
    return _matches(spark, d).where("kind = 'shot'").select("video_id", "target_id", F.col("shot_indexes")[0].alias("index"), "start_seconds", "end_seconds", "score")


@query(f"WITH {FR}, {SHOTS}, {MATCH} SELECT video_id, target_id, shot_indexes[1] AS first_index, shot_indexes[2] AS second_index, start_seconds, end_seconds, score FROM mt WHERE kind = 'pair'")
def target_matches_pair(spark, d):
    return _matches(spark, d).where("kind = 'pair'").select("video_id", "target_id", F.col("shot_indexes")[0].alias("first_index"), F.col("shot_indexes")[1].alias("second_index"), "start_seconds", "end_seconds", "score")


@query(f"WITH {FR}, {SHOTS}, {MATCH} SELECT video_id, start_seconds, end_seconds, target_id, score, array_to_string(list_distinct_in_order, ',') AS target_ids FROM md")
def match_dedup(spark, d):
    return narrative.distinct_matches(_matches(spark, d)).select("video_id", "start_seconds", "end_seconds", "target_id", "score", F.array_join("target_ids", ",").alias("target_ids"))


@query(f"WITH {FR}, {SHOTS}, {MATCH} SELECT video_id, start_seconds, end_seconds, score, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, score DESC, target_pos) - 1 AS position FROM md")
def narrative_chronological(spark, d):
    return narrative.chronological(narrative.distinct_matches(_matches(spark, d))).select("video_id", "start_seconds", "end_seconds", "score", "position")


@query(f"""WITH {FR}, {SHOTS}, {MATCH}, c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, score DESC, target_pos) - 1 AS p FROM md), h AS (SELECT *, count(*) OVER (PARTITION BY video_id) // 2 AS half FROM c WHERE p < 6)
SELECT video_id, start_seconds, end_seconds, score, CASE WHEN p < half THEN 2 * p WHEN p < 2 * half THEN 2 * (p - half) + 1 ELSE p END AS position FROM h""")
def narrative_interleave(spark, d):
    return narrative.interleaved(narrative.distinct_matches(_matches(spark, d)), STORY.max_pairs).select("video_id", "start_seconds", "end_seconds", "score", "position")


@query(f"""WITH {FR}, {SHOTS}, q AS (SELECT *, end_seconds - start_seconds < 2.0 AS short FROM ss), c AS (SELECT *, CASE WHEN short = lag(short) OVER (PARTITION BY video_id ORDER BY "index") THEN 0 ELSE 1 END AS x FROM q),
r AS (SELECT *, sum(x) OVER (PARTITION BY video_id ORDER BY "index") AS run FROM c) SELECT video_id, CAST(run AS BIGINT) AS run, min("index") AS first, count(*) AS length FROM r WHERE short GROUP BY video_id, run HAVING count(*) >= 2""")
def flash_runs(spark, d):
    from dataclasses import replace

    return narrative.flash_runs(_shots(spark, d).withColumn("position", F.col("index")), replace(STORY, min_shot_seconds=2.0))


#: Pieces of each video, best first, for the oracles of timelines.
PIECES = """pc AS (SELECT video_id, target_pos, {'s': start_seconds, 'e': end_seconds, 'sc': score, 'kind': kind, 'target': target_id, 'shots': shot_indexes, 'targets': list_distinct_in_order} AS p FROM md),
pl AS (SELECT video_id, list(p ORDER BY p.sc DESC, p.s, target_pos) AS ps FROM pc GROUP BY video_id)"""


def _told_sql(opening: bool, least: float, target: float = 15.0) -> str:
    """CTEs from ``po`` (video_id, position, p) to ``fin`` (video_id, position, piece): no shot twice, the budget, the rhythm guard."""
    hull = lambda x, y: f"{{'s': least({x}.s, {y}.s), 'e': greatest({x}.e, {y}.e), 'sc': greatest({x}.sc, {y}.sc), 'shots': list_sort(list_distinct(list_concat({x}.shots, {y}.shots))), 'targets': list_sort(list_distinct(list_concat({x}.targets, {y}.targets))), 'role': {x}.role}}"
    touch = lambda x, y: f"least(abs({x}.s - {y}.e), abs({y}.s - {x}.e)) < 0.05"
    role = "CASE WHEN position = 0 THEN 'opening' ELSE 'body' END" if opening else "'body'"
    return f"""us1 AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS used, CAST([] AS BIGINT[]) AS kept FROM pl
  UNION ALL SELECT u.video_id, u.k + 1, CASE WHEN list_has_any(u.used, po.p.shots) THEN u.used ELSE list_concat(u.used, po.p.shots) END, CASE WHEN list_has_any(u.used, po.p.shots) THEN u.kept ELSE list_append(u.kept, CAST(po.position AS BIGINT)) END FROM us1 u JOIN po ON po.video_id = u.video_id AND po.position = u.k),
uk AS (SELECT video_id, unnest(kept) AS position FROM (SELECT video_id, max_by(kept, k) AS kept FROM us1 GROUP BY video_id)),
un AS (SELECT po.video_id, row_number() OVER (PARTITION BY po.video_id ORDER BY position) - 1 AS position, p FROM po JOIN uk USING (video_id, position)),
bu AS (SELECT *, {target} - coalesce(sum(p.e - p.s) OVER (PARTITION BY video_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM un),
tr AS (SELECT video_id, position, {{'s': p.s, 'e': CASE WHEN p.e - p.s > room THEN round(p.s + room, 3) ELSE p.e END, 'sc': p.sc, 'shots': p.shots, 'targets': p.targets, 'role': {role}}} AS p FROM bu WHERE room > 0),
sh AS (SELECT *, p.e - p.s < {least} AS short, lead(p) OVER (PARTITION BY video_id ORDER BY position) AS nx FROM tr),
sr AS (SELECT *, sum(CASE WHEN short = pv THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY position) AS run FROM (SELECT *, lag(short) OVER (PARTITION BY video_id ORDER BY position) AS pv FROM sh)),
sf2 AS (SELECT *, short AND count(*) OVER (PARTITION BY video_id, run) >= 2 AS flash FROM sr),
gd AS (SELECT video_id, CAST(0 AS BIGINT) AS k, [p][:0] AS o, CASE WHEN false THEN p END AS held FROM sf2 WHERE position = 0
  UNION ALL SELECT video_id, k + 1, CASE WHEN stays THEN list_append(o, own) WHEN joins THEN list_append(o[:-2], {hull('o[-1]', 'own')}) ELSE o END, CASE WHEN NOT stays AND NOT joins AND waits THEN own END
  FROM (SELECT *, flash OR own.e - own.s >= {least} AS stays, len(o) > 0 AND {touch('o[-1]', 'own')} AS joins, nx IS NOT NULL AND {touch('own', 'nx')} AS waits
        FROM (SELECT g.video_id, g.k, g.o, f.flash, f.nx, CASE WHEN g.held IS NULL THEN f.p ELSE {hull('f.p', 'g.held')} END AS own FROM gd g JOIN sf2 f ON f.video_id = g.video_id AND f.position = g.k))),
fin AS (SELECT video_id, unnest(o) AS p, generate_subscripts(o, 1) - 1 AS position FROM (SELECT video_id, max_by(o, k) AS o FROM gd GROUP BY video_id))
SELECT video_id, position, p.role AS role, p.s AS start_seconds, p.e AS end_seconds, p.sc AS score, array_to_string(p.targets, ',') AS target_ids FROM fin"""


def _chain_sql(contrast: bool) -> str:
    """CTE ``po``: always the piece most related to the one before; ties by score, then by the order of the step before."""
    pair = "list_filter(ps, lambda x: x.kind = 'pair')" if contrast else "ps[:0]"
    rel = "greatest(0.0, 1 - greatest(0.0, x.s - c.e, c.s - x.e) / 10.0) + CASE WHEN x.target = c.target THEN 0.5 ELSE 0.0 END + 0.25 * greatest(0.0, 1 - abs(x.sc - c.sc) / greatest(x.sc, c.sc, 1e-6))"
    return f"""op AS (SELECT video_id, ps, coalesce({pair}[1], ps[1]) AS c, len({pair}) > 0 AS paired FROM pl),
ch AS (SELECT video_id, CAST(0 AS BIGINT) AS k, c, list_filter(ps, lambda x: NOT (x.s = c.s AND x.e = c.e) AND (NOT paired OR x.s >= c.e)) AS rest FROM op
  UNION ALL SELECT video_id, k + 1, so[1].p, list_transform(so[2:], lambda z: z.p) FROM (SELECT video_id, k, list_sort(list_transform(rest, lambda x, i: {{'r': -({rel}), 'sc': -x.sc, 'i': i, 'p': x}})) AS so FROM ch WHERE len(rest) > 0)),
po AS (SELECT video_id, k AS position, c AS p FROM ch)"""


STORY_SQL = f"WITH RECURSIVE {FR}, {SHOTS}, {MATCH}, {PIECES}"


@query(f"{STORY_SQL}, {_chain_sql(False)}, {_told_sql(True, 1.0)}")
def narrative_hook_chain(spark, d):
    return narrative.plan(_matches(spark, d), STORY, "hook_first").withColumn("target_ids", F.array_join("target_ids", ",")).drop("shot_indexes")


@query(f"{STORY_SQL}, {_chain_sql(True)}, {_told_sql(True, 1.0)}")
def narrative_contrast_open(spark, d):
    return narrative.plan(_matches(spark, d), STORY, "twist_bridge").withColumn("target_ids", F.array_join("target_ids", ",")).drop("shot_indexes")


@query(f"""{STORY_SQL}, tc AS (SELECT video_id, p, row_number() OVER (PARTITION BY video_id ORDER BY p.s, p.sc DESC, target_pos) - 1 AS c FROM pc), th AS (SELECT *, count(*) OVER (PARTITION BY video_id) // 2 AS half FROM tc WHERE c < 6),
po AS (SELECT video_id, p, CAST(CASE WHEN c < half THEN 2 * c WHEN c < 2 * half THEN 2 * (c - half) + 1 ELSE c END AS BIGINT) AS position FROM th), {_told_sql(False, 2.0)}""")
def rhythm_guard(spark, d):
    from dataclasses import replace

    return narrative.plan(_matches(spark, d), replace(STORY, min_shot_seconds=2.0), "linear", 15.0, True).withColumn("target_ids", F.array_join("target_ids", ",")).drop("shot_indexes")


SEG = f"WITH {FR}, {CAND}, sg AS (SELECT video_id, start_seconds, start_seconds + duration_seconds AS end_seconds, score FROM cand), ia AS (SELECT *, CASE WHEN start_seconds <= max(end_seconds) OVER (PARTITION BY video_id ORDER BY start_seconds, end_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS x FROM sg), ib AS (SELECT *, sum(x) OVER (PARTITION BY video_id ORDER BY start_seconds, end_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM ia), im AS (SELECT video_id, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, max(score) AS score FROM ib GROUP BY video_id, k)"

GREEDY = """gr AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s DOUBLE, e DOUBLE, sc DOUBLE)[]) AS l, CAST(0 AS DOUBLE) AS cov FROM n
  UNION ALL SELECT video_id, k + 1, CASE WHEN take THEN nl ELSE l END, CASE WHEN take THEN nc ELSE cov END
  FROM (SELECT *, duration_seconds >= 1.0 AND cov < 15.0 AND nc > cov + 1e-9 AS take
        FROM (SELECT *, list_sum(list_transform(sl, lambda x, i: greatest(0.0, x.e - greatest(x.s, coalesce(list_max(list_transform(sl[:i - 1], lambda y: y.e)), x.s))))) AS nc
              FROM (SELECT *, list_sort(nl) AS sl FROM (SELECT g.*, c.duration_seconds, list_append(g.l, {'s': c.start_seconds, 'e': c.start_seconds + c.duration_seconds, 'sc': c.score}) AS nl FROM gr g JOIN cand c ON c.video_id = g.video_id AND c.rank = g.k + 1)))))"""
CHOSEN = "sg AS (SELECT video_id, w.s AS start_seconds, w.e AS end_seconds, w.sc AS score FROM (SELECT video_id, unnest(max_by(l, k)) AS w FROM gr GROUP BY video_id))"


@query(f"""{SEG.replace('WITH ', 'WITH RECURSIVE ', 1).replace('sg AS (SELECT video_id, start_seconds, start_seconds + duration_seconds AS end_seconds, score FROM cand)', f'{GREEDY}, {CHOSEN}')},
bl AS (SELECT *, 15.0 - coalesce(sum(end_seconds - start_seconds) OVER (PARTITION BY video_id ORDER BY start_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM im)
SELECT video_id, start_seconds, CASE WHEN end_seconds - start_seconds > l THEN round(start_seconds + l, 3) ELSE end_seconds END AS end_seconds, score FROM bl WHERE l > 0 AND (end_seconds - start_seconds <= l OR l >= 1.0)""")
def clip_plan_greedy(spark, d):
    return planner.plan_clips(motion.candidates(timelines(spark, d)))



def _segments(spark, d):
    c = motion.candidates(timelines(spark, d))
    return c.select("video_id", "start_seconds", (F.col("start_seconds") + F.col("duration_seconds")).alias("end_seconds"), "score")


@query(f"{SEG} SELECT video_id, round(sum(end_seconds - start_seconds), 3) AS covered_seconds FROM im GROUP BY video_id")
def interval_union(spark, d):
    return planner.union_length(_segments(spark, d), ["video_id"])


@query(f"{SEG} SELECT video_id, round(start_seconds, 3) AS start_seconds, round(end_seconds, 3) AS end_seconds, score FROM im")
def merge_segments(spark, d):
    return planner.merged(_segments(spark, d), ["video_id"]).withColumn("start_seconds", F.round("start_seconds", 3)).withColumn("end_seconds", F.round("end_seconds", 3))


@query(f"{SEG}, bl AS (SELECT *, 7.5 - coalesce(sum(end_seconds - start_seconds) OVER (PARTITION BY video_id ORDER BY start_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM im) SELECT video_id, round(start_seconds, 3) AS start_seconds, round(least(end_seconds, start_seconds + l), 3) AS end_seconds, score FROM bl WHERE l > 0 AND (end_seconds - start_seconds <= l OR l >= 1.0)")
def budget_clip(spark, d):
    c = planner.within_budget(planner.merged(_segments(spark, d), ["video_id"]), ["video_id"], ["start_seconds"], 7.5, 1.0)
    return c.withColumn("start_seconds", F.round("start_seconds", 3)).withColumn("end_seconds", F.round("end_seconds", 3))


@query("""WITH l AS (SELECT doc_id AS item_id, 'violence' AS dimension, CASE WHEN toxic = 1 AND quality = 0 THEN 'violence_graphic' WHEN toxic = 1 THEN 'violence_light' ELSE 'none' END AS label FROM labels UNION ALL SELECT doc_id, 'gore', CASE WHEN quality = 0 THEN 'gore_x' END FROM labels),
v AS (SELECT item_id, max(CASE WHEN dimension = 'violence' AND label = 'violence_graphic' THEN 2 WHEN dimension = 'violence' AND label = 'violence_light' THEN 1 ELSE 0 END) AS s, bool_or(dimension = 'gore' AND label IS NOT NULL) AS u FROM l GROUP BY item_id)
SELECT item_id, CASE s WHEN 2 THEN 'block' WHEN 1 THEN 'review' ELSE 'pass' END AS verdict, CASE s WHEN 2 THEN 'violence=violence_graphic' WHEN 1 THEN 'violence=violence_light' ELSE '' END AS hits, CASE WHEN u THEN 'gore' ELSE '' END AS unknown FROM v""")
def gate_verdicts(spark, d):
    l = table(spark, d, "labels")
    violence = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "violence_graphic").when(F.col("toxic") == 1, "violence_light").otherwise("none")
    rows = l.select(F.col("doc_id").alias("item_id"), F.explode(F.create_map(F.lit("violence"), violence, F.lit("gore"), F.when(F.col("quality") == 0, "gore_x"))).alias("dimension", "label"))
    v = gate.verdicts(rows, STYLE.gate)
    return v.select("item_id", "verdict", F.array_join(F.concat("block_hits", "review_hits"), ",").alias("hits"), F.array_join("unknown", ",").alias("unknown"))


@query(f"WITH {PX}, b AS (SELECT video_id, t, list_transform(range(64), lambda i: CASE WHEN v[64 - i] > list_aggregate(v, 'sum') / 64 THEN 1 ELSE 0 END) AS bits FROM px), x AS (SELECT video_id, t, list_transform(range(16), lambda j: substr('0123456789abcdef', bits[4 * j + 1] * 8 + bits[4 * j + 2] * 4 + bits[4 * j + 3] * 2 + bits[4 * j + 4] + 1, 1)) AS h FROM b) SELECT video_id, t, array_to_string(h, '') AS fingerprint FROM x")
def ahash_fingerprint(spark, d):
    return pictures(spark, d).select("video_id", "t", scalars.hex16(fingerprints.average_hash(F.col("px"))).alias("fingerprint"))


PRINTS = f"""WITH {PX}, pn AS (SELECT video_id, count(*) AS n FROM px GROUP BY video_id), pk AS (SELECT video_id, n, greatest(4, least(24, greatest(4, n))) AS k FROM pn),
pt AS (SELECT video_id, i, CAST(least(round_even(round(n * (i + 0.5) / k, 3), 0), n - 1) AS BIGINT) AS t FROM pk, range(24) r(i) WHERE i < k),
b AS (SELECT px.video_id, pt.i, list_transform(v, lambda x: CASE WHEN x > list_aggregate(v, 'sum') / 64 THEN 1 ELSE 0 END) AS bits FROM px JOIN pt ON px.video_id = pt.video_id AND px.t = pt.t),
pb AS (SELECT video_id, video_id // 1000 AS shelf, row_number() OVER (PARTITION BY video_id // 1000 ORDER BY video_id) - 1 AS i, count(*) OVER (PARTITION BY video_id // 1000) AS c FROM pn),
rf AS (SELECT p.video_id AS a, q.video_id AS b FROM pb p, range(1, 9) r(k), pb q WHERE q.shelf = p.shelf AND k < p.c AND q.i = (p.i + k) % p.c),
m AS (SELECT rf.a, rf.b, p.i AS ta, q.i AS tb, 1 - list_aggregate(list_transform(list_zip(p.bits, q.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END), 'sum') / 64.0 AS s FROM rf JOIN b p ON p.video_id = rf.a JOIN b q ON q.video_id = rf.b),
l AS (SELECT a, b, avg(s) AS s FROM (SELECT a, b, ta, max(s) AS s FROM m GROUP BY a, b, ta) GROUP BY a, b), r AS (SELECT a, b, avg(s) AS s FROM (SELECT a, b, tb, max(s) AS s FROM m GROUP BY a, b, tb) GROUP BY a, b),
fs AS (SELECT l.a, l.b, round(least(l.s, r.s), 6) AS similarity FROM l JOIN r ON l.a = r.a AND l.b = r.b)"""


def _prints(spark, d):
    """Hashes of frames spread evenly over each video's whole length."""
    p = pictures(spark, d)
    points = durations(p).select("video_id", "n", F.explode(grids.uniform_times(F.col("n").cast("double"), 24)).alias("ts"))
    return grids.sampled(points, p).select("video_id", fingerprints.average_hash(F.col("px")).alias("hash"))


def _similar(spark, d):
    """Each video against eight references: the next ones on its shelf of a thousand numbers, round to the shelf's first."""
    p = _prints(spark, d)
    w = Window.partitionBy("shelf")
    v = p.select("video_id").distinct().withColumn("shelf", F.floor(F.col("video_id") / 1000))
    v = v.withColumn("i", F.row_number().over(w.orderBy("video_id")) - 1).withColumn("c", F.count("*").over(w))
    asked = v.select(F.col("video_id").alias("a"), "shelf", "i", "c", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).where("k < c").select("a", "shelf", F.expr("(i + k) % c").alias("i"))
    pairs = asked.join(v.select("shelf", F.col("i").cast("long").alias("i"), F.col("video_id").alias("b")), ["shelf", "i"])
    return fingerprints.similarity(pairs.select("a", "b"), p)


@query(f"{PRINTS} SELECT * FROM fs")
def fingerprint_similarity(spark, d):
    return _similar(spark, d)


OVER = f"""WITH {PX}, pi AS (SELECT video_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM px), ps AS (SELECT video_id, i, i // 8 AS r, i % 8 AS c, var_pop(x) < 0.002 AS st, avg(x) < 0.08 AS dk FROM pi GROUP BY video_id, i),
ov AS (SELECT video_id, round(avg(st::INT), 6) AS static_pixel_ratio, round(avg(st::INT) FILTER (r < 2 AND c < 2), 6) AS top_left, round(avg(st::INT) FILTER (r < 2 AND c >= 6), 6) AS top_right, round(avg(st::INT) FILTER (r >= 6 AND c < 2), 6) AS bottom_left, round(avg(st::INT) FILTER (r >= 6 AND c >= 6), 6) AS bottom_right FROM ps GROUP BY video_id),
br AS (SELECT video_id, r, avg((st AND dk)::INT) > 0.9 AS bar FROM ps GROUP BY video_id, r), bb AS (SELECT video_id, round((count(*) FILTER (bar AND r < 2) + count(*) FILTER (bar AND r >= 6)) / 8.0, 6) AS black_bar_ratio FROM br GROUP BY video_id)"""


@query(f"{OVER} SELECT * FROM ov JOIN bb USING (video_id)")
def static_overlay(spark, d):
    return fingerprints.static_overlay(pictures(spark, d))


@query(f"{PRINTS}, {OVER.removeprefix(f'WITH {PX}, ')}, ms AS (SELECT a AS video_id, max(similarity) AS similarity FROM fs GROUP BY a), x AS (SELECT *, greatest(top_left, top_right, bottom_left, bottom_right) AS cm FROM ov JOIN bb USING (video_id) JOIN ms USING (video_id)) SELECT video_id, similarity, CASE WHEN similarity >= 0.9 THEN 'block' WHEN similarity >= 0.75 OR cm >= 0.55 OR black_bar_ratio >= 0.12 THEN 'review' ELSE 'pass' END AS verdict, array_to_string(list_filter([CASE WHEN similarity >= 0.9 THEN 'near_duplicate' WHEN similarity >= 0.75 THEN 'high_similarity' END, CASE WHEN cm >= 0.55 THEN 'suspected_watermark_residual' END, CASE WHEN black_bar_ratio >= 0.12 THEN 'suspected_black_bars' END], lambda f: f IS NOT NULL), ',') AS flags FROM x")
def dedup_verdict(spark, d):
    most = _similar(spark, d).groupBy(F.col("a").alias("video_id")).agg(F.max("similarity").alias("similarity"))
    o = fingerprints.static_overlay(pictures(spark, d)).join(most, "video_id")
    return fingerprints.verdict(o, books.DEDUP_THRESHOLDS).select("video_id", "similarity", "verdict", F.array_join("flags", ",").alias("flags"))


@query("WITH m AS (SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL), g AS (SELECT md5, count(*) AS copies, min(doc_id) AS first_key FROM m GROUP BY md5 HAVING count(*) > 1) SELECT doc_id, md5, copies, first_key FROM m JOIN g USING (md5)")
def file_md5_duplicates(spark, d):
    m = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return media.duplicates(m, "doc_id", "md5")


@query("""WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
cn AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_aggregate(list_transform(v, lambda y: y * y), 'sum'))) AS v FROM c), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings),
en AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_aggregate(list_transform(w, lambda y: y * y), 'sum'))) AS w FROM e), s AS (SELECT vec_id, label, list_aggregate(list_transform(list_zip(w, v), lambda z: z[1] * z[2]), 'sum') AS s FROM en, cn),
r AS (SELECT vec_id, label, s, lead(s) OVER w AS nx, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, label::VARCHAR))
SELECT vec_id AS item_id, CASE WHEN s >= 0.1 AND s - nx >= 0.01 THEN label::VARCHAR END AS answer, CASE WHEN s >= 0.1 AND s - nx >= 0.01 THEN 'answered' ELSE 'abstained' END AS status, round(s - nx, 6) AS margin, round(1 / (1 + exp(-10 * (s - nx))), 6) AS confidence, round(s, 6) AS top_score FROM r WHERE k = 1""")
def closed_set_answers(spark, d):
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    catalog = c.select(F.lit("label").alias("question"), F.col("label").cast("string").alias("value"), "v")
    a = closed_set.answers(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), catalog)
    return a.select("item_id", "answer", "status", "margin", "confidence", "top_score")


@query("WITH h AS (SELECT page_id, sha256('text:' || url) AS s FROM pages) SELECT page_id, round(('0x' || substr(s, 1, 2))::INT / 255.0 - 0.5, 6) AS first, round(('0x' || substr(s, 3, 2))::INT / 255.0 - 0.5, 6) AS second, round(list_aggregate(list_transform(range(64), lambda i: ('0x' || substr(s, CAST(2 * (i % 32) + 1 AS INT), 2))::INT / 255.0 - 0.5), 'sum'), 6) + 0.0 AS total FROM h")
def fake_embedding(spark, d):
    v = scalars.fake_embedding(F.concat(F.lit("text:"), F.col("url")))
    p = table(spark, d, "pages").select("page_id", v.alias("v"))
    return p.select("page_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[1], 6).alias("second"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6) + 0.0).alias("total"))


LENGTH = "CASE WHEN length(p_name) <= 0 THEN -10.0 WHEN length(p_name) BETWEEN 6 AND 22 THEN 2.0 ELSE -abs(length(p_name) - 14) * 0.15 END"


@query(f"SELECT p_partkey, CAST(round({LENGTH}, 6) AS DOUBLE) AS length_score FROM part")
def length_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(scalars.length_score(F.col("p_name")), 6).alias("length_score"))


@query(f"""WITH s AS (SELECT p_brand, p_partkey, p_name, {LENGTH} + CASE WHEN contains(p_name, '?') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(p_name, '!') THEN 0.5 ELSE 0.0 END + ('0x' || substr(sha256(p_name || '#' || p_partkey), 1, 2))::INT / 1000.0 AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 6) DESC, p_partkey) AS rank FROM s) SELECT p_brand, rank, p_partkey, CAST(round(score, 6) AS DOUBLE) AS score FROM r WHERE rank <= 3""")
def title_ranking(spark, d):
    s = table(spark, d, "part").withColumn("score", F.round(scalars.title_score(F.col("p_name"), F.col("p_partkey")), 6))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))).where("rank <= 3")
    return r.select("p_brand", "rank", "p_partkey", "score")


@query("WITH t AS (SELECT page_id, regexp_replace('  .' || url || '<|>*. ', '[<>:\"/\\\\|*\\x00-\\x1F]', '', 'g') AS b FROM pages) SELECT page_id, trim(substr(regexp_replace(trim(b), '^\\.+|\\.+$', '', 'g'), 1, 60)) AS title FROM t")
def sanitize_title(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.sanitize_title(F.concat(F.lit("  ."), F.col("url"), F.lit("<|>*. "))).alias("title"))


_POOL = ", ".join(f"('{key}', {k}, '{t}')" for key, texts in books.TITLE_POOLS.items() for k, t in enumerate(texts))
_ROUTES = ", ".join(f"'{t}': {keys}" for t, keys in books.TITLE_ROUTES.items())


@query(f"""WITH {FR}, {SHOTS}, {MATCH}, po(key, k, template) AS (VALUES {_POOL}), cx AS (SELECT video_id AS item_id, list_sort(list(DISTINCT target_id)) AS ts FROM md GROUP BY video_id),
ks AS (SELECT item_id, list_concat(['ran_xiang'], flatten(list_transform(ts, lambda t: MAP {{{_ROUTES}}}[t])), ['generic']) AS keys FROM cx), u AS (SELECT item_id, unnest(keys) AS key, generate_subscripts(keys, 1) AS kp FROM ks),
f AS (SELECT item_id, key, min(kp) AS kp FROM u GROUP BY ALL), t AS (SELECT item_id, replace(template, '{{seconds}}', '15') AS title, min(kp * 1000 + k) AS o FROM f JOIN po USING (key) WHERE NOT contains(template, '{{subject}}') AND NOT contains(template, '{{action}}') GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o) - 1 AS i FROM t),
s AS (SELECT *, CASE WHEN length(title) BETWEEN 6 AND 22 THEN 2.0::DOUBLE ELSE -abs(length(title) - 14) * 0.15::DOUBLE END + CASE WHEN contains(title, '？') OR contains(title, '?') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(title, '！') OR contains(title, '!') THEN 0.5 ELSE 0.0 END + ('0x' || substr(sha256(title || '#' || i), 1, 2))::INT / 1000.0::DOUBLE AS score FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) AS rank FROM s) SELECT item_id, rank, title, CAST(round(score, 6) AS DOUBLE) AS score FROM r WHERE rank <= 3""")
def title_candidates(spark, d):
    m = narrative.distinct_matches(_matches(spark, d)).groupBy(F.col("video_id").alias("item_id")).agg(F.array_sort(F.collect_set("target_id")).alias("target_ids"))
    c = m.select("item_id", "target_ids", F.lit("ran_xiang").alias("style_hint"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("action"), F.lit(15.0).alias("duration_seconds"))
    return titles.titles(c)


_CATS = ", ".join(f"('{c}', '{p}', '{','.join(names)}', {tid if p == 'bilibili' else 'NULL'})" for c, by, tid in books.PLATFORM_CATEGORIES for p, names in by.items())
_SPECS = ", ".join(f"('{p}', '{a}', {m}, {r})" for p, a, m, r in books.PLATFORM_SPECS)


@query(f"WITH c(category, platform, names, tid) AS (VALUES {_CATS}), s(platform, aspect, max_seconds, recommend_seconds) AS (VALUES {_SPECS}), e AS (SELECT event_id, ['drama_clip', 'hype_mashup', 'fast_dialogue', 'emotional', 'comedy'][event_id % 5 + 1] AS category FROM events) SELECT platform, category, names, tid, aspect, max_seconds, count(*) AS items FROM e JOIN c USING (category) LEFT JOIN s USING (platform) GROUP BY ALL")
def platform_mapping(spark, d):
    names = [c for c, *_ in books.PLATFORM_CATEGORIES]
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int")).alias("category"))
    m = platforms.mapped(e).withColumn("names", F.array_join("names", ","))
    return m.groupBy("platform", "category", "names", "tid", "aspect", "max_seconds").agg(F.count("*").alias("items"))


@query("SELECT conv_id AS job_id, arg_max(role, turn) AS status, count(*) AS n FROM conversations GROUP BY conv_id")
def job_state(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), "turn", F.col("role").alias("status"))
    return jobs.latest(c, "job_id", ["turn"], "status")


STATES = [x for x in jobs.NEXT if x]
_NEXT = ", ".join(f"'{state or 'none'}': [{', '.join(repr(t) for t in sorted(to))}]::VARCHAR[]" for state, to in jobs.NEXT.items())


@query(f"WITH l AS (SELECT user_id AS job_id, list({STATES}[event_id % {len(STATES)} + 1] ORDER BY ts, event_id) AS l FROM events GROUP BY user_id) SELECT job_id, nullif(list_reduce(l, lambda s, e: CASE WHEN list_contains(MAP {{{_NEXT}}}[s], e) THEN e ELSE s END, 'none'), 'none') AS status, CAST(len(l) AS BIGINT) AS n_events FROM l")
def job_states(spark, d):
    """Users' events as the logs of jobs."""
    event = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES) + 1).cast("int"))
    return jobs.settled(table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", event.alias("event")), ["ts", "event_id"])


@query(f"""{SEG} SELECT video_id, round(sum(end_seconds - start_seconds), 3) AS total_seconds FROM sg GROUP BY video_id""")
def total_seconds(spark, d):
    return planner.total_seconds(_segments(spark, d))


@query(f"""WITH {PX}, q AS (SELECT video_id, t, list_concat(v[19:22], v[27:30], v[35:38]) AS v FROM px), r AS (SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY t) AS u FROM q), z AS (SELECT video_id, t, unnest(v) AS a, unnest(u) AS b FROM r WHERE u IS NOT NULL)
SELECT video_id, t, round(avg(abs(a - b)), 6) AS mean_diff, round(avg(CAST(abs(a - b) >= 0.1 AS DOUBLE)), 6) AS changed_ratio FROM z GROUP BY video_id, t""")
def roi_pixel_change(spark, d):
    """Pair measures of a region: columns 2 to 5 of rows 2 to 4."""
    p = pictures(spark, d).withColumn("px", motion.crop(F.col("px"), 8, 8, (0.25, 0.75, 0.25, 0.625)))
    s = motion.with_steps(p, Window.partitionBy("video_id").orderBy("t")).where("mean_diff IS NOT NULL")
    return s.select("video_id", "t", F.round("mean_diff", 6).alias("mean_diff"), F.round("changed_ratio", 6).alias("changed_ratio"))


@query(f"WITH {FR}, {GRID}, {WS}, a AS (SELECT video_id, ts FROM ut UNION SELECT video_id, ts FROM lt) SELECT video_id, ts FROM a")
def sampling_points(spark, d):
    """All points that the motion windows and the luminance grid ask for, each once."""
    n = F.col("n").cast("double")
    starts = grids.window_starts(n, CONF.signal_motion_window_count)
    windows = F.flatten(F.transform(starts, lambda s: grids.window_times(s, n)))
    return durations(timelines(spark, d)).select("video_id", F.explode(grids.all_times(windows, grids.luminance_times(n))).alias("ts"))


@query("WITH b AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, p_brand || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.mp4' AS file_name FROM b")
def file_names(spark, d):
    return titles.file_names(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "file_name")


from . import ingest  # noqa: E402, F401  adds its queries
