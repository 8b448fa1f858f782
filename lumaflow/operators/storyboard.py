"""Shots of a video and their signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions.scalars import rounded
from ..sources.views import durations
from . import grids, motion

CONF = EngineConf()
#: Fixed value: shorter fragments are no shots.
FRAGMENT = 0.05


def shots(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, index, start, end, n) from cuts (video_id, ts) and videos (video_id, n = seconds); fragments leave gaps."""
    ends = videos.select("video_id", F.explode(F.array(F.lit(0.0), F.col("n").cast("double"))).alias("ts"))
    inner = cuts.select("video_id", "ts").join(videos, "video_id").where("ts > 0 AND ts < n").select("video_id", "ts")
    w = Window.partitionBy("video_id").orderBy("ts")
    s = ends.unionByName(inner).withColumn("end", F.lead("ts").over(w)).where(F.col("end") - F.col("ts") > FRAGMENT)
    s = s.select("video_id", (F.row_number().over(w) - 1).alias("index"), F.round("ts", 3).alias("start_seconds"), F.round("end", 3).alias("end_seconds"))
    none = videos.join(s.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(0).alias("index"), F.lit(0.0).alias("start_seconds"), F.round(F.col("n").cast("double"), 3).alias("end_seconds"))
    return s.unionByName(none)


def shot_signals(frames: DataFrame, cuts: DataFrame, conf: EngineConf = CONF, shipped: bool = False) -> DataFrame:
    """Shots with motion and luminance measures of their samples; fewer than two samples give zeros. ``shipped`` rounds exactly, to the settings' digits."""
    videos = durations(frames)
    s = shots(cuts, videos).withColumn("in_video", F.count("*").over(Window.partitionBy("video_id"))).join(videos, "video_id")
    points = s.withColumn("ts", F.explode(grids.shot_times(F.col("start_seconds"), F.col("end_seconds"), grids.per_shot(F.col("in_video"), conf))))
    got = grids.sampled(points, frames)
    got = motion.with_steps(got, Window.partitionBy("video_id", "index").orderBy("ts"), conf)
    zero = lambda c: rounded(F.coalesce(c, F.lit(0.0)), conf.signal_digits if shipped else None, 6)
    return got.groupBy("video_id", "index", "start_seconds", "end_seconds").agg(
        F.count("*").cast("int").alias("sampled_frames"), zero(F.avg("changed_ratio")).alias("mean_motion_intensity"), zero(F.max("changed_ratio")).alias("peak_motion_intensity"),
        zero(F.avg((F.col("lum_diff") >= conf.luminance_spike_threshold).cast("double"))).alias("luminance_spike_ratio"), zero(F.max("lum_diff")).alias("luminance_delta_max"),
    ).withColumn("duration_seconds", F.round(F.col("end_seconds") - F.col("start_seconds"), 3))
