"""Sampling grids: table functions that turn a row into its sampling points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf

#: Seconds and samples per second of the window profiles.
PROFILES = {"burst_1s_3fps": (1.0, 3.0), "window_3s_1fps": (3.0, 1.0)}


def window_times(start: Column, duration: Column, profile: str = "window_3s_1fps") -> Column:
    """Sampling points of a window that lie in the video."""
    length, rate = PROFILES[profile]
    n = max(2, round(length * rate))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(start + i / rate, 6)), lambda x: x < duration)


def window_starts(duration: Column, count: int) -> Column:
    """Starts of ``count`` windows of three seconds over the whole video; one at 0 if there is no room for more."""
    most = F.greatest(duration - 3.0, F.lit(0.0))
    if count == 1:
        return F.array(F.lit(0.0))
    return F.when(most == 0, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(most * i / (count - 1), 3)))


def luminance_times(duration: Column, conf: EngineConf = EngineConf()) -> Column:
    """Midpoints of equal parts of the video: a second each, 2 at least, as many as the settings allow."""
    n = F.least(F.lit(conf.signal_luminance_max_frames), F.greatest(F.lit(2), (duration * conf.signal_luminance_fps).cast("int")))
    step = duration / n
    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(i * step + step / 2, 3)), lambda x: x < duration)


def uniform_times(duration: Column, most: int) -> Column:
    """Midpoints for 4 to ``most`` frames, one a second."""
    n = F.greatest(F.lit(4), F.least(F.lit(most), F.greatest(F.lit(4), duration.cast("int"))))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(duration * (i + 0.5) / n, 3))


def shot_times(start: Column, end: Column, count: Column) -> Column:
    """Points in a shot, away from its ends; the middle if one is asked for or there is no room."""
    inset = F.least(F.lit(0.1), (end - start) * 0.2)
    low, high = start + inset, end - inset
    return (
        F.when(high <= low, F.array(F.round((start + end) / 2, 3)))
        .when(count <= 1, F.array(F.round((low + high) / 2, 3)))
        .otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.round(low + i * ((high - low) / (count - 1)), 3)))
    )


def per_shot(shots_in_video: Column, conf: EngineConf = EngineConf()) -> Column:
    """Samples of a shot within the video's budget."""
    return F.greatest(F.lit(1), F.least(F.lit(conf.frames_per_shot), F.floor(F.lit(conf.max_frames) / shots_in_video).cast("int"))).cast("int")


def frame_index(ts: Column, n: Column, rate: Column | float = 1.0) -> Column:
    """Frame that a decoder at ``rate`` frames a second gives for a time: the nearest one, half to even, the last at most."""
    return F.least(F.bround(ts * rate, 0).cast("long"), (n - 1).cast("long"))


def decode_rate(span: Column, most: int) -> Column:
    return F.least(F.lit(1.0), most / span)


def sampled(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points (video_id, n, ts, ...) with the frame of their time; one hash join on (video_id, t)."""
    return points.withColumn("t", frame_index(F.col("ts"), F.col("n"))).join(frames, ["video_id", "t"])


def all_times(*lists: Column) -> Column:
    """Sorted distinct union of sampling points."""
    out = lists[0]
    for x in lists[1:]:
        out = F.array_union(out, x)
    return F.array_sort(F.array_distinct(out))
