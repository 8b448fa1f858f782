"""Clip plans: greedy choice of windows, and the interval algebra around it."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str = "start_seconds", end: str = "end_seconds") -> DataFrame:
    """Numbers touching or overlapping intervals alike, in ``island``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Touching or overlapping segments as one, with their best score."""
    i = islands(df, keys).groupBy(*keys, "island").agg(F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.max("score").alias("score"))
    return i.drop("island")


def union_length(df: DataFrame, keys: list[str]) -> DataFrame:
    return merged(df, keys).groupBy(*keys).agg(F.round(F.sum(F.col("end_seconds") - F.col("start_seconds")), 3).alias("covered_seconds"))


def within_budget(df: DataFrame, keys: list[str], order: list, target: float, least: float = 0.0) -> DataFrame:
    """Segments in order up to ``target`` seconds; the last is cut, or dropped if less than ``least`` would stay."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_seconds") - F.col("start_seconds")
    left = target - F.coalesce(F.sum(length).over(w), F.lit(0.0))
    d = df.withColumn("_left", left).withColumn("_length", length).where("_left > 0").where((F.col("_length") <= F.col("_left")) | (F.col("_left") >= least))
    return d.withColumn("end_seconds", F.when(F.col("_length") > F.col("_left"), F.round(F.col("start_seconds") + F.col("_left"), 3)).otherwise(F.col("end_seconds"))).drop("_left", "_length")


def choose(windows: list[tuple[float, float, float]], target: float, least: float) -> list[int]:
    """Places of the windows (start, duration, score) that a greedy cover takes: best score first, each only if it adds time.

    What is covered is kept as disjoint intervals in order, so a window's gain needs only its neighbours.
    """
    starts: list[float] = []
    ends: list[float] = []
    covered, out = 0.0, []
    for k in sorted(range(len(windows)), key=lambda k: (-windows[k][2], windows[k][0], windows[k][1])):
        start, duration, _ = windows[k]
        if duration < least:
            continue
        if covered >= target:
            break
        end = start + duration
        hi = bisect_right(starts, end)
        lo = next((i for i in range(hi - 1, -1, -1) if ends[i] < start), -1) + 1
        a, b = min([start, *starts[lo:hi]]), max([end, *ends[lo:hi]])
        gain = (b - a) - sum(ends[i] - starts[i] for i in range(lo, hi))
        if gain <= 0:
            continue
        starts[lo:hi], ends[lo:hi] = [a], [b]
        covered += gain
        out.append(k)
    return out


def plan_clips(windows: DataFrame, target: float = 15.0, least: float = 1.0) -> DataFrame:
    """(video_id, start_seconds, end_seconds, score): a clip plan for each video from scored windows.

    The choice is sequential by nature, and runs on one video's windows at a time (their number is set by the window
    grid, not by the corpus); merging and cutting to the target are window functions.
    """
    if target <= 0 or least < 0:
        raise ValueError("the target is positive, the least length not negative")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        w = list(zip(pdf["start_seconds"], pdf["duration_seconds"], pdf["score"]))
        got = pdf.iloc[choose(w, target, least)]
        return pd.DataFrame({"video_id": got["video_id"], "start_seconds": got["start_seconds"], "end_seconds": got["start_seconds"] + got["duration_seconds"], "score": got["score"]})

    kind = windows.schema["video_id"].dataType.simpleString()
    valid = windows.where("start_seconds >= 0 AND duration_seconds > 0")
    chosen = valid.select("video_id", "start_seconds", "duration_seconds", "score").groupBy("video_id").applyInPandas(pick, f"video_id {kind}, start_seconds double, end_seconds double, score double")
    return within_budget(merged(chosen, ["video_id"]), ["video_id"], ["start_seconds"], target, least)


def total_seconds(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(F.round(F.sum(F.col("end_seconds") - F.col("start_seconds")), 3).alias("total_seconds"))


def edit_list(segments: DataFrame, path: str = "path") -> DataFrame:
    """Cutting instructions for a renderer: a row for each segment, checked for positive length."""
    ok = F.when(F.col("end_seconds") > F.col("start_seconds"), F.col("end_seconds")).otherwise(F.raise_error(F.lit("segment without length")).cast("double"))
    return segments.withColumn("out_seconds", ok).withColumn("in_seconds", F.col("start_seconds"))
