"""Readers of what media tools report, of files, and of job records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the tools print.
RATE, CUT, VOLUME = "avg_frame_rate", "pts_time", "mean_volume"


def media_info(df: DataFrame, text: str = "probe") -> DataFrame:
    """Adds duration_seconds, width, height, fps and has_audio from a probe's key=value lines. No duration: an error."""
    first = lambda key: F.regexp_extract(F.col(text), rf"(?m)^{key}=([^\s]+)", 1)
    num = lambda c: c.try_cast("double")
    rate = F.split(F.regexp_extract(F.col(text), rf"(?m)^{RATE}=([0-9.]+/0*[1-9][0-9]*)", 1), "/")  # the first that has a denominator
    duration = num(first("duration"))
    d = df.withColumn("duration_seconds", F.when(duration.isNull(), F.raise_error(F.lit("probe without a duration")).cast("double")).otherwise(duration))
    d = d.withColumn("width", first("width").try_cast("int")).withColumn("height", first("height").try_cast("int"))
    d = d.withColumn("fps", F.when(num(F.get(rate, F.lit(1))) > 0, F.try_divide(num(F.get(rate, F.lit(0))), num(F.get(rate, F.lit(1))))))
    return d.withColumn("has_audio", F.col(text).rlike(r"(?m)^codec_type=audio\s*$"))


def _values(log: Column, key: str) -> Column:
    """What stands behind each ``key:`` of a log, up to the next blank, as numbers; what isn't a number is left out."""
    behind = F.split(log, key + ":", -1)
    numbers = F.transform(F.slice(behind, F.lit(2), F.greatest(F.size(behind) - 1, F.lit(0))), lambda x: F.split_part(F.concat(F.ltrim(F.translate(x, "\t\r\n", "   ")), F.lit(" ")), F.lit(" "), F.lit(1)).try_cast("double"))
    return F.filter(numbers, lambda x: x.isNotNull())


def scene_cut_times(log: Column) -> Column:
    """Sorted seconds of the cuts in a scene filter's log."""
    return F.array_sort(_values(log, CUT))


def mean_volume(log: Column) -> Column:
    """Decibels, or null."""
    return F.get(_values(log, VOLUME), F.lit(0))


def parse_probe(text: str) -> dict:
    """The values of ``media_info`` for one probe's text. No duration, or a number that isn't one: ValueError."""
    lines = [(k.strip(), v.strip()) for k, sep, v in (line.partition("=") for line in text.splitlines()) if sep]
    first = {k: v for k, v in reversed(lines)}
    if "duration" not in first:
        raise ValueError("probe without a duration")
    whole = lambda key: int(first[key]) if key in first else None
    rates = (re.fullmatch(r"([0-9.]+)/([0-9.]+)", v) for k, v in lines if k == RATE)
    fps = next((float(m[1]) / float(m[2]) for m in rates if m and float(m[2]) > 0), None)
    return {"duration_seconds": float(first["duration"]), "width": whole("width"), "height": whole("height"), "fps": fps, "has_audio": ("codec_type", "audio") in lines}


def parse_scenes(log: str) -> list[float]:
    """Sorted seconds of the cuts in one scene filter's log."""
    return sorted(float(x) for x in re.findall(rf"{CUT}:\s*([0-9]+(?:\.[0-9]+)?)", log))


def parse_volume(log: str) -> float | None:
    found = re.search(rf"{VOLUME}:\s*(-?[0-9]+(?:\.[0-9]+)?)\s*dB", log)
    return float(found[1]) if found else None


def jpeg_data_url(jpeg: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(jpeg))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of files; the content is hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def duplicates(df: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest another row has too: key, digest, copies, first_key."""
    groups = df.groupBy(digest).agg(F.count("*").alias("copies"), F.min(key).alias("first_key")).where("copies > 1")
    return df.join(groups, digest).select(key, digest, "copies", "first_key")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records (one JSON file each), the latest first."""
    return spark.read.option("multiLine", True).schema("job_id STRING, status STRING, created_at STRING, updated_at STRING, error STRING").json(path).orderBy(F.desc("created_at"), "job_id")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a calibration matrix file."""
    from ..schemas import SIGNALS

    signals = SIGNALS.replace("video_id STRING, ", "")
    struct = ",".join(f"{n}:{t}" for n, t in (x.strip().split(" ") for x in signals.split(",")))
    return spark.read.option("multiLine", True).schema(f"file STRING, title STRING, quality_label STRING, signals STRUCT<{struct}>, elapsed_seconds DOUBLE, error STRING").json(path)
