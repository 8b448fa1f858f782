"""Media tables made of the star-schema tables: one-pixel timelines of events, 8 x 8 frames of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, t, lum): a user's events in order, a frame a second."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("video_id"), t.cast("long").alias("t"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("lum"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, t, px): a label's embeddings in order, each an 8 x 8 frame."""
    e = table(spark, sf_dir, "embeddings")
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("video_id"), t.cast("long").alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("px"))


def gray_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, t, height, width, gray): the same frames as 8-bit pixels, row by row."""
    level = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround((x + 0.5) * 255, 0))).cast("int")
    gray = F.unhex(F.array_join(F.transform("px", lambda x: F.lpad(F.hex(level(x)), 2, "0")), ""))
    return pictures(spark, sf_dir).select("video_id", "t", F.lit(8).alias("height"), F.lit(8).alias("width"), gray.alias("gray"))


def durations(frames: DataFrame) -> DataFrame:
    """(video_id, n): frames of a video, which are its seconds."""
    return frames.groupBy("video_id").agg(F.count("*").alias("n"))
