"""Average hashes of frames, static overlays, and duplicate verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hamming_likeness

#: Side of the hash grid, and the overlay's thresholds.
GRID, VARIANCE, CORNER, DARK, ROW_SHARE = 8, 0.002, 0.25, 0.08, 0.9
#: Fixed value: most frames of a video that are compared.
FRAMES = 64


def average_hash(cells: Column) -> Column:
    """Bit i is set where cell i is above the mean of the 64 cells; cell 0 is the lowest bit."""
    mean = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)
    marked = F.transform(F.array(mean), lambda m: F.transform(cells, lambda x, i: F.when(x > m, 1).otherwise(0)))[0]
    # the binary digits, highest cell first, read as an unsigned number and kept as the signed one with the same bits
    digits = F.array_join(F.reverse(F.transform(marked, lambda b: b.cast("string"))), "")
    high, low = F.conv(F.substring(digits, 1, 32), 2, 10).cast("long"), F.conv(F.substring(digits, 33, 32), 2, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def block_means(gray: Column, height: Column, width: Column) -> Column:
    """8 x 8 block means of 8-bit frames, row by row, as shares of 255."""

    @F.pandas_udf("array<double>")
    def of(gray: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for g, h, w in zip(gray, height, width):
            a = np.frombuffer(g, np.uint8).reshape(h, w) / 255.0
            rows, cols = (np.linspace(0, n, GRID + 1, dtype=int) for n in (h, w))
            out.append([float(c.mean()) if (c := a[r0:r1, c0:c1]).size else 0.0 for r0, r1 in zip(rows, rows[1:]) for c0, c1 in zip(cols, cols[1:])])
        return pd.Series(out)

    return of(gray, height, width)


def similarity(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b, similarity): for pairs of videos, the lower of the two means of each frame's best match in the other.

    ``prints`` is (video_id, hash). Frames meet only within a given pair; a video has at most FRAMES of them, which the
    sampler gives, more are an error. The pairs are given (references, or videos that share near hashes), never all. A
    video without frames has likeness 0.
    """
    left, right = prints.select(F.col("video_id").alias("a"), F.col("hash").alias("x")), prints.select(F.col("video_id").alias("b"), F.col("hash").alias("y"))
    hashes = lambda d, k, h, n: d.groupBy(k).agg(F.when(F.count("*") > FRAMES, F.raise_error(F.lit("more frames than are compared")).cast("array<long>")).otherwise(F.collect_list(h)).alias(n))
    p = pairs.join(hashes(left, "a", "x", "xs"), "a", "left").join(hashes(right, "b", "y", "ys"), "b", "left")
    def best(of: Column, among: Column) -> Column:
        return F.aggregate(F.transform(of, lambda h: F.array_max(F.transform(among, lambda o: hamming_likeness(h, o)))), F.lit(0.0), lambda s, x: s + x) / F.size(of)
    both = F.least(best(F.col("xs"), F.col("ys")), best(F.col("ys"), F.col("xs")))
    return p.select("a", "b", F.coalesce(F.round(F.when((F.size("xs") > 0) & (F.size("ys") > 0), both), 6), F.lit(0.0)).alias("similarity"))


def near_hashes(prints: DataFrame, most: int = 7) -> DataFrame:
    """(hash, other): different hashes at a Hamming distance of at most ``most`` (7 or less), found by equal bytes.

    Of 64 bits in eight bytes, seven differences leave one byte equal, so hashes meet on (byte place, byte) only. Equal
    hashes are one row: the videos of a hash are the rows of ``prints`` that have it, and aren't listed in pairs, so a
    frame that all videos share (a black one) costs one hash. The bytes' groups grow with distinct hashes.
    """
    distinct = prints.select("hash").distinct()
    chunks = distinct.select("hash", F.posexplode(F.array(*[F.shiftright("hash", 8 * i).bitwiseAND(255) for i in range(8)])).alias("i", "byte"))
    other = chunks.select(F.col("hash").alias("other"), "i", "byte")
    return chunks.join(other, ["i", "byte"]).where((F.col("hash") < F.col("other")) & (F.bit_count(F.col("hash").bitwiseXOR(F.col("other"))) <= most)).select("hash", "other").distinct()


def static_overlay(frames: DataFrame, width: int = GRID, height: int = GRID) -> DataFrame:
    """(video_id, static ratio, four corner ratios, black bar ratio) of frames (video_id, px) of one size.

    A pixel is static where its population variance over time is below VARIANCE. Rows of dark static pixels in the
    upper and lower corner height are bars.
    """
    px = frames.select("video_id", F.posexplode("px").alias("i", "v"))
    p = px.groupBy("video_id", "i").agg((F.var_pop("v") < VARIANCE).alias("static"), (F.avg("v") < DARK).alias("dark"))
    row, col = F.floor(F.col("i") / width), F.pmod("i", F.lit(width))
    ch, cw = max(1, int(height * CORNER)), max(1, int(width * CORNER))
    top, bottom, left, right = row < ch, row >= height - ch, col < cw, col >= width - cw
    share = lambda at: F.round(F.avg(F.when(at, F.col("static").cast("double"))), 6)
    corners = p.groupBy("video_id").agg(F.round(F.avg(F.col("static").cast("double")), 6).alias("static_pixel_ratio"), share(top & left).alias("top_left"), share(top & right).alias("top_right"), share(bottom & left).alias("bottom_left"), share(bottom & right).alias("bottom_right"))
    rows = p.withColumn("row", row).groupBy("video_id", "row").agg(F.avg((F.col("static") & F.col("dark")).cast("double")).alias("share"))
    bar = F.col("share") > ROW_SHARE
    bars = rows.groupBy("video_id").agg(F.round((F.count_if(bar & (F.col("row") < ch)) + F.count_if(bar & (F.col("row") >= height - ch))) / height, 6).alias("black_bar_ratio"))
    return corners.join(bars, "video_id")


def verdict(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Adds verdict and flags from similarity (null: not compared), the four corners and black_bar_ratio (null: not measured)."""
    sim, corner, bars = F.col("similarity"), F.greatest("top_left", "top_right", "bottom_left", "bottom_right"), F.col("black_bar_ratio")
    block, high = sim >= thresholds["similarity_block"], sim >= thresholds["similarity_review"]
    mark, dark = corner >= thresholds["corner_static_watermark"], bars >= thresholds["black_bar_ratio_review"]
    flags = F.array_compact(F.array(F.when(block, F.lit("near_duplicate")).when(high, F.lit("high_similarity")), F.when(mark, F.lit("suspected_watermark_residual")), F.when(dark, F.lit("suspected_black_bars"))))
    return df.withColumn("verdict", F.when(block, "block").when(high | mark | dark, "review").otherwise("pass")).withColumn("flags", flags)
