"""Streams of frames and uploads against batch results and brute force, with rows shuffled into batches."""

import random
import types
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaflow.conf import EngineConf
from lumaflow.operators import motion
from lumaflow.sources.views import gray_frames, timelines
from lumaflow.streaming import frames as live

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def in_batches(spark, tmp_path, df, stream, n=4, seed=1, last=None):
    """Feeds the rows of df in n batches, shuffled, then one row (or the one given) far in the future."""
    df = spark.createDataFrame(df.rdd, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])) if any(not f.nullable for f in df.schema.fields) else df
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    src, out = str(tmp_path / "in"), None
    for k in range(n):
        spark.createDataFrame(rows[k::n] or rows[:0], df.schema).coalesce(1).write.mode("append").parquet(src)
        out = out or stream(spark.readStream.schema(df.schema).parquet(src))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    spark.createDataFrame([tuple(datetime(2100, 1, 1) if f.name == "ts" else 0 if f.name in ("video_id", "upload_id", "hash") else None for f in df.schema.fields)], df.schema).coalesce(1).write.mode("append").parquet(src)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def close(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9 for x, y in zip(a, b)) and len(a) == len(b)


COLUMNS = ["video_id", "start", "samples", "pairs", "active_pairs", "mean_ratio", "peak_ratio", "mean_difference", "spike", "pattern", "status"]


@pytest.mark.parametrize("gray", [False, True])
def test_windows_are_those_of_the_batch(spark, tmp_path, gray):
    f = gray_frames(spark, SMALL).where("t < 12") if gray else timelines(spark, SMALL).where("video_id % 4 = 0")
    f = f.where("video_id < 30").cache()
    want = motion.motion_windows(f, motion.tumbling(f)).select(*COLUMNS).collect()
    stream = f.withColumn("ts", live.media_time(F.col("t"))).drop("t")  # fed in three batches
    got = in_batches(spark, tmp_path, stream, lambda s: live.live_windows(s, "10 years"), n=3).select(*COLUMNS).collect()
    order = lambda r: (r["video_id"], r["start"])
    assert len(want) > 20 and len(got) == len(want)
    assert [(a, b) for a, b in zip(map(tuple, sorted(got, key=order)), map(tuple, sorted(want, key=order))) if not close(a, b)] == []


def test_pairs_go_over_batches(spark, tmp_path):
    f = timelines(spark, SMALL).where("video_id < 8").cache()
    want = motion.with_steps(f, Window.partitionBy("video_id").orderBy("t")).where("mean_diff IS NOT NULL").select("video_id", live.media_time(F.col("t")).alias("ts"), "mean_diff").collect()
    got = in_batches(spark, tmp_path, f.withColumn("ts", live.media_time(F.col("t"))).drop("t"), lambda s: live.live_pairs(s, "10 years"), n=3).select("video_id", "ts", "mean_diff").collect()
    assert len(want) > 10 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_frames_are_dropped(spark, tmp_path):
    """A frame behind the watermark changes no window; one within the delay is put in its place."""
    put = lambda rows: spark.createDataFrame([(1, START + timedelta(seconds=s), v) for s, v in rows], "video_id long, ts timestamp, lum double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = live.live_windows(spark.readStream.schema("video_id long, ts timestamp, lum double").parquet(str(tmp_path / "in")) if put([(0, 0.0), (2, 0.5)]) is None else None, "5 seconds")
    for rows in ([(1, 0.0), (20, 0.1)], [(1.5, 0.9), (21, 0.1)], [(100, 0.0)]):
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        put(rows)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    first = [r for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect() if r["start"] == START.timestamp() - live.BASE or r["samples"] == 3]
    assert len(first) == 1 and (first[0]["samples"], first[0]["active_pairs"], first[0]["pattern"]) == (3, 1, "intermittent")


def brute(rows, days, bits):
    """(upload, earlier, bits) by comparing each with all before it: the last of each near hash."""
    out, seen = [], {}
    for ts, i, h in sorted(rows):
        for other, (then, earlier) in seen.items():
            apart = ((h ^ other) & (1 << 64) - 1).bit_count()
            if apart <= bits and ts - then <= timedelta(days=days):
                out.append((i, earlier, apart))
        seen[h] = ts, i
    return sorted(out)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("n", [2])
def test_repeats_within_ninety_days(spark, tmp_path, n):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for k in range(40):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 0, 1, 5, 6, 7, 9])):
            h ^= 1 << b
        rows.append((START + timedelta(days=rng.randrange(300), hours=rng.randrange(24)), f"u{k:02d}", signed(h)))
    h = signed(rng.getrandbits(64))
    # near copies on both sides of the limit, and exactly at it
    rows += [(START, "a", h), (START + timedelta(days=90), "b", h ^ 63), (START + timedelta(days=180, microseconds=1), "c", h ^ 63), (START + timedelta(days=180), "d", h ^ 127)]
    df = spark.createDataFrame(rows, "ts timestamp, upload_id string, hash long")
    got = in_batches(spark, tmp_path, df, lambda s: live.near_repeats(s, late="1000 days"), n=n)
    want = brute(rows, 90, 6)
    assert ("b", "a", 6) in want and not any(x == "c" and y == "b" for x, y, _ in want) and len(want) > 20
    assert sorted((r["upload_id"], r["earlier_id"], r["bits"]) for r in got.collect()) == want


def test_two_bytes_always_agree():
    rng = random.Random(9)
    for _ in range(500):
        a, b = rng.getrandbits(64), 0
        b = a
        for k in rng.sample(range(64), 6):
            b ^= 1 << k
        i, j = live.BYTES[live._agreeing(a, b)]
        assert (a ^ b) >> 8 * i & 255 == 0 == (a ^ b) >> 8 * j & 255
    assert live._agreeing(0, (1 << 64) - 1) == -1
    with pytest.raises(ValueError):
        live.near_repeats(None, bits=7)


def test_windows_keep_no_state_in_python(spark, tmp_path):
    """A call of Python for each window and row was what took the time (F1); of frames of one time the last counts."""
    put = lambda rows: spark.createDataFrame([(1, START + timedelta(seconds=s), v) for s, v in rows], "video_id long, ts timestamp, lum double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(0, 0.0), (1, 0.5)])
    s = live.live_windows(spark.readStream.schema("video_id long, ts timestamp, lum double").parquet(str(tmp_path / "in")), "5 seconds")
    assert "TransformWithState" not in s._jdf.queryExecution().analyzed().toString()
    for rows in ([(1, 0.25)], [(100, 0.0)], None):
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        if rows:
            put(rows)
    got = spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect()
    assert [(r["samples"], r["pairs"], r["peak_ratio"]) for r in got] == [(2, 1, 0.25)]


class Counted:
    """A list or map of state that counts its calls."""

    def __init__(self):
        self.calls, self.rows, self.map = 0, [], {}

    def __getattr__(self, name):
        done = {
            "appendValue": self.rows.append, "clear": self.rows.clear, "get": lambda: iter([*self.rows]), "exists": lambda: bool(self.rows), "update": lambda v: self.rows.__setitem__(slice(None), [v]),
            "updateValue": self.map.__setitem__, "getValue": self.map.get, "removeKey": self.map.pop, "iterator": lambda: iter([*self.map.items()]),
        }[name]

        def call(*a):
            self.calls += 1
            return done(*a)

        return call


class Handle:
    def __init__(self):
        self.states, self.timers = [], []

    def registerTimer(self, at):
        self.timers.append(at)

    def __getattr__(self, name):
        return lambda *_: self.states.append(Counted()) or self.states[-1]


def through(processor, key, *batches):
    """What a processor gives for batches of rows, and how many calls it makes."""
    handle, out = Handle(), []
    processor.init(handle)
    for pdf in batches:
        list(processor.handleInputRows(key, iter([pdf]), None))
        out += [r for df in processor.handleExpiredTimer(key, types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**12), None) for r in df.itertuples(index=False)]
    return out, len(handle.timers) + sum(s.calls for s in handle.states)


def test_pairs_make_few_calls_for_many_rows():
    """One call for each row was what took the time (F4)."""
    n, half = 4000, 2000
    pdf = pd.DataFrame({"video": "1", "at": range(n), "ts": [pd.Timestamp(i, unit="us") for i in range(n)], "height": None, "width": None, "gray": None, "lum": [i * i % 97 / 97 for i in range(n)]}, dtype=object)
    pdf["at"] = pdf["at"].astype("int64")
    out, calls = through(live.Pairs(EngineConf()), ("1",), pdf[:half].sample(frac=1, random_state=1), pdf[half:].sample(frac=1, random_state=1))
    assert [r[2] for r in out] == [abs(b - a) for a, b in zip(pdf["lum"], pdf["lum"][1:])] and calls < 100


def test_repeats_make_few_calls_for_many_rows():
    """Some calls for each of 28 rows of an upload were what took the time (F5)."""
    n, day = 4000, 86_400_000_000
    rng = random.Random(3)
    hashes = [rng.getrandbits(40) << 8 | (rng.randrange(3)) << 8 for _ in range(n)]
    pdf = pd.DataFrame({"upload_id": [f"u{i:05d}" for i in range(n)], "at": [i * day for i in range(n)], "ts": [pd.Timestamp(i * day, unit="us") for i in range(n)], "hash": hashes})
    out, calls = through(live.Stock(90, 6), (0, 0), pdf[:2000], pdf[2000:])
    want = [r for r in brute([(START + timedelta(days=i), f"u{i:05d}", h) for i, h in enumerate(hashes)], 90, 6)]
    own = [w for w in want if 0 in live.BYTES[live._agreeing(hashes[int(w[0][1:])], hashes[int(w[1][1:])])]]
    assert sorted((r[0], r[2], r[4]) for r in out) == own and calls < 150
