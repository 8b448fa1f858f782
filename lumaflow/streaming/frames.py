"""Live streams of frames and uploads, with state by event time: what a batch job gives for the same rows, once the watermark has passed.

State is kept in RocksDB (``stateful`` sets it). Rows wait until the watermark says that nothing earlier can come, so the
results don't depend on how the rows were dealt to batches. Rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..conf import EngineConf
from ..operators.motion import gray_change

#: Fixed value: seconds of a live window.
LENGTH = 3
_FRAME = "height int, width int, gray binary, lum double"
#: Second at which media time 0 stands: the watermark begins at the epoch, and rows that aren't after it are late.
BASE = 86_400


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def media_time(seconds: Column) -> Column:
    """The timestamp of a second of media time; ``live_windows`` gives its starts in media time again."""
    return F.timestamp_seconds(seconds + BASE)


def step(before: tuple, now: tuple, threshold: float) -> tuple[float, float, float]:
    """Mean change, changed ratio and luminance change of two frames (height, width, gray, lum): of their 8-bit pixels, or of the one number they are."""
    if now[2] is None:
        d = abs(now[3] - before[3])
        return d, d, d
    if before[:2] != now[:2]:
        raise ValueError(f"frames differ in shape: {before[:2]}, {now[:2]}")
    return gray_change(before[2], now[2], threshold)


#: Rows of one entry of a list of waiting rows: a key's rows of a batch go to its state in few calls, not one for each row.
CHUNK = 256
_COLUMNS = {"video": str, "at": int, "height": int, "width": int, "gray": bytes, "lum": float}
#: Keys that share the videos whose frames are numbers.
SHARES = 1024


def _held(state) -> list[tuple]:
    """The rows of a list state whose entries are chunks of columns, in the order they came."""
    return [row for chunk in state.get() for row in zip(*chunk)]


def _hold(state, rows: list[tuple], anew: bool = False) -> None:
    """Appends rows to such a list, or has it hold them alone."""
    chunks = [tuple(map(list, zip(*rows[k : k + CHUNK]))) for k in range(0, len(rows), CHUNK)]
    if anew:
        state.clear()
    for chunk in chunks:
        state.appendValue(chunk)


class Pairs(StatefulProcessor):
    """Frames of some videos wait for the watermark; the last one of each video stays. Each frame that the watermark has
    passed meets the one before it. Of a video's frames of one time the last to come counts."""

    def __init__(self, conf: EngineConf):
        self.conf = conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "video array<string>, at array<long>, height array<int>, width array<int>, gray array<binary>, lum array<double>")
        self.last = handle.getMapState("last", "video string", _FRAME)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            columns = [[None if x is None or x != x else k(x) for x in pdf[c].tolist()] for c, k in _COLUMNS.items()]
            _hold(self.waiting, list(zip(*columns)))
            first = min(columns[1] if first is None else [first, *columns[1]], default=first)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due, stay, out = 1000 * timerValues.getCurrentWatermarkInMs(), {}, [], []
        for (video, at), frame in {(video, at): frame for video, at, *frame in _held(self.waiting)}.items():
            if at < now:
                due.setdefault(video, []).append((at, frame))
            else:
                stay.append((video, at, *frame))
        if not due:
            return
        _hold(self.waiting, stay, anew=True)
        if stay:
            self.handle.registerTimer(min(r[1] for r in stay) // 1000 + 1)
        for video, frames in due.items():
            last = self.last.getValue((video,))
            for at, frame in sorted(frames, key=itemgetter(0)):
                if last is not None:
                    out.append((video, at, *step(tuple(last), tuple(frame), self.conf.changed_pixel_threshold)))
                last = frame
            self.last.updateValue((video,), tuple(last))
        if out:
            yield pd.DataFrame(out, columns=["video", "at", "mean_diff", "changed_ratio", "lum_diff"])

    def close(self) -> None:
        pass


def _framed(frames: DataFrame) -> DataFrame:
    """(video_id, ts, height, width, gray, lum): what a stream lacks is null."""
    kinds = {"height": "int", "width": "int", "gray": "binary", "lum": "double"}
    return frames.select("video_id", "ts", *[(F.col(c) if c in frames.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _steps(windows: DataFrame, gray: bool, conf: EngineConf) -> DataFrame:
    """Adds _d to windows with their frames ``f`` in order: an array of the changes of each against the one before it."""
    if not gray:
        before, now = F.slice("f", 1, F.size("f") - 1), F.slice("f", 2, F.size("f") - 1)
        change = F.transform(F.arrays_zip(before.alias("a"), now.alias("b")), lambda p: F.abs(p["b"]["lum"] - p["a"]["lum"]))
        return windows.withColumn("_d", F.transform(F.filter(change, lambda d: d.isNotNull()), lambda d: F.struct(d.alias("mean"), d.alias("ratio"), d.alias("light"))))

    @F.arrow_udf("array<struct<mean: double, ratio: double, light: double>>")
    def of(batch: pa.Array) -> pa.Array:
        names = ("mean", "ratio", "light")
        out = []
        for window in batch:
            known = [tuple(f[c] for c in ("height", "width", "gray", "lum")) for f in window.as_py()]
            out.append([dict(zip(names, step(a, b, conf.changed_pixel_threshold))) for a, b in zip(known, known[1:])])
        return pa.array(out, pa.list_(pa.struct([(c, pa.float64()) for c in names])))

    return windows.withColumn("_d", of("f"))


def live_windows(frames: DataFrame, late: str = "10 seconds", conf: EngineConf = EngineConf()) -> DataFrame:
    """Stream of window summaries with their pattern from a stream of frames (video_id, ts, and gray with height and width, or lum).

    Windows of three seconds of ``ts`` (see ``media_time``), each emitted once when the watermark passes its end: a
    grouping by video and window, whose frames are gathered, put in order and summed up. A frame counts as long as its
    window is open. Of frames of one time the last to come counts. A video's windows are keys of their own, so one long
    video is spread over all tasks.
    """
    stateful(frames.sparkSession)
    f = _framed(frames).where("ts IS NOT NULL").withWatermark("ts", late)
    f = f.groupBy("video_id", F.window("ts", f"{LENGTH} seconds").alias("w")).agg(F.collect_list(F.struct("ts", "height", "width", "gray", "lum")).alias("f"))
    f = f.select("video_id", (F.unix_micros("w.start") / 1_000_000 - BASE).alias("start"), F.array_sort(F.transform("f", lambda x, k: F.struct(x["ts"].alias("ts"), k.alias("k"), x["height"].alias("height"), x["width"].alias("width"), x["gray"].alias("gray"), x["lum"].alias("lum")))).alias("f"))
    f = f.withColumn("f", F.filter("f", lambda x, k: (k + 1 == F.size("f")) | (x["ts"] != F.get("f", k + 1)["ts"])))
    s = _steps(f, "gray" in frames.columns, conf)
    ratio, count = F.transform("_d", lambda d: d["ratio"]), F.size("_d")
    active = F.size(F.filter(ratio, lambda x: x >= conf.active_changed_pixel_ratio))
    mean = lambda c: F.when(count > 0, F.aggregate(F.transform("_d", lambda d: d[c]), F.lit(0.0), lambda a, x: a + x) / count)
    spike = F.when(count > 0, F.size(F.filter("_d", lambda d: d["light"] >= conf.luminance_spike_threshold)) / count)
    abrupt = F.exists("_d", lambda d: (d["ratio"] >= conf.abrupt_changed_pixel_ratio) & (d["mean"] >= conf.abrupt_mean_absolute_difference))
    pattern = F.when(count < 1, F.lit(None)).when(abrupt, "abrupt").when(active == count, "continuous").when(active > 0, "intermittent").otherwise("stable")
    return s.select(
        "video_id", "start", F.size("f").cast("long").alias("samples"), count.cast("long").alias("pairs"), active.cast("long").alias("active_pairs"),
        mean("ratio").alias("mean_ratio"), F.array_max(ratio).alias("peak_ratio"), mean("mean").alias("mean_difference"), spike.alias("spike"),
        pattern.alias("pattern"), F.when(count > 0, "completed").otherwise("insufficient_data").alias("status"),
    )


def live_pairs(frames: DataFrame, late: str = "10 seconds", conf: EngineConf = EngineConf()) -> DataFrame:
    """Stream of (video_id, ts, mean_diff, changed_ratio, lum_diff) of each frame against the one before it, in order and across batches.

    Videos whose frames are pictures are keys of their own; those whose frames are numbers share SHARES keys by their hash,
    as a key of its own would cost more than its rows."""
    stateful(frames.sparkSession)
    f = _framed(frames).where("ts IS NOT NULL").withWatermark("ts", late)
    kind, video = dict(f.dtypes)["video_id"], F.col("video_id").cast("string")
    f = f.select(video.alias("video"), "ts", F.unix_micros("ts").alias("at"), "height", "width", "gray", "lum", (video if "gray" in frames.columns else F.pmod(F.xxhash64("video_id"), F.lit(SHARES))).alias("share"))
    p = f.groupBy("share").transformWithStateInPandas(Pairs(conf), "video string, at long, mean_diff double, changed_ratio double, lum_diff double", "Append", "EventTime")
    return p.select(F.col("video").cast(kind).alias("video_id"), F.timestamp_micros("at").alias("ts"), "mean_diff", "changed_ratio", "lum_diff")


#: Pairs of a hash's bytes: two hashes that differ in at most BITS bits agree in two bytes at least.
BITS, DAYS = 6, 90
BYTES = list(combinations(range(8), 2))


def _agreeing(a: int, b: int) -> int:
    """The first of BYTES in which two hashes agree, or -1."""
    x = (a ^ b) & (1 << 64) - 1
    same = [i for i in range(8) if not x >> (8 * i) & 255]
    return BYTES.index((same[0], same[1])) if len(same) > 1 else -1


class Stock(StatefulProcessor):
    """Hashes that share a byte at one place: of each the last upload, for so many days after it. They are compared where
    they share a second byte further on."""

    def __init__(self, days: int, bits: int):
        self.span, self.bits = days * 86_400_000_000, bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        chunk = "at array<long>, id array<string>, hash array<long>"
        self.waiting, self.stock = handle.getListState("waiting", chunk), handle.getListState("stock", chunk)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            columns = [pdf[c].tolist() for c in ("at", "upload_id", "hash")]
            _hold(self.waiting, list(zip(*columns)))
            first = min(columns[0] if first is None else [first, *columns[0]], default=first)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, place, out = 1000 * timerValues.getCurrentWatermarkInMs(), int(key[0]), []
        rows = sorted((at, upload, h) for (at, upload), h in {(at, upload): h for at, upload, h in _held(self.waiting)}.items())
        due = [r for r in rows if r[0] < now]
        if due:
            _hold(self.waiting, rows[len(due) :], anew=True)
        if len(due) < len(rows):
            self.handle.registerTimer(rows[len(due)][0] // 1000 + 1)
        # all hashes, and those that share a second byte, each in the order of their last uploads
        known, sharing = {}, {}

        def put(h: int, entry: tuple[int, str]) -> None:
            for shelf in (known, *(sharing.setdefault((j, h >> 8 * j & 255), {}) for j in range(place + 1, 8))):
                shelf.pop(h, None)
                shelf[h] = entry

        for at, upload, h in _held(self.stock):
            put(h, (at, upload))
        for at, upload, h in due:
            for j in range(place + 1, 8):
                shelf = sharing.get((j, h >> 8 * j & 255), {})
                while shelf and at - shelf[first := next(iter(shelf))][0] > self.span:
                    del shelf[first]
                for other, (then, earlier) in shelf.items():
                    apart = ((h ^ other) & (1 << 64) - 1).bit_count()
                    if apart <= self.bits and BYTES[_agreeing(h, other)] == (place, j):
                        out.append((upload, at, earlier, then, apart))
            put(h, (at, upload))
        stay = [(at, upload, h) for h, (at, upload) in known.items() if at + self.span >= now]
        if due or len(stay) < len(known):
            _hold(self.stock, stay, anew=True)
        if stay:
            self.handle.registerTimer((stay[0][0] + self.span) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["upload_id", "at", "earlier_id", "earlier_at", "bits"])

    def close(self) -> None:
        pass


def near_repeats(uploads: DataFrame, days: int = DAYS, bits: int = BITS, late: str = "1 day") -> DataFrame:
    """Stream of (upload_id, ts, earlier_id, earlier_ts, bits): uploads (upload_id, ts, hash) that a stock of the last ``days`` has nearly.

    An upload is linked with the last earlier upload of each hash that differs from its own in at most ``bits`` of 64,
    if that was ``days`` ago or less; ties in time go by id. Hashes are found by each two of their eight bytes, of which
    near ones share two: a key is the first of two places and its byte, seven keys an upload, and hashes of a key are
    compared where they share a second byte, one in 65,536; a pair is told by the first two places that it shares. Copies
    of one hash are one entry of the stock, so a group of copies gives a link for each member, not for each pair. An
    entry goes when the watermark is ``days`` past its last upload. Rows without a time, id or hash are left out.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"at most {BITS} bits can be found by two bytes")
    stateful(uploads.sparkSession)
    u = uploads.select(F.col("upload_id").cast("string").alias("upload_id"), "ts", F.col("hash").cast("long").alias("hash")).dropna().withWatermark("ts", late)
    keys = F.array(*[F.struct(F.lit(i).alias("place"), F.shiftrightunsigned("hash", 8 * i).bitwiseAND(255).cast("int").alias("value")) for i in range(7)])
    u = u.withColumn("k", F.explode(keys)).select("upload_id", "ts", F.unix_micros("ts").alias("at"), "hash", "k.place", "k.value")
    out = u.groupBy("place", "value").transformWithStateInPandas(Stock(days, bits), "upload_id string, at long, earlier_id string, earlier_at long, bits int", "Append", "EventTime")
    return out.select("upload_id", F.timestamp_micros("at").alias("ts"), "earlier_id", F.timestamp_micros("earlier_at").alias("earlier_ts"), "bits")


def replayed(rows: DataFrame, stream, folder: str, far: str = "2100-01-01") -> DataFrame:
    """What ``stream`` (a function of a streaming table) emits for the rows of a table with a ``ts``, all of them past the watermark.

    The rows go to files below ``folder`` and are read as a stream that ends when all were read; one row of the far future,
    null but for its ``ts``, its first column and a hash, moves the watermark past all others.
    """
    spark = rows.sparkSession
    names = rows.columns
    key = next(f for f in rows.schema.fields if f.name != "ts")
    last = spark.range(1).select(*[F.to_timestamp(F.lit(far)).alias(n) if n == "ts" else (F.lit(0) if n == key.name else F.lit(0) if n == "hash" else F.lit(None)).cast(rows.schema[n].dataType).alias(n) for n in names])
    rows.union(last).write.parquet(f"{folder}/in")
    out = stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
