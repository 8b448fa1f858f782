"""Data sources of reports and committed files, and frames from decoded streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumaflow.functions import decode
from lumaflow.sources import files, media


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / "out")


def put(spark, folder, rows):
    files.commit(spark.createDataFrame([(n, t.encode()) for n, t in rows], "path string, content binary").repartition(3), folder)


PROBE = "codec_type=video\nwidth=1920\nheight=1080\navg_frame_rate=0/0\nwidth=7\ncodec_type=audio\navg_frame_rate=30000/1001\nduration=12.5\n"


def test_reports(spark, folder):
    put(spark, folder, [("a.probe", PROBE), ("a.scenes", "x pts_time:3.5 y\npts_time: 1.25\n pts_time:abc"), ("a.volume", "[v] mean_volume: -23.4 dB\nmax_volume: -1 dB"), ("b.probe", "duration=4"), ("c.d.probe", "duration=1"), ("b.volume", "silent"), ("notes.txt", "x")])
    out = files.reports(spark, folder)
    assert out.schema.simpleString() == "struct<video_id:string,duration_seconds:double,width:int,height:int,fps:double,has_audio:boolean,scene_cuts:array<double>,audio_mean_volume_db:double,error:string>"
    rows = {r["video_id"]: r for r in out.collect()}
    assert rows["a"] == ("a", 12.5, 1920, 1080, 30000 / 1001, True, [1.25, 3.5], -23.4, None)
    assert rows["b"] == ("b", 4.0, None, None, None, False, None, None, None) and set(rows) == {"a", "b", "c.d"}


def test_reports_that_are_wrong(spark, folder):
    put(spark, folder, [("a.probe", "width=3"), ("b.probe", "duration=2"), ("c.probe", "duration=N/A"), ("d.scenes", "pts_time:1")])
    rows = {r["video_id"]: r["error"] for r in files.reports(spark, folder, mode="PERMISSIVE").collect()}
    assert rows["b"] is None and "duration" in rows["a"] and rows["c"] and rows["d"]
    with pytest.raises(Exception, match="probe without a duration"):
        files.reports(spark, folder).collect()


def test_small_reports_share_partitions(spark, folder):
    put(spark, folder, [(f"v{k}.probe", f"duration={k}") for k in range(40)])
    assert files.reports(spark, folder).rdd.getNumPartitions() == 1
    few = files.reports(spark, folder, maxPartitionBytes=str(10 * files.OPEN + 500))
    assert few.rdd.getNumPartitions() == 4 and few.count() == 40


def test_parsers_agree(spark):
    """The source's parsers and the column functions give the same values for random logs."""
    rng = random.Random(3)
    some = lambda: "".join(rng.choice(["pts_time:", "pts_time: ", "1.5", "22", " ", "\n", "mean_volume: ", "-7.25", " dB", "x", "n:3 "]) for _ in range(rng.randrange(30)))
    logs = [t for t in (some() for _ in range(2000)) if not any(x in t for x in ("e: d", "e:d"))]
    df = spark.createDataFrame([(t,) for t in logs], "t string")
    got = df.select("t", media.scene_cut_times(F.col("t")).alias("c")).collect()
    clean = [r for r in got if all(p[:1].isspace() or p[:1].isdigit() for p in r["t"].split("pts_time:")[1:]) and all(len(p.split()[:1]) and p.split()[0].replace(".", "", 1).isdigit() for p in r["t"].split("pts_time:")[1:])]
    assert len(clean) > 100 and all(media.parse_scenes(r["t"]) == r["c"] for r in clean)
    probe = spark.createDataFrame([(PROBE,)], "probe string")
    row = media.media_info(probe).drop("probe").first().asDict()
    assert row == media.parse_probe(PROBE)


def test_files_appear_together(spark, folder):
    rows = spark.createDataFrame([(f"x/{k}.bin", bytes([k]) * (k + 1)) for k in range(20)], "path string, content binary").repartition(4)
    files.commit(rows, folder)
    files.register(spark)
    read = spark.read.format("committed_files").load(folder)
    assert {(r["path"], bytes(r["content"])) for r in read.collect()} == {(f"x/{k}.bin", bytes([k]) * (k + 1)) for k in range(20)}
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).count() == 20
    with pytest.raises(Exception, match="written before"):
        files.commit(rows, folder)
    with pytest.raises(Exception, match="never overwritten"):
        rows.write.format("committed_files").mode("overwrite").save(folder)
    assert read.count() == 20


def test_a_failed_task_leaves_nothing(spark, folder, tmp_path):
    bad = spark.range(8).repartition(4).select(F.concat(F.col("id"), F.lit(".bin")).alias("path"), F.when(F.col("id") == 5, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        files.commit(bad, folder)
    files.register(spark)
    with pytest.raises(Exception, match="nothing was committed"):
        spark.read.format("committed_files").load(folder).collect()
    assert not [p for p in (tmp_path / "out").rglob("*.bin") if "_staged" not in str(p)]
    files.commit(spark.createDataFrame([("1.bin", b"y")], "path string, content binary"), folder)
    assert [r["content"] for r in spark.read.format("committed_files").load(folder).collect()] == [b"y"]


@pytest.mark.parametrize("name", ["", "/etc/x", "a/../../x", "_hidden", None])
def test_names_that_leave_the_folder(spark, folder, name):
    with pytest.raises(Exception, match="not a file's name"):
        files.commit(spark.createDataFrame([(name, b"")], "path string, content binary"), folder)


def test_two_rows_of_one_name(spark, folder, tmp_path):
    with pytest.raises(Exception, match="same file"):
        files.commit(spark.createDataFrame([("a", b"1"), ("a", b"2")], "path string, content binary").repartition(2), folder)
    assert not (tmp_path / "out" / files.MANIFEST).exists()


def test_no_rows(spark, folder, tmp_path):
    files.commit(spark.createDataFrame([], "path string, content binary"), folder)
    files.register(spark)
    assert spark.read.format("committed_files").load(folder).count() == 0
    assert json.loads((tmp_path / "out" / files.MANIFEST).read_text())["files"] == []


def test_frames_in_one_pass():
    raw = bytes(range(12))  # three frames of 2 x 2
    assert [(t, k, g) for t, k, h, w, g in decode.frames_at(raw + b"\x07", 2, 2, [0.5, 1.5, 9.0, 0.5, None], 240)] == [(0.5, 0, raw[:4]), (1.5, 2, raw[8:]), (9.0, 2, raw[8:])]
    # 20 seconds in ten frames: half a frame a second
    assert decode.rate_of([19.0], 10) == 0.5
    many = bytes(range(10))
    assert [k for _, k, *_ in decode.frames_at(b"".join(bytes([b] * 4) for b in many), 2, 2, [0.0, 1.0, 3.0, 19.0], 10)] == [0, 0, 2, 9]
    assert list(decode.frames_at(raw, 2, 2, [], 5)) == [] == list(decode.frames_at(raw, 2, 2, None, 5))
    for wrong in ((b"", 2, 2), (None, 2, 2), (b"abc", 2, 2), (raw, 1, 2)):
        with pytest.raises(ValueError):
            list(decode.frames_at(*wrong, [1.0], 5))


def test_pgm_images():
    image = lambda w, h, v: b"P5\n# made by hand\n%d %d\n255\n" % (w, h) + bytes([v] * (w * h))
    stream = image(3, 2, 10) + image(3, 2, 32) + image(3, 2, 35)
    assert list(decode.frames_at(stream, None, None, [0.0, 1.0, 2.0, 7.0], 240)) == [(0.0, 0, 2, 3, bytes([10] * 6)), (1.0, 1, 2, 3, bytes([32] * 6)), (2.0, 2, 2, 3, bytes([35] * 6)), (7.0, 2, 2, 3, bytes([35] * 6))]
    assert [k for _, k, *_ in decode.frames_at(stream[:-1], None, None, [2.0], 240)] == [1]
    for wrong in (b"", b"P6\n1 1\n255\nx", image(3, 2, 1) + image(2, 2, 1), b"P5\n1 1\n65535\nxx"):
        with pytest.raises(ValueError):
            list(decode.frames_at(wrong, None, None, [1.0], 5))


def test_sample_frames_in_sql(spark):
    decode.register(spark)
    df = spark.createDataFrame([("v", bytes(range(8)), 2, 2, [0.0, 1.0]), ("w", b"", 2, 2, [])], "id string, content binary, width int, height int, asked array<double>")
    df.createOrReplaceTempView("streams")
    rows = spark.sql("SELECT v.id, f.* FROM streams v, LATERAL sample_frames(v.content, v.width, v.height, v.asked, 240) f ORDER BY ts").collect()
    assert [(r["id"], r["frame_index"], bytes(r["gray"])) for r in rows] == [("v", 0, bytes(range(4))), ("v", 1, bytes(range(4, 8)))]
    sizes = spark.createDataFrame([(1080, 1920), (1920, 1080), (3, 1000), (1000, 3)], "w int, h int")
    assert [r[0] for r in sizes.select(decode.output_height(320, F.col("w"), F.col("h"))).collect()] == [570, 180, 106668, 2]
