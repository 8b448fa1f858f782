import json

import pytest
from pyspark.sql import functions as F

from lumaflow import api
from lumaflow.sources.views import timelines

SMALL = "/root/testdata/sf0.001"


def test_jobs(tmp_path):
    s = api.JobStore(tmp_path)
    j = s.create({"path": "x"})
    assert s.get(j["job_id"])["status"] == "queued" and s.get(j["job_id"])["gate"] == "not_evaluated"
    with pytest.raises(api.RequestError):
        s.retry(j["job_id"])
    s.cancel(j["job_id"])
    assert s.retry(j["job_id"])["status"] == "queued" and len(s.list()) == 1


def test_run_job(spark, tmp_path):
    s = api.JobStore(tmp_path / "jobs")
    j = s.create({})
    frames = timelines(spark, SMALL).where("video_id < 3")
    done = api.run_job(s, j["job_id"], frames, str(tmp_path / "out"))
    assert done["status"] == "completed", done["error"]
    assert spark.read.parquet(f"{done['products']}/signals").count() == frames.select("video_id").distinct().count()


def test_limits(spark):
    with pytest.raises(api.RequestError):
        api.within("target_seconds", 61)
    with pytest.raises(api.RequestError):
        api.exclusive(a=None, b=None)
    assert api.exclusive(a=1, b=None) == "a"
    with pytest.raises(Exception, match="too many windows"):
        api.per_video(spark.range(40).select(F.lit("v").alias("video_id"), "id"), "windows").collect()


def test_compare(spark):
    prints = spark.createDataFrame([("a", k) for k in range(4)] + [("b", k) for k in range(4)] + [("c", -1 - k) for k in range(4)], "video_id string, hash long")
    refs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "video_id string, reference_id string")
    got = {r["video_id"]: (r["similarity"], r["verdict"]) for r in api.compare(prints, refs, prints).collect()}
    assert got["a"] == (1.0, "block") and got["c"][1] == "pass"


def test_review_and_json(spark):
    frames = timelines(spark, SMALL).where("video_id < 3")
    signals, candidates = api.compute_signals(frames)
    _, referrals = api.evaluate_profiles(signals)
    answers = api.review_windows(candidates, referrals, lambda row: json.dumps({"verdict": "keep", "rank": row["rank"]})).collect()
    assert all(json.loads(r["answer"])["verdict"] == "keep" and r["rank"] <= 3 for r in answers)
    assert json.loads(api.as_json(signals, "signals").first()["json"])["schema_version"] == "signals-1.0"
    assert api.capabilities(spark)["decode"] is False
    assert api.profiles(spark).count() == 4 and api.platform_tables(spark)["specs"].count() == 7
