from lumaflow.streaming import jobs


def test_steps():
    assert jobs.step(None, "queued") == "queued"
    assert jobs.step("queued", "completed") == "queued"
    assert jobs.step("failed", "queued") == "queued"
    assert jobs.step("completed", "queued") == "completed"


def test_states(spark, tmp_path):
    rows = [("a", 1, "queued"), ("a", 2, "analyzing"), ("a", 3, "queued"), ("b", 1, "queued"), ("b", 2, "cancelled")]
    spark.createDataFrame(rows, "job_id string, at long, event string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, at long, event string").parquet(str(tmp_path / "in"))
    q = jobs.states(stream).writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.sql("SELECT * FROM job_states").collect():
        got[r["job_id"]] = max(got.get(r["job_id"], (0, "")), (r["n_events"], r["status"]))
    assert got == {"a": (3, "analyzing"), "b": (2, "cancelled")}


def test_live_motion(spark, tmp_path):
    rows = [("v", f"2024-01-01 00:00:0{k}", 0.1) for k in range(3)]
    spark.createDataFrame(rows, "video_id string, ts string, changed_ratio double").selectExpr("video_id", "timestamp(ts) AS ts", "changed_ratio").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, ts timestamp, changed_ratio double").parquet(str(tmp_path / "in"))
    q = jobs.live_motion(stream).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM live").first()
    assert r["samples"] == 3 and r["continuous"]
