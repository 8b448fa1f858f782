"""Embedding providers, and closed-set answers that don't depend on where vectors come from."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from lumaflow import api
from lumaflow.conf import EngineConf
from lumaflow.functions import providers, scalars


def test_fake_is_the_column_function(spark):
    df = spark.createDataFrame([("a",), ("déjà vu",), (None,), ("",)], "t string")
    rows = df.select(providers.text_vectors(F.col("t"), "fake").alias("x"), scalars.fake_embedding(F.concat(F.lit("text:"), F.col("t"))).alias("y")).collect()
    assert all(rows[k]["x"] == rows[k]["y"] for k in (0, 1, 3)) and rows[2]["x"] is None
    image = df.select(providers.image_vectors(F.concat(F.lit("/x/"), F.col("t")), None, "fake:8").alias("x")).collect()
    assert len(image[0]["x"]) == 8 and image[2]["x"] is None


def test_vectors_from_a_file(spark, tmp_path):
    at = str(tmp_path / "v")
    spark.createDataFrame([("a", [1.0, 0.0]), ("b.jpg", [0.0, 1.0])], "key string, vector array<double>").write.parquet(at)
    df = spark.createDataFrame([("a", "x/b.jpg", b"..")], "t string, n string, c binary")
    assert tuple(df.select(providers.text_vectors(F.col("t"), f"file:{at}"), providers.image_vectors(F.col("n"), F.col("c"), f"file:{at}")).first()) == ([1.0, 0.0], [0.0, 1.0])
    with pytest.raises(Exception, match="no vector for 'x'"):
        df.select(providers.text_vectors(F.lit("x"), f"file:{at}")).collect()
    with pytest.raises(ValueError, match="unknown embedding provider"):
        providers.provider("nobody")


def test_a_provider_of_ones_own(monkeypatch):
    made = []

    class Own:
        def __init__(self, argument):
            made.append(argument)

        def texts(self, texts):
            return [[float(len(t))] for t in texts][: len(texts) - ("short" in texts)]

    module = types.ModuleType("own_provider")
    module.Own = Own
    monkeypatch.setitem(sys.modules, "own_provider", module)
    p = providers.provider("own_provider.Own:folder:x")
    assert providers.provider("own_provider.Own:folder:x") is p and made == ["folder:x"]
    assert providers._placed([True, False], lambda: p.texts(["ab"])).to_pylist() == [[2.0], None]
    with pytest.raises(ValueError, match="one vector for each input"):
        providers._placed([True, True], lambda: p.texts(["short", "x"]))


def test_requests_by_the_setting(spark):
    conf = EngineConf(embedding_provider="fake:32")
    frames = api.embed_frames(spark.createDataFrame([(1, "a/night.jpg"), (1, "b.jpg"), (2, "c.jpg")], "item_id int, name string"), conf)
    catalog = api.embed_catalog(spark, {"mood": {"x": "one", "y": "two"}}, conf)
    assert {len(r["v"]) for r in catalog.collect()} == {32}
    rows = api.analyze_visual(frames, catalog).collect()
    assert {r["item_id"] for r in rows} == {1, 2} and len(rows) == 2 * catalog.select("question").distinct().count()


def test_frames_of_an_item_give_their_best(spark):
    catalog = spark.createDataFrame([("q", "a", [1.0, 0.0]), ("q", "b", [0.0, 1.0]), ("r", "c", [1.0, 0.0]), ("r", "d", [1.0, 0.0])], "question string, value string, v array<double>")
    frames = spark.createDataFrame([(1, [0.6, 0.8]), (1, [1.0, 0.2]), (2, [0.0, 2.0]), (3, None), (4, [1.0])], "item_id int, v array<double>")
    rows = {(r["item_id"], r["question"]): r for r in api.analyze_visual(frames, catalog).collect()}
    assert rows[1, "q"]["answer"] == "a" and rows[2, "q"]["answer"] == "b" and rows[2, "q"]["margin"] == 1.0
    assert rows[1, "r"]["status"] == "abstained" and rows[1, "r"]["top_value"] == "c" and rows[1, "r"]["margin"] == 0
    assert all(rows[k, "q"]["answer"] is None and rows[k, "q"]["top_score"] is None for k in (3, 4)) and len(rows) == 8
    with pytest.raises(Exception, match="zero vector"):
        api.analyze_visual(spark.createDataFrame([(1, [0.0, 0.0])], "item_id int, v array<double>"), catalog).collect()


def test_responses(spark):
    from lumaflow.schemas import SHOTS

    rows = [("v", k, 2.0 * k, 2.0 * k + 1.9, 1.9, 3, 0.05 if k % 2 else 0.5, 0.5, 0.3, 0.3) for k in range(30)]
    shots = spark.createDataFrame(rows, SHOTS)
    r = api.narrative_response(shots, "hook_first", target=6.0).first()
    assert len(r["matches"]) == 64 and r["matches"][0]["score"] == max(m["score"] for m in r["matches"]) and r["total_duration_seconds"] <= 6.0
    assert "timeline truncated to target duration" in r["notes"] and [s["position"] for s in r["segments"]] == list(range(len(r["segments"])))
    context = api.title_contexts(shots, "ran_xiang", subject="she", action="runs").first()
    assert context["target_ids"] == sorted({m["target_id"] for m in api.narrative_response(shots, "linear", "ran_xiang").first()["matches"][:8]})
    with pytest.raises(api.RequestError):
        api.title_contexts(shots, subject="she")


def test_a_file_of_vectors_is_joined_and_held_by_no_worker(spark, tmp_path):
    """Each worker held all vectors of the file (F3)."""
    at = str(tmp_path / "v")
    spark.createDataFrame([("a", [1.0, 0.0]), ("b.jpg", [0.0, 1.0]), ("b.jpg", [0.0, 1.0])], "key string, vector array<float>").write.parquet(at)
    images = spark.createDataFrame([(1, "x/b.jpg"), (2, "b.jpg"), (3, None), (4, "/y/a")], "item_id int, name string")
    df = api.embed_frames(images, EngineConf(embedding_provider=f"file:{at}"))
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["item_id"], r["v"]) for r in df.collect()) == [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0])]
    catalog = providers.catalog_vectors(spark.createDataFrame([("q", "one", "a")], "question string, value string, prompt string"), f"file:{at}")
    assert [tuple(r) for r in catalog.collect()] == [("q", "one", [1.0, 0.0])]
    with pytest.raises(Exception, match="no vector for 'c'"):
        api.embed_frames(images.union(spark.createDataFrame([(5, "x/c")], images.schema)), EngineConf(embedding_provider=f"file:{at}")).collect()
