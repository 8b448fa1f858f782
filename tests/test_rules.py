import copy

import pytest

from lumaflow.functions import books
from lumaflow.functions.rules import RuleBookError, narrative, rule_book
from lumaflow.operators import gate, styles
from lumaflow.schemas import SIGNALS, strict

BASE = dict(video_id="v", shot_cut_rate_per_min=20.0, scene_count=4, mean_motion_intensity=0.5, peak_motion_intensity=0.7, continuous_motion_window_ratio=1.0, audio_mean_volume_db=None, luminance_spike_ratio=0.05, duration_seconds=30.0, width=None, height=None, fps=None)


def signals(spark, *rows):
    return spark.createDataFrame([{**BASE, **r} for r in rows], SIGNALS)


def matched(spark, **changes):
    m = styles.evaluate(signals(spark, changes), books.styles()).orderBy("position").collect()
    return [r["profile_id"] for r in m]


def test_match_and_referral(spark):
    assert matched(spark) == ["ran_xiang"]
    assert matched(spark, continuous_motion_window_ratio=0.3) == ["ran_xiang", "quality_flag"]
    both = styles.referrals(styles.evaluate(signals(spark, {"continuous_motion_window_ratio": 0.3}), books.styles()), books.styles()).collect()
    assert {(r["profile_id"], r["reason"]) for r in both} == {("ran_xiang", "multi_hit_ambiguous"), ("quality_flag", "multi_hit_ambiguous")}
    assert styles.referrals(styles.evaluate(signals(spark, {}), books.styles()), books.styles()).count() == 0


def test_null_signal_is_false(spark):
    assert matched(spark, mean_motion_intensity=None) == []


def test_louder_scores_higher(spark):
    s = styles.evaluate(signals(spark, {"video_id": "a", "audio_mean_volume_db": -15.0}, {"video_id": "b", "audio_mean_volume_db": -30.0}), books.styles()).collect()
    by = {r["video_id"]: r["style_score"] for r in s}
    assert by["a"] > by["b"]


def test_production_needs_calibration(spark):
    with pytest.raises(RuleBookError):
        styles.evaluate(signals(spark, {}), books.styles(), production=True)


@pytest.mark.parametrize(
    "change",
    [
        lambda b: b["profiles"][0]["conditions"]["all"][0].update(signal="nope"),
        lambda b: b["profiles"][0]["conditions"]["all"][0].update(op="eq"),
        lambda b: b["profiles"][0].update(conditions={"all": [{"any": [{"all": [{"signal": "mean_motion_intensity", "op": "gte", "value": 1}]}]}]}),
        lambda b: b["calibration"].update(status="calibrated", sample_count=3),
        lambda b: b["profiles"].append(b["profiles"][0]),
        lambda b: b["profiles"][0]["score_weights"].update(mean_motion_intensity=-1),
        lambda b: b["profiles"][0]["l2_fallback"].update(max_windows=0),
        lambda b: b["profiles"][0].update(other=1),
    ],
)
def test_bad_books(change):
    raw = copy.deepcopy(books.STYLE)
    change(raw)
    with pytest.raises(RuleBookError):
        rule_book(raw)


def test_bad_narratives():
    raw = copy.deepcopy(books.NARRATIVE)
    raw["targets"][0]["conditions"][0]["op"] = "between"
    with pytest.raises(RuleBookError):
        narrative(raw)


def test_gate(spark):
    rows = [("a", "violence", "violence_graphic"), ("b", "violence", "violence_light"), ("c", "violence", "violence_light"), ("c", "violence", "violence_moderate"), ("d", "mystery", "x"), ("e", "violence", None)]
    v = {r["item_id"]: r for r in gate.verdicts(spark.createDataFrame(rows, "item_id string, dimension string, label string"), books.styles().gate).collect()}
    assert [v[k]["verdict"] for k in "abcde"] == ["block", "review", "block", "pass", "pass"]
    assert v["d"]["unknown"] == ["mystery"] and v["c"]["block_hits"] == ["violence=violence_moderate"]


def test_strict_schema(spark):
    with pytest.raises(ValueError):
        strict(spark.createDataFrame([(1,)], "extra int"), SIGNALS)
